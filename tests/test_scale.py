"""How queries grow: what their plans join, shuffle and sort, and that faster ways give what the plain ones do."""

import datetime
import decimal
import inspect
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import catalog, grids, identity, prices
from ledgerline.operators import matching
from ledgerline.plans import registry
from ledgerline.sources import work

registry.load()


def plan_of(spark, sf, name):
    text = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)


RATES = [(1, 1.5, 1.2, 0.55), (2, 0.5, 2.8, 0.36), (3, 2.2, 2.2, 0.5), (4, 0.0, 1.1, 0.5), (5, 2.9, 0.4, 0.65)]


def test_hockey_catalog_is_that_of_the_cells_without_a_join(spark, sf):
    assert "Join" not in plan_of(spark, sf, "d27_hockey_catalog")
    size, rates = 10, spark.createDataFrame([r for r in RATES if r[1]], "match_id long, home double, away double, target double")
    regulation = lambda h, a, t: grids.tilted(grids.scores(h, a, size), t, size)
    parts = [(catalog.HOCKEY_REGULATION, regulation), (catalog.HOCKEY_FINAL, lambda h, a, t: grids.after_overtime(regulation(h, a, t), size, 0.52))]
    got = {tuple(r[:3]): r.prob for r in grids.priced(rates, "match_id", [F.col(c) for c in ("home", "away", "target")], size, parts).collect()}
    tilted = catalog.margin_tilt(catalog.cells(rates, size), ["match_id"], F.col("target")).drop("theta")
    final = catalog.overtime(tilted, ["match_id"], size, F.lit(0.52)).groupBy("match_id", "i", "j").agg(F.sum("p").alias("p"))
    plain = catalog.prices(tilted, ["match_id"], catalog.HOCKEY_REGULATION).unionByName(catalog.prices(final, ["match_id"], catalog.HOCKEY_FINAL)).unionByName(catalog.top_scores(final, ["match_id"]))
    want = {tuple(r[:3]): r.prob for r in plain.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_soccer_catalog_is_that_of_the_cells_without_an_aggregate(spark, sf):
    assert "HashAggregate" not in plan_of(spark, sf, "d25_soccer_catalog")
    size, rates = 10, spark.createDataFrame([*[r[:3] for r in RATES], (6, None, 1.0)], "match_id long, home double, away double")
    got = {tuple(r[:3]): r.prob for r in grids.priced(rates, "match_id", [F.col("home"), F.col("away")], size, [(catalog.SOCCER, lambda h, a: grids.scores(h, a, size))]).collect()}
    g = catalog.cells(rates.where("home is not null"), size)
    want = {tuple(r[:3]): r.prob for r in catalog.prices(g, ["match_id"], catalog.SOCCER).unionByName(catalog.top_scores(g, ["match_id"])).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {k for k in got if k[0] != 6} == want.keys() and all(v is None for k, v in got.items() if k[0] == 6 and k[1] != "correct_score")


def test_shin_shares_in_few_steps(spark):
    assert inspect.signature(prices.devig_shin).parameters["steps"].default <= 10
    odds = [[1.5, 2.4], [1.01, 1.02], [6.0, 6.0], [1.2, 9.0, 30.0], [2.0, 2.0], [1.0001, 500.0], [3.1, 3.2, 2.4, 12.0, 50.0]]
    for r in spark.createDataFrame([(o,) for o in odds], "o array<double>").select("o", prices.devig_shin(F.col("o")).alias("p")).collect():
        raw = [1 / x for x in r.o]
        book, lo, hi = sum(raw), 0.0, 0.5
        fair = lambda z: [(math.sqrt(z * z + 4 * (1 - z) * p * p / book) - z) / (2 * (1 - z)) for p in raw]  # noqa: B023, E731
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(fair(mid)) > 1 else (lo, mid)
        assert r.p == pytest.approx(fair((lo + hi) / 2), abs=1e-9)


def test_proportional_fitting_runs_by_batches(spark, sf):
    assert "ArrowEvalPython" in plan_of(spark, sf, "d24_fitted_marginals")
    df = spark.createDataFrame([(0.2, 0.25), (0.1, None)], "x double, v double")
    cols = [F.col("x"), *[F.lit(v) for v in (0.2, 0.1, 0.1, 0.15, 0.25)]]
    whole, none = df.select(grids.proportional(cols, [F.lit(0.5), F.lit(0.2), F.lit(0.3)], F.coalesce("v", F.lit(None).cast("double")), 100).alias("f")).collect()
    assert [whole.f[0] + whole.f[1], whole.f[2] + whole.f[3], whole.f[1] + whole.f[3] + whole.f[5]] == pytest.approx([0.5, 0.2, 0.25])
    assert all(v is None or math.isnan(v) for v in none.f)


@pytest.mark.parametrize("name", ["d44_settled_bets", "d43_graded_markets"])
def test_equal_scores_are_graded_once(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "HashAggregate" in plan[plan.index("Generate") :]


def test_near_fixtures_shuffle_matches_and_no_pairs(spark, sf):
    plan = plan_of(spark, sf, "n22_near_fixtures")
    assert "Aggregate" not in plan and plan.count("SortMergeJoin") == 3


def test_race_grading_deals_and_sorts_once(spark, sf):
    plan = plan_of(spark, sf, "d47_race_grading")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_parts_grow_with_the_rows(spark):
    assert work.dealt(spark.range(1000), "id", 100).rdd.getNumPartitions() == 11


def test_clubs_are_resolved_without_a_broadcast(spark, sf):
    assert "Broadcast" not in plan_of(spark, sf, "q5_resolve_clubs")


def test_spellings_are_resolved_without_a_broadcast(spark, sf):
    assert "Broadcast" not in plan_of(spark, sf, "x27_spellings")


def test_names_of_events_and_games_are_compared_once(spark):
    rows = lambda a: spark.createDataFrame([(s, n) for s in "uv" for n in ("red lions", "blue lines") for _ in range(5)], f"snapshot string, {a} string")
    got = matching._likely_names(rows("eh"), rows("gh"), "eh", "gh", 0.8).collect()
    assert sorted((r.x, r.y, r.r) for r in got) == [("blue lines", "blue lines", 1.0), ("red lions", "red lions", 1.0)]


def test_names_are_compared_after_the_distinct(spark):
    """A filter on the ratio was moved below the distinct and the shuffle, so that every row was compared."""
    pairs = spark.range(8).select(F.lit("a").alias("x"), F.col("id").cast("string").alias("y")).distinct()
    plan = work.spread(pairs).select("x", identity.block_ratio(F.col("x"), F.col("y")).alias("r")).where("r > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange") < plan.index("HashAggregate")


def test_a_longer_queue_takes_no_more_jobs(spark):
    """Events that all want the same games were settled by rounds, some jobs each."""

    def jobs(n):
        at = "timestamp '2024-01-01 12:00:00'"
        rows = lambda key, time, home: spark.range(n).selectExpr(f"id AS {key}", "'s' AS snapshot", f"{at} AS {time}", f"'{home}' AS home", "'blue lines' AS away")
        spark.sparkContext.setJobGroup(f"queue-{n}", "queue")
        got = matching.assign_events(rows("event_id", "commence", "red lion"), rows("match_id", "starts", "red lions"), spark.sql(f"SELECT 's' AS snapshot, {at} - INTERVAL 1 HOUR AS taken_at")).collect()
        spark.sparkContext.setJobGroup("", "")
        assert sorted((r.event_id, r.match_id, r.how) for r in got) == [(i, i, "fuzzy") for i in range(n)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"queue-{n}"))

    assert jobs(40) <= jobs(2) + 5


def test_market_odds_round_as_their_sql(spark, tmp_path):
    """A ratio of 0.7865624999999999 is 786562.5 when scaled; the SQL of this match has one result, whatever the order of its sums."""
    quotes = [(3, 84), (2, 809), (2, 541), (0, 682), (3, 254), (1, 808), (4, 579), (2, 243), (1, 411), (1, 437), (1, 550)]
    spark.createDataFrame([(1, s, p, datetime.datetime(2000, 1, 1 + i)) for i, (s, p) in enumerate(quotes)], "l_orderkey long, l_suppkey long, l_partkey long, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.ORACLE["d5_market_odds"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["d5_market_odds"](spark, str(tmp_path)).collect()] == [tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r) for r in want]


def test_market_odds_have_one_order_of_sums(spark, tmp_path):
    """Means no longer depend on how the quotes are dealt over files and tasks."""
    rows = [(m, s, (m * 7 + s * 311) // 3 % 300 * 3, datetime.datetime(2000, 1, 1 + (m + s) % 28)) for m in range(400) for s in range(6)]
    quotes = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_shipdate timestamp").unionByName(spark.createDataFrame([(m, s, p + 2, t) for m, s, p, t in rows], "l_orderkey long, l_suppkey long, l_partkey long, l_shipdate timestamp"))
    got = []
    for name, order in (("up", "l_suppkey"), ("down", "-l_suppkey")):
        quotes.repartition(3, "l_suppkey").sortWithinPartitions(F.expr(order)).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        plan = registry.QUERIES["d5_market_odds"](spark, f"{tmp_path}/{name}")
        assert "avg(" not in plan._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted(map(tuple, plan.collect()), key=lambda r: r[0]))
    assert got[0] == got[1]


def test_near_fixtures_are_written_in_few_bytes(spark, tmp_path):
    """A match's pairs come in one run; in the order of the former join a pair of these took nearly two."""
    orders = [(i * 7919 % 20011, 50 * (i % 83) + i % 3, datetime.datetime(2000, 1, 1 + i % 4)) for i in range(1500)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").withColumn("o_orderstatus", F.lit("F")).repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    registry.QUERIES["n22_near_fixtures"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE["n22_near_fixtures"]).fetchall())
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < len(want)
