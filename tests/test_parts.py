"""Column functions, table operators and streams on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import grading, names, prices
from ledgerline.operators.relational import asof_join, changed, insert_ignore, latest_by, optional, split_by_order, unique, upsert
from ledgerline.plans.details import default_rate_level
from ledgerline.plans.markets import mass, score_grid
from ledgerline.plans.relations import greedy_sessions
from ledgerline.streaming.ticks import event_stream, finished, streamed_moves, windowed


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_margin_removal(spark):
    odds = F.array(*map(F.lit, (2.1, 3.4, 3.9)))
    for f in (prices.devig_proportional, prices.devig_power, prices.devig_shin):
        p = one(spark, f(odds))[0]
        assert sum(p) == pytest.approx(1) and p == sorted(p, reverse=True)
    assert one(spark, prices.devig_proportional(F.array(F.lit(0.0), F.lit(3.0))))[0] is None


def test_prices(spark):
    lit = F.lit
    got = one(spark, prices.kelly(lit(0.5), lit(2.2)), prices.kelly(lit(0.1), lit(2.0)), prices.capped_stake(lit(99.0), 1000.0), prices.american_to_decimal(lit(-150)), prices.decimal_to_american(lit(1.5)), prices.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), prices.poisson(lit(2), lit(0.0)))
    assert got[0] == pytest.approx(0.1 / 1.2) and got[1] == 0 and got[2] == 25.0 and got[3] == 1.67 and got[4] == -200 and got[5] == pytest.approx(111.19, abs=0.01) and got[6] == 0


def test_quarter_lines(spark):
    margins = [(m, line, u) for m, line, u in [(0, -0.25, -0.5), (1, -0.75, 0.5), (1, -1.0, 0.0), (2, -1.0, 1.0), (0, 0.75, 1.0), (-1, 0.75, -0.5)]]
    d = spark.createDataFrame(margins, "m int, line double, want double")
    assert all(r.got == r.want for r in d.withColumn("got", grading.handicap_units(F.col("m"), F.col("line"))).collect())


def test_score_grid(spark):
    g = score_grid(F.lit(1.5), F.lit(1.1), -0.13)
    r = one(spark, mass(g, lambda i, j: F.lit(True)), F.array_min(F.transform(g, lambda x: x["p"])), mass(score_grid(F.lit(1.5), F.lit(1.1)), lambda i, j: (i == 1) & (j == 1)))
    assert r[0] == pytest.approx(1) and r[1] >= 0 and r[2] == pytest.approx(0.33470 * 0.36616, rel=1e-3)


def test_names(spark):
    pairs = [("FC Köln", "Koln", 1.0), ("Manchester United", "MU", 0.95), ("Real Sociedad", "Sociedad", 0.9), ("abcd", "wxyz", 0.0)]
    d = spark.createDataFrame(pairs, "a string, b string, want double").withColumn("got", names.name_tier(F.col("a"), F.col("b")))
    assert all(r.got == pytest.approx(r.want) for r in d.collect())
    bad = "Atlético".encode().decode("latin-1")
    assert [r[0] for r in spark.createDataFrame([(bad,), ("Köln",), ("plain",)], "t string").select(names.repaired(F.col("t"))).collect()] == ["Atlético", "Köln", "plain"]
    assert one(spark, names.flat_numbers(F.lit('{"a": 1.5, "b": true, "c": "x", "d": "NaN"}')))[0] == {"a": 1.5, "b": 1.0}


def test_asof_join_is_strict_and_breaks_ties(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 11), (3, "j", 5)], "id long, key string, t long")
    right = spark.createDataFrame([("k", 10, "a", 1), ("k", 9, "b", 1), ("k", 10, "c", 2)], "key string, at long, v string, n long")
    out = lambda strict: {r.id: r.v for r in asof_join(left, right, ["key"], "t", "at", ["v"], strict=strict, ties=["n"]).collect()}
    assert out(True) == {1: "b", 2: "c", 3: None} and out(False) == {1: "c", 2: "c", 3: None}


def test_table_operators(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(changed(old, new, ["k"])) == [(1, "removed", None), (2, "changed", "v"), (3, "added", None)]
    assert rows(optional(old, k=None, v="a")) == [(1, "a")]
    assert rows(latest_by(old, ["v"], [F.desc("k")])) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        unique(old.unionByName(old), ["k"])
    parts = split_by_order(spark.range(10), ["id"], [0.6, 0.2, 0.2])
    assert [r.part for r in parts.orderBy("id").collect()] == [0] * 6 + [1] * 2 + [2] * 2


def test_greedy_sessions_count_from_the_first_row(spark):
    d = spark.createDataFrame([(i, 1, at) for i, at in enumerate((0, 5, 10, 11, 12, 30))], "event_id long, key long, at long")
    out = d.repartition("key").sortWithinPartitions("key", "at").mapInPandas(greedy_sessions(10), "event_id long, key long, session long")
    assert [r.session for r in out.orderBy("event_id").collect()] == [1, 1, 1, 2, 2, 3]


def test_streamed_moves_are_the_batch_change_log(spark, sf):
    from ledgerline.plans.ingest import change_log
    from ledgerline.sources.views import ticks

    got = {r.event_id for r in finished(streamed_moves(event_stream(spark, sf)), "append").collect()}
    assert got == {r.event_id for r in change_log(ticks(spark, sf)).collect()}


def test_a_window_is_written_once_and_late_rows_are_left_out(spark, tmp_path):
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    batches = [[(1, at(1, 3), 1.0), (2, at(1, 9), 3.0), (3, at(4, 1), 5.0)], [(4, at(3, 5), 7.0)], [(5, at(1, 12), 100.0), (6, at(9, 1), 1.0)]]
    for i, rows in enumerate(batches):  # in the order of the files' times
        d = spark.createDataFrame(rows, "event_id long, ts string, price double").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "price", F.lit("x").alias("event_type"))
        d.coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for f in (tmp_path / str(i)).glob("*.parquet"):
            target = tmp_path / f"in-{i}.parquet"
            f.rename(target)
            os.utime(target, (1_700_000_000 + i * 3600,) * 2)
    stream = spark.readStream.schema(d.schema).option("pathGlobFilter", "in-*").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = sorted((r.day // 86400 - 19723, r.n, r["mean"]) for r in finished(windowed(stream), "append").collect())
    assert got == [(0, 2, 2.0), (2, 1, 7.0), (3, 1, 5.0)]


def test_default_rate_levels(spark):
    rows = [(14, 14, 99, 0, None), (20, 18, 14, 0, "warn"), (20, 17, 0, 0, None), (20, 10, 20, 5, "alert"), (20, 9, 20, 0, None), (20, 18, 20, 18, "warn"), (20, 15, 20, 11, None)]
    d = spark.createDataFrame(rows, "n_recent long, d_recent long, n_base long, d_base long, want string")
    assert [(r.got, r.want) for r in d.withColumn("got", default_rate_level()).collect()] == [(r[4], r[4]) for r in rows]


def test_margins_with_odds_of_one_or_less(spark):
    from ledgerline.functions import prices

    df = spark.createDataFrame([(1, [1.0, 4.0]), (2, [0.0, 2.0]), (3, [2.0, 2.0])], "id int, o array<double>")
    got = {r.id: (r.a, r.b) for r in df.select("id", prices.devig_proportional(F.col("o")).alias("a"), prices.devig_power(F.col("o")).alias("b")).collect()}
    assert got[1][0] == got[1][1] == pytest.approx([0.8, 0.2]) and got[2] == (None, None) and got[3][1] == pytest.approx([0.5, 0.5])


def test_bytes_of_feeds(spark):
    from ledgerline.sources.files import decoded

    raw = [(1, "é".encode()), (2, b"\xef\xbb\xbfa"), (3, b"\x80\x9f\xe9"), (4, b"")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in raw], "id int, raw binary")
    got = {r.id: tuple(r.d) for r in df.select("id", decoded(F.col("raw"), F.lit("feed.csv")).alias("d")).collect()}
    assert got == {1: ("é", "utf-8"), 2: ("a", "utf-8"), 3: ("€Ÿé", "cp1252"), 4: ("", "utf-8")}
    bad = spark.createDataFrame([(bytearray(b"\x81\xe9"),)], "raw binary")
    with pytest.raises(Exception, match="feed.csv: neither"):
        bad.select(decoded(F.col("raw"), F.lit("feed.csv")).alias("d")).collect()


def test_exports_are_written_once(spark, tmp_path):
    from ledgerline.sources.files import ragged_csv, write_once

    write_once(spark.range(3), f"{tmp_path}/a")
    with pytest.raises(Exception, match="(?i)exist"):
        write_once(spark.range(5), f"{tmp_path}/a")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/a").count() == 3
    (tmp_path / "r.csv").write_text("a,b\n1,x\n2,y,z\n3\n4,p,q,r,s\n")
    assert sorted(map(tuple, ragged_csv(spark, f"{tmp_path}/r.csv", "a int, b string").collect())) == [(1, "x"), (3, None)]


def test_cache_expires_at_its_moment_and_by_version(spark):
    from ledgerline.sources.files import through_cache

    cache = spark.createDataFrame([(1, 10, "v2", 100), (2, 20, "v2", 50), (3, 30, "v1", 100)], "key int, n int, version string, expires_at int")
    seen = []
    compute = lambda rows: seen.append(sorted(r.key for r in rows.collect())) or rows.withColumn("n", F.lit(0))
    got = through_cache(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "key int"), cache, ["key"], "v2", F.lit(50), compute)
    assert sorted(map(tuple, got.select("key", "n", "cached").collect())) == [(1, 10, True), (2, 0, False), (3, 0, False), (4, 0, False)] and seen == [[2, 3, 4]]


def test_blend_weights_have_a_floor():
    from ledgerline.plans.decisions import floored

    w = floored([0.0, 0.0, -20.0])
    assert sum(w) == pytest.approx(1) and w[2] == pytest.approx(0.05 / 1.05)
