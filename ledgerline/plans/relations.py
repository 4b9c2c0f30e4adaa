"""Relational reads: latest rows, anti-joins, pivots, ordered-set aggregates, survivors, ranks, sessions, set operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.relational import asof_join, changed, insert_ignore, latest_by, tagged_union, upsert
from ledgerline.sources.views import MATCHES, PREDICTIONS, QUOTES, RACES, TEAM_ROWS, TICKS, matches, predictions, quotes, races, table, team_rows, ticks

from .registry import query


def r6(c):
    return F.round(c, 6)


@query(f"WITH {TICKS} SELECT a.event_id, b.event_id AS before_id, b.price AS price_before FROM k a ASOF LEFT JOIN (SELECT event_id, key, ts, price FROM k) b ON a.key = b.key AND a.ts > b.ts")
def j6_asof_price(spark, folder):
    """The key's last price strictly before each observation (J5, J6, N11): one merged, sorted sequence for each key, nothing is paired."""
    t = ticks(spark, folder).select("event_id", "key", "ts", "price")
    right = t.select("key", F.col("ts").alias("at"), F.col("event_id").alias("before_id"), F.col("price").alias("price_before"))
    return asof_join(t, right, ["key"], "ts", "at", ["before_id", "price_before"], ties=["before_id"]).select("event_id", "before_id", "price_before")


@query(f"WITH {QUOTES} SELECT match_id, selection, max(odds) AS best, arg_max(book, (odds, -book)) AS best_book, count(*) AS books FROM q GROUP BY match_id, selection")
def w3_best_price(spark, folder):
    """Latest price of each book and selection, then the best with its book (W1, W3): two aggregates, no window sort."""
    return quotes(spark, folder).groupBy("match_id", "selection").agg(F.max("odds").alias("best"), F.max_by("book", F.struct("odds", -F.col("book"))).alias("best_book"), F.count(F.lit(1)).alias("books"))


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 250000)")
def j10_needs_refresh(spark, folder):
    """Rows without a partner of a kind (J10, J11, Q7): an anti-join on a filtered, pruned side."""
    o = table(spark, folder, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000").select("o_custkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned_price FROM supplier")
def j13_scalar_lookups(spark, folder):
    """Correlated counts and averages beside a row (J13, J7): one aggregate joined once instead of a subquery for each."""
    li = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 4).alias("returned_price"))
    s = table(spark, folder, "supplier").select("s_suppkey")
    return s.join(li, s.s_suppkey == li.l_suppkey, "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"), "returned_price")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c.o_custkey, c.o_orderkey AS current_key, p.o_orderkey AS previous_key, round(c.o_totalprice - p.o_totalprice, 4) AS change FROM r c JOIN r p ON c.o_custkey = p.o_custkey AND c.rn = 1 AND p.rn = 2""")
def j17_current_and_previous(spark, folder):
    """The newest row beside the one before it (J17, W1): a limited window and a pivot instead of a self-join."""
    o = latest_by(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)
    x = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")), asc=False)
    o = o.groupBy("o_custkey").agg(x.alias("x")).where(F.size("x") == 2)  # two entries at most
    return o.select("o_custkey", F.col("x")[0]["o_orderkey"].alias("current_key"), F.col("x")[1]["o_orderkey"].alias("previous_key"), F.round(F.col("x")[0]["o_totalprice"] - F.col("x")[1]["o_totalprice"], 4).alias("change"))


@query("""WITH b AS (SELECT o_custkey AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
a AS (SELECT o_custkey AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.total IS DISTINCT FROM b.total THEN 'total' END) END AS columns
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total""")
def j18_change_report(spark, folder):
    """What was added, removed and changed between two snapshots, null-safe."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus", "o_totalprice")
    part = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return changed(part(o.where("o_orderstatus = 'F'")), part(o.where("o_orderstatus in ('F', 'O') and key % 7 <> 0")), ["key"])


@query("""SELECT l_orderkey, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS avg_r, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS max_a, min(l_quantity) FILTER (WHERE l_linestatus = 'O') AS min_o,
 round(stddev_samp(l_discount), 6) AS sd, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount >= 0.05) AS discounted FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2""")
def a9_wide_pivot(spark, folder):
    """Conditional aggregates side by side, with a least group size."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_suppkey")
    when = lambda c, v: F.when(c, F.col(v))
    return li.groupBy("l_orderkey").agg(
        F.round(F.avg(when(F.col("l_returnflag") == "R", "l_extendedprice")), 4).alias("avg_r"), F.max(when(F.col("l_returnflag") == "A", "l_quantity")).alias("max_a"), F.min(when(F.col("l_linestatus") == "O", "l_quantity")).alias("min_o"),
        r6(F.stddev_samp("l_discount")).alias("sd"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") >= 0.05).alias("discounted"), F.count(F.lit(1)).alias("n"),
    ).where("n >= 2").drop("n")


@query("SELECT l_suppkey, round(quantile_cont(l_quantity, 0.5), 6) AS median_quantity, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price FROM lineitem GROUP BY l_suppkey")
def a11_medians(spark, folder):
    """Exact medians and percentiles by key."""
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(r6(F.percentile("l_quantity", 0.5)).alias("median_quantity"), F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90_price"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(*) || ':' || CAST(sum((c_custkey * 2654435761) % 4294967291) AS BIGINT) AS fingerprint FROM customer GROUP BY c_nationkey")
def a14_fingerprint(spark, folder):
    """Distinct values of a small domain as ordered text, and a fingerprint of a group's keys: their number and an order-free sum of hashes, so no group is gathered."""
    mark = F.sum((F.col("c_custkey") * F.lit(2654435761)) % F.lit(4294967291))
    return table(spark, folder, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.concat_ws(":", F.count(F.lit(1)), mark).alias("fingerprint"))


@query(f"""WITH {TEAM_ROWS}, g AS (SELECT avg(gf) AS mean FROM t), x AS (SELECT league_id, team_id, sum(gf) AS s, count(*) AS n FROM t GROUP BY ALL)
SELECT league_id, team_id, round((s + 10 * mean) / (n + 10), 6) AS shrunk, round(s * 1.0 / n, 6) AS raw FROM x CROSS JOIN g""")
def a19_shrunk_means(spark, folder):
    """Group means drawn to the global mean by k = 10 pseudo rows (A7, A8, A19): the global mean comes from the reduced groups."""
    x = team_rows(spark, folder).groupBy("league_id", "team_id").agg(F.sum("gf").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = x.agg((F.sum("s") / F.sum("n")).alias("mean"))  # one row
    return x.crossJoin(F.broadcast(mean)).select("league_id", "team_id", r6((F.col("s") + 10 * F.col("mean")) / (F.col("n") + 10)).alias("shrunk"), r6(F.col("s") / F.col("n")).alias("raw"))


@query("""SELECT p_brand, p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size > 25 DESC, p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) WHERE rn = 1""")
def w2_survivor(spark, folder):
    """The survivor of duplicates by a priority of several keys, booleans first, nulls last."""
    p = table(spark, folder, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice", "p_size")
    return latest_by(p, ["p_brand", "p_type"], [F.desc(F.col("p_size") > 25), F.desc_nulls_last("p_retailprice"), F.col("p_partkey")]).drop("p_size")


@query(f"""WITH {RACES}, r AS (SELECT *, 1 / odds AS p FROM e WHERE NOT scratched)
SELECT race_id, entrant_id, rank() OVER (PARTITION BY race_id ORDER BY p DESC) AS rank_min, row_number() OVER (PARTITION BY race_id ORDER BY p DESC, entrant_id) AS rank_first,
 round(p / sum(p) OVER (PARTITION BY race_id), 6) AS share, round(odds - min(odds) OVER (PARTITION BY race_id), 6) AS gap, round(exp(p / 0.5) / sum(exp(p / 0.5)) OVER (PARTITION BY race_id), 6) AS softmax FROM r""")
def w15_race_ranks(spark, folder):
    """Ranks, normalised shares, gap to the favourite and softmax inside a race (W15, W16, W17, X6, X17): one shuffle and sort for all."""
    e = races(spark, folder).where(~F.col("scratched")).withColumn("p", 1 / F.col("odds"))
    by, w = Window.partitionBy("race_id"), Window.partitionBy("race_id").orderBy(F.desc("p"))
    tempered = F.exp(F.col("p") / 0.5)
    return e.select("race_id", "entrant_id", F.rank().over(w).alias("rank_min"), F.row_number().over(w.orderBy(F.desc("p"), "entrant_id")).alias("rank_first"), r6(F.col("p") / F.sum("p").over(by)).alias("share"), r6(F.col("odds") - F.min("odds").over(by)).alias("gap"), r6(tempered / F.sum(tempered).over(by)).alias("softmax"))


def greedy_sessions(seconds: int):
    """A function of frames sorted by (key, at): numbers groups that close `seconds` after their first row. State is one row, so a key of any size streams through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, number = None, 0, 0
        for f in frames:
            out = []
            for k, at in zip(f["key"].tolist(), f["at"].tolist(), strict=True):
                if k != key:
                    key, start, number = k, at, 1
                elif at - start > seconds:
                    start, number = at, number + 1
                out.append(number)
            yield f[["event_id", "key"]].assign(session=pd.Series(out, index=f.index, dtype="int64"))

    return run


@query(f"""WITH RECURSIVE {TICKS}, o AS (SELECT event_id, key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM k),
g AS (SELECT event_id, key, i, sec AS start, 1::BIGINT AS session FROM o WHERE i = 1 UNION ALL
 SELECT o.event_id, o.key, o.i, CASE WHEN o.sec - g.start > 604800 THEN o.sec ELSE g.start END, g.session + CASE WHEN o.sec - g.start > 604800 THEN 1 ELSE 0 END FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)
SELECT event_id, key, session FROM g""")
def w20_greedy_sessions(spark, folder):
    """Groups that close a week after their first item (W20, R9), unlike gap sessions: a sorted stream with one row of state."""
    t = ticks(spark, folder).select("event_id", "key", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return t.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(greedy_sessions(604_800), "event_id long, key long, session long")


@query(f"WITH {MATCHES} SELECT league_id, count(*) AS teams FROM (SELECT league_id, home_id AS t FROM m UNION SELECT league_id, away_id FROM m) GROUP BY league_id")
def u1_union_count(spark, folder):
    """Distinct ids of both sides of a match (U1, U2, U5): one scan that is exploded, not two that are joined."""
    return matches(spark, folder).select("league_id", F.explode(F.array("home_id", "away_id")).alias("t")).distinct().groupBy("league_id").agg(F.count(F.lit(1)).alias("teams"))


@query("SELECT kind, key, n FROM (SELECT 'customer' AS kind, c_nationkey::BIGINT AS key, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey::BIGINT, count(*) FROM supplier GROUP BY 2) WHERE n > 1")
def u3_tagged_union(spark, folder):
    """UNION ALL over child tables with a tag."""
    part = lambda t, c: table(spark, folder, t).groupBy(F.col(c).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return tagged_union([("customer", part("customer", "c_nationkey")), ("supplier", part("supplier", "s_nationkey"))], "kind").where("n > 1")


@query("""WITH old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.k, new.k) AS k, round(coalesce(new.v, old.v), 4) AS merged, round(coalesce(old.v, new.v), 4) AS ignored FROM old FULL JOIN new ON old.k = new.k""")
def s9_upsert(spark, folder):
    """Upsert and insert-or-ignore as table algebra."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    old, new = c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.col("v") * 2)
    merged = upsert(old, new, ["k"]).select("k", F.round("v", 4).alias("merged"))
    return merged.join(insert_ignore(old, new, ["k"]).select("k", F.round("v", 4).alias("ignored")), "k")


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%_UR%' OR regexp_matches(o_orderpriority, '^[12]-'))
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE (o_totalprice > 100000) IS NOT TRUE) AS not_above, regexp_extract(o_orderpriority, '^([0-9])', 1) AS digit, split_part(o_orderpriority, '-', 2) AS label FROM d WHERE (o_custkey, o_orderkey) IS DISTINCT FROM (1, 1) GROUP BY o_orderpriority""")
def f9_predicates(spark, folder):
    """LIKE, regular expressions, split, three-valued and row comparisons."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    o = o.where((F.col("o_orderpriority").like("%_UR%") | F.col("o_orderpriority").rlike("^[12]-")) & ~(F.col("o_custkey").eqNullSafe(1) & F.col("o_orderkey").eqNullSafe(1)))
    p = F.col("o_orderpriority")
    return o.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("o_totalprice") <= 100000, F.lit(True))).alias("not_above")).select(p, "n", "not_above", F.regexp_extract(p, "^([0-9])", 1).alias("digit"), F.split_part(p, F.lit("-"), F.lit(2)).alias("label"))


@query(f"""WITH {PREDICTIONS}, n AS (SELECT sport, count(*) AS n, count(DISTINCT p) AS different, round(avg(p), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY doc_id DESC) AS rn FROM p) WHERE rn <= 50 GROUP BY sport)
SELECT *, n >= 30 AND different < 5 AS constant_prior FROM n""")
def a13_constant_prior(spark, folder):
    """Too few distinct values among the last 50 of a group."""
    p = latest_by(predictions(spark, folder).select("sport", "doc_id", "p"), ["sport"], [F.desc("doc_id")], 50)
    n = p.groupBy("sport").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("different"), r6(F.avg("p")).alias("mean"))
    return n.withColumn("constant_prior", (F.col("n") >= 30) & (F.col("different") < 5))


@query("SELECT ps_key, price, share FROM (SELECT CASE WHEN rn <= 5 THEN CAST(p_partkey AS VARCHAR) ELSE 'other' END AS ps_key, round(sum(p_retailprice), 4) AS price, round(sum(p_retailprice) / any_value(total), 6) AS share FROM (SELECT p_partkey, p_retailprice, sum(p_retailprice) OVER () AS total, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) GROUP BY 1)")
def t5_top_and_other(spark, folder):
    """The top five and the remainder as `other` (T2, T5, W6): a top-k and one total, no global window."""
    p = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    top = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)
    total = p.agg(F.sum("p_retailprice").alias("total"))
    best = top.crossJoin(total).select(F.col("p_partkey").cast("string").alias("ps_key"), F.round("p_retailprice", 4).alias("price"), r6(F.col("p_retailprice") / F.col("total")).alias("share"))
    rest = p.join(F.broadcast(top), "p_partkey", "left_anti").agg(F.sum("p_retailprice").alias("s")).crossJoin(total).where("s is not null")
    return best.unionByName(rest.select(F.lit("other").alias("ps_key"), F.round("s", 4).alias("price"), r6(F.col("s") / F.col("total")).alias("share")))
