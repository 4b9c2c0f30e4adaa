"""Ingest, identity and quality: change logs, current prices, late data, as-of states, screening, names, JSON, orphans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators.relational import latest_by
from ledgerline.sources.views import MATCHES, TICKS, matches, table, ticks
from ledgerline.streaming.ticks import streamed_rates

from .registry import query
from .relations import greedy_sessions


def r6(c):
    return F.round(c, 6)


_LOG = f"{TICKS}, x AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY ts, event_id) AS last FROM k)"


def change_log(t):
    """Those ticks whose price differs from the key's one before."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    return t.withColumn("last", F.lag("price").over(w)).where(~F.col("price").eqNullSafe(F.col("last")))


@query(f"WITH {_LOG} SELECT event_id, key, price, last FROM x WHERE price IS DISTINCT FROM last")
def r1_change_log(spark, folder):
    """A tick is kept only if its price differs from the key's latest."""
    return change_log(ticks(spark, folder).select("event_id", "key", "ts", "price")).select("event_id", "key", "price", "last")


@query(f"""WITH {_LOG}, l AS (SELECT key, max(ts) AS seen, arg_max(price, (ts, event_id)) AS price FROM x GROUP BY key), c AS (SELECT key, max(ts) AS moved FROM x WHERE price IS DISTINCT FROM last GROUP BY key)
SELECT l.key, price, epoch_us(moved) AS moved_us, epoch_us(seen) AS seen_us, date_diff('second', seen, TIMESTAMP '2024-01-30 12:00:00') > 21600 AS stale FROM l JOIN c ON l.key = c.key""")
def r2_current_price(spark, folder):
    """Current price with both clocks: a move stamps both, a repeat only the last sight; stale after 6 hours."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    t = ticks(spark, folder).select("event_id", "key", "ts", "price").withColumn("last", F.lag("price").over(w))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    x = t.groupBy("key").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max(F.when(~F.col("price").eqNullSafe(F.col("last")), F.col("ts"))).alias("moved"), F.max("ts").alias("seen"))
    return x.select("key", "price", us(F.col("moved")).alias("moved_us"), us(F.col("seen")).alias("seen_us"), (F.lit(1706616000) - F.unix_seconds(F.col("seen").cast("timestamp")) > 21600).alias("stale"))


@query(f"""WITH {TICKS}, c AS (SELECT key, min(ts) + INTERVAL 20 DAY AS cutoff FROM k GROUP BY key)
SELECT k.key, count(*) FILTER (WHERE ts < cutoff) AS in_time, count(*) FILTER (WHERE ts >= cutoff) AS late, arg_max(price, (ts, event_id)) FILTER (WHERE ts < cutoff) AS price FROM k JOIN c ON k.key = c.key GROUP BY k.key""")
def r3_late_data(spark, folder):
    """Observations at or after a key's cut-off never change its state."""
    t = ticks(spark, folder).select("event_id", "key", "ts", "price")
    cut = t.groupBy("key").agg((F.min("ts") + F.expr("interval 20 days")).alias("cutoff"))
    ok = F.col("ts") < F.col("cutoff")
    return t.join(cut, "key").groupBy("key").agg(F.count_if(ok).alias("in_time"), F.count_if(~ok).alias("late"), F.max_by(F.when(ok, F.col("price")), F.when(ok, F.struct("ts", "event_id"))).alias("price"))


@query(f"WITH {_LOG} SELECT key, arg_max(price, (ts, event_id)) AS price, count(*) AS changes FROM x WHERE price IS DISTINCT FROM last AND ts <= TIMESTAMP '2024-01-15' GROUP BY key")
def n8_state_at(spark, folder):
    """The state of every quote at an instant, from its change log."""
    log = change_log(ticks(spark, folder).select("event_id", "key", "ts", "price")).where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    return log.groupBy("key").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.count(F.lit(1)).alias("changes"))


@query(f"""WITH {TICKS}, w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS d, price FROM k) SELECT event_type, epoch(d)::BIGINT AS day, count(*) AS n, round(avg(price), 6) AS mean FROM w WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM k) - INTERVAL 1 DAY GROUP BY ALL""")
def r8_streamed_rates(spark, folder):
    """Daily counts and means by type from a stream with a watermark of a day (R8): Structured Streaming in append mode, the days that are closed after one run over what is there."""
    return streamed_rates(spark, folder).select("event_type", "day", "n", r6("mean").alias("mean"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_totalprice IS NULL THEN 'missing_price' WHEN o_totalprice < 1000 THEN 'price_low' WHEN o_totalprice > 200000 THEN 'price_high' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'not_listed' ELSE 'ok' END AS reason FROM orders) GROUP BY reason""")
def q1_screening(spark, folder):
    """Rows with the first rule that rejects them (Q1, Q3)."""
    p = F.col("o_totalprice")
    reason = F.when(p.isNull(), "missing_price").when(p < 1000, "price_low").when(p > 200000, "price_high").when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "not_listed").otherwise("ok")
    return table(spark, folder, "orders").select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'lineitem.orders' AS reference, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'labels.documents', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def q7_orphans(spark, folder):
    """Rows whose foreign key has no partner, over every reference (Q7): anti-joins on key columns only."""
    from functools import reduce

    def orphans(child, key, parent, own):
        c, p = table(spark, folder, child).select(key), table(spark, folder, parent).select(F.col(own).alias("_own"))
        return c.join(p, F.col(key) == F.col("_own"), "left_anti").agg(F.lit(f"{child}.{parent}").alias("reference"), F.count(F.lit(1)).alias("orphans"))

    return reduce(lambda a, b: a.unionByName(b), [orphans("lineitem", "l_orderkey", "orders", "o_orderkey"), orphans("lineitem", "l_partkey", "part", "p_partkey"), orphans("orders", "o_custkey", "customer", "c_custkey"), orphans("labels", "doc_id", "documents", "doc_id")])


@query("""WITH k AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '\\b(fc|cf|sc|ac|afc|club|the|de)\\b', '', 'g')) AS key FROM part)
SELECT key, count(*) AS n, min(p_partkey) AS first_key FROM k GROUP BY key HAVING count(*) > 1""")
def q6_alias_index(spark, folder):
    """Normalised names claimed by several rows resolve to none."""
    k = table(spark, folder, "part").select("p_partkey", names.club_key(F.col("p_name")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("""SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS max_k FROM events GROUP BY event_type""")
def x33_json_numbers(spark, folder):
    """Numeric members of JSON objects as features."""
    e = table(spark, folder, "events").select("event_type", names.flat_numbers(F.col("props"))["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("k")).alias("mean_k"), F.max("k").alias("max_k"))


@query(f"""WITH RECURSIVE {TICKS}, o AS (SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM k),
g AS (SELECT key, i, sec AS sent, 1::BIGINT AS alerts FROM o WHERE i = 1 UNION ALL
 SELECT o.key, o.i, CASE WHEN o.sec - g.sent > 82800 THEN o.sec ELSE g.sent END, g.alerts + CASE WHEN o.sec - g.sent > 82800 THEN 1 ELSE 0 END FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)
SELECT key, max(alerts) AS alerts, count(*) AS rows FROM g GROUP BY key""")
def r6_alert_dedup(spark, folder):
    """Alerts sent where those within 23 hours of the last one sent are held back (R6): a sorted stream with the last sending as its state."""
    t = ticks(spark, folder).select("event_id", "key", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    sent = t.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(greedy_sessions(82_800), "event_id long, key long, session long")
    return sent.groupBy("key").agg(F.max("session").alias("alerts"), F.count(F.lit(1)).alias("rows"))


@query("""WITH c AS (SELECT l_orderkey AS target, l_partkey AS child, l_shipdate, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_orderkey AS target FROM lineitem WHERE l_returnflag = 'A')
SELECT target, child FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY l_shipdate DESC, child DESC) AS rn FROM c WHERE target NOT IN (SELECT target FROM h)) WHERE rn = 1""")
def n20_repointing(spark, folder):
    """The latest child for each target that has none yet."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("child"), "l_shipdate", "l_returnflag")
    c = li.where("l_returnflag = 'R'").join(li.where("l_returnflag = 'A'").select("target"), "target", "left_anti")
    return latest_by(c.select("target", "child", "l_shipdate"), ["target"], [F.desc("l_shipdate"), F.desc("child")]).select("target", "child")
