"""Files in and out, and cached features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.sources.files import feed_lines, ragged_csv, through_cache, write_once
from ledgerline.sources.views import table
from ledgerline.streaming.ticks import shared

from .registry import query

AS_OF = "1998-06-15"


@query("SELECT n_nationkey, n_name || ' é' || CASE WHEN n_nationkey % 2 = 1 THEN '€' ELSE '' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'utf-8' ELSE 'cp1252' END AS encoding FROM nation")
def s3_feed_encodings(spark, folder):
    """Feeds in UTF-8 with a byte-order mark, else Windows-1252 (S3): written to the shared folder in both, read as whole small files."""
    n, path = table(spark, folder, "nation").select("n_nationkey", "n_name"), shared(spark)
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(" é")))
    for even, codec in ((True, "UTF-8"), (False, "ISO-8859-1")):
        # Latin-1 writes U+0080 as the byte that Windows-1252 reads as the euro sign.
        text = F.concat(F.when(F.col("n_nationkey") == 0, F.lit("\ufeff")).otherwise(""), line) if even else F.concat(line, F.lit("\x80"))
        n.where((F.col("n_nationkey") % 2 == 0) == even).coalesce(1).sortWithinPartitions("n_nationkey").select(text.alias("value")).write.option("encoding", codec).option("quote", "\u0000").option("delimiter", "|").csv(f"{path}/{codec}")
    parts = F.split("line", ";")
    return feed_lines(spark, path).select(parts[0].cast("int").alias("n_nationkey"), parts[1].alias("name"), "encoding")


@query("SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0")
def s2_ragged_csv(spark, folder):
    """CSV whose lines have too many fields (skipped) or too few (null at the end) (S2, and S1's CSV path)."""
    p, path = table(spark, folder, "part"), shared(spark)
    tail = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(","), F.col("p_size").cast("string"), F.lit(",x"))).when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(","), F.col("p_size").cast("string")))
    lines = p.select(F.concat(F.col("p_partkey").cast("string"), F.lit(","), "p_brand", tail).alias("value"))
    lines.write.text(path)
    return ragged_csv(spark, path, "p_partkey long, p_brand string, p_size int", header=False)


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}'")
def s11_audit_export(spark, folder):
    """The rows of a query as a CSV export that is written once and never over another (S11, S12), and its rows read back."""
    path = shared(spark)
    write_once(table(spark, folder, "orders").where(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp")).select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").option("header", "true").csv(path)


@query(f"""WITH f AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT o_custkey AS key, n * 10 AS n, CASE WHEN o_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS version, TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR + INTERVAL 1 HOUR * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 24 END AS expires_at FROM (SELECT key AS o_custkey, n FROM f WHERE key % 4 <> 1))
SELECT f.key, CASE WHEN c.key IS NULL THEN f.n ELSE c.n END AS n, c.key IS NOT NULL AS cached FROM f LEFT JOIN c ON c.key = f.key AND version = 'v2' AND expires_at > TIMESTAMP '{AS_OF}'""")
def r7_feature_cache(spark, folder):
    """Features through a Parquet cache (R7, S14): rows of another version or past their hour or day are computed again, the others are taken as they lie. Stand-ins: cached counts are ten times the real ones, so that the source of a row shows."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"))
    count = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    now, path = F.lit(AS_OF).cast("timestamp"), shared(spark)
    ttl = F.make_dt_interval(hours=F.when(F.col("key") % 2 == 0, 1).otherwise(24))
    old = count(o.where("key % 4 != 1")).select("key", (F.col("n") * 10).alias("n"), F.when(F.col("key") % 3 == 0, "v1").otherwise("v2").alias("version"), (now - F.expr("INTERVAL 2 HOURS") + ttl).alias("expires_at"))
    old.write.partitionBy("version").parquet(path)
    return through_cache(o.distinct(), spark.read.parquet(path), ["key"], "v2", now, lambda missing: count(o.join(missing, "key", "left_semi")))
