"""Mixing sources to target weights, with DataFrame operations only.

Every document has a hash-random key (md5 of its doc_id); documents are range-sorted by key within their source, word
counts are summed to prefix sums in two levels (totals of key ranges first, then inside each range, so that no source is
ever in one task), and the sorted sequence is cut where the source's target is reached. A target above the source's size
takes whole epochs first and cuts the last one; the document that crosses the cut is taken if its middle lies before it.

Cases: null source is a source of its own and sorts last; null, empty and blank texts have size 0 and are taken 0 times a
word; rows with a null doc_id get their key from their text; rows that repeat a doc_id are mixed row by row; an empty
table gives no rows. Only a text's number of words counts, whatever its length. Extra columns are ignored by the query and
kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source and its target in words: weights are shared out by source order, no target exceeds most times its source's size.

    With caps c and weights w, the fixed point of capping and resharing is min(w * level, c); sources leave in the order of
    c / w, so the level is the first of total-left / weight-left that does not exceed the ratio of the source it stops at.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))).over(whole)["level"]
    return rows.withColumn("target", F.least(F.col("w") * level, F.col("cap"))).select("source", "source_size", "target")


def mixed(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, keys, size, source_size, target, taken, times for each row of docs (doc_id, text, source and keys)."""
    sized = docs.select(
        "doc_id", *keys, "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("")))).alias("key"),
    )
    sized = stored(sized.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sized")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("words").over(order), F.lit(0))).drop("words")
    ranges = ranges.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "range", "base", "source_size", "target")
    rows = sized.alias("s").join(ranges.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("s.range") == F.col("r.range"))).select("s.*", "base", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    rows = rows.withColumn("times", (epochs + F.when((F.col("size") > 0) & (start + F.col("size") / 2 <= rest), 1).otherwise(0)).cast("long"))
    return rows.select("doc_id", *keys, "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words with weights 5, 2, 1 by source and at most two epochs."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("times")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, least(w * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), cap) AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
j AS (SELECT p.doc_id, p.size, p.start, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
      FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND start + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every row as often as the mix takes it: 0, 1 or 2 times. Rows without words are not taken.

    Rows are numbered and stored first, so that rows that repeat a doc_id, or have none, are taken one by one.
    """
    row = free_name([*docs.columns, "size", "source_size", "target", "taken", "times", "key", "range", "base"], "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    times = mixed(numbered.select("doc_id", "text", "source", row), row).where("times > 0").select(row, F.expr("sequence(1, cast(times as int))").alias("_times"))
    rows = numbered.join(times.withColumnRenamed("_times", f"{row}_times"), row)
    return rows.withColumn(f"{row}_copy", F.explode(f"{row}_times")).select(docs.columns)
