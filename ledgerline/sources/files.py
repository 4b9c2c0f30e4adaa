"""Files of feeds: texts in two encodings, ragged CSV, write-once exports, and a cache of computed rows with versions and expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What Windows-1252 has at 0x80 to 0x9F; 81, 8D, 8F, 90 and 9D are not defined.
C1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


def decoded(raw: Column, source: Column) -> Column:
    """(text, encoding) of bytes: UTF-8 with or without a mark at the start, else Windows-1252; bytes that neither reads stop the job with the source's name."""
    bare = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, 4, 2_147_483_647)).otherwise(raw)
    utf8, latin = bare.cast("string"), F.decode(raw, "ISO-8859-1")
    wrong = F.raise_error(F.concat(source, F.lit(": neither UTF-8 nor Windows-1252")))
    western = F.when(latin.rlike(UNDEFINED), wrong).otherwise(F.translate(latin, C1, CP1252))
    valid = F.is_valid_utf8(utf8)
    return F.struct(F.when(valid, utf8).otherwise(western).alias("text"), F.when(valid, "utf-8").otherwise("cp1252").alias("encoding"))


def feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, line) of every line that holds something, of files small enough for one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = files.select("path", decoded(F.col("content"), F.col("path")).alias("d"))
    return x.select("path", "d.encoding", F.explode(F.split("d.text", "\r?\n")).alias("line")).where("line != ''")


def ragged_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of CSV files; lines with more fields than the schema are skipped, missing fields at the end are null."""
    rows = spark.read.schema(f"{schema}, more_ string").option("header", header).option("enforceSchema", "true").csv(path)
    return rows.where("more_ is null").drop("more_")


def write_once(df: DataFrame, path: str) -> None:
    """CSV with a header; an existing folder is an error and stays as it is."""
    df.write.mode("errorifexists").option("header", "true").csv(path)


def through_cache(wanted: DataFrame, cache: DataFrame, keys: list[str], version: str, now: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of this version that have not expired, and computed rows for the other keys: only those reach the computation."""
    fresh = cache.where((F.col("version") == version) & (F.col("expires_at") > now)).drop("version", "expires_at")
    hits = fresh.join(wanted, keys, "left_semi").withColumn("cached", F.lit(True))
    return hits.unionByName(compute(wanted.join(fresh, keys, "left_anti")).withColumn("cached", F.lit(False)))
