"""Nested JSON: flattening to names of paths, and merging of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.work import stored


def flattened(df: DataFrame, json: str, prefix: str = "feature") -> DataFrame:
    """The columns of df but json, with name and value for each number under the JSON object: names join the keys of the path by two underscores.

    true and false are 1 and 0; text, nulls, arrays and numbers that are not finite are left out; dots in keys become underscores; what is no JSON object has no
    rows. Objects are exploded a level a round, all rows at once, until none is left, so the rounds are the depth of the deepest object, whatever its keys."""
    keys = [c for c in df.columns if c != json]
    level = df.select(*keys, F.lit(prefix).alias("name"), F.try_parse_json(F.col(json)).alias("v")).where("schema_of_variant(v) like 'OBJECT<%'")
    numbers: list[DataFrame] = []
    spark = df.sparkSession
    while True:
        level = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*keys, F.concat("name", F.lit("__"), F.translate(F.col("key"), ".", "_")).alias("name"), F.col("value").alias("v"))
        level = stored(level.select(*keys, "name", F.schema_of_variant("v").alias("kind"), F.to_json("v").alias("text")).where("kind like 'OBJECT<%' or kind like 'DECIMAL%' or kind in ('BIGINT', 'DOUBLE', 'FLOAT', 'BOOLEAN')"), "level")
        number = F.when(F.col("kind") == "BOOLEAN", (F.col("text") == "true").cast("double")).otherwise(F.col("text").try_cast("double"))
        numbers.append(level.where("kind not like 'OBJECT<%'").select(*keys, "name", number.alias("value")).where("value is not null and not isnan(value) and abs(value) < double('inf')"))
        inner = level.where("kind like 'OBJECT<%'")
        if inner.isEmpty():
            break
        level = inner.select(*keys, "name", F.parse_json("text").alias("v"))
    out = numbers[0]
    for n in numbers[1:]:
        out = out.unionByName(n)
    return out


def merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one: members of the new one win, whole; values keep their types; a null old object is empty, a null new one changes nothing."""
    members = lambda j: F.from_json(F.coalesce(j, F.lit("{}")), "map<string,variant>")
    kept = F.map_filter(members(old), lambda k, _: ~F.coalesce(F.map_contains_key(members(new), k), F.lit(False)))
    return F.to_json(F.map_concat(kept, members(new)))
