"""Relational operators that SQL dialects with lateral joins and DISTINCT ON have built in, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.work import stored


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given total order (DISTINCT ON for n = 1); Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sides(matches: DataFrame, home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """One row for each side of a match, so that 'home = t OR away = t' becomes an equi-join. home, away: output column -> input column."""
    both = F.array(
        F.struct(F.lit(True).alias("is_home"), *[F.col(v).alias(k) for k, v in home.items()]),
        F.struct(F.lit(False).alias("is_home"), *[F.col(v).alias(k) for k, v in away.items()]),
    )
    moved = {*home.values(), *away.values()}
    return matches.select(*[c for c in matches.columns if c not in moved], F.inline(both))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT .. ON CONFLICT DO UPDATE: rows of new replace rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT .. ON CONFLICT DO NOTHING: rows of new whose keys old lacks; one row for each key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Each left row with the values of the last right row of its keys before left_time (at it too unless strict).

    Both sides are merged to one event sequence per key, and the last right row is carried forward by a window, so the work is one
    shuffle and sort, whatever the number of candidates; nothing is paired.
    """
    stamp = F.col(right_time)
    r = right.select(*keys, stamp.alias("_t"), F.lit(0 if not strict else 1).alias("_side"), F.struct(*[F.col(v) for v in values]).alias("_v"), F.struct(*[F.col(t) for t in ties]).alias("_tie") if ties else F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    one = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 if not strict else 0).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    merged = one.unionByName(r).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    return merged.select("_row.*", *[F.col("_last")[v].alias(v) for v in values])


def changed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed, and the columns that differ (null-safe)."""
    values = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*values).alias("_b"))
    a = after.select(*keys, F.struct(*values).alias("_a"))
    joined = b.join(a, list(keys), "full")
    differing = F.filter(F.array(*[F.when(~F.col(f"_b.{v}").eqNullSafe(F.col(f"_a.{v}")), F.lit(v)) for v in values]), lambda x: x.isNotNull())
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(differing) > 0, "changed")
    return joined.select(*keys, kind.alias("change"), F.when(kind == "changed", F.array_join(differing, ",")).alias("columns")).where("change is not null")


def optional(df: DataFrame, **equal) -> DataFrame:
    """Filters of which each holds only if its value is given: (:x IS NULL OR col = :x)."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] is not None else d, equal.items(), df)


def tagged_union(parts: Iterable[tuple[str, DataFrame]], tag: str = "tag") -> DataFrame:
    """UNION ALL of frames with a column that names the part."""
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(name)) for name, d in parts])


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, after a check that keys identify its rows (the validate= of a many-to-one merge)."""
    twice = df.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{list(keys)} are not unique")
    return df


def split_by_order(df: DataFrame, order: Sequence[str], ratios: Sequence[float], name: str = "part") -> DataFrame:
    """Temporal split: rows in order, cut at int(n * cumulated ratio); part 0, 1, ... Ranks come from range partitions, not one task."""
    n = df.count()
    ranked = global_rank(df, order, "_at")
    cuts, total = [], 0.0
    for r in ratios[:-1]:
        total += r
        cuts.append(int(n * round(total, 9)))
    part = reduce(lambda c, k: c + F.when(F.col("_at") > k, 1).otherwise(0), cuts, F.lit(0))
    return ranked.withColumn(name, part).drop("_at")


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Row number of a total order over the whole table: sorted range partitions, numbered with the counts of those before. The ranges are stored, so that their bounds stay."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_i", inside).join(F.broadcast(base), "_p").withColumn(name, F.col("_i") + F.col("_base")).drop("_i", "_p", "_base")
