"""Isotonic calibration and a listwise ranker for races.

Pools of adjacent violators merge: the fit of a whole is the fit of the pools of its parts, set end to end. Parts are ranges of the score, so a task pools its own range and hands on pools, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.work import stored

#: Pools that one task takes.
PER_TASK = 200_000


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pools (low, high, weight, sum) of rising means, from blocks of rising scores."""
    out: list[list[float]] = []
    for low, high, weight, total in blocks:
        out.append([low, high, weight, total])
        # Means that are equal are one pool too.
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high, weight, total = out.pop()
            out[-1][1] = high
            out[-1][2] += weight
            out[-1][3] += total
    return out


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one task, sorted by score, to its pools; each batch is pooled together with the pools so far."""
    held: list[list[float]] = []
    for b in batches:
        held = pooled((*held, *zip(*(b.column(c).to_pylist() for c in ("low", "high", "weight", "total")), strict=True)))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()) for c in zip(*held, strict=True)], names=["low", "high", "weight", "total"])


def isotonic(rows: DataFrame, score: str, target: str, weight: Column | None = None) -> DataFrame:
    """low, high, weight, value: the rising step function of least squares from score to target. Rows of one score are one block.

    Range partitions of the blocks are pooled by their tasks, and what is left is dealt anew with other bounds until no pool of one range
    violates the next range's (the order of merging does not matter), or few enough pools are left for one task."""
    w = weight if weight is not None else F.lit(1.0)
    whole = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(target).isNotNull())
    blocks = whole.groupBy(F.col(score).cast("double").alias("low")).agg(F.sum(w).cast("double").alias("weight"), F.sum(w * F.col(target)).cast("double").alias("total")).select("low", F.col("low").alias("high"), "weight", "total")
    pools, turn, mean = stored(blocks, "blocks"), 0, F.col("total") / F.col("weight")
    while True:
        parts = -(-pools.count() // PER_TASK)
        ranged = pools.coalesce(1) if parts <= 1 else pools.repartitionByRange(parts + turn % 2, "low")
        pooled_ = ranged.sortWithinPartitions("low").mapInArrow(_pool, "low double, high double, weight double, total double")
        pools = stored(pooled_.withColumn("part", F.spark_partition_id()), "pools")
        # One row for each range.
        ends = pools.groupBy("part").agg(F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        if parts <= 1 or ends.withColumn("before", F.lag("last").over(Window.orderBy("low"))).where("before >= first").isEmpty():
            return pools.select("low", "high", "weight", mean.alias("value"))
        pools, turn = pools.drop("part"), turn + 1


def calibrated(score: Column, steps: Column) -> Column:
    """The value of the fit at score, straight between steps and level outside; steps: an array of (low, high, value) by low."""
    under = F.filter(steps, lambda s: s["low"] <= score)
    over = F.filter(steps, lambda s: s["high"] >= score)
    a, b = F.element_at(under, -1), F.get(over, 0)
    return F.when(F.size(under) == 0, b["value"]).when(F.size(over) == 0, a["value"]).when(a["high"] >= score, a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * (score - a["high"]) / (b["low"] - a["high"]))


def listwise(races: DataFrame, features: list[str], steps: int = 25) -> tuple[list[float], list[float]]:
    """Weights of a linear score by which runners of a race are chosen with the softmax of their scores, fitted to the winners, and the mean log-likelihood of each step.

    races: race_id, won, features. A race is one row with its runners as an array (a field is short); a step of Newton's is one aggregate of the
    likelihood, its gradient and its curvature, folded over the array in the row, and a step that would lower the likelihood is halved."""
    import numpy as np

    runner = F.struct(F.col("won").cast("double").alias("won"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    fields = stored(races.groupBy("race_id").agg(F.collect_list(runner).alias("r")).where(F.aggregate("r", F.lit(0.0), lambda a, r: a + r["won"]) == 1), "fields")
    w, path, step = [0.0] * len(features), [], np.zeros(len(features))
    sums = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    for _ in range(steps):
        score = lambda r: sum((F.lit(k) * r["x"][i] for i, k in enumerate(w)), F.lit(0.0))  # noqa: B023, E731
        scored = fields.select(F.transform("r", lambda r: F.struct(r["won"].alias("won"), r["x"].alias("x"), score(r).alias("s"))).alias("r"))  # noqa: B023
        top = scored.withColumn("top", F.array_max(F.transform("r", lambda r: r["s"]))).withColumn("e", F.transform("r", lambda r: F.exp(r["s"] - F.col("top"))))
        mass = top.withColumn("mass", sums(F.col("e")))
        best = sums(F.transform("r", lambda r: r["won"] * (r["s"] - F.col("top")))) - F.ln("mass")
        share = F.transform("e", lambda e: e / F.col("mass"))
        mean = lambda i: sums(F.zip_with(share, "r", lambda e, r: e * r["x"][i]))  # noqa: B023, E731
        both = lambda i, j: sums(F.zip_with(share, "r", lambda e, r: e * r["x"][i] * r["x"][j]))  # noqa: B023, E731
        own = lambda i: sums(F.transform("r", lambda r: r["won"] * r["x"][i]))  # noqa: B023, E731
        n = len(features)
        cells = [(i, j) for i in range(n) for j in range(i + 1)]
        found = mass.agg(F.avg(best), *[F.avg(own(i) - mean(i)) for i in range(n)], *[F.avg(both(i, j) - mean(i) * mean(j)) for i, j in cells]).first()
        if found[0] is None:
            break
        if path and found[0] < path[-1] - 1e-12:
            step = step / 2
            w = [a - b for a, b in zip(w, step, strict=True)]
            continue
        path.append(found[0])
        h = np.zeros((n, n))
        for (i, j), c in zip(cells, found[n + 1 :], strict=True):
            h[i, j] = h[j, i] = c
        step = np.linalg.lstsq(h, np.array(found[1 : n + 1]), rcond=None)[0]
        w = [float(a + b) for a, b in zip(w, step, strict=True)]
        if np.abs(step).max(initial=0.0) < 1e-9:
            break
    return w, path
