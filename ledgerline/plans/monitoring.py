"""Monitoring and evaluation: calibration, proper scores, drift, bootstrap-free clustered errors, splits, feature checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.relational import split_by_order
from ledgerline.sources.views import PREDICTIONS, predictions, table

from .registry import query


def r6(c):
    return F.round(c, 6)


_BINS = f"{PREDICTIONS}, b AS (SELECT sport, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS actual FROM p GROUP BY ALL)"


def bins(spark, folder):
    p = predictions(spark, folder).withColumn("bin", F.least(F.floor(F.col("p") * 10).cast("int"), F.lit(9)))
    return p.groupBy("sport", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"))


@query(f"WITH {_BINS} SELECT sport, bin, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM b")
def a18_calibration_buckets(spark, folder):
    """Equal-width calibration buckets."""
    return bins(spark, folder).select("sport", "bin", "n", r6("predicted").alias("predicted"), r6("actual").alias("actual"))


@query(f"WITH {_BINS} SELECT sport, round(sum(n * abs(predicted - actual)) / sum(n), 6) AS ece, round(coalesce(max(CASE WHEN n >= 20 THEN abs(predicted - actual) END), 0), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY sport")
def d33_calibration_error(spark, folder):
    """Expected calibration error over the reduced buckets, and the maximum over those of 20 rows or more."""
    gap = F.abs(F.col("predicted") - F.col("actual"))
    return bins(spark, folder).groupBy("sport").agg(r6(F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), r6(F.coalesce(F.max(F.when(F.col("n") >= 20, gap)), F.lit(0.0))).alias("mce"), F.sum("n").alias("n"))


@query(f"""WITH {PREDICTIONS} SELECT sport, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN greatest(p, 1e-6) ELSE greatest(1 - p, 1e-6) END)), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
 count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM p GROUP BY sport""")
def d31_scores(spark, folder):
    """Brier, clipped log-loss, accuracy and the confusion counts."""
    p, y = F.col("p"), F.col("y")
    hit = F.when(y == 1, F.greatest(p, F.lit(1e-6))).otherwise(F.greatest(1 - p, F.lit(1e-6)))
    return predictions(spark, folder).groupBy("sport").agg(r6(F.avg((p - y) * (p - y))).alias("brier"), r6(F.avg(-F.ln(hit))).alias("log_loss"), r6(F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0))).alias("accuracy"), F.count_if((p >= 0.5) & (y == 1)).alias("tp"), F.count_if((p >= 0.5) & (y == 0)).alias("fp"), F.count_if((p < 0.5) & (y == 1)).alias("fn"))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT sport, p, y, rank() OVER (PARTITION BY sport ORDER BY p) + (count(*) OVER (PARTITION BY sport, p) - 1) / 2.0::DOUBLE AS r FROM p)
SELECT sport, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY sport""")
def d31_auc(spark, folder):
    """Area under the curve by mid-ranks (D31): scores are counted first, so ties and hot groups shrink before the window."""
    c = predictions(spark, folder).groupBy("sport", "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("sport").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("below", F.coalesce(below, F.lit(0))).groupBy("sport").agg(r6(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))).alias("auc"))


@query(f"""WITH {PREDICTIONS}, x AS (SELECT sport, avg((p - y) * (p - y)) FILTER (WHERE doc_id % 2 = 0) AS now, avg((p - y) * (p - y)) FILTER (WHERE doc_id % 2 = 1) AS before, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM p GROUP BY sport)
SELECT sport, round(now - before, 6) AS drift, CASE WHEN now - before >= 0.05 THEN 'alert' WHEN now - before >= 0.02 THEN 'warn' ELSE 'ok' END AS level, acc + 1.645 * sqrt(acc * (1 - acc) / n) < 0.524 AS below_floor FROM x""")
def d34_drift(spark, folder):
    """Brier drift between two windows with levels, and the accuracy floor with a one-sided bound."""
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    x = predictions(spark, folder).groupBy("sport").agg(F.avg(F.when(F.col("doc_id") % 2 == 0, e)).alias("now"), F.avg(F.when(F.col("doc_id") % 2 == 1, e)).alias("before"), F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias("acc"), F.count(F.lit(1)).alias("n"))
    d = F.col("now") - F.col("before")
    return x.select("sport", r6(d).alias("drift"), F.when(d >= 0.05, "alert").when(d >= 0.02, "warn").otherwise("ok").alias("level"), (F.col("acc") + 1.645 * F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("n")) < 0.524).alias("below_floor"))


@query("""WITH c AS (SELECT l_suppkey AS cluster, sum(l_discount - l_tax) AS s, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT sum(s) / sum(n) AS mean, sum(n) AS total, count(*) AS g FROM c)
SELECT round(any_value(mean), 9) AS delta, round(sqrt(any_value(g) / (any_value(g) - 1.0::DOUBLE) * sum(pow(s - mean * n, 2))) / any_value(total), 9) AS se, any_value(g) AS clusters FROM c CROSS JOIN m""")
def n12_clustered_delta(spark, folder):
    """Mean paired difference with a cluster-robust error in ratio form (D35, N12): sums by cluster, then one row."""
    c = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_discount") - F.col("l_tax")).alias("s"), F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"))
    mean, g = F.col("s") / F.col("n"), F.col("g")
    spread = F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn")
    return t.select(F.round(mean, 9).alias("delta"), F.round(F.sqrt(g / (g - 1) * spread) / F.col("n"), 9).alias("se"), g.alias("clusters"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem)
SELECT l_returnflag, round(regr_slope(b, a), 4) AS slope, round(regr_intercept(b, a), 2) AS intercept, round(regr_r2(b, a), 6) AS r2, round(corr(a, c), 6) AS corr_ac, round(var_pop(c), 8) AS var_c FROM x GROUP BY l_returnflag""")
def n15_regression(spark, folder):
    """Least squares, R2, correlation and variance by group."""
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"), r6(F.corr("l_quantity", "l_discount")).alias("corr_ac"), F.round(F.var_pop("l_discount"), 8).alias("var_c"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_orderkey, CASE WHEN i > CAST(floor(n * 0.8) AS BIGINT) THEN 2 WHEN i > CAST(floor(n * 0.6) AS BIGINT) THEN 1 ELSE 0 END AS part FROM r CROSS JOIN n""")
def d19_temporal_split(spark, folder):
    """Train, validation and test by time order, 60 / 20 / 20 (D19): ranks from range partitions, not from one sorted task."""
    return split_by_order(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], [0.6, 0.2, 0.2]).select("o_orderkey", "part")


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem) SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_extendedprice IS NULL) AS missing, count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.05) AS out_of_range, count(*) FILTER (WHERE abs(l_extendedprice - m) > 2 * sd) AS outliers FROM lineitem CROSS JOIN s GROUP BY l_returnflag""")
def d8_feature_checks(spark, folder):
    """Missing, out-of-range and outlying values."""
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    s = li.agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("sd"))
    return li.crossJoin(F.broadcast(s)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_extendedprice").isNull()).alias("missing"), F.count_if(~F.col("l_discount").between(0, 0.05)).alias("out_of_range"), F.count_if(F.abs(F.col("l_extendedprice") - F.col("m")) > 2 * F.col("sd")).alias("outliers"))
