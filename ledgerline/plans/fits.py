"""Fits: attack and defence strengths, low-score correction, linear models with errors, blends, isotonic calibration and a race ranker."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.calibration import isotonic, listwise
from ledgerline.operators.fits import blend_weights, least_squares, low_score_rho, means, strengths
from ledgerline.sources.views import MATCHES, PREDICTIONS, matches, predictions, races, table

from .registry import query

DECAY, SHRINK, PRIOR = 0.00095, 200.0, 20.0
_FINISHED = f"""{MATCHES}, f0 AS (SELECT *, max(match_date) OVER () AS last FROM m WHERE status = 'finished'), f AS (SELECT *, exp(-{DECAY}::DOUBLE * (epoch_us(last) - epoch_us(match_date))::DOUBLE / 86400000000) AS w FROM f0),
 g AS (SELECT sum(w * home_score) / sum(w) AS gh, sum(w * away_score) / sum(w) AS ga FROM f), b AS (SELECT league_id, (sum(w * home_score) + {SHRINK}::DOUBLE * any_value(gh)) / (sum(w) + {SHRINK}) AS hb, (sum(w * away_score) + {SHRINK}::DOUBLE * any_value(ga)) / (sum(w) + {SHRINK}) AS ab FROM f, g GROUP BY league_id),
 s AS (SELECT home_id AS t, away_id AS o, w, hb AS mine, ab AS theirs, home_score AS gf, away_score AS ga FROM f JOIN b ON b.league_id = f.league_id UNION ALL SELECT away_id, home_id, w, ab, hb, away_score, home_score FROM f JOIN b ON b.league_id = f.league_id),
 e AS (SELECT t, o, sum(w * mine) AS mine, sum(w * theirs) AS theirs FROM s GROUP BY ALL), n AS (SELECT t, sum(w * gf) AS gf, sum(w * ga) AS ga FROM s GROUP BY t),
 fit(i, t, attack, defence) AS (SELECT 0, t, 1.0::DOUBLE, 1.0::DOUBLE FROM n
 UNION ALL SELECT i + 1, t, raw / avg(raw) OVER (), defence FROM (SELECT max(fit.i) AS i, n.t, (any_value(n.gf) + {PRIOR}) / (sum(e.mine * fit.defence) + {PRIOR}) AS raw, (any_value(n.ga) + {PRIOR}) / (sum(e.theirs * fit.attack) + {PRIOR}) AS defence FROM fit JOIN e ON e.o = fit.t JOIN n ON n.t = e.t WHERE fit.i < 60 GROUP BY n.t))"""


def played(spark, folder):
    m = matches(spark, folder).where("status = 'finished'")
    return m.select(F.col("home_id").alias("home"), F.col("away_id").alias("away"), F.col("league_id").alias("league"), F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), "match_date")


def fitted(spark, folder):
    return strengths(played(spark, folder), DECAY, SHRINK, PRIOR, tolerance=1e-7)


@query(f"WITH RECURSIVE {_FINISHED} SELECT t AS team_id, round(attack, 4) AS attack, round(defence, 4) AS defence FROM fit WHERE i = 60")
def d21_strengths(spark, folder):
    """Attack and defence of each side by maximum likelihood (D21): recency weights, levels of leagues drawn to the whole, a prior of 20 matches, mean attack one.

    The matches are reduced to sums of (side, opponent) once; a round is one join and one group over those, stored in the shared folder."""
    return fitted(spark, folder).ratings.select(F.col("team").alias("team_id"), F.round("attack", 4).alias("attack"), F.round("defence", 4).alias("defence"))


_SLOPE = "sum(CASE WHEN x = 0 AND y = 0 THEN -w * h * a / (1 - h * a * ({r})) WHEN x = 0 AND y = 1 THEN w * h / (1 + h * ({r})) WHEN x = 1 AND y = 0 THEN w * a / (1 + a * ({r})) ELSE -w / (1 - ({r})) END)"


@query(f"""WITH RECURSIVE {_FINISHED}, r AS MATERIALIZED (SELECT * FROM fit WHERE i = 60), c AS MATERIALIZED (SELECT f.w, f.home_score AS x, f.away_score AS y, h.attack * v.defence * b.hb AS h, v.attack * h.defence * b.ab AS a FROM f JOIN b ON b.league_id = f.league_id JOIN r h ON h.t = f.home_id JOIN r v ON v.t = f.away_id WHERE f.home_score <= 1 AND f.away_score <= 1),
 z(i, lo, hi) AS (SELECT 0, max(CASE WHEN x = 0 AND y = 1 THEN -1 / h WHEN x = 1 AND y = 0 THEN -1 / a END), min(CASE WHEN x = 0 AND y = 0 THEN 1 / (h * a) WHEN x = 1 AND y = 1 THEN 1.0::DOUBLE END) FROM c
 UNION ALL SELECT i + 1, CASE WHEN d > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN d > 0 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT z.i, lo, hi, {_SLOPE.format(r="(lo + hi) / 2")} AS d FROM z, c WHERE z.i < 50 GROUP BY z.i, lo, hi))
SELECT round((lo + hi) / 2, 4) AS rho, (SELECT count(*) FROM c) AS low_scores FROM z WHERE i = 50""")
def d22_low_score_rho(spark, folder):
    """The correction of low scores by maximum likelihood, after the strengths (D22). The oracle bisects the slope; here each pass sums the likelihood at 33 points in one aggregate."""
    fit = fitted(spark, folder)
    rho, _ = low_score_rho(means(fit.pairs, fit.ratings))
    low = matches(spark, folder).where("status = 'finished' and home_score <= 1 and away_score <= 1")
    return low.agg(F.round(F.lit(rho), 4).alias("rho"), F.count(F.lit(1)).alias("low_scores"))


TERMS = ["p_size", "p_partkey_mod", "retail"]
_X = "SELECT p_size::DOUBLE AS x1, (p_partkey % 13)::DOUBLE AS x2, p_retailprice AS x3, (p_size * 2 + (p_partkey * 7 % 17) - (p_partkey % 13) * 0.5)::DOUBLE AS y FROM part"


@query(f"""WITH x AS ({_X}), m AS (SELECT count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM x),
 c AS (SELECT any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my, sum((x1 - m1) ** 2) AS a, sum((x2 - m2) ** 2) AS b, sum((x3 - m3) ** 2) AS c, sum((x1 - m1) * (x2 - m2)) AS d, sum((x1 - m1) * (x3 - m3)) AS e, sum((x2 - m2) * (x3 - m3)) AS f,
 sum((x1 - m1) * (y - my)) AS p, sum((x2 - m2) * (y - my)) AS q, sum((x3 - m3) * (y - my)) AS r, sum((y - my) ** 2) AS t FROM x, m),
 i AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det FROM c),
 v AS (SELECT *, (b * c - f * f) / det AS v11, (e * f - d * c) / det AS v12, (d * f - b * e) / det AS v13, (a * c - e * e) / det AS v22, (d * e - a * f) / det AS v23, (a * b - d * d) / det AS v33 FROM i),
 w AS (SELECT *, v11 * p + v12 * q + v13 * r AS b1, v12 * p + v22 * q + v23 * r AS b2, v13 * p + v23 * q + v33 * r AS b3 FROM v),
 z AS (SELECT *, t - b1 * p - b2 * q - b3 * r AS rss FROM w), o AS (SELECT *, rss / (n - 4) AS s2, 1 - rss / t AS r2, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, 1 / n + m1 * (v11 * m1 + v12 * m2 + v13 * m3) + m2 * (v12 * m1 + v22 * m2 + v23 * m3) + m3 * (v13 * m1 + v23 * m2 + v33 * m3) AS v00 FROM z)
SELECT u.term, round(u.coefficient, 5) AS coefficient, round(u.se, 5) AS se, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2 FROM o, LATERAL (VALUES ('intercept', b0, sqrt(s2 * v00)), ('p_size', b1, sqrt(s2 * v11)), ('p_partkey_mod', b2, sqrt(s2 * v22)), ('retail', b3, sqrt(s2 * v33))) u(term, coefficient, se)""")
def n15_least_squares(spark, folder):
    """A linear model of three features with standard errors and R2 (N15): one aggregate of products, then Cholesky's factor in its row. The oracle centres and inverts by cofactors."""
    p = table(spark, folder, "part")
    rows = p.select(F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 13).cast("double").alias("p_partkey_mod"), F.col("p_retailprice").alias("retail"), (F.col("p_size") * 2 + F.col("p_partkey") * 7 % 17 - F.col("p_partkey") % 13 * 0.5).cast("double").alias("y"))
    out = least_squares(rows, TERMS, "y")
    return out.select("term", F.round("coefficient", 5).alias("coefficient"), F.round("se", 5).alias("se"), "n", F.round("r2", 6).alias("r2"))


def three_members(spark, folder):
    """Graded predictions with three members made from one probability."""
    p = F.col("p")
    return predictions(spark, folder).select("doc_id", "y", F.when(F.col("doc_id") % 15 == 0, float("nan")).otherwise(p).alias("m1"), F.sqrt(p).alias("m2"), ((p + 1) / 3).alias("m3"))


@query()
def d28_fitted_blend(spark, folder):
    """The members' weights of least log-loss, none under 0.05, and the losses of the blend and of each member alone (D28). A test compares the loss with a fine grid's."""
    members = ["m1", "m2", "m3"]
    rows = three_members(spark, folder)
    w, loss = blend_weights(rows, members, "y")
    fine = rows.where(~F.isnan("m1"))
    own = [F.avg(F.when(F.col("y") == 1, -F.ln(F.greatest(F.col(m), F.lit(1e-12)))).otherwise(-F.ln(F.greatest(1 - F.col(m), F.lit(1e-12))))).alias(f"loss_{m}") for m in members]
    return fine.agg(F.count(F.lit(1)).alias("rows"), *own).select("rows", *[F.round(F.lit(x), 3).alias(f"weight_{m}") for x, m in zip(w, members, strict=True)], F.round(F.lit(loss), 6).alias("loss"), *[F.round(f"loss_{m}", 6).alias(f"loss_{m}") for m in members])


@query(f"""WITH {PREDICTIONS}, b AS (SELECT p, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS t FROM p GROUP BY p), c AS (SELECT p, w, t, sum(w) OVER (ORDER BY p) AS cw, sum(t) OVER (ORDER BY p) AS ct FROM b),
 m AS (SELECT x.p, lo.p AS l, min((hi.ct - lo.ct + lo.t) / (hi.cw - lo.cw + lo.w)) AS least FROM c x JOIN c lo ON lo.p <= x.p JOIN c hi ON hi.p >= x.p GROUP BY ALL), v AS (SELECT p, max(least) AS value FROM m GROUP BY p),
 g AS (SELECT b.p, b.w, round(v.value, 9) AS value FROM b JOIN v ON v.p = b.p) SELECT round(min(p), 6) AS low, round(max(p), 6) AS high, sum(w) AS weight, round(value, 6) AS value FROM g GROUP BY value""")
def d30_isotonic(spark, folder):
    """Isotonic calibration (D30): pools of adjacent violators, merged over ranges of the score. The oracle takes the greatest of the least means over all intervals around a score."""
    return isotonic(predictions(spark, folder), "p", "y").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "weight", F.round("value", 6).alias("value"))


@query()
def d30_race_ranker(spark, folder):
    """A listwise ranker of races (D30): the weights of a linear score under which the winners are likeliest, and each runner's chance. A test compares the weights with a plain ascent."""
    e = races(spark, folder).where(~F.col("scratched"))
    won = e.groupBy("race_id").agg(F.min(F.struct("pace", "entrant_id")).alias("w"))
    rows = e.join(won, "race_id").select("race_id", "entrant_id", (F.col("entrant_id") == F.col("w.entrant_id")).cast("int").alias("won"), (F.ln("odds")).alias("price"), (F.col("pace") % 7 / 7).alias("form"))
    w, _ = listwise(rows, ["price", "form"])
    score = sum((F.lit(k) * F.col(f) for k, f in zip(w, ["price", "form"], strict=True)), F.lit(0.0))
    race = Window.partitionBy("race_id")
    return rows.select("race_id", "entrant_id", "won", F.exp(score).alias("e")).select("race_id", "entrant_id", "won", F.round(F.col("e") / F.sum("e").over(race), 4).alias("chance"))
