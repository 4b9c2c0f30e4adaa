"""The whole catalogs of soccer and hockey markets over grids of scores. Stand-in: a part is a match, its expected goals come from its numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerline.functions.catalog import HOCKEY_FINAL, HOCKEY_REGULATION, SOCCER, TOP_SCORES
from ledgerline.functions.grids import after_overtime, corrected, priced, scores, tilted
from ledgerline.operators.fits import margin_factors, means
from ledgerline.sources.views import table
from ledgerline.sources.work import spread

from .fits import fitted, played
from .registry import query

SIZE, RHO = 10, -0.13
_HOME, _AWAY = "(p_size % 25 + 5) / 10.0", "(p_partkey % 19 + 4) / 10.0"
_GRID = f"""r AS (SELECT p_partkey AS match_id, {_HOME} AS home, {_AWAY} AS away FROM part), n AS (SELECT unnest(range({SIZE + 1}))::INTEGER AS k),
 g0 AS (SELECT match_id, home, away, a.k AS i, b.k AS j, exp(a.k * ln(home) - home - ln(factorial(a.k)::DOUBLE)) * exp(b.k * ln(away) - away - ln(factorial(b.k)::DOUBLE)) AS p FROM r, n a, n b)"""


def rates(spark, folder):
    return spread(table(spark, folder, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("match_id"), F.expr(_HOME).cast("double").alias("home"), F.expr(_AWAY).cast("double").alias("away"))


def _sql(catalog, grid: str) -> str:
    return " UNION ALL ".join(f"SELECT match_id, '{m}' AS market, '{s}' AS selection, round(sum(p * ({w})) / sum(p), 6) AS prob FROM {grid} GROUP BY match_id" for m, s, w in catalog)


def _top(grid: str) -> str:
    return f"""SELECT match_id, 'correct_score' AS market, selection, prob FROM (SELECT match_id, i || '-' || j AS selection, round(p / mass, 6) AS prob FROM {grid}_top WHERE rn <= {TOP_SCORES}
 UNION ALL SELECT match_id, 'other', round(greatest(0.0, 1 - sum(p) / any_value(mass)), 6) FROM {grid}_top WHERE rn <= {TOP_SCORES} GROUP BY match_id)"""


def _ranked(grid: str) -> str:
    return f"{grid}_top AS (SELECT *, sum(p) OVER (PARTITION BY match_id) AS mass, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 9) DESC, i DESC, j DESC) AS rn FROM {grid})"


@query(f"""WITH {_GRID}, g AS (SELECT match_id, i, j, p * CASE WHEN i = 0 AND j = 0 THEN 1 - home * away * {RHO} WHEN i = 0 AND j = 1 THEN 1 + home * {RHO} WHEN i = 1 AND j = 0 THEN 1 + away * {RHO} WHEN i = 1 AND j = 1 THEN 1 - {RHO} ELSE 1 END AS p FROM g0), {_ranked("g")}
 {_sql(SOCCER, "g")} UNION ALL {_top("g")}""")
def d25_soccer_catalog(spark, folder):
    """Every market of the soccer catalog from a corrected grid of scores (D25): results, double chance, totals, both score, handicaps with quarter lines, team totals, clean sheets, wins to nil, odd or even,
    exact totals, margins, combinations, correct scores. The oracle shares the list of conditions; a test computes the markets with arrays."""
    size, rho = SIZE, RHO
    grid = lambda h, a: corrected(scores(h, a, size), h, a, size, rho)
    return priced(rates(spark, folder), "match_id", [F.col("home"), F.col("away")], SIZE, [(SOCCER, grid)]).withColumn("prob", F.round("prob", 6))


FACTORS = {0: 0.3, 1: -0.5, 3: 0.4}
SHARE = 0.52
_TARGET = "0.35 + (p_partkey % 31) / 100.0"


@query(f"""WITH RECURSIVE {_GRID}, t AS (SELECT p_partkey AS match_id, {_TARGET} AS target FROM part), b AS (SELECT match_id, i, j, p * exp(CASE abs(i - j) {" ".join(f"WHEN {k} THEN {v}" for k, v in FACTORS.items())} ELSE 0 END) AS p FROM g0),
 d AS (SELECT match_id, i - j AS d, sum(p) AS p FROM b GROUP BY ALL),
 z(n, match_id, lo, hi) AS (SELECT 0, match_id, -3.0::DOUBLE, 3.0::DOUBLE FROM t
 UNION ALL SELECT n + 1, match_id, CASE WHEN h < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h < target THEN hi ELSE (lo + hi) / 2 END FROM (SELECT any_value(z.n) AS n, z.match_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(target) AS target,
 sum(CASE WHEN d > 0 THEN p * exp((lo + hi) / 2 * d) ELSE 0 END) / sum(CASE WHEN d <> 0 THEN p * exp((lo + hi) / 2 * d) ELSE 0 END) AS h FROM z JOIN d ON d.match_id = z.match_id JOIN t ON t.match_id = z.match_id WHERE n < 50 GROUP BY z.match_id)),
 r1 AS (SELECT b.match_id, i, j, p * exp((lo + hi) / 2 * (i - j)) AS p FROM b JOIN z ON z.match_id = b.match_id AND z.n = 50),
 f AS (SELECT match_id, i, j, sum(p) AS p FROM (SELECT match_id, i, j, p FROM r1 WHERE i <> j UNION ALL SELECT match_id, CASE WHEN i = {SIZE} THEN i ELSE i + 1 END, CASE WHEN i = {SIZE} THEN j - 1 ELSE j END, p * {SHARE} FROM r1 WHERE i = j
 UNION ALL SELECT match_id, CASE WHEN i = {SIZE} THEN i - 1 ELSE i END, CASE WHEN i = {SIZE} THEN j ELSE j + 1 END, p * {1 - SHARE} FROM r1 WHERE i = j) GROUP BY ALL), {_ranked("f")}
 {_sql(HOCKEY_REGULATION, "r1")} UNION ALL {_sql(HOCKEY_FINAL, "f")} UNION ALL {_top("f")}""")
def d27_hockey_catalog(spark, folder):
    """The hockey catalog from two coupled grids (D27): regulation scores with factors by margin, tilted so that decided games go to the home side as often as a price says, and final scores, in which overtime
    resolves every tie. Regulation markets read the first, all others the second. Stand-ins: factors, overtime share and price."""
    size, share = SIZE, SHARE
    factor = np.array([math.exp(FACTORS.get(abs(i - j), 0.0)) for i in range(SIZE + 1) for j in range(SIZE + 1)])
    regulation = lambda h, a, t: tilted(scores(h, a, size) * factor, t, size)
    final = lambda h, a, t: after_overtime(regulation(h, a, t), size, share)
    target = F.expr(_TARGET.replace("p_partkey", "match_id"))
    return priced(rates(spark, folder), "match_id", [F.col("home"), F.col("away"), target], SIZE, [(HOCKEY_REGULATION, regulation), (HOCKEY_FINAL, final)]).withColumn("prob", F.round("prob", 6))


@query()
def d27_margin_factors(spark, folder):
    """The log-factors of ties and of margins of one and three goals by maximum likelihood, after the strengths (D27). A test compares them with a search over all matches."""
    fit = fitted(spark, folder)
    rated = means(fit.pairs, fit.ratings).select("home", "away", "league", F.col("home_mean").alias("h"), F.col("away_mean").alias("a"))
    m = played(spark, folder).withColumn("gap", F.abs(F.least("home_goals", F.lit(SIZE)) - F.least("away_goals", F.lit(SIZE))))
    seen = m.groupBy("home", "away", "league").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("gap") == k).alias(f"n{k}") for k in FACTORS])
    rows = seen.join(rated, ["home", "away", "league"]).select(F.col("h").alias("home"), F.col("a").alias("away"), "n", *[f"n{k}" for k in FACTORS])
    found = margin_factors(rows, {k: f"n{k}" for k in FACTORS}, "n", SIZE)
    n = m.groupBy().agg(F.count(F.lit(1)).alias("matches"))
    return n.select("matches", F.inline(F.array(*[F.struct(F.lit(k).alias("margin"), F.round(F.lit(v), 4).alias("log_factor")) for k, v in found.items()])))
