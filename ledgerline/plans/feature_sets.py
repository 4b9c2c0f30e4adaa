"""Whole feature sets: a side's form in fifteen metrics over four windows, and a match's prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.windows import last_n, slope
from ledgerline.sources.views import QUOTES, TEAM_ROWS, quotes, team_rows

from .registry import query

WINDOWS = (3, 5, 10, 20)
KEYS, ORDER = ["team_id"], ["match_date", "match_id"]
_OVER = "PARTITION BY team_id ORDER BY match_date, match_id"
#: Stand-ins for what the tables don't have, each from the match and the side.
STATS = {"xg": "(match_id * 3 + team_id) % 30 / 10.0", "xg_against": "(match_id * 3 + opponent_id) % 30 / 10.0", "shots": "(match_id + team_id * 2) % 20 * 1.0", "shots_on_target": "(match_id + team_id) % 9 * 1.0", "possession": "30.0 + (match_id * 7 + team_id) % 41", "corners": "(match_id + team_id * 5) % 12 * 1.0"}
#: metric: whether it is a mean, and what it sums.
METRICS = {
    "wins": (False, "CASE WHEN gf > ga THEN 1 ELSE 0 END"), "draws": (False, "CASE WHEN gf = ga THEN 1 ELSE 0 END"), "losses": (False, "CASE WHEN gf < ga THEN 1 ELSE 0 END"), "points_per_game": (True, "pts"), "goals_scored": (False, "gf"), "goals_conceded": (False, "ga"),
    "goal_diff": (False, "gf - ga"), "clean_sheets": (False, "CASE WHEN ga = 0 THEN 1 ELSE 0 END"), "btts": (False, "CASE WHEN gf > 0 AND ga > 0 THEN 1 ELSE 0 END"), **{f"avg_{k}": (True, k) for k in STATS},
}
_FORM = ", ".join(f"round(CAST({'avg' if mean else 'sum'}({x}) OVER w{n} AS DOUBLE), 6) AS {m}__last{n}" for m, (mean, x) in METRICS.items() for n in WINDOWS)
_TREND = ", ".join(f"round(CASE WHEN count(*) OVER w10 >= 3 THEN regr_slope({x}, pos) OVER w10 END, 6) + 0.0 AS {m}_trend" for m, x in (("points", "pts"), ("goals", "gf"), ("xg", "xg")))
_CV = ", ".join(f"CASE WHEN count(*) OVER w20 >= 3 THEN round(coalesce(stddev_pop({x}) OVER w10 / nullif(abs(avg({x}) OVER w10), 0), 0), 6) END AS {m}_consistency" for m, x in (("scoring", "gf"), ("defensive", "ga")))


@query(f"""WITH {TEAM_ROWS}, s AS (SELECT *, {", ".join(f"{x} AS {k}" for k, x in STATS.items())}, row_number() OVER ({_OVER}) AS pos FROM t WHERE status = 'finished')
SELECT match_id, team_id, {_FORM}, {_TREND}, {_CV} FROM s WINDOW {", ".join(f"w{n} AS ({_OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in WINDOWS)}""")
def d1_team_performance(spark, folder):
    """A side's form before each match (D1): fifteen metrics over its last 3, 5, 10 and 20 matches, trends of points, goals and expected goals from three on, and the variation of goals for and against.

    All windows share one partitioning and order, so one shuffle and sort serve the 65 columns."""
    t = team_rows(spark, folder).where("status = 'finished'").withColumns({k: F.expr(x).cast("double") for k, x in STATS.items()})
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER)))
    w = {n: last_n(KEYS, ORDER, n) for n in WINDOWS}
    form = [F.round((F.avg if mean else F.sum)(F.expr(x)).over(w[n]).cast("double"), 6).alias(f"{m}__last{n}") for m, (mean, x) in METRICS.items() for n in WINDOWS]
    trend = [(F.round(slope(F.col(x), F.col("pos"), w[10]), 6) + 0.0).alias(f"{m}_trend") for m, x in (("points", "pts"), ("goals", "gf"), ("xg", "xg"))]
    cv = lambda x: F.round(F.coalesce(F.try_divide(F.stddev_pop(x).over(w[10]), F.abs(F.avg(x).over(w[10]))), F.lit(0.0)), 6)
    steady = [F.when(F.count(F.lit(1)).over(w[20]) >= 3, cv(x)).alias(f"{m}_consistency") for m, x in (("scoring", "gf"), ("defensive", "ga"))]
    return t.select("match_id", "team_id", *form, *trend, *steady)


SIDES = ("home", "draw", "away")
_BY = lambda f, x: ", ".join(f"{f}({x}) FILTER (WHERE selection = '{s}' AND odds > 1) AS {f}_{s}" for s in SIDES)


@query(f"""WITH {QUOTES}, f AS (SELECT match_id, {", ".join(f"arg_min(odds, (captured_at, book)) FILTER (WHERE selection = '{s}' AND odds > 1) AS opening_{s}" for s in SIDES)} FROM q GROUP BY match_id),
 g AS (SELECT match_id, {_BY("max", "odds")}, {_BY("avg", "odds")}, {_BY("stddev_pop", "1 / odds")}, {_BY("count", "odds")} FROM q GROUP BY match_id), p AS (SELECT *, 1 / avg_home AS h, 1 / avg_draw AS d, 1 / avg_away AS a FROM g JOIN f USING (match_id))
SELECT match_id, {", ".join(f"round(max_{s}, 6) AS current_{s}, round(opening_{s}, 6) AS opening_{s}, round(max_{s} - opening_{s}, 6) + 0.0 AS movement_{s}, CASE WHEN count_{s} >= 2 THEN round(stddev_pop_{s}, 6) END AS spread_{s}" for s in SIDES)},
 {", ".join(f"CASE WHEN max_{s} - opening_{s} < -0.05 THEN 1.0 WHEN max_{s} - opening_{s} > 0.05 THEN -1.0 WHEN max_{s} IS NOT NULL THEN 0.0 END AS drift_{s}" for s in ("home", "away"))},
 round(CASE WHEN h + d + a >= 1 THEN h + d + a - 1 WHEN h + d + a < 1 THEN 0.0 END, 6) AS overround, round(h / (h + d + a), 6) AS implied_home, round(d / (h + d + a), 6) AS implied_draw, round(a / (h + d + a), 6) AS implied_away,
 CASE WHEN h >= d AND h >= a THEN 1.0 WHEN a >= d AND a > h THEN -1.0 WHEN h + d + a IS NOT NULL THEN 0.0 END AS favourite, round(greatest(h, d, a) / (h + d + a), 6) + (h - h) + (d - d) + (a - a) AS favourite_prob, round(CASE WHEN h + d + a IS NOT NULL THEN avg_home / avg_away END, 6) AS home_away_ratio FROM p""")
def d5_market_odds(spark, folder):
    """A match's price features (D5): best and opening prices, their movement and drift beyond 0.05, the spread of implied probabilities over two books or more, the margin of the mean prices, fair probabilities, favourite and
    ratio where all three sides are quoted. One aggregate of a match's quotes.

    A mean of doubles depends on the order of its sum, which SQL leaves open; here it is always that of the quotes, latest first. Rounding goes by the scaled value, as the SQL's does."""
    o, when = F.col("odds"), lambda s, x: F.when((F.col("selection") == s) & (F.col("odds") > 1), x)
    mean = lambda s: F.when(F.col(f"n_{s}") > 0, F.aggregate(F.reverse(F.array_sort(f"all_{s}")), F.lit(0.0), lambda total, x: total + x["odds"]) / F.col(f"n_{s}"))
    aggs = [c for s in SIDES for c in (F.max(when(s, o)).alias(f"max_{s}"), F.collect_list(when(s, F.struct("captured_at", "book", "odds"))).alias(f"all_{s}"), F.stddev_pop(when(s, 1 / o)).alias(f"std_{s}"), F.count(when(s, o)).alias(f"n_{s}"), F.min_by(when(s, o), when(s, F.struct("captured_at", "book"))).alias(f"opening_{s}"))]
    g = quotes(spark, folder).groupBy("match_id").agg(*aggs).withColumns({f"avg_{s}": mean(s) for s in SIDES}).withColumns({k: 1 / F.col(f"avg_{s}") for k, s in (("h", "home"), ("d", "draw"), ("a", "away"))})
    h, d, a = map(F.col, ("h", "d", "a"))
    total = h + d + a
    rounded = lambda c: F.round(c * 1e6) / 1e6
    r = lambda c, name: rounded(c).alias(name)
    move = lambda s: F.col(f"max_{s}") - F.col(f"opening_{s}")
    each = [c for s in SIDES for c in (r(F.col(f"max_{s}"), f"current_{s}"), r(F.col(f"opening_{s}"), f"opening_{s}"), (rounded(move(s)) + 0.0).alias(f"movement_{s}"), F.when(F.col(f"n_{s}") >= 2, rounded(F.col(f"std_{s}"))).alias(f"spread_{s}"))]
    drift = [F.when(move(s) < -0.05, 1.0).when(move(s) > 0.05, -1.0).when(F.col(f"max_{s}").isNotNull(), 0.0).alias(f"drift_{s}") for s in ("home", "away")]
    whole = lambda c: F.when(total.isNotNull(), c)
    favourite = whole(F.when((h >= d) & (h >= a), 1.0).when((a >= d) & (a > h), -1.0).otherwise(0.0))
    return g.select("match_id", *each, *drift, r(whole(F.greatest(total - 1, F.lit(0.0))), "overround"), r(h / total, "implied_home"), r(d / total, "implied_draw"), r(a / total, "implied_away"), favourite.alias("favourite"), r(whole(F.greatest(h, d, a) / total), "favourite_prob"), r(whole(F.col("avg_home") / F.col("avg_away")), "home_away_ratio"))
