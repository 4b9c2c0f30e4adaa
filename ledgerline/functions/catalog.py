"""Catalogs of markets over a grid of scores: each selection is a condition on home goals i and away goals j, or a weight between 0 and 1.

The probability of a selection is the sum of its weight over the grid's cells, so a catalog is a list of (market, selection, SQL weight of i and j).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines that the catalogs offer.
TOTAL_LINES = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5)
TEAM_LINES = (0.5, 1.5, 2.5)
HANDICAP_LINES = (-2.5, -2.0, -1.75, -1.5, -1.25, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5)
HOCKEY_TOTALS = (4.5, 5.5, 6.5)
TOP_SCORES = 12

Entry = tuple[str, str, str]
_RESULT = {"home": "i > j", "draw": "i = j", "away": "i < j"}


def yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def label(line: float) -> str:
    return f"{line:g}"


def handicap(line: float) -> list[Entry]:
    """The home side's win, loss and refund at a line; a quarter line is half a stake at each of its neighbours."""
    parts = [line - 0.25, line + 0.25] if line * 4 % 2 else [line]
    share = lambda sign: " + ".join(f"{1 / len(parts)} * {yes(f'i - j + {p} {sign} 0')}" for p in parts)
    return [("asian_handicap", f"{label(line)}_{name}", share(sign)) for name, sign in (("home", ">"), ("away", "<"), ("push", "="))]


def both_sides(market: str, home: str, away: str) -> list[Entry]:
    return [(market, f"{side}_{answer}", yes(c if answer == "yes" else f"NOT ({c})")) for side, c in (("home", home), ("away", away)) for answer in ("yes", "no")]


def clean(cap: int) -> list[Entry]:
    """What both sports share: clean sheets, wins to nil and exact totals up to a cap."""
    totals = [("total_goals", str(k), yes(f"i + j = {k}")) for k in range(cap)] + [("total_goals", f"{cap}+", yes(f"i + j >= {cap}"))]
    return both_sides("clean_sheet", "j = 0", "i = 0") + both_sides("win_to_nil", "i > j AND j = 0", "i < j AND i = 0") + totals


def overs(lines: Iterable[float]) -> list[Entry]:
    return [("over_under", f"{side}_{label(x)}", yes(f"i + j {sign} {x}")) for x in lines for side, sign in (("over", ">"), ("under", "<"))]


RESULT = [("1x2", k, yes(c)) for k, c in _RESULT.items()]
DOUBLE = [("double_chance", k, yes(c)) for k, c in (("1X", "i >= j"), ("12", "i <> j"), ("X2", "i <= j"))]
SOCCER: list[Entry] = [
    *RESULT, *DOUBLE, *overs(TOTAL_LINES),
    *[("btts", k, yes(c)) for k, c in (("yes", "i > 0 AND j > 0"), ("no", "i = 0 OR j = 0"))],
    *[e for x in HANDICAP_LINES for e in handicap(x)],
    *[("team_total", f"{side}_{way}_{label(x)}", yes(f"{goals} {sign} {x}")) for side, goals in (("home", "i"), ("away", "j")) for way, sign in (("over", ">"), ("under", "<")) for x in TEAM_LINES],
    *clean(6),
    *[("odd_even", k, yes(f"(i + j) % 2 = {r}")) for k, r in (("odd", 1), ("even", 0))],
    *[("winning_margin", k, yes(c)) for k, c in (("home_1", "i - j = 1"), ("home_2", "i - j = 2"), ("home_3plus", "i - j >= 3"), ("draw", "i = j"), ("away_1", "j - i = 1"), ("away_2", "j - i = 2"), ("away_3plus", "j - i >= 3"))],
    *[("result_btts", f"{k}_{b}", yes(f"{c} AND {'' if b == 'yes' else 'NOT '}(i > 0 AND j > 0)")) for k, c in _RESULT.items() for b in ("yes", "no")],
    *[("result_over_under", f"{k}_{o}", yes(f"{c} AND i + j {s} 2.5")) for k, c in _RESULT.items() for o, s in (("over", ">"), ("under", "<"))],
]
#: Of the score after regulation, and of the final one, which knows no draw.
HOCKEY_REGULATION: list[Entry] = [("regulation_1x2", k, w) for _, k, w in RESULT] + DOUBLE
HOCKEY_FINAL: list[Entry] = [
    ("moneyline", "home", yes("i > j")), ("moneyline", "away", yes("i < j")),
    *[("puck_line", f"{x}_{side}", yes(c if side == "home" else f"NOT ({c})")) for x, c in (("-1.5", "i - j >= 2"), ("1.5", "i - j >= -1")) for side in ("home", "away")],
    *overs(HOCKEY_TOTALS), *clean(8),
]


def cells(rates: DataFrame, size: int) -> DataFrame:
    """rates (with columns home, away: expected goals) with a row for each score i, j below size + 1 and its Poisson probability p, not normalised."""
    goals = F.sequence(F.lit(0), F.lit(size))
    chance = lambda rate: F.transform(goals, lambda k: F.when(rate <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(k * F.ln(rate) - rate - F.ln(F.factorial(k).cast("double")))))
    x = rates.withColumns({"_h": chance(F.col("home")), "_a": chance(F.col("away"))})
    x = x.select(*rates.columns, F.posexplode("_h").alias("i", "_p"), "_a").select(*rates.columns, "i", "_p", F.posexplode("_a").alias("j", "_q"))
    return x.withColumn("p", F.col("_p") * F.col("_q")).drop("_p", "_q")


def prices(grid: DataFrame, keys: list[str], catalog: list[Entry], p: str = "p") -> DataFrame:
    """keys, market, selection, prob of every entry: one aggregate over the cells, which a task sums before anything is shuffled."""
    sums = [F.sum(F.col(p) * F.expr(w)).alias(f"s{k}") for k, (_, _, w) in enumerate(catalog)]
    whole = grid.groupBy(*keys).agg(F.sum(p).alias("_mass"), *sums)
    rows = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), (F.col(f"s{k}") / F.col("_mass")).alias("prob")) for k, (m, s, _) in enumerate(catalog)])
    return whole.select(*keys, F.inline(rows))


def top_scores(grid: DataFrame, keys: list[str], n: int = TOP_SCORES, p: str = "p") -> DataFrame:
    """keys, market, selection, prob of the n likeliest scores (of equal ones the higher score) and of all others; a grid is a short array."""
    by = grid.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.round(p, 9)).alias("o"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), (-F.col(p)).alias("k")))).alias("c"))
    mass = F.aggregate("c", F.lit(0.0), lambda a, x: a - x["k"])
    first = F.transform(F.slice("c", 1, n), lambda x: F.struct(F.concat((-x["i"]).cast("string"), F.lit("-"), (-x["j"]).cast("string")).alias("selection"), (-x["k"] / mass).alias("prob")))
    x = by.select(*keys, first.alias("f"))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate("f", F.lit(0.0), lambda a, r: a + r["prob"]))
    return x.select(*keys, F.lit("correct_score").alias("market"), F.inline(F.concat("f", F.array(F.struct(F.lit("other").alias("selection"), rest.alias("prob"))))))


def overtime(regulation: DataFrame, keys: list[str], size: int, home_share: Column) -> DataFrame:
    """The final scores of a regulation grid: a tie moves one goal up for the side that wins overtime; the last tie of the grid, which has no place above it, one goal down for the other."""
    tie, last = F.col("i") == F.col("j"), F.col("i") == size
    one = lambda i, j, p: F.struct(i.alias("i"), j.alias("j"), p.alias("p"))
    up, down = F.col("i") + 1, F.col("i") - 1
    home = F.when(last, one(F.col("i"), down, F.col("p") * home_share)).otherwise(one(up, F.col("j"), F.col("p") * home_share))
    away = F.when(last, one(down, F.col("j"), F.col("p") * (1 - home_share))).otherwise(one(F.col("i"), up, F.col("p") * (1 - home_share)))
    return regulation.select(*keys, F.inline(F.when(tie, F.array(home, away)).otherwise(F.array(one(F.col("i"), F.col("j"), F.col("p"))))))


def margin_tilt(catalog_of: DataFrame, keys: list[str], target: Column, steps: int = 20) -> DataFrame:
    """The grid with each cell times exp(theta * (i - j)), theta such that the chance of a home win, draws left out, is target; keys, i, j, p, theta.

    Only the sums by goal difference matter for theta, a short array in the row, and Newton's steps on the log-odds run in the row: the derivative is the
    difference of the mean margins of home and away wins."""
    by_gap = catalog_of.groupBy(*keys, (F.col("i") - F.col("j")).alias("d")).agg(F.sum("p").alias("p"), F.first(target).alias("_t")).groupBy(*keys).agg(F.collect_list(F.struct("d", "p")).alias("g"), F.first("_t").alias("_t"))
    total = lambda theta, sign, by: F.aggregate("g", F.lit(0.0), lambda a, x: a + F.when(sign * x["d"] > 0, x["p"] * F.exp(theta * x["d"]) * (x["d"] if by else 1.0)).otherwise(0.0))
    goal = F.ln(F.col("_t") / (1 - F.col("_t")))

    def step(theta: Column, _: Column) -> Column:
        h, a = total(theta, 1, False), total(theta, -1, False)
        return theta - (F.ln(h / a) - goal) / (total(theta, 1, True) / h - total(theta, -1, True) / a)

    found = by_gap.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step).alias("theta"))
    return catalog_of.join(found, keys).withColumn("p", F.col("p") * F.exp(F.col("theta") * (F.col("i") - F.col("j")))).select(*keys, "i", "j", "p", "theta")
