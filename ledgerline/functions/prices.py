"""Price mathematics as columns: implied probabilities, margins and their removal, expected value, stakes and conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds).otherwise(F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def devig_proportional(odds: Column, to: Column | float = 1.0) -> Column:
    """Fair probabilities of an array of odds, in proportion; null unless all odds exceed 0."""
    raw = F.transform(odds, implied)
    return F.when(F.forall(odds, lambda o: o > 0), F.transform(raw, lambda p: p * to / total(raw)))


def devig_power(odds: Column, to: Column | float = 1.0, steps: int = 10) -> Column:
    """Fair probabilities p ** k of odds above 1, with k in [0.05, 50] such that they sum to `to`; in proportion where there is no such k.

    The logarithm of the sum is convex and falls in k, so Newton's steps from a k below the root rise to it; a fold over few steps in the JVM."""
    raw = F.transform(odds, implied)
    goal = F.ln(to if isinstance(to, Column) else F.lit(float(to)))
    sums = lambda k: F.aggregate(raw, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d")), lambda a, p: F.struct((a["s"] + F.pow(p, k)).alias("s"), (a["d"] + F.pow(p, k) * F.ln(p)).alias("d")))
    move = lambda k, x: k - (F.ln(x["s"]) - goal) * x["s"] / x["d"]
    step = lambda k, _: F.get(F.transform(F.array(sums(k)), lambda x: move(k, x)), 0)
    start = F.when(total(raw) > F.exp(goal), 1.0).otherwise(0.05)
    k = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    shares = F.get(F.transform(F.array(k), lambda x: F.when(x.between(0.05, 50.0), F.transform(raw, lambda p: F.pow(p, x)))), 0)
    fair = F.get(F.transform(F.array(shares), lambda f: F.transform(f, lambda v: v * F.exp(goal) / total(f))), 0)
    return F.when(F.forall(odds, lambda o: o > 1) & (F.size(odds) > 1), F.coalesce(fair, devig_proportional(odds, to))).otherwise(devig_proportional(odds, to))


def devig_shin(odds: Column, steps: int = 8) -> Column:
    """Shin's fair probabilities, insider share z in [0, 0.5] by Newton's steps from 0: with c = p * p / book and r = sqrt(z * z + 4 * (1 - z) * c) an outcome's share is
    (r - z) / (2 * (1 - z)) = 2 * c / (r + z), which falls in z."""
    raw = F.transform(odds, implied)
    book = total(raw)
    within = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    root = lambda c, z: F.sqrt(z * z + 4 * (1 - z) * c)
    add = lambda a, c, z, r: F.struct((a["s"] + 2 * c / (r + z)).alias("s"), (a["d"] - 2 * c * ((z - 2 * c) / r + 1) / ((r + z) * (r + z))).alias("d"))

    def solved(squares: Column) -> Column:
        sums = lambda z: F.aggregate(squares, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d")), lambda a, c: within(root(c, z), lambda r: add(a, c, z, r)))
        step = lambda z, _: within(sums(z), lambda x: F.least(F.greatest(z - (x["s"] - 1) / x["d"], F.lit(0.0)), F.lit(0.5)))
        z = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
        return within(z, lambda x: F.transform(squares, lambda c: 2 * c / (root(c, x) + x)))

    squares = within(book, lambda b: F.transform(raw, lambda p: p * p / b))
    return F.when(F.forall(odds, lambda o: o > 1), within(squares, solved))


def expected_value(p: Column, odds: Column, push: Column | None = None) -> Column:
    return p * odds + (push if push is not None else F.lit(0.0)) - 1


def kelly(p: Column, odds: Column) -> Column:
    return F.greatest(F.coalesce(F.try_divide(p * odds - 1, odds - 1), F.lit(0.0)), F.lit(0.0))


def capped_stake(stake: Column, bankroll: float, share: float = 0.025) -> Column:
    return F.round(F.greatest(F.least(stake, F.lit(bankroll * share)), F.lit(0.0)), 2)


def american_to_decimal(line: Column) -> Column:
    return F.round(F.when(line > 0, 1 + line / 100).when(line < 0, 1 + 100 / F.abs(line)), 2)


def decimal_to_american(odds: Column) -> Column:
    return F.when(odds >= 2, ((odds - 1) * 100).cast("int")).when(odds > 1, F.try_divide(F.lit(-100.0), odds - 1).cast("int"))


def confidence(ev: Column, p: Column) -> Column:
    return F.when((ev >= 0.15) & (p >= 0.6), "very_high").when((ev >= 0.1) & (p >= 0.5), "high").when(ev >= 0.05, "medium").otherwise("low")


def poisson(k: Column, rate: Column) -> Column:
    """Poisson probability of k <= 20; a rate of 0 or less is a point mass at 0."""
    return F.when(rate <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(k * F.ln(rate) - rate - F.ln(F.factorial(k).cast("double"))))


def elo_expectation(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points on a sphere of 6,371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(a))


def place_terms(runners: Column) -> Column:
    """Places and odds fraction of each-way bets by field size."""
    return F.when(runners <= 4, F.struct(F.lit(0).alias("places"), F.lit(0.0).alias("fraction"))).when(runners <= 7, F.struct(F.lit(2).alias("places"), F.lit(0.25).alias("fraction"))).otherwise(F.struct(F.lit(3).alias("places"), F.lit(0.2).alias("fraction")))
