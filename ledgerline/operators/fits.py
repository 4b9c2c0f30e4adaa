"""Likelihood fits over match tables: attack and defence strengths by a fixed point, the correction of low scores by a refined grid.

Raw matches are reduced once, to sums for each pair of sides and league; every later step works on those sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.sources.work import stored

CELLS = ((0, 0), (0, 1), (1, 0), (1, 1))


@dataclass
class Strengths:
    """A fit: ratings (team, attack, defence), pairs (home, away, league, home_level, away_level and weighted sums), and how it ended."""

    ratings: DataFrame
    pairs: DataFrame
    rounds: int
    converged: bool
    change: float
    change_of_two: float
    log_likelihood: float

    @property
    def oscillates(self) -> bool:
        """Whether the last rounds went back and forth between two states."""
        return not self.converged and self.change_of_two < 0.01 * self.change


def pair_sums(matches: DataFrame, decay: float = 0.0) -> DataFrame:
    """The weighted matches, goals and low scores of each (home, away, league). matches: home, away, league, home_goals, away_goals, match_date.

    A match weighs exp(-decay * days before the last one); one without a date is as old as the oldest."""
    first, last = matches.agg(F.min("match_date"), F.max("match_date")).first()
    days = (F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.coalesce("match_date", F.lit(first)).cast("timestamp"))) / 86_400_000_000
    w = F.exp(-decay * F.greatest(days, F.lit(0.0))) if decay > 0 and last is not None else F.lit(1.0)
    weighed = matches.select("home", "away", "league", "home_goals", "away_goals", w.alias("w"))
    cell = lambda h, a: F.sum(F.when((F.col("home_goals") == h) & (F.col("away_goals") == a), F.col("w")).otherwise(0.0)).alias(f"w{h}{a}")
    return weighed.groupBy("home", "away", "league").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("hg"), F.sum(F.col("w") * F.col("away_goals")).alias("ag"), *[cell(h, a) for h, a in CELLS])


def with_levels(pairs: DataFrame, shrink: float | None, home_advantage: float = 0.25) -> DataFrame:
    """pairs with the goals that an average side scores at home and away: of its league, drawn to the whole by shrink matches, or (None) one level and a home advantage for all."""
    w, hg, ag = pairs.agg(F.sum("w"), F.sum("hg"), F.sum("ag")).first()
    if not w:
        return pairs.withColumns({"home_level": F.lit(None).cast("double"), "away_level": F.lit(None).cast("double")})
    if shrink is None:
        level = (hg + ag) / w / 2
        return pairs.withColumns({"home_level": F.lit(level + home_advantage), "away_level": F.lit(level)})
    own = lambda goals, whole: ((F.sum(goals) + shrink * whole) / (F.sum("w") + shrink))
    leagues = pairs.where("league is not null").groupBy("league").agg(own("hg", hg / w).alias("home_level"), own("ag", ag / w).alias("away_level"))
    return pairs.join(leagues, "league", "left").withColumns({"home_level": F.coalesce("home_level", F.lit(hg / w)), "away_level": F.coalesce("away_level", F.lit(ag / w))})


def strengths(matches: DataFrame, decay: float = 0.0, shrink: float | None = None, prior: float = 0.001, rounds: int = 1000, tolerance: float = 1e-6) -> Strengths:
    """Attack and defence of each side: its goals are Poisson with mean attack * opponent's defence * level of its league and side.

    Fixed point by rounds of one join and one group each: a side's attack is its goals over what an average attack would have scored
    against its opponents, both raised by prior; all sides move at once. The mean attack is held at one, the defences take the level.
    A round is one write to the shared folder; the rounds end when no strength has moved by tolerance."""
    pairs = stored(with_levels(pair_sums(matches, decay), shrink), "pairs")
    side = lambda t, o, mine, other, f, a: pairs.select(F.col(t).alias("t"), F.col(o).alias("o"), (F.col("w") * F.col(mine)).alias("mine"), (F.col("w") * F.col(other)).alias("theirs"), F.col(f).alias("gf"), F.col(a).alias("ga"))
    both = side("home", "away", "home_level", "away_level", "hg", "ag").unionByName(side("away", "home", "away_level", "home_level", "ag", "hg"))
    meetings = stored(both.groupBy("t", "o").agg(*[F.sum(c).alias(c) for c in ("mine", "theirs", "gf", "ga")]), "meetings")
    one = F.lit(1.0)
    state = stored(meetings.groupBy(F.col("t").alias("team")).agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga")).select("team", "gf", "ga", *[one.alias(f"{w}{c}") for w in ("", "was_", "before_") for c in ("attack", "defence")]), "start")
    change = of_two = float("inf")
    done = 0
    converged = state.isEmpty()
    gap = lambda old: F.max(F.greatest(F.abs(F.col("was_attack") - F.col(f"{old}_attack")), F.abs(F.col("was_defence") - F.col(f"{old}_defence"))))
    while not converged and done < rounds:
        due = meetings.join(state.select(F.col("team").alias("o"), "attack", "defence"), "o").groupBy(F.col("t").alias("team")).agg(F.sum(F.col("mine") * F.col("defence")).alias("for_due"), F.sum(F.col("theirs") * F.col("attack")).alias("against_due"))
        moved = lambda got, owed, old: F.when(F.col(owed) > 0, (F.col(got) + prior) / (F.col(owed) + prior)).otherwise(F.col(old))
        earlier = [F.col(f"{a}_{c}").alias(f"{b}_{c}") for a, b in (("was", "before"), ("before", "first")) for c in ("attack", "defence")]
        step = state.join(due, "team").select("team", "gf", "ga", moved("gf", "for_due", "attack").alias("raw"), moved("ga", "against_due", "defence").alias("defence"), F.col("attack").alias("was_attack"), F.col("defence").alias("was_defence"), *earlier)
        # The write also yields the mean, which the next round divides by, and how far the round before this one moved.
        seen = Observation()
        step = stored(step.observe(seen, F.avg("raw").alias("mean"), gap("before").alias("change"), gap("first").alias("of_two")), f"round{done}")
        if done:
            change, of_two = seen.get["change"], seen.get["of_two"]
            converged = change < tolerance
        if not converged:
            done += 1
            state = step.withColumn("attack", F.col("raw") / seen.get["mean"]).drop("raw", "first_attack", "first_defence")
    ratings = state.select("team", "attack", "defence")
    rated = means(pairs, ratings)
    fit = rated.agg(F.sum(F.col("hg") * F.ln("home_mean") + F.col("ag") * F.ln("away_mean") - F.col("w") * (F.col("home_mean") + F.col("away_mean")))).first()[0]
    return Strengths(ratings, pairs, done, bool(converged), float(change), float(of_two), float(fit or 0.0))


def means(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """pairs with the expected goals of both sides."""
    side = lambda name: ratings.select(F.col("team").alias(name), F.col("attack").alias(f"{name}_attack"), F.col("defence").alias(f"{name}_defence"))
    x = pairs.join(side("home"), "home").join(side("away"), "away")
    return x.withColumns({"home_mean": F.col("home_attack") * F.col("away_defence") * F.col("home_level"), "away_mean": F.col("away_attack") * F.col("home_defence") * F.col("away_level")}).drop("home_attack", "home_defence", "away_attack", "away_defence")


def tau(h: int, a: int, home: Column, away: Column, rho: Column | float) -> Column:
    """The factor on the probability of a low score."""
    return {(0, 0): 1 - home * away * rho, (0, 1): 1 + home * rho, (1, 0): 1 + away * rho, (1, 1): F.lit(1.0) - rho}[h, a]


def low_score_rho(rated: DataFrame, points: int = 33, passes: int = 6) -> tuple[float, float]:
    """The rho of greatest likelihood of the four low scores, and its log-likelihood over rho 0. rated: home_mean, away_mean, w00, w01, w10, w11.

    Only those cells depend on rho and the likelihood is concave where all observed factors are positive, so each pass sums it at
    points of the bracket in one aggregate over the pairs and keeps the neighbours of the best: no row leaves the executors."""
    h, a = F.col("home_mean"), F.col("away_mean")
    seen = lambda c, x: F.when(F.col(c) > 0, x)
    lo, hi = rated.agg(F.max(F.greatest(seen("w01", -1 / h), seen("w10", -1 / a))), F.min(F.least(seen("w00", 1 / (h * a)), seen("w11", F.lit(1.0))))).first()
    lo, hi = -1.0 if lo is None else lo, 1.0 if hi is None else hi
    best, value = 0.0, 0.0
    rated = stored(rated.select("home_mean", "away_mean", *[f"w{x}{y}" for x, y in CELLS]), "rated")
    for _ in range(passes):
        grid = [lo + (hi - lo) * (k + 1) / (points + 1) for k in range(points)]
        gain = sum((F.when(F.col(f"w{x}{y}") > 0, F.col(f"w{x}{y}") * F.ln(tau(x, y, h, a, F.col("rho")))).otherwise(0.0) for x, y in CELLS), F.lit(0.0))
        sums = rated.select("*", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "rho")).groupBy("k").agg(F.sum(gain).alias("gain")).collect()  # one row for each point
        found = [0.0] * points
        for r in sums:
            found[r.k] = r.gain
        k = max(range(points), key=found.__getitem__)
        best, value = grid[k], found[k]
        lo, hi = grid[k - 1] if k else lo, grid[k + 1] if k + 1 < points else hi
    return best, value


# Least squares from a Gram matrix


def gram(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row with n and the sums of products of (1, features, target), the lower triangle row by row: a mergeable aggregate, of a size that only the number of features sets."""
    x = [F.lit(1.0), *map(F.col, features), F.col(target)]
    whole = rows.dropna(subset=[*features, target])
    return whole.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]).alias("sums"))


def least_squares(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """term, coefficient, se, n, r2 of a linear model with an intercept: the sums of products come from one aggregate, Cholesky's factor and the inverse from column arithmetic on its row."""
    p = len(features) + 1
    one = gram(rows, features, target)
    at = lambda i, j: F.col("sums")[max(i, j) * (max(i, j) + 1) // 2 + min(i, j)]
    for i in range(p):
        for j in range(i + 1):
            rest = at(i, j) - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            # A dependent feature leaves no pivot: its terms are null.
            one = one.withColumn(f"l{i}_{j}", F.when(rest > 1e-12 * F.abs(at(i, i)), F.sqrt(rest)) if i == j else rest / F.col(f"l{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            rest = F.lit(1.0 if i == j else 0.0) - sum((F.col(f"l{i}_{k}") * F.col(f"m{k}_{j}") for k in range(j, i)), F.lit(0.0))
            one = one.withColumn(f"m{i}_{j}", rest / F.col(f"l{i}_{i}"))
    inverse = lambda i, j: sum((F.col(f"m{k}_{i}") * F.col(f"m{k}_{j}") for k in range(max(i, j), p)), F.lit(0.0))
    beta = [sum((inverse(i, j) * at(p, j) for j in range(p)), F.lit(0.0)) for i in range(p)]
    one = one.select("n", "sums", *[b.alias(f"b{i}") for i, b in enumerate(beta)], *[inverse(i, i).alias(f"v{i}") for i in range(p)])
    left = at(p, p) - sum((F.col(f"b{i}") * at(p, i) for i in range(p)), F.lit(0.0))
    whole = at(p, p) - at(p, 0) * at(p, 0) / F.col("n")
    one = one.withColumns({"s2": F.try_divide(left, F.col("n") - p), "r2": 1 - F.try_divide(left, whole)})
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"b{i}").alias("coefficient"), F.sqrt(F.col("s2") * F.col(f"v{i}")).alias("se")) for i, t in enumerate(["intercept", *features])])
    return one.select("n", "r2", F.inline(terms)).select("term", "coefficient", "se", "n", "r2")


# Weights of a blend


def blend_weights(rows: DataFrame, members: list[str], target: str, floor: float = 0.05, steps: int = 200, rate: float = 2.0) -> tuple[list[float], float]:
    """The softmax weights of the least log-loss of the members' blend of a 0/1 target, none below floor, and that loss.

    Each step is one aggregate of the loss and its gradient over the rows; the step shrinks when the loss rises. Rows with a member that is not finite are left out."""
    import math

    fine = rows
    for m in members:
        fine = fine.where(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) <= 1))
    fine = stored(fine.select(*[F.col(m).cast("double").alias(m) for m in members], F.col(target).cast("double").alias("y")), "blend")

    def weights(logits: list[float]) -> list[float]:
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        return [floor + (1 - floor * len(e)) * x / sum(e) for x in e]

    def loss(logits: list[float]) -> tuple[float, list[float]]:
        w = weights(logits)
        p = F.greatest(F.least(sum((F.lit(k) * F.col(m) for k, m in zip(w, members, strict=True)), F.lit(0.0)), F.lit(1 - 1e-12)), F.lit(1e-12))
        pull = F.when(F.col("y") == 1, -1 / p).otherwise(1 / (1 - p))
        found = fine.agg(F.avg(F.when(F.col("y") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))), *[F.avg(pull * F.col(m)) for m in members]).first()
        if found[0] is None:
            return 0.0, [0.0] * len(members)
        share = [(x - floor) / (1 - floor * len(w)) for x in w]
        mean = sum(g * s for g, s in zip(found[1:], share, strict=True))
        return found[0], [(1 - floor * len(w)) * s * (g - mean) for g, s in zip(found[1:], share, strict=True)]

    logits = [0.0] * len(members)
    value, slope = loss(logits)
    for _ in range(steps):
        if max(map(abs, slope)) < 1e-7 or rate < 1e-6:
            break
        ahead = [x - rate * g / max(map(abs, slope)) for x, g in zip(logits, slope, strict=True)]
        found, new = loss(ahead)
        if found < value:
            logits, value, slope, rate = ahead, found, new, rate * 1.5
        else:
            rate /= 3
    return weights(logits), value


# Factors of margins


def margin_factors(rated: DataFrame, seen: dict[int, str], weight: str, size: int = 10, rounds: int = 30, tolerance: float = 1e-9) -> dict[int, float]:
    """The log-factors of absolute margins under which the observed margins are likeliest: the chance of a score is Poisson times exp(factor of |i - j|), normalised.

    rated: home, away (means), weight, and for each margin of seen the column of its observed weight. The chance of a margin only needs the Poisson mass of each
    margin, so a pair's grid is summed once to a few numbers; Newton's steps (the likelihood is concave) then sum gradient and curvature in one aggregate each."""
    import numpy as np

    from ledgerline.functions.catalog import cells

    margins = sorted(seen)
    kept = rated.select("home", "away", F.col(weight).cast("double").alias("_w"), *[F.col(seen[m]).cast("double").alias(f"_o{m}") for m in margins]).withColumn("_k", F.monotonically_increasing_id())
    kept = stored(kept, "margins")
    gap = F.abs(F.col("i") - F.col("j"))
    mass = cells(kept.select("_k", "home", "away"), size).groupBy("_k").agg(F.sum("p").alias("_all"), *[F.sum(F.when(gap == m, F.col("p")).otherwise(0.0)).alias(f"_m{m}") for m in margins])
    rows = stored(kept.join(mass, "_k"), "margins")
    theta = np.zeros(len(margins))
    for _ in range(rounds):
        tilted = [F.col(f"_m{m}") * float(np.exp(t)) for m, t in zip(margins, theta, strict=True)]
        total = F.col("_all") + sum((F.col(f"_m{m}") * float(np.exp(t) - 1) for m, t in zip(margins, theta, strict=True)), F.lit(0.0))
        e = [x / total for x in tilted]
        slope = [F.sum(F.col(f"_o{m}") - F.col("_w") * x) for m, x in zip(margins, e, strict=True)]
        curve = [F.sum(F.col("_w") * (e[a] * (1 if a == b else 0) - e[a] * e[b])) for a in range(len(e)) for b in range(a + 1)]
        found = [v or 0.0 for v in rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(slope)], *[c.alias(f"c{k}") for k, c in enumerate(curve)]).first()]
        h = np.zeros((len(e), len(e)))
        for k, (a, b) in enumerate((a, b) for a in range(len(e)) for b in range(a + 1)):
            h[a, b] = h[b, a] = found[len(e) + k]
        step = np.clip(np.linalg.lstsq(h, np.array(found[: len(e)]), rcond=None)[0], -0.5, 0.5)
        theta = theta + step
        if np.abs(step).max(initial=0.0) < tolerance:
            break
    return dict(zip(margins, map(float, theta), strict=True))
