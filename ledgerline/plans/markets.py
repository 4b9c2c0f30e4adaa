"""Price queries: margin removal, consensus, movement, closing value, value bets, racing places, score grids and their markets."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ledgerline.functions import grading, prices
from ledgerline.sources.views import MATCHES, QUOTES, RACES, TICKS, matches, quotes, races, table, ticks

from .registry import query


def r6(c):
    return F.round(c, 6)


_BOOKS = f"{QUOTES}, b AS (SELECT match_id, book, max(odds) FILTER (WHERE selection = 'home') AS h, max(odds) FILTER (WHERE selection = 'draw') AS d, max(odds) FILTER (WHERE selection = 'away') AS a FROM q GROUP BY ALL)"


def books(spark, folder):
    """A row for each match and book with the three prices, null where it has none."""
    one = lambda s: F.max(F.when(F.col("selection") == s, F.col("odds")))
    return quotes(spark, folder).groupBy("match_id", "book").agg(one("home").alias("h"), one("draw").alias("d"), one("away").alias("a"))


def two_way(spark, folder):
    return books(spark, folder).where("h is not null and a is not null").withColumn("o", F.array("h", "a"))


@query(f"WITH {_BOOKS} SELECT match_id, book, round(1 / h + 1 / a - 1, 6) AS margin, round((1 / h) / (1 / h + 1 / a), 6) AS home, round((1 / a) / (1 / h + 1 / a), 6) AS away FROM b WHERE h IS NOT NULL AND a IS NOT NULL")
def x3_devig_proportional(spark, folder):
    """Implied probabilities, margin and proportional margin removal."""
    p = prices.devig_proportional(F.col("o"))
    return two_way(spark, folder).select("match_id", "book", r6(1 / F.col("h") + 1 / F.col("a") - 1).alias("margin"), r6(p[0]).alias("home"), r6(p[1]).alias("away"))


@query(f"""WITH RECURSIVE {_BOOKS}, s AS (SELECT match_id, book, 1 / h AS p, 1 / a AS r, 0.05::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS i FROM b WHERE h IS NOT NULL AND a IS NOT NULL
 UNION ALL SELECT match_id, book, p, r, CASE WHEN pow(p, (lo + hi) / 2) + pow(r, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(p, (lo + hi) / 2) + pow(r, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 60)
SELECT match_id, book, round(pow(p, (lo + hi) / 2), 5) AS home, round(pow(r, (lo + hi) / 2), 5) AS away FROM s WHERE i = 60""")
def x4_devig_power(spark, folder):
    """Power margin removal, the exponent by Newton's steps inside the expression: no Python, no shuffle (X4). The oracle bisects."""
    p = prices.devig_power(F.col("o"))
    return two_way(spark, folder).withColumn("p", p).select("match_id", "book", F.round(F.col("p")[0], 5).alias("home"), F.round(F.col("p")[1], 5).alias("away"))


_SHIN = "sqrt({z} * {z} + 4 * (1 - {z}) * {p} * {p} / (p + r)) / (2 * (1 - {z})) - {z} / (2 * (1 - {z}))"
_Z = "((lo + hi) / 2)"
_MASS = f"({_SHIN.format(z=_Z, p='p')} + {_SHIN.format(z=_Z, p='r')})"


@query(f"""WITH RECURSIVE {_BOOKS}, s AS (SELECT match_id, book, 1 / h AS p, 1 / a AS r, 0.0::DOUBLE AS lo, 0.5::DOUBLE AS hi, 0 AS i FROM b WHERE h IS NOT NULL AND a IS NOT NULL
 UNION ALL SELECT match_id, book, p, r, CASE WHEN {_MASS} > 1 THEN {_Z} ELSE lo END, CASE WHEN {_MASS} > 1 THEN hi ELSE {_Z} END, i + 1 FROM s WHERE i < 60)
SELECT match_id, book, round({_SHIN.format(z=_Z, p='p')}, 5) AS home, round({_SHIN.format(z=_Z, p='r')}, 5) AS away FROM s WHERE i = 60""")
def x5_devig_shin(spark, folder):
    """Shin's margin removal, the insider share by bisection."""
    return two_way(spark, folder).withColumn("p", prices.devig_shin(F.col("o"))).select("match_id", "book", F.round(F.col("p")[0], 5).alias("home"), F.round(F.col("p")[1], 5).alias("away"))


@query(f"""WITH {_BOOKS}, f AS (SELECT match_id, book, h, a, (1 / h) / (1 / h + 1 / a) AS fair, 1 / h + 1 / a - 1 AS margin FROM b WHERE h IS NOT NULL AND a IS NOT NULL)
SELECT match_id, count(*) AS n_books, round(avg(fair), 6) AS consensus, round(max(h) - min(h), 6) AS spread, round(stddev_pop(h), 6) AS sd, round(avg(margin), 6) AS margin, round(max(h), 6) AS best_home, count(*) >= 3 AS enough FROM f GROUP BY match_id""")
def d36_consensus(spark, folder):
    """Consensus over books: fair mean, range, population deviation, margin, at least three books."""
    f = two_way(spark, folder).withColumn("fair", prices.devig_proportional(F.col("o"))[0]).withColumn("m", 1 / F.col("h") + 1 / F.col("a") - 1)
    return f.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_books"), r6(F.avg("fair")).alias("consensus"), r6(F.max("h") - F.min("h")).alias("spread"), r6(F.stddev_pop("h")).alias("sd"), r6(F.avg("m")).alias("margin"), r6(F.max("h")).alias("best_home"), (F.count(F.lit(1)) >= 3).alias("enough"))


@query(f"""WITH {QUOTES}, x AS (SELECT match_id, selection, max(odds) AS best FROM q GROUP BY ALL)
SELECT q.match_id, q.selection, count(*) AS tied, string_agg(CAST(book AS VARCHAR), ',' ORDER BY book) AS books FROM q JOIN x ON q.match_id = x.match_id AND q.selection = x.selection AND q.odds = x.best GROUP BY ALL""")
def n10_price_ties(spark, folder):
    """How many and which books share the best price."""
    top = quotes(spark, folder).groupBy("match_id", "selection", "odds").agg(F.array_sort(F.collect_list("book")).alias("b"))
    return top.groupBy("match_id", "selection").agg(F.max_by("b", "odds").alias("b")).select("match_id", "selection", F.size("b").cast("long").alias("tied"), F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("books"))


@query(f"""WITH {QUOTES}, x AS (SELECT match_id, selection, avg(odds) FILTER (WHERE book = 0) AS sharp, avg(odds) FILTER (WHERE book <> 0) AS rest FROM q GROUP BY ALL) SELECT match_id, selection, round(sharp - rest, 6) AS delta FROM x WHERE sharp IS NOT NULL AND rest IS NOT NULL""")
def n18_sharp_delta(spark, folder):
    """One book against the mean of the others."""
    book = lambda c: F.avg(F.when(c, F.col("odds")))
    x = quotes(spark, folder).groupBy("match_id", "selection").agg(book(F.col("book") == 0).alias("sharp"), book(F.col("book") != 0).alias("rest"))
    return x.where("sharp is not null and rest is not null").select("match_id", "selection", r6(F.col("sharp") - F.col("rest")).alias("delta"))


@query(f"""WITH {TICKS}, x AS (SELECT key, arg_min(price, (ts, event_id)) AS opening, arg_max(price, (ts, event_id)) AS closing, count(*) AS points FROM k GROUP BY key)
SELECT key, opening, closing, round(closing - opening, 6) AS change, round((closing - opening) / opening, 6) AS pct, CASE WHEN closing > opening + 0.05 THEN 'drifting' WHEN closing < opening - 0.05 THEN 'shortening' ELSE 'stable' END AS direction, points, round(opening / closing - 1, 6) AS clv FROM x""")
def w18_movement(spark, folder):
    """Opening against closing price, direction and closing-line value (W18, A15, D5): first and last by one aggregate."""
    x = ticks(spark, folder).groupBy("key").agg(F.min_by("price", F.struct("ts", "event_id")).alias("opening"), F.max_by("price", F.struct("ts", "event_id")).alias("closing"), F.count(F.lit(1)).alias("points"))
    move = F.col("closing") - F.col("opening")
    kind = F.when(F.col("closing") > F.col("opening") + 0.05, "drifting").when(F.col("closing") < F.col("opening") - 0.05, "shortening").otherwise("stable")
    return x.select("key", "opening", "closing", r6(move).alias("change"), r6(move / F.col("opening")).alias("pct"), kind.alias("direction"), "points", r6(F.col("opening") / F.col("closing") - 1).alias("clv"))


_VALUE = f"{_BOOKS}, c AS (SELECT match_id, avg((1 / h) / (1 / h + 1 / a)) AS p, max(h) AS odds FROM b WHERE h IS NOT NULL AND a IS NOT NULL GROUP BY match_id)"


def value_rows(spark, folder):
    f = two_way(spark, folder).withColumn("fair", prices.devig_proportional(F.col("o"))[0])
    return f.groupBy("match_id").agg(F.avg("fair").alias("p"), F.max("h").alias("odds"))


@query(f"""WITH {_VALUE} SELECT match_id, round(p * odds - 1, 6) AS ev, round(p - 1 / odds, 6) AS edge, round(greatest((p * odds - 1) / (odds - 1), 0), 6) AS kelly, round(greatest(least(0.25 * greatest((p * odds - 1) / (odds - 1), 0) * 1000, 25.0), 0), 2) AS stake,
 CASE WHEN p * odds - 1 >= 0.15 AND p >= 0.6 THEN 'very_high' WHEN p * odds - 1 >= 0.1 AND p >= 0.5 THEN 'high' WHEN p * odds - 1 >= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM c WHERE p - 1 / odds > 0.02""")
def d50_value_bets(spark, folder):
    """Value, Kelly fraction, capped stake and confidence of bets above a least edge."""
    c = value_rows(spark, folder).where(F.col("p") - 1 / F.col("odds") > 0.02)
    p, o = F.col("p"), F.col("odds")
    ev, k = prices.expected_value(p, o), prices.kelly(p, o)
    return c.select("match_id", r6(ev).alias("ev"), r6(p - 1 / o).alias("edge"), r6(k).alias("kelly"), prices.capped_stake(0.25 * k * 1000, 1000.0).alias("stake"), prices.confidence(ev, p).alias("confidence"))


@query(f"""WITH {_VALUE}, {MATCHES}, s AS (SELECT m.match_id, m.league_id, c.odds, CASE WHEN home_score > away_score THEN 'won' WHEN home_score = away_score THEN 'void' ELSE 'lost' END AS outcome FROM m JOIN c ON m.match_id = c.match_id WHERE m.status = 'finished')
SELECT league_id, count(*) AS settled, count(*) FILTER (WHERE outcome = 'won') AS won, count(*) FILTER (WHERE outcome = 'void') AS void, round(sum(CASE outcome WHEN 'won' THEN 10 * (odds - 1) WHEN 'lost' THEN -10.0 ELSE 0 END), 4) AS pnl,
 round(100 * sum(CASE outcome WHEN 'won' THEN 10 * (odds - 1) WHEN 'lost' THEN -10.0 ELSE 0 END) / (10 * count(*) FILTER (WHERE outcome <> 'void')), 2) AS roi FROM s GROUP BY league_id""")
def a2_settlement(spark, folder):
    """Grading and profit by league, draws void."""
    m = matches(spark, folder).where("status = 'finished'").select("match_id", "league_id", "home_score", "away_score")
    s = m.join(value_rows(spark, folder).select("match_id", "odds"), "match_id")
    units = F.signum(F.col("home_score") - F.col("away_score"))
    s = s.withColumn("units", units).withColumn("gain", grading.profit(F.col("units"), F.lit(10.0), F.col("odds")))
    bets = F.count_if(F.col("units") != 0)
    return s.groupBy("league_id").agg(F.count(F.lit(1)).alias("settled"), F.count_if(F.col("units") > 0).alias("won"), F.count_if(F.col("units") == 0).alias("void"), F.round(F.sum("gain"), 4).alias("pnl"), F.round(F.try_divide(100 * F.sum("gain"), 10 * bets), 2).alias("roi"))


@query(f"""WITH {MATCHES} SELECT match_id, CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END AS result, CASE WHEN home_score + away_score > 3 THEN 'over' WHEN home_score + away_score < 3 THEN 'under' ELSE 'push' END AS total_3,
 CASE WHEN home_score - away_score > 1.5 THEN 'home' ELSE 'away' END AS spread_15, CASE WHEN home_score > 0 AND away_score > 0 THEN 'yes' ELSE 'no' END AS both_score,
 (sign(home_score - away_score - 0.5) + sign(home_score - away_score - 0.0)) / 2 AS handicap_025, sign(home_score - away_score - 1.0) AS handicap_1 FROM m WHERE status = 'finished'""")
def d42_grading(spark, folder):
    """Outcomes of the result, total, spread, both-score and Asian handicap markets."""
    h, a = F.col("home_score"), F.col("away_score")
    return matches(spark, folder).where("status = 'finished'").select("match_id", grading.result(h, a).alias("result"), grading.total_line(h, a, F.lit(3)).alias("total_3"), grading.spread(h, a, F.lit(-1.5)).alias("spread_15"), grading.both_score(h, a).alias("both_score"), grading.handicap_units(h - a, F.lit(-0.25)).alias("handicap_025"), grading.handicap_units(h - a, F.lit(-1.0)).alias("handicap_1"))


@query(f"""WITH {RACES}, r AS (SELECT race_id, entrant_id, odds, (1 / odds) / sum(1 / odds) OVER (PARTITION BY race_id) AS p, count(*) OVER (PARTITION BY race_id) AS runners FROM e WHERE NOT scratched),
s AS (SELECT a.race_id, a.entrant_id, sum(b.p * a.p / (1 - b.p)) AS second FROM r a JOIN r b ON a.race_id = b.race_id AND a.entrant_id <> b.entrant_id GROUP BY ALL)
SELECT r.race_id, r.entrant_id, round(r.p, 6) AS win, round(least(r.p + coalesce(s.second, 0), 1), 6) AS top_2, CASE WHEN runners <= 4 THEN 0 WHEN runners <= 7 THEN 2 ELSE 3 END AS places, CASE WHEN runners <= 4 THEN 0.0 WHEN runners <= 7 THEN 0.25 ELSE 0.2 END AS fraction
FROM r LEFT JOIN s ON r.race_id = s.race_id AND r.entrant_id = s.entrant_id""")
def x13_harville(spark, folder):
    """Win and top-two probabilities by Harville, and each-way terms (X14): P(2nd) = p (S - p / (1 - p)) with S = sum p / (1 - p), so no pairs are made."""
    by = Window.partitionBy("race_id")
    e = races(spark, folder).where(~F.col("scratched")).withColumn("p", (1 / F.col("odds")) / F.sum(1 / F.col("odds")).over(by)).withColumn("n", F.count(F.lit(1)).over(by))
    share = F.try_divide(F.col("p"), 1 - F.col("p"))
    e = e.withColumn("s", F.when(F.col("n") > 1, F.sum(F.when(F.col("n") > 1, share)).over(by) - share).otherwise(0.0))
    terms = prices.place_terms(F.col("n"))
    return e.select("race_id", "entrant_id", r6("p").alias("win"), r6(F.least(F.col("p") * (1 + F.col("s")), F.lit(1.0))).alias("top_2"), terms["places"].alias("places"), terms["fraction"].alias("fraction"))


GRID = 10


def score_grid(home: Column, away: Column, rho: float = 0.0, size: int = GRID) -> Column:
    """Normalised score probabilities as an array of (i, j, p), with the low-score correction of dependence rho."""
    low = lambda i, j: F.when((i == 0) & (j == 0), 1 - home * away * rho).when((i == 0) & (j == 1), 1 + home * rho).when((i == 1) & (j == 0), 1 + away * rho).when((i == 1) & (j == 1), F.lit(1 - rho)).otherwise(F.lit(1.0))
    axis = F.sequence(F.lit(0), F.lit(size))
    cells = F.flatten(F.transform(axis, lambda i: F.transform(axis, lambda j: F.struct(i.alias("i"), j.alias("j"), (prices.poisson(i, home) * prices.poisson(j, away) * low(i, j)).alias("p")))))
    return F.element_at(F.transform(F.array(cells), lambda g: F.transform(g, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), (x["p"] / F.aggregate(g, F.lit(0.0), lambda a, y: a + y["p"])).alias("p")))), 1)


def mass(grid: Column, condition) -> Column:
    """The probability of the cells (i, j) that meet a condition."""
    return F.aggregate(grid, F.lit(0.0), lambda a, x: a + F.when(condition(x["i"], x["j"]), x["p"]).otherwise(0.0))


@query(f"""WITH r AS (SELECT DISTINCT 0.6 + (p_partkey % 17) / 10.0::DOUBLE AS h, 0.5 + (p_partkey % 13) / 10.0::DOUBLE AS a FROM part), g AS (SELECT range::DOUBLE AS n, CASE WHEN range = 0 THEN 1.0::DOUBLE ELSE factorial(range::INTEGER)::DOUBLE END AS f FROM range({GRID + 1})),
c AS (SELECT h, a, i.n AS i, j.n AS j, exp(-h) * pow(h, i.n) / i.f * exp(-a) * pow(a, j.n) / j.f * CASE WHEN i.n = 0 AND j.n = 0 THEN 1 + 0.1 * h * a WHEN i.n = 0 AND j.n = 1 THEN 1 - 0.1 * h WHEN i.n = 1 AND j.n = 0 THEN 1 - 0.1 * a WHEN i.n = 1 AND j.n = 1 THEN 1.1 ELSE 1.0 END AS p FROM r CROSS JOIN g i CROSS JOIN g j)
SELECT round(h, 1) AS home_rate, round(a, 1) AS away_rate, round(sum(CASE WHEN i > j THEN p END) / sum(p), 6) AS home, round(sum(CASE WHEN i = j THEN p END) / sum(p), 6) AS draw, round(sum(CASE WHEN i + j > 2.5 THEN p END) / sum(p), 6) AS over_25, round(sum(CASE WHEN i > 0 AND j > 0 THEN p END) / sum(p), 6) AS both_score,
 round(sum(CASE WHEN i = 1 AND j = 1 THEN p END) / sum(p), 6) AS score_1_1, round(sum(CASE WHEN j = 0 THEN p END) / sum(p), 6) AS home_clean_sheet, round(sum(CASE WHEN i >= j THEN p END) / sum(p), 6) AS home_or_draw FROM c GROUP BY h, a""")
def d25_market_catalog(spark, folder):
    """Score grids of pairs of rates and the markets read off them (X12, D22, D23, D25, J23): arrays of 121 cells inside the row, no cross join."""
    r = table(spark, folder, "part").select((F.lit(0.6) + F.pmod("p_partkey", F.lit(17)) / 10.0).alias("h"), (F.lit(0.5) + F.pmod("p_partkey", F.lit(13)) / 10.0).alias("a")).distinct()
    r = r.withColumn("g", score_grid(F.col("h"), F.col("a"), -0.1))
    put = lambda f: r6(mass(F.col("g"), f))
    return r.select(F.round("h", 1).alias("home_rate"), F.round("a", 1).alias("away_rate"), put(lambda i, j: i > j).alias("home"), put(lambda i, j: i == j).alias("draw"), put(lambda i, j: i + j > 2.5).alias("over_25"), put(lambda i, j: (i > 0) & (j > 0)).alias("both_score"), put(lambda i, j: (i == 1) & (j == 1)).alias("score_1_1"), put(lambda i, j: j == 0).alias("home_clean_sheet"), put(lambda i, j: i >= j).alias("home_or_draw"))


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100 + p_partkey % 300 ELSE -100 - p_partkey % 300 END AS line FROM part), d AS (SELECT p_partkey, line, round(CASE WHEN line > 0 THEN 1 + line / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / abs(line) END, 2) AS odds FROM a)
SELECT p_partkey, line, odds, CASE WHEN odds >= 2 THEN trunc((odds - 1) * 100)::INTEGER ELSE trunc(-100.0 / (odds - 1))::INTEGER END AS back FROM d""")
def x10_conversions(spark, folder):
    """American and decimal prices."""
    k = F.col("p_partkey")
    p = table(spark, folder, "part").select(k, F.when(k % 2 == 0, 100 + k % 300).otherwise(-100 - k % 300).alias("line")).withColumn("odds", prices.american_to_decimal(F.col("line")))
    return p.select("p_partkey", "line", "odds", prices.decimal_to_american(F.col("odds")).alias("back"))
