"""Point-in-time feature queries: form, meetings, rest, trends, standings, season-to-date."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.windows import before, days_between, folded, last_n, seconds_before, slope
from ledgerline.sources.views import MATCHES, TEAM_ROWS, matches, table, team_rows

from .registry import query

KEYS, ORDER = ["team_id"], ["match_date", "match_id"]
_W = "PARTITION BY team_id ORDER BY match_date, match_id"


def r6(c):
    return F.round(c, 6)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, avg(o_totalprice) OVER w AS form, date_diff('microsecond', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) / 86400000000.0 AS rest,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT o_custkey, c_name, n_name, o_orderkey, round(form, 6) AS form_5, round(rest, 6) AS rest_days
FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE rn = 1
""")
def d1_flagship(spark, folder):
    """Latest order of each customer with its last-5 form and rest days, joined to its nation."""
    key, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    o = o.withColumn("form_5", r6(F.avg("o_totalprice").over(last_n(key, order, 5))))
    previous = F.lag("o_orderdate").over(Window.partitionBy(*key).orderBy(*order))
    o = o.withColumn("rest_days", r6(days_between(F.col("o_orderdate"), previous)))
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    o = o.withColumn("rn", newest).where("rn = 1")
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_custkey", "c_name", "n_name", "o_orderkey", "form_5", "rest_days")


@query(f"""WITH {TEAM_ROWS} SELECT match_id, team_id, {', '.join(f"round(avg(pts) OVER w{n}, 6) AS ppg_{n}, round(avg(gf) OVER w{n}, 6) AS gf_{n}, round(avg(ga) OVER w{n}, 6) AS ga_{n}, round(avg(CASE WHEN ga = 0 THEN 1.0 ELSE 0.0 END) OVER w{n}, 6) AS clean_{n}" for n in (3, 5, 10, 20))}
FROM t WINDOW {', '.join(f"w{n} AS ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 10, 20))}""")
def w7_team_form(spark, folder):
    """Form over the last 3, 5, 10 and 20 matches before each match (W7, D1): one sort serves all four frames."""
    t = team_rows(spark, folder)
    cols = {}
    for n in (3, 5, 10, 20):
        w = last_n(KEYS, ORDER, n)
        cols |= {f"ppg_{n}": r6(F.avg("pts").over(w)), f"gf_{n}": r6(F.avg("gf").over(w)), f"ga_{n}": r6(F.avg("ga").over(w)), f"clean_{n}": r6(F.avg(F.when(F.col("ga") == 0, 1.0).otherwise(0.0)).over(w))}
    return t.withColumns(cols).select("match_id", "team_id", *cols)


@query(f"WITH {TEAM_ROWS} SELECT match_id, team_id, is_home, round(avg(gf) OVER (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS gf_5, round(avg(gf) OVER (PARTITION BY team_id, is_home ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS gf_5_venue FROM t")
def w8_rolling_per_team(spark, folder):
    """Shifted rolling means, per team and per team and venue (W8, W9, N2); the ungrouped roll of the original leaks and isn't reproduced."""
    t = team_rows(spark, folder)
    return t.select("match_id", "team_id", "is_home", r6(F.avg("gf").over(last_n(KEYS, ORDER, 5))).alias("gf_5"), r6(F.avg("gf").over(last_n(["team_id", "is_home"], ORDER, 5))).alias("gf_5_venue"))


@query(f"WITH {TEAM_ROWS} SELECT match_id, team_id, count(*) OVER w30 AS games_30d, round(avg(pts) OVER w30, 6) AS ppg_30d, count(*) OVER w7 AS games_7d FROM t WINDOW w30 AS (PARTITION BY team_id ORDER BY CAST(epoch(match_date) AS BIGINT) RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING), w7 AS (PARTITION BY team_id ORDER BY CAST(epoch(match_date) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)")
def w10_time_range(spark, folder):
    """Counts and form in the 30 and 7 days before each match (W10, N5), a RANGE frame that excludes the moment itself."""
    t = team_rows(spark, folder)
    w30, w7 = seconds_before(KEYS, "match_date", 2_592_000), seconds_before(KEYS, "match_date", 604_800)
    return t.select("match_id", "team_id", F.count(F.lit(1)).over(w30).alias("games_30d"), r6(F.avg("pts").over(w30)).alias("ppg_30d"), F.count(F.lit(1)).over(w7).alias("games_7d"))


@query(f"""WITH {TEAM_ROWS}, r AS (SELECT *, date_diff('microsecond', lag(match_date) OVER ({_W}), match_date) / 86400000000.0 AS rest FROM t)
SELECT match_id, team_id, round(rest, 6) AS rest_days, CAST(floor(rest) AS BIGINT) AS whole_days, coalesce(rest <= 1.5, false) AS back_to_back, CASE WHEN rest < 4 THEN 'short' WHEN rest > 10 THEN 'long' WHEN rest IS NOT NULL THEN 'normal' END AS rest_class, round(CASE WHEN rest IS NOT NULL THEN least(rest, 30) END, 6) AS rest_capped FROM r""")
def w11_rest_days(spark, folder):
    """Days since the previous match: fractional, floored, capped, and the flags built on them."""
    t = team_rows(spark, folder)
    rest = days_between(F.col("match_date"), F.lag("match_date").over(Window.partitionBy(*KEYS).orderBy(*ORDER)))
    t = t.withColumn("rest", rest)
    kind = F.when(F.col("rest") < 4, "short").when(F.col("rest") > 10, "long").when(F.col("rest").isNotNull(), "normal")
    return t.select("match_id", "team_id", r6("rest").alias("rest_days"), F.floor("rest").alias("whole_days"), F.coalesce(F.col("rest") <= 1.5, F.lit(False)).alias("back_to_back"), kind.alias("rest_class"), r6(F.when(F.col("rest").isNotNull(), F.least(F.col("rest"), F.lit(30.0)))).alias("rest_capped"))


@query(f"""WITH {TEAM_ROWS}, n AS (SELECT *, row_number() OVER ({_W}) AS pos FROM t)
SELECT match_id, team_id, round(CASE WHEN count(pts) OVER w >= 3 THEN regr_slope(pts, pos) OVER w END, 6) + 0.0 AS trend_pts, round(CASE WHEN count(gf) OVER w >= 3 THEN regr_slope(gf, pos) OVER w END, 6) + 0.0 AS trend_gf FROM n WINDOW w AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w12_trend(spark, folder):
    """Linear trend of points and goals over the last 10 matches, from 3 on."""
    t = team_rows(spark, folder).withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER)))
    w = last_n(KEYS, ORDER, 10)
    return t.select("match_id", "team_id", (r6(slope(F.col("pts"), F.col("pos"), w)) + 0.0).alias("trend_pts"), (r6(slope(F.col("gf"), F.col("pos"), w)) + 0.0).alias("trend_gf"))


@query(f"WITH {TEAM_ROWS} SELECT match_id, team_id, round(coalesce(stddev_pop(gf) OVER w / nullif(abs(avg(gf) OVER w), 0), 0), 6) AS cv_gf FROM t WINDOW w AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def w13_consistency(spark, folder):
    """Coefficient of variation over the last 10, population deviation, 0 where the mean is 0."""
    w = last_n(KEYS, ORDER, 10)
    return team_rows(spark, folder).select("match_id", "team_id", r6(F.coalesce(F.try_divide(F.stddev_pop("gf").over(w), F.abs(F.avg("gf").over(w))), F.lit(0.0))).alias("cv_gf"))


@query(f"""WITH {TEAM_ROWS}, l AS (SELECT match_id, team_id, list(gf) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v FROM t)
SELECT match_id, team_id, round(CASE WHEN len(v) > 0 THEN list_reduce(list_transform(v, lambda x: x::DOUBLE), lambda a, x: a * (1 - 2.0 / 6) + x * (2.0 / 6)) END, 6) AS ewa_gf FROM l""")
def w14_weighted_average(spark, folder):
    """Exponentially weighted goals over the last 5, alpha 2 / (n + 1), seeded with the oldest (W14): a fold in the JVM."""
    v = F.collect_list("gf").over(last_n(KEYS, ORDER, 5))
    return team_rows(spark, folder).withColumn("v", v).select("match_id", "team_id", r6(folded(F.col("v"), 2 / 6)).alias("ewa_gf"))


@query(f"""WITH {TEAM_ROWS}, h AS (SELECT *, least(team_id, opponent_id) AS a, greatest(team_id, opponent_id) AS b FROM t)
SELECT match_id, team_id, count(*) OVER w AS meetings, round(avg(CASE WHEN gf > ga THEN 1.0 ELSE 0.0 END) OVER w, 6) AS win_rate, round(avg(CASE WHEN gf > 0 AND ga > 0 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS btts_rate, round(avg(CASE WHEN gf + ga > 2.5 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS over_rate, round(avg(gf - ga) OVER w3, 6) AS gd_recent_3,
 round(date_diff('microsecond', max(match_date) OVER w, match_date) / 86400000000.0, 6) AS days_since FROM h
WINDOW w AS (PARTITION BY a, b, team_id ORDER BY match_date, match_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w3 AS (PARTITION BY a, b, team_id ORDER BY match_date, match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def d2_head_to_head(spark, folder):
    """The last 20 meetings of a pair, seen from each side (D2, N6): pair key by least and greatest instead of an OR join."""
    keys = ["a", "b", "team_id"]
    t = team_rows(spark, folder).withColumns({"a": F.least("team_id", "opponent_id"), "b": F.greatest("team_id", "opponent_id")})
    w, w3 = last_n(keys, ORDER, 20), last_n(keys, ORDER, 3)
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)).over(w))
    return t.select("match_id", "team_id", F.count(F.lit(1)).over(w).alias("meetings"), share(F.col("gf") > F.col("ga")).alias("win_rate"), share((F.col("gf") > 0) & (F.col("ga") > 0)).alias("btts_rate"), share(F.col("gf") + F.col("ga") > 2.5).alias("over_rate"), r6(F.avg(F.col("gf") - F.col("ga")).over(w3)).alias("gd_recent_3"), r6(days_between(F.col("match_date"), F.max("match_date").over(w))).alias("days_since"))


_STANDINGS = "SELECT league_id, season, team_id, count(*) AS played, CAST(sum(CASE WHEN pts = 3 THEN 1 ELSE 0 END) AS BIGINT) AS won, CAST(sum(CASE WHEN pts = 1 THEN 1 ELSE 0 END) AS BIGINT) AS drawn, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(gf) - sum(ga) AS BIGINT) AS gd, CAST(sum(pts) AS BIGINT) AS points FROM t WHERE status = 'finished' GROUP BY league_id, season, team_id"


@query(f"WITH {TEAM_ROWS}, s AS ({_STANDINGS}) SELECT *, row_number() OVER (PARTITION BY league_id, season ORDER BY points DESC, gd DESC, gf DESC, team_id) AS position FROM s")
def a4_standings(spark, folder):
    """League tables by season: points, goal difference, goals (A4)."""
    s = standings(team_rows(spark, folder).where("status = 'finished'"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("league_id", "season").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team_id")).cast("long"))


def standings(rows):
    return rows.groupBy("league_id", "season", "team_id").agg(
        F.count(F.lit(1)).alias("played"), F.count_if(F.col("pts") == 3).alias("won"), F.count_if(F.col("pts") == 1).alias("drawn"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), (F.sum("gf") - F.sum("ga")).alias("gd"), F.sum("pts").alias("points"),
    )


@query(f"""WITH {TEAM_ROWS} SELECT match_id, team_id, CAST(coalesce(sum(CASE WHEN status = 'finished' THEN pts END) OVER w, 0) AS BIGINT) AS points, round(avg(CASE WHEN status = 'finished' THEN gf - ga END) OVER w, 6) AS gd_per_game, count(*) OVER w AS played FROM t
WINDOW w AS (PARTITION BY league_id, season, team_id ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def n3_season_to_date(spark, folder):
    """Points and goal difference of the season so far: the as-of variant of the standings."""
    w = before(["league_id", "season", "team_id"], ORDER)
    done = lambda c: F.when(F.col("status") == "finished", c)
    return team_rows(spark, folder).select("match_id", "team_id", F.coalesce(F.sum(done(F.col("pts"))).over(w), F.lit(0)).alias("points"), r6(F.avg(done(F.col("gf") - F.col("ga"))).over(w)).alias("gd_per_game"), F.count(F.lit(1)).over(w).alias("played"))


@query(f"WITH {MATCHES} SELECT league_id, season, count(*) AS n, round(avg(home_score + away_score), 6) AS avg_goals, round(stddev_samp(home_score + away_score), 6) AS sd_goals, round(avg(CASE WHEN home_score > away_score THEN 1.0 ELSE 0.0 END), 6) AS home_win_rate, round(avg(CASE WHEN home_score = away_score THEN 1.0 ELSE 0.0 END), 6) AS draw_rate FROM m WHERE status = 'finished' GROUP BY league_id, season HAVING count(*) >= 20")
def a6_league_scoring(spark, folder):
    """Scoring of a league and season: mean, sample deviation, home wins and draws, from 20 games on."""
    g = F.col("home_score") + F.col("away_score")
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return matches(spark, folder).where("status = 'finished'").groupBy("league_id", "season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(g)).alias("avg_goals"), r6(F.stddev_samp(g)).alias("sd_goals"), share(F.col("home_score") > F.col("away_score")).alias("home_win_rate"), share(F.col("home_score") == F.col("away_score")).alias("draw_rate")).where("n >= 20")


@query(f"""WITH {TEAM_ROWS}, l AS (SELECT match_id, team_id, list(gf - ga) OVER ({_W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS v FROM t),
u AS (SELECT match_id, team_id, unnest(list_transform(v, lambda x, i: (x * pow(0.5, (len(v) - i) / 8.0))::DOUBLE)) AS num, unnest(list_transform(v, lambda x, i: pow(0.5, (len(v) - i) / 8.0)::DOUBLE)) AS den FROM l)
SELECT l.match_id, l.team_id, round(g, 6) AS gd_half_life FROM l LEFT JOIN (SELECT match_id, team_id, sum(num) / sum(den) AS g FROM u GROUP BY match_id, team_id) s ON l.match_id = s.match_id AND l.team_id = s.team_id""")
def n4_half_life(spark, folder):
    """Goal difference of the last 40 matches, weighted with a half-life of 8 matches."""
    t = team_rows(spark, folder).withColumn("v", F.collect_list(F.col("gf") - F.col("ga")).over(last_n(KEYS, ORDER, 40)))
    weight = lambda i: F.pow(F.lit(0.5), (F.size("v") - 1 - i) / 8.0)
    add = lambda a, x: a + x
    num = F.aggregate(F.transform("v", lambda x, i: x * weight(i)), F.lit(0.0), add)
    den = F.aggregate(F.transform("v", lambda x, i: weight(i)), F.lit(0.0), add)
    return t.select("match_id", "team_id", r6(F.try_divide(num, den)).alias("gd_half_life"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_orderdate) OVER () AS newest, o_orderdate FROM orders)
SELECT o_custkey, round(sum(o_totalprice * exp(-0.002 * w)) / sum(exp(-0.002 * w)), 4) AS recent_price FROM (SELECT *, date_diff('microsecond', o_orderdate, newest) / 86400000000.0 AS w FROM o) GROUP BY o_custkey""")
def w21_recency_weight(spark, folder):
    """Mean price weighted by exp(-0.002 age in days) against the newest date (W21): the maximum is a one-row aggregate, not an unpartitioned window."""
    o = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    newest = o.agg(F.max("o_orderdate").alias("newest"))
    w = F.exp(F.lit(-0.002) * days_between(F.col("newest"), F.col("o_orderdate")))
    return o.crossJoin(F.broadcast(newest)).groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * w) / F.sum(w), 4).alias("recent_price"))


@query(f"""WITH {TEAM_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn FROM t)
SELECT team_id, round(avg(CASE WHEN rn <= 10 THEN pts END), 6) AS recent, round(avg(CASE WHEN rn BETWEEN 11 AND 20 THEN pts END), 6) AS previous, round(avg(CASE WHEN rn <= 10 THEN pts END) - avg(CASE WHEN rn BETWEEN 11 AND 20 THEN pts END), 6) AS change FROM r WHERE rn <= 20 GROUP BY team_id""")
def a23_two_windows(spark, folder):
    """Mean of the last 10 against the 10 before."""
    r = team_rows(spark, folder).withColumn("rn", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("match_date"), F.desc("match_id")))).where("rn <= 20")
    recent, previous = F.avg(F.when(F.col("rn") <= 10, F.col("pts"))), F.avg(F.when(F.col("rn") > 10, F.col("pts")))
    return r.groupBy("team_id").agg(r6(recent).alias("recent"), r6(previous).alias("previous"), r6(recent - previous).alias("change"))


_H, _A = "h.team_id", "a.team_id"


@query(f"""WITH {TEAM_ROWS}, f AS (SELECT match_id, team_id, is_home, avg(pts) OVER w AS ppg, avg(gf) OVER w AS gf5, avg(ga) OVER w AS ga5, count(*) OVER w AS n FROM t WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT h.match_id, round(1500 + (coalesce(h.ppg, 1.5) - 1.5) * 200, 6) AS home_elo, round(1500 + (coalesce(a.ppg, 1.5) - 1.5) * 200, 6) AS away_elo, round(1 / (1 + pow(10.0, ((coalesce(a.ppg, 1.5) - 1.5) * 200 - (coalesce(h.ppg, 1.5) - 1.5) * 200) / 400)), 6) AS home_expectation,
 round((coalesce(h.gf5, 1.3) + coalesce(a.ga5, 1.3)) / 2, 6) AS home_rate, round((coalesce(a.gf5, 1.3) + coalesce(h.ga5, 1.3)) / 2, 6) AS away_rate, round(coalesce(h.ppg, 1.5) - coalesce(a.ppg, 1.5), 6) AS form_gap, h.n >= 5 AND a.n >= 5 AS complete FROM f h JOIN f a ON h.match_id = a.match_id AND h.is_home AND NOT a.is_home""")
def d7_derived(spark, folder):
    """One wide row for each match: both sides' windows, Elo proxy, rates and gaps with neutral defaults."""
    w = last_n(KEYS, ORDER, 5)
    f = team_rows(spark, folder).select("match_id", "is_home", F.avg("pts").over(w).alias("ppg"), F.avg("gf").over(w).alias("gf5"), F.avg("ga").over(w).alias("ga5"), F.count(F.lit(1)).over(w).alias("n"))
    pick = lambda home: F.max(F.when(F.col("is_home") == home, F.struct(F.coalesce("ppg", F.lit(1.5)).alias("ppg"), F.coalesce("gf5", F.lit(1.3)).alias("gf"), F.coalesce("ga5", F.lit(1.3)).alias("ga"), "n")))
    m = f.groupBy("match_id").agg(pick(True).alias("h"), pick(False).alias("a"))
    elo = lambda s: 1500 + (F.col(f"{s}.ppg") - 1.5) * 200
    return m.select("match_id", r6(elo("h")).alias("home_elo"), r6(elo("a")).alias("away_elo"), r6(1 / (1 + F.pow(F.lit(10.0), (elo("a") - elo("h")) / 400))).alias("home_expectation"), r6((F.col("h.gf") + F.col("a.ga")) / 2).alias("home_rate"), r6((F.col("a.gf") + F.col("h.ga")) / 2).alias("away_rate"), r6(F.col("h.ppg") - F.col("a.ppg")).alias("form_gap"), ((F.col("h.n") >= 5) & (F.col("a.n") >= 5)).alias("complete"))


@query("""SELECT o_orderkey, round(sin(2 * pi() * ((dayofweek(o_orderdate) + 6) % 7) / 7), 6) AS dow_sin, round(cos(2 * pi() * ((dayofweek(o_orderdate) + 6) % 7) / 7), 6) AS dow_cos, round(sin(2 * pi() * (month(o_orderdate) - 1) / 12), 6) AS month_sin, round(cos(2 * pi() * (dayofyear(o_orderdate) - 1) / 365), 6) AS doy_cos, ((dayofweek(o_orderdate) + 6) % 7) >= 5 AS weekend,
 round(CASE WHEN month(o_orderdate) IN (6, 7) THEN 1.0 WHEN month(o_orderdate) >= 8 THEN (month(o_orderdate) - 8) / 9.0 ELSE (month(o_orderdate) + 4) / 9.0 END, 6) AS season_phase,
 CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) ELSE (year(o_orderdate) - 1) || '-' || year(o_orderdate) END AS season_label FROM orders""")
def d6_temporal(spark, folder):
    """Cyclic calendar features, weekend flag, season phase and season label."""
    d = F.col("o_orderdate")
    turn = lambda c, n: 2 * F.pi() * c / n
    month, year = F.month(d), F.year(d)
    phase = F.when(month.isin(6, 7), 1.0).when(month >= 8, (month - 8) / 9.0).otherwise((month + 4) / 9.0)
    label = F.when(month >= 7, F.concat_ws("-", year, year + 1)).otherwise(F.concat_ws("-", year - 1, year))
    return table(spark, folder, "orders").select("o_orderkey", r6(F.sin(turn(F.weekday(d), 7))).alias("dow_sin"), r6(F.cos(turn(F.weekday(d), 7))).alias("dow_cos"), r6(F.sin(turn(month - 1, 12))).alias("month_sin"), r6(F.cos(turn(F.dayofyear(d) - 1, 365))).alias("doy_cos"), (F.weekday(d) >= 5).alias("weekend"), r6(phase).alias("season_phase"), label.alias("season_label"))


@query(f"""WITH {MATCHES}, k AS (SELECT match_id, match_date, home_id, away_id FROM m)
SELECT a.match_id, b.match_id AS other_id FROM k a JOIN k b ON a.home_id = b.home_id AND a.away_id = b.away_id AND a.match_id < b.match_id AND abs(date_diff('day', a.match_date::DATE, b.match_date::DATE)) <= 14""")
def j14_duplicate_fixtures(spark, folder):
    """Pairs of fixtures of the same teams within 14 days (J14, N22): time buckets make the band join an equi-join."""
    m = matches(spark, folder).select("match_id", "home_id", "away_id", F.datediff("match_date", F.lit("1990-01-01")).alias("day"))
    a = m.withColumn("bucket", F.floor(F.col("day") / 15))
    b = m.select(F.col("match_id").alias("other_id"), "home_id", "away_id", F.col("day").alias("other_day"), F.explode(F.array(*[F.floor(F.col("day") / 15) + i for i in (-1, 0, 1)])).alias("bucket"))
    return a.join(b, ["home_id", "away_id", "bucket"]).where((F.col("match_id") < F.col("other_id")) & (F.abs(F.col("day") - F.col("other_day")) <= 14)).select("match_id", "other_id")


@query("""WITH c AS (SELECT l_suppkey, l_partkey, l_shipdate, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_quantity DESC) AS rn FROM lineitem),
s AS (SELECT l_suppkey, l_partkey, count(*) AS starts, max(l_shipdate) AS latest FROM c WHERE rn <= 7 GROUP BY l_suppkey, l_partkey)
SELECT l_suppkey, l_partkey AS starter, starts FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY starts DESC, latest DESC, l_partkey) AS r FROM s) WHERE r = 1""")
def w22_recent_starter(spark, folder):
    """The part that occurs most in a supplier's last 7 lines, ties to the most recent."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_partkey"), F.desc("l_quantity"))
    recent = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_orderkey", "l_quantity").withColumn("rn", F.row_number().over(w)).where("rn <= 7")
    s = recent.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("starts"), F.max("l_shipdate").alias("latest"))
    return s.groupBy("l_suppkey").agg(F.max_by(F.struct(F.col("l_partkey").alias("starter"), "starts"), F.struct("starts", "latest", -F.col("l_partkey"))).alias("x")).select("l_suppkey", "x.*")


def elo_stream(start: float, factor: float, edge: float):
    """Ratings before each match, folded over matches sorted by league and date. The state is one league's ratings, so a league of any size streams through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league, rating = None, {}
        for f in frames:
            out = []
            for m in f.itertuples():
                if m.league_id != league:
                    league, rating = m.league_id, {}
                h, a = rating.get(m.home_id, start), rating.get(m.away_id, start)
                score = 1.0 if m.home_score > m.away_score else 0.5 if m.home_score == m.away_score else 0.0
                step = factor * math.log(abs(m.home_score - m.away_score) + 2) * (score - 1 / (1 + 10 ** ((a - h - edge) / 400)))
                rating[m.home_id], rating[m.away_id] = h + step, a - step
                out.append((m.match_id, m.league_id, h, a))
            yield pd.DataFrame(out, columns=["match_id", "league_id", "home_elo", "away_elo"])

    return run


_SCORE = "CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END"
_STEP = f"20 * ln(abs(x - y) + 2) * ({_SCORE} - 1 / (1 + pow(10, (a - h - 60) / 400)))"


@query(f"""WITH RECURSIVE {MATCHES}, o AS (SELECT league_id, match_id, home_id, away_id, home_score AS x, away_score AS y, row_number() OVER (PARTITION BY league_id ORDER BY match_date, match_id) AS i FROM m WHERE status = 'finished'),
 g(league_id, i, r, match_id, h, a) AS (SELECT DISTINCT league_id, 0::BIGINT, MAP([]::BIGINT[], []::DOUBLE[]), NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM o
 UNION ALL SELECT league_id, i, map_concat(r, MAP([home_id, away_id], [h + {_STEP}, a - {_STEP}])), match_id, h, a FROM (SELECT o.*, r, coalesce(element_at(r, home_id)[1], 1500.0::DOUBLE) AS h, coalesce(element_at(r, away_id)[1], 1500.0::DOUBLE) AS a FROM g JOIN o ON o.league_id = g.league_id AND o.i = g.i + 1))
SELECT match_id, league_id, round(h, 4) AS home_elo, round(a, 4) AS away_elo FROM g WHERE i > 0""")
def n1_sequential_elo(spark, folder):
    """True sequential Elo per league (N1, W19): each rating depends on all results before, so a league is one ordered fold; leagues run in parallel."""
    m = matches(spark, folder).where("status = 'finished'").select("match_id", "match_date", "league_id", "home_id", "away_id", "home_score", "away_score")
    m = m.repartition("league_id").sortWithinPartitions("league_id", "match_date", "match_id")
    rated = m.mapInPandas(elo_stream(1500.0, 20.0, 60.0), "match_id long, league_id long, home_elo double, away_elo double")
    return rated.select("match_id", "league_id", F.round("home_elo", 4).alias("home_elo"), F.round("away_elo", 4).alias("away_elo"))
