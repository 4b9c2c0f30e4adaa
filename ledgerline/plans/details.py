"""Details of events: shot quality, ages, wall clocks, weather around the start, key players, lottery odds, canaries, fold variance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators.relational import latest_by, unique
from ledgerline.sources.views import MATCHES, matches, table

from .registry import query

AS_OF = "1998-06-15"

# Goals a shot by its type and by any other, and the place of the net.
SHOTS = {"wrist": 0.10, "snap": 0.09, "slap": 0.07, "backhand": 0.10, "tip-in": 0.18, "deflected": 0.15, "wrap-around": 0.06}
OTHER_SHOT, NET_X, NET_Y = 0.09, 89.0, 0.0
KINDS = [*SHOTS, "penalty", None]


def r6(c):
    return F.round(c, 6)


@query(f"""WITH {MATCHES} SELECT league_id, count(*) FILTER (WHERE match_date < TIMESTAMP '{AS_OF}') AS last_30_days, count(*) FILTER (WHERE match_date >= TIMESTAMP '{AS_OF}') AS next_7_days
FROM m WHERE match_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND match_date <= TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY GROUP BY league_id""")
def f8_around_now(spark, folder):
    """Matches of the last 30 and the next 7 days of a given moment (F8): both bounds reach the scan, and the moment is a parameter."""
    now = F.lit(AS_OF).cast("timestamp")
    m = matches(spark, folder).where(F.col("match_date").between(now - F.expr("INTERVAL 30 DAYS"), now + F.expr("INTERVAL 7 DAYS")))
    return m.groupBy("league_id").agg(F.count_if(F.col("match_date") < now).alias("last_30_days"), F.count_if(F.col("match_date") >= now).alias("next_7_days"))


_KIND = f"CASE p_partkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS) if k) + " END"


@query(f"""WITH s AS (SELECT p_partkey AS shot_id, {_KIND} AS kind, CASE WHEN p_size % 10 > 0 THEN p_size * 2.0::DOUBLE END AS x, (p_partkey % 85 - 42)::DOUBLE AS y FROM part)
SELECT shot_id, kind, round(CASE WHEN x IS NULL THEN 0 ELSE (CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SHOTS.items())} ELSE {OTHER_SHOT} END)::DOUBLE * exp(-sqrt(({NET_X} - x) ** 2 + ({NET_Y} - y) ** 2) / 30) END, 6) AS xg FROM s""")
def x16_shot_quality(spark, folder):
    """Expected goals of a shot: its type's base rate, falling with the distance to the net; 0 without a place (X16). Stand-ins: a part is a shot."""
    kinds = F.array(*[F.lit(k).cast("string") for k in KINDS])
    s = table(spark, folder, "part").select(F.col("p_partkey").alias("shot_id"), F.get(kinds, (F.col("p_partkey") % len(KINDS)).cast("int")).alias("kind"), F.when(F.col("p_size") % 10 > 0, F.col("p_size") * 2.0).alias("x"), (F.col("p_partkey") % 85 - 42).alias("y"))
    base = reduce(lambda c, kv: c.when(F.lower("kind") == kv[0], kv[1]), SHOTS.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_SHOT)
    far = F.sqrt(F.pow(F.lit(NET_X) - F.col("x"), 2) + F.pow(F.lit(NET_Y) - F.col("y"), 2))
    return s.select("shot_id", "kind", r6(F.when(F.col("x").isNull(), 0.0).otherwise(base * F.exp(-far / 30))).alias("xg"))


@query(f"""SELECT o_orderkey, round(date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') / 365.25::DOUBLE, 6) AS age_years, round(epoch(TIMESTAMP '{AS_OF} 12:30:00' - o_orderdate) / 3600.0::DOUBLE, 6) AS hours,
 greatest(abs(o_totalprice - 100000), 5000) AS far, least(o_totalprice, 200000) AS capped, nullif(o_custkey % 4, 0) AS no_zero, coalesce(nullif(o_custkey % 4, 0), -1) AS filled, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS thousands FROM orders""")
def x21_ages(spark, folder):
    """Age in years of 365.25 days, hours since a moment (X21), and the scalar functions GREATEST, LEAST, NULLIF, CEIL, ABS and COALESCE."""
    price, rest = F.col("o_totalprice"), F.nullif(F.col("o_custkey") % 4, F.lit(0))
    hours = (F.unix_micros(F.lit(f"{AS_OF} 12:30:00").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3_600_000_000
    return table(spark, folder, "orders").select(
        "o_orderkey", r6(F.datediff(F.lit(AS_OF).cast("date"), "o_orderdate") / 365.25).alias("age_years"), r6(hours).alias("hours"), F.greatest(F.abs(price - 100000), F.lit(5000.0)).alias("far"),
        F.least(price, F.lit(200000.0)).alias("capped"), rest.alias("no_zero"), F.coalesce(rest, F.lit(-1)).alias("filled"), F.ceil(price / 1000).alias("thousands"),
    )


@query("""WITH w AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 96 * 15) AS wall FROM orders), b AS (SELECT *, make_date(year(wall), 3, 31) AS mar, make_date(year(wall), 10, CASE WHEN year(wall) < 1996 THEN 28 ELSE 31 END) AS oct FROM w),
 s AS (SELECT *, mar - CAST(isodow(mar) % 7 AS INTEGER) + INTERVAL 2 HOUR AS summer, oct - CAST(isodow(oct) % 7 AS INTEGER) + INTERVAL 2 HOUR AS winter FROM b)
SELECT o_orderkey, CAST(epoch(CASE WHEN o_orderkey % 11 = 0 THEN date_trunc('day', wall) WHEN wall >= summer AND wall < winter THEN wall - INTERVAL 1 HOUR ELSE wall END) AS BIGINT) AS kickoff FROM s""")
def x22_wall_clock(spark, folder):
    """Kick-offs written as day/month/year and a London wall clock, as UTC (X22): the repeated hour of October is read as summer time, the skipped one of March as winter time; a time that is not HH:MM leaves midnight."""
    o = table(spark, folder, "orders")
    wall = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 96 * 15).cast("int"))
    raw = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format(wall, "dd/MM/yyyy")).otherwise(F.date_format(wall, "dd/MM/yy")).alias("day"), F.when(F.col("o_orderkey") % 11 == 0, "tbc").otherwise(F.date_format(wall, "HH:mm")).alias("clock"))
    year = F.split("day", "/")[2]
    day = F.concat(F.substring("day", 1, 6), F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < 69, "20").otherwise("19"), year)).otherwise(year))
    timed = F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, "clock"), F.lit("dd/MM/yyyy HH:mm")), "Europe/London")
    return raw.select("o_orderkey", F.unix_seconds(F.when(F.col("clock").rlike(r"^\d{1,2}:\d{2}$"), timed).otherwise(F.try_to_timestamp(day, F.lit("dd/MM/yyyy")))).alias("kickoff"))


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), j AS (SELECT s.event_id, h.value, json_extract(h.props, '$.k')::BIGINT AS k, h.event_type AS code FROM s JOIN events h ON h.user_id = s.user_id AND h.ts >= s.ts - INTERVAL 3 HOUR AND h.ts <= s.ts + INTERVAL 1 HOUR),
 c AS (SELECT event_id, code, count(*) AS n FROM j GROUP BY ALL), d AS (SELECT event_id, arg_min(code, (-n, code)) AS modal FROM c GROUP BY event_id)
SELECT j.event_id, round(avg(value), 6) AS mean, CAST(sum(k) AS BIGINT) AS total, any_value(d.modal) AS modal, count(*) AS hours FROM j JOIN d ON d.event_id = j.event_id GROUP BY j.event_id""")
def d51_weather_window(spark, folder):
    """Readings from 3 hours before to 1 hour after a start, as mean, sum and most common code (D51). Stand-ins: a user is a venue, purchases are starts, events readings.

    The range join is an equi-join on venue and four-hour bucket: a window touches two buckets at most."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    at, width = F.unix_micros(F.col("ts").cast("timestamp")), 4 * 3_600_000_000
    span = lambda hours: F.lit(hours * 3_600_000_000)
    bucket = lambda c: F.floor(c / width)
    starts = e.where("event_type = 'purchase'").select("event_id", "user_id", at.alias("start")).withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("start") - span(3)), bucket(F.col("start") + span(1))))))
    readings = e.select("user_id", at.alias("at"), bucket(at).alias("bucket"), "value", "k", F.col("event_type").alias("code"))
    near = starts.join(readings, ["user_id", "bucket"]).where(F.col("at").between(F.col("start") - span(3), F.col("start") + span(1)))
    by_code = near.groupBy("event_id", "code").agg(F.sum("value").alias("v"), F.count("value").alias("nv"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))
    return by_code.groupBy("event_id").agg(r6(F.sum("v") / F.sum("nv")).alias("mean"), F.sum("k").alias("total"), F.min_by("code", F.struct(-F.col("n"), "code")).alias("modal"), F.sum("n").alias("hours"))


@query("""WITH c AS (SELECT c_nationkey AS squad, c_custkey AS player, c_acctbal AS worth, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer), t AS (SELECT * FROM c WHERE rn <= 5),
 r AS (SELECT t.squad, player, rn, o_orderdate, o_orderkey % 4 AS goals, row_number() OVER (PARTITION BY player ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM t JOIN orders ON o_custkey = player),
 p AS (SELECT squad, player, rn, sum(goals) AS goals, count(*) AS played FROM r WHERE k <= 5 GROUP BY ALL),
 a AS (SELECT t.squad, t.player, t.rn, t.worth, coalesce(p.goals, 0) AS goals, coalesce(p.played, 0) AS played FROM t LEFT JOIN p ON p.player = t.player)
SELECT squad, round(sum(worth), 2) AS top_five_worth, arg_min(player, (-goals, player)) AS top_scorer, CAST(max(goals) AS BIGINT) AS top_goals, round(sum(goals) FILTER (WHERE rn <= 3)::DOUBLE / nullif(sum(played) FILTER (WHERE rn <= 3), 0), 6) AS key_goals FROM a GROUP BY squad""")
def t4_key_players(spark, folder):
    """A squad's five players of most worth, the top scorer of them in the last five games, and the mean of the first three (T4). Stand-ins: nations are squads, customers players, orders games.

    Groups are limited before the shuffle, and only games of chosen players are ranked."""
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("squad"), F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("worth"))
    squad = Window.partitionBy("squad").orderBy(F.desc("worth"), "player")
    top = c.withColumn("rn", F.row_number().over(squad)).where("rn <= 5")
    games = table(spark, folder, "orders").select(F.col("o_custkey").alias("player"), "o_orderdate", "o_orderkey").join(top.select("player"), "player", "left_semi")
    form = latest_by(games, ["player"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).groupBy("player").agg(F.sum(F.col("o_orderkey") % 4).alias("goals"), F.count(F.lit(1)).alias("played"))
    a = top.join(form, "player", "left").fillna(0, ["goals", "played"])
    key = lambda x: F.sum(F.when(F.col("rn") <= 3, F.col(x)))
    return a.groupBy("squad").agg(F.round(F.sum("worth"), 2).alias("top_five_worth"), F.min_by("player", F.struct(-F.col("goals"), "player")).alias("top_scorer"), F.max("goals").alias("top_goals"), r6(F.try_divide(key("goals"), key("played"))).alias("key_goals"))


@query("""WITH e AS (SELECT p_partkey AS era, 35 + p_size AS n, CAST(4 + p_partkey % 4 AS INTEGER) AS k, CAST(9 + p_size % 6 AS INTEGER) AS bonus FROM part), t AS (SELECT *, CAST(unnest(range(0, k + 1)) AS INTEGER) AS m FROM e),
 c AS (SELECT *, coalesce(list_product([(k - i)::DOUBLE / (i + 1) for i in range(m)]), 1) AS hit, coalesce(list_product([(n - k - i)::DOUBLE / (i + 1) for i in range(k - m)]), 1) AS missed, list_product([(n - i)::DOUBLE / (i + 1) for i in range(k)]) AS total FROM t)
SELECT era, m, round(hit * missed / total / bonus, 12) AS with_bonus, round(hit * missed / total * (bonus - 1) / bonus, 12) AS without_bonus, CASE WHEN m = k THEN round(total * bonus) END AS jackpot_odds FROM c""")
def x39_tier_odds(spark, folder):
    """Hypergeometric chances of matching m main numbers with and without the bonus ball, and the jackpot's odds (X39). Stand-ins: a part is a game's era."""
    e = table(spark, folder, "part").select(F.col("p_partkey").alias("era"), (F.col("p_size") + 35).alias("n"), (F.col("p_partkey") % 4 + 4).cast("int").alias("k"), (F.col("p_size") % 6 + 9).cast("int").alias("bonus"))
    t = e.withColumn("m", F.explode(F.sequence(F.lit(0), "k")))

    def choose(n, k):
        return F.when(k < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - i) / (i + 1)))

    n, k, m, bonus = F.col("n"), F.col("k"), F.col("m"), F.col("bonus")
    p, total = choose(k, m) * choose(n - k, k - m) / choose(n, k), choose(n, k)
    return t.select("era", "m", F.round(p / bonus, 12).alias("with_bonus"), F.round(p * (bonus - 1) / bonus, 12).alias("without_bonus"), F.when(m == k, F.round(total * bonus)).alias("jackpot_odds"))


@query(f"""WITH l AS (SELECT l_orderkey, l_discount AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem),
 f AS (SELECT o_custkey % 5 AS league, o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AS recent, CASE WHEN o_custkey % 5 = 1 THEN v <= 0.07 WHEN o_custkey % 5 = 2 AND o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN true WHEN o_custkey % 5 = 3 THEN true ELSE abs(v - 0.05) < 1e-9 END AS dflt
  FROM orders JOIN l ON l_orderkey = o_orderkey AND rn = 1 WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY AND o_orderdate <= TIMESTAMP '{AS_OF}' + INTERVAL 12 HOUR),
 c AS (SELECT league, count(*) FILTER (WHERE recent) AS n_recent, count(*) FILTER (WHERE recent AND dflt) AS d_recent, count(*) FILTER (WHERE NOT recent) AS n_base, count(*) FILTER (WHERE NOT recent AND dflt) AS d_base FROM f GROUP BY league)
SELECT *, CASE WHEN n_recent < 15 THEN NULL WHEN n_base < 15 THEN CASE WHEN d_recent / n_recent >= 0.9 THEN 'warn' END WHEN d_recent / n_recent - d_base / n_base >= 0.25 AND d_recent / n_recent >= 0.5 THEN 'alert' WHEN d_recent / n_recent >= 0.9 AND d_base / n_base >= 0.9 THEN 'warn' END AS severity FROM c""")
def a24_default_rates(spark, folder):
    """Shares of a feature's default value in the last 3 days and in the 25 before, of each match's latest row, with the level they call for (A24). Stand-ins: a line item is a feature row; leagues 1, 2 and 3 have faults put in."""
    now = F.lit(AS_OF).cast("timestamp")
    day = lambda d: now - F.make_dt_interval(days=F.lit(d))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("league"), F.col("o_orderdate").cast("timestamp").alias("at")).where(F.col("at").between(day(28), now + F.expr("INTERVAL 12 HOURS")))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_discount", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").join(o, "l_orderkey")
    last = rows.groupBy("l_orderkey", "league", "at").agg(F.max_by("l_discount", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("v"))
    recent, league = F.col("at") >= day(3), F.col("league")
    default = F.when(league == 1, F.col("v") <= 0.07).when((league == 2) & recent, True).when(league == 3, True).otherwise(F.col("v").isNull() | (F.abs(F.col("v") - 0.05) < 1e-9))
    c = last.groupBy("league").agg(F.count_if(recent).alias("n_recent"), F.count_if(recent & default).alias("d_recent"), F.count_if(~recent).alias("n_base"), F.count_if(~recent & default).alias("d_base"))
    return c.withColumn("severity", default_rate_level())


def default_rate_level():
    """alert where the recent share jumped by 0.25 to 0.5 or more; warn where both shares, or a share without 15 rows to compare, reach 0.9."""
    recent, base = F.try_divide("d_recent", "n_recent"), F.try_divide("d_base", "n_base")
    stuck = F.when(recent >= 0.9, "warn")
    known = F.when((recent - base >= 0.25) & (recent >= 0.5), "alert").when((recent >= 0.9) & (base >= 0.9), "warn")
    return F.when(F.col("n_recent") < 15, None).when(F.col("n_base") < 15, stuck).otherwise(known)


@query(f"""WITH {MATCHES}, d AS (SELECT league_id, strftime(match_date, '%Y-%m') AS fold, (home_score - away_score)::DOUBLE / 4 AS d FROM m WHERE status = 'finished'),
 f AS (SELECT league_id, fold, avg(d) AS mean, var_samp(d) / count(*) AS within FROM d GROUP BY ALL HAVING count(*) >= 2),
 g AS (SELECT league_id, count(*) AS folds, CASE WHEN count(*) >= 3 THEN var_samp(mean) - avg(within) END AS tau2_raw FROM f GROUP BY league_id),
 s AS (SELECT league_id, count(*) AS n, avg(d) AS mean, CASE WHEN count(*) >= 2 THEN stddev_samp(d) END AS sd FROM d GROUP BY league_id)
SELECT s.league_id, n, folds, round(mean, 6) AS mean, round(sd / sqrt(n), 6) AS se, round(tau2_raw, 6) AS tau2_raw, round(greatest(tau2_raw, 0), 6) AS tau2, CAST(ceil(((1.96 + 0.84) * sd / nullif(0.05, 0)) ** 2) AS BIGINT) AS n_for_power FROM s LEFT JOIN g ON g.league_id = s.league_id""")
def n14_fold_variance(spark, folder):
    """Variance of the true fold means by moments, and the rows needed for 80 % power against a difference of 0.05 (N14). Folds are months; everything comes from one sum, sum of squares and count a fold."""
    d = matches(spark, folder).where("status = 'finished'").select("league_id", F.date_format("match_date", "yyyy-MM").alias("fold"), ((F.col("home_score") - F.col("away_score")) / 4).alias("d"))
    f = d.groupBy("league_id", "fold").agg(F.count(F.lit(1)).alias("k"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    some = F.col("k") >= 2
    mean, within = F.when(some, F.col("s") / F.col("k")), F.when(some, (F.col("ss") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1) / F.col("k"))
    g = f.groupBy("league_id").agg(F.sum("k").alias("n"), F.count(mean).alias("folds"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), (F.var_samp(mean) - F.avg(within)).alias("raw"))
    n, raw = F.col("n"), F.when(F.col("folds") >= 3, F.col("raw"))
    sd = F.when(n >= 2, F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)))
    return g.select("league_id", "n", F.when(F.col("folds") > 0, F.col("folds")).alias("folds"), r6(F.col("s") / n).alias("mean"), r6(sd / F.sqrt(n)).alias("se"), r6(raw).alias("tau2_raw"), r6(F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))).alias("tau2"), F.ceil(F.pow((1.96 + 0.84) * sd / 0.05, 2)).alias("n_for_power"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def j19_checked_merge(spark, folder):
    """Inner and left merges that must find one row at most: a repeated key on the right stops the job instead of multiplying rows."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = unique(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), ["l_orderkey"])
    p = unique(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"])
    return li.join(o, "l_orderkey").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "o_orderpriority")
