"""Grading of derived markets and settlement of bets. Stand-ins: half-time scores are half of the final ones, some unknown, some wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import grading
from ledgerline.sources.views import MATCHES, matches, table

from .registry import query

_R = "CASE WHEN h > a THEN 'home' WHEN h < a THEN 'away' ELSE 'draw' END"
_RH = "CASE WHEN hh > ha THEN 'home' WHEN hh < ha THEN 'away' ELSE 'draw' END"
_OK = "hh <= h AND ha <= a"
_B = "CASE WHEN h > 0 AND a > 0 THEN 'yes' ELSE 'no' END"
#: market, pick, SQL of what happened, SQL of whether the pick came true where it is not equality (pushes are null).
PICKS = [
    ("match_result", "home", _R, None), ("double_chance", "12", _R, "h <> a"), ("double_chance", "X2", _R, "h <= a"), ("double_chance", "XX", _R, "NULL"), ("moneyline", "away", "CASE WHEN h > a THEN 'home' WHEN h < a THEN 'away' END", None),
    ("btts", "yes", _B, None), ("over_under", "over_2.5", "CASE WHEN h + a > 2.5 THEN 'over_2.5' ELSE 'under_2.5' END", None), ("over_under", "under_3", "CASE WHEN h + a > 3 THEN 'over_3' WHEN h + a < 3 THEN 'under_3' ELSE 'push_3' END", "CASE WHEN h + a <> 3 THEN h + a < 3 END"), ("over_under", "over", "NULL", None),
    ("draw_no_bet", "home", "CASE WHEN h > a THEN 'home' WHEN h < a THEN 'away' ELSE 'push' END", "CASE WHEN h <> a THEN h > a END"), ("correct_score", "2-1", "h || '-' || a", None), ("correct_score", "other", "h || '-' || a", "h || '-' || a NOT IN ('1-0', '2-1', '1-1')"),
    ("asian_handicap", "-0.5_home", "CASE WHEN h > a THEN 'home_covers_-0.5' ELSE 'away_covers_-0.5' END", "h > a"), ("asian_handicap", "-1_away", "CASE WHEN h - a > 1 THEN 'home_covers_-1' WHEN h - a < 1 THEN 'away_covers_-1' ELSE 'push_-1' END", "CASE WHEN h - a <> 1 THEN h - a < 1 END"),
    ("asian_handicap", "-0.75_home", "CASE WHEN h - a > 1 THEN 'home_covers_-0.75' WHEN h - a < 1 THEN 'away_covers_-0.75' ELSE 'push_-0.75' END", "CASE WHEN h - a <> 1 THEN h - a > 1 END"), ("asian_handicap", "0.25_away", "CASE WHEN h > a THEN 'home_covers_0.25' WHEN h < a THEN 'away_covers_0.25' ELSE 'push_0.25' END", "CASE WHEN h <> a THEN h < a END"),
    ("clean_sheet", "home_yes", "CASE WHEN a = 0 THEN 'home_yes' ELSE 'home_no' END", None), ("clean_sheet", "yes", "NULL", None), ("win_to_nil", "away_no", "CASE WHEN a > h AND h = 0 THEN 'away_yes' ELSE 'away_no' END", None),
    ("team_total", "home_over_1.5", "CASE WHEN h > 1.5 THEN 'home_over_1.5' ELSE 'home_under_1.5' END", None), ("team_total", "away_under_2", "CASE WHEN a = 2 THEN 'push' WHEN a > 2 THEN 'away_over_2' ELSE 'away_under_2' END", "CASE WHEN a <> 2 THEN a < 2 END"),
    ("odd_even", "odd", "CASE WHEN (h + a) % 2 = 1 THEN 'odd' ELSE 'even' END", None), ("total_goals", "6+", "CASE WHEN h + a >= 6 THEN '6+' ELSE CAST(h + a AS VARCHAR) END", None), ("winning_margin", "home_3plus", f"CASE WHEN h = a THEN 'draw' ELSE {_R} || '_' || CASE WHEN abs(h - a) >= 3 THEN '3plus' ELSE CAST(abs(h - a) AS VARCHAR) END END", None),
    ("result_btts", "home_yes", f"{_R} || '_' || {_B}", None), ("result_over_under", "away_over", f"{_R} || CASE WHEN h + a > 2.5 THEN '_over' ELSE '_under' END", None), ("match_result_ht", "draw", f"CASE WHEN {_OK} THEN {_RH} END", None), ("btts_ht", "no", f"CASE WHEN {_OK} THEN CASE WHEN hh > 0 AND ha > 0 THEN 'yes' ELSE 'no' END END", None),
    ("over_under_ht", "over_0.5", f"CASE WHEN {_OK} THEN CASE WHEN hh + ha > 0.5 THEN 'over_0.5' ELSE 'under_0.5' END END", None), ("ht_ft_double_result", "draw_home", f"CASE WHEN {_OK} THEN {_RH} || '_' || {_R} END", None), ("player_prop", "x", "NULL", None),
]
_HALVES = f"{MATCHES}, s AS (SELECT match_id, CAST(home_score AS BIGINT) AS h, CAST(away_score AS BIGINT) AS a, CASE WHEN match_id % 7 <> 0 THEN CASE WHEN match_id % 11 = 0 THEN home_score + 1 ELSE home_score // 2 END END AS hh, away_score // 2 AS ha FROM m WHERE status = 'finished')"


def scored(spark, folder):
    m, k = matches(spark, folder).where("status = 'finished'"), F.col("match_id")
    return m.select("match_id", "match_date", F.col("home_score").alias("h"), F.col("away_score").alias("a"), F.when(k % 7 != 0, F.when(k % 11 == 0, F.col("home_score") + 1).otherwise(F.floor(F.col("home_score") / 2))).alias("hh"), F.floor(F.col("away_score") / 2).alias("ha"))


@query(f"WITH {_HALVES}, g AS (" + " UNION ALL ".join(f"SELECT '{m}' AS market, '{p}' AS pick, x AS actual, {c or f'x = {chr(39)}{p}{chr(39)}'} AS is_correct FROM (SELECT *, {x} AS x FROM s)" for m, p, x, c in PICKS) + ") SELECT market, pick, actual, is_correct, count(*) AS n FROM g GROUP BY ALL")
def d43_graded_markets(spark, folder):
    """What happened in each derived market and whether the pick came true (D43): results, totals, handicaps with quarter lines, half-times, margins and combinations, as one expression for each different score; counted by outcome."""
    picks = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(p).alias("pick")) for m, p, _, _ in PICKS])
    x = scored(spark, folder).groupBy("h", "a", "hh", "ha").agg(F.count(F.lit(1)).alias("n")).select("h", "a", "hh", "ha", "n", F.inline(picks))
    x = x.withColumn("actual", grading.actual_outcome(*map(F.col, ("market", "pick", "h", "a", "hh", "ha"))))
    listed = F.array(*map(F.lit, ("1-0", "2-1", "1-1")))
    return x.withColumn("is_correct", grading.is_correct(F.col("market"), F.col("pick"), F.col("actual"), listed)).groupBy("market", "pick", "actual", "is_correct").agg(F.sum("n").alias("n"))


def _ah(margin: str, line: float) -> str:
    if line * 4 % 2:
        lo, hi = _sign(margin, line - 0.25), _sign(margin, line + 0.25)
        return f"CASE {lo} + {hi} WHEN 2 THEN 'won' WHEN 1 THEN 'half_won' WHEN 0 THEN 'push' WHEN -1 THEN 'half_lost' ELSE 'lost' END"
    return f"CASE {_sign(margin, line)} WHEN 1 THEN 'won' WHEN 0 THEN 'push' ELSE 'lost' END"


def _sign(margin: str, line: float) -> str:
    return f"CAST(sign({margin} + {line}) AS INTEGER)"


_WON = lambda c: f"CASE WHEN {c} THEN 'won' ELSE 'lost' END"
#: bet, selection, SQL of its verdict.
BETS = [
    ("1x2", "home", _WON("h > a")), ("Moneyline", "Draw", _WON("h = a")), ("h2h", "nobody", "NULL"), ("over_under", "over_2.5", _WON("h + a > 2.5")), ("total", "under 3", "CASE WHEN h + a = 3 THEN 'push' WHEN h + a < 3 THEN 'won' ELSE 'lost' END"), ("total", "under", "NULL"),
    *[("asian_handicap", f"{side}_{x}", _ah("(h - a)" if side == "home" else "(a - h)", x)) for side in ("home", "away") for x in (-1.25, -0.75, -0.5, 0.0, 0.25, 1.0)], ("spread", "home -1.5", _ah("(h - a)", -1.5)), ("puck_line", "home", "NULL"),
    ("btts", "yes", _WON("h > 0 AND a > 0")), ("double_chance", "1x", _WON("h >= a")), ("double_chance", "zz", "NULL"), ("draw_no_bet", "away", "CASE WHEN h = a THEN 'push' WHEN h < a THEN 'won' ELSE 'lost' END"), ("correct_score", "1-1", _WON("h = 1 AND a = 1")), ("correct_score", "Other", "NULL"), ("match_result_ht", "home", "NULL"),
]
_MONEY = "CASE v WHEN 'won' THEN stake * (odds - 1) WHEN 'half_won' THEN stake / 2 * (odds - 1) WHEN 'lost' THEN -stake WHEN 'half_lost' THEN -stake / 2 WHEN 'push' THEN 0 END"


@query(f"WITH {_HALVES}, g AS (" + " UNION ALL ".join(f"SELECT match_id, '{b}' AS bet, '{s}' AS selection, {v} AS v FROM s" for b, s, v in BETS) + f"), p AS (SELECT *, match_id % 10 + 0.5 AS stake, 1.5 + (match_id % 8) / 4 AS odds FROM g) SELECT bet, selection, v AS verdict, CASE WHEN v IN ('won', 'half_won') THEN 'won' WHEN v IN ('lost', 'half_lost') THEN 'lost' WHEN v = 'push' THEN 'void' END AS status, count(*) AS n, round(CAST(sum({_MONEY}) AS DOUBLE), 4) AS profit FROM p GROUP BY ALL")
def d44_settled_bets(spark, folder):
    """Bets settled from their own selection, quarter lines half won and half lost, money in decimals (D44, D40); what the final score can't settle stays open. Summed by verdict."""
    bets = F.array(*[F.struct(F.lit(b).alias("bet"), F.lit(s).alias("selection")) for b, s, _ in BETS])
    k = F.col("match_id")
    money = {"stake": k % 10 + F.lit(0.5), "odds": F.lit(1.5) + k % 8 / 4}
    # Bets of equal scores, stakes and odds have equal verdicts and profits, and these are exact decimals: each is settled once and counts as often as it occurs.
    x = scored(spark, folder).withColumns(money).groupBy("h", "a", "stake", "odds").agg(F.count(F.lit(1)).alias("n")).select("*", F.inline(bets)).withColumn("verdict", grading.settled(*map(F.col, ("bet", "selection", "h", "a"))))
    x = x.withColumn("profit", grading.profit_of(F.col("verdict"), F.col("stake"), F.col("odds")) * F.col("n").cast("decimal(12,0)"))
    return x.groupBy("bet", "selection", "verdict", grading.status_of(F.col("verdict")).alias("status")).agg(F.sum("n").alias("n"), F.round(F.sum("profit").cast("double"), 4).alias("profit"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 <> 0 THEN l_shipdate END AS made, o_orderdate + INTERVAL 60 DAY AS kickoff, CASE WHEN l_linenumber = 1 THEN false END AS graded, l_partkey % 2 = o_custkey % 2 AS verdict FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
 y AS (SELECT *, CASE WHEN graded IS NOT NULL THEN graded WHEN (made > kickoff) IS NOT TRUE THEN verdict END AS p, CASE WHEN (made >= kickoff) IS NOT TRUE THEN true END AS bettable FROM x)
SELECT p AS is_correct, CASE WHEN p IS NOT NULL AND bettable THEN CASE WHEN p THEN 'won' ELSE 'lost' END ELSE 'pending' END AS status, count(*) AS n FROM y GROUP BY ALL""")
def d45_graded_once(spark, folder):
    """Rows graded once (D45): a grade that stands is kept, predictions made after the kick-off stay open, and bets made at it or later stay pending. Stand-in: an item is a prediction with a bet, shipped when it was made."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate")
    x = li.join(table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey")
    made, kickoff = F.when(F.col("l_partkey") % 9 != 0, F.col("l_shipdate")), F.col("o_orderdate") + F.expr("interval 60 days")
    verdict = F.col("l_partkey") % 2 == F.col("o_custkey") % 2
    p = grading.graded_row(F.when(F.col("l_linenumber") == 1, F.lit(False)), verdict, made, kickoff)
    x = x.select(p.alias("is_correct"), made.alias("made"), kickoff.alias("kickoff"))
    bet = grading.graded_row(F.lit(None).cast("string"), F.when(F.col("is_correct"), "won").when(~F.col("is_correct"), "lost"), F.col("made"), F.col("kickoff"), strict=True)
    return x.select("is_correct", F.coalesce(bet, F.lit("pending")).alias("status")).groupBy("is_correct", "status").agg(F.count(F.lit(1)).alias("n"))


HOURS = 72
_VOIDS = f"""b AS (SELECT l_orderkey, l_linenumber, CASE WHEN o_orderpriority LIKE '5%' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'P' THEN 'postponed' ELSE 'scheduled' END AS status, o_orderdate AS kickoff, o_orderdate - INTERVAL 1 DAY * (l_partkey % 9 - 1) AS made,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate - INTERVAL 1 DAY * (o_orderkey % 6) END AS was, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate - INTERVAL 1 DAY * (o_orderkey % 6 - 1) END AS told, o_orderkey % 10 = 0 AS twin FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT max(o_orderdate) AS now FROM orders)"""


@query(f"""WITH {_VOIDS} SELECT status, CASE WHEN status = 'finished' AND made >= kickoff THEN 'void: written after kickoff' WHEN status = 'finished' AND kickoff - was > INTERVAL {HOURS} HOUR AND made < told THEN 'void: match postponed >72h' WHEN status = 'finished' THEN 'settle'
 WHEN status = 'postponed' AND kickoff + INTERVAL {HOURS} HOUR < now THEN 'void: match postponed >72h' WHEN status = 'cancelled' AND twin THEN 'settle with twin' WHEN status = 'cancelled' AND kickoff + INTERVAL {HOURS} HOUR < now THEN 'void: match cancelled' ELSE 'open' END AS verdict, count(*) AS n FROM b, n GROUP BY ALL""")
def d46_bet_voids(spark, folder):
    """What becomes of open bets that no score decides (D46): made at or after the kick-off, on a match that is postponed or was played more than 72 hours after the kick-off they were made for, or on one that is cancelled
    and no duplicate of a played one."""
    o = table(spark, folder, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    day = lambda k: F.make_interval(days=k.cast("int"))
    moved, key = F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")
    status = F.when(F.col("o_orderpriority").startswith("5"), "cancelled").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled")
    m = o.select(key, status.alias("status"), F.col("o_orderdate").alias("kickoff"), F.when(moved, F.col("o_orderdate") - day(key % 6)).alias("was"), F.when(moved, F.col("o_orderdate") - day(key % 6 - 1)).alias("told"), (key % 10 == 0).alias("twin"))
    b = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(m, "o_orderkey").withColumn("made", F.col("kickoff") - day(F.col("l_partkey") % 9 - 1)).crossJoin(F.broadcast(now))
    span, is_ = F.make_interval(hours=F.lit(HOURS)), F.col("status")
    old = F.col("kickoff") + span < F.col("now")
    verdict = (
        F.when((is_ == "finished") & (F.col("made") >= F.col("kickoff")), "void: written after kickoff").when((is_ == "finished") & (F.col("kickoff") > F.col("was") + span) & (F.col("made") < F.col("told")), "void: match postponed >72h")
        .when(is_ == "finished", "settle").when((is_ == "postponed") & old, "void: match postponed >72h").when((is_ == "cancelled") & F.col("twin"), "settle with twin").when((is_ == "cancelled") & old, "void: match cancelled").otherwise("open")
    )
    return b.groupBy("status", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_CLASSES = f"""{MATCHES}, c AS (SELECT league_id AS league, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS y, (match_id % 7 + 1)::DOUBLE AS a, (match_id % 5 + 1)::DOUBLE AS b, (match_id % 11 + 1)::DOUBLE AS d FROM m WHERE status = 'finished'),
 q AS (SELECT league, y, a / (a + b + d) AS p0, b / (a + b + d) AS p1, d / (a + b + d) AS p2, CASE WHEN a >= b AND a >= d THEN 0 WHEN b >= d THEN 1 ELSE 2 END AS z FROM c), k AS (SELECT unnest([0, 1, 2]) AS k),
 t AS (SELECT league, k, count(*) FILTER (WHERE y = k AND z = k)::DOUBLE AS tp, count(*) FILTER (WHERE z = k)::DOUBLE AS said, count(*) FILTER (WHERE y = k)::DOUBLE AS was, count(*)::DOUBLE AS n, avg(((CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) - CAST(y = k AS INTEGER)) ** 2) AS brier FROM q, k GROUP BY ALL),
 f AS (SELECT league, sum(CASE WHEN said > 0 THEN tp / said ELSE 0 END * was / n) AS precision, sum(CASE WHEN was > 0 THEN tp / was ELSE 0 END * was / n) AS recall, sum(CASE WHEN said + was > 0 THEN 2 * tp / (said + was) ELSE 0 END * was / n) AS f1, avg(brier) AS brier FROM t GROUP BY league)"""


@query(f"""WITH {_CLASSES} SELECT q.league, count(*) AS n, round(avg(CAST(y = z AS INTEGER)), 6) AS accuracy, round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss, round(any_value(f.brier), 6) AS brier,
 round(avg(((p0 - CAST(y = 0 AS INTEGER)) ** 2 + (p0 + p1 - CAST(y <= 1 AS INTEGER)) ** 2) / 2), 6) AS rps, round(any_value(precision), 6) AS precision, round(any_value(recall), 6) AS recall, round(any_value(f1), 6) AS f1 FROM q JOIN f ON f.league = q.league GROUP BY q.league""")
def d31_three_way_scores(spark, folder):
    """Scores of three-way predictions (D31): accuracy, log-loss, the mean of the classes' Brier scores, the ranked probability score, and precision, recall and F1 weighted by class; one aggregate. Stand-in probabilities."""
    k = F.col("match_id")
    m = matches(spark, folder).where("status = 'finished'").select(F.col("league_id").alias("league"), F.when(F.col("home_score") > F.col("away_score"), 0).when(F.col("home_score") == F.col("away_score"), 1).otherwise(2).alias("y"), F.array(k % 7 + 1, k % 5 + 1, k % 11 + 1).alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    q = m.select("league", "y", F.transform("w", lambda x: x / total).alias("p"), (F.array_position("w", F.array_max("w")) - 1).alias("z"))
    p, y, z = F.col("p"), F.col("y"), F.col("z")
    rps = (F.pow(p[0] - (y == 0).cast("int"), 2) + F.pow(p[0] + p[1] - (y <= 1).cast("int"), 2)) / 2
    per = [c for i in range(3) for c in (F.count_if((y == i) & (z == i)).alias(f"tp{i}"), F.count_if(z == i).alias(f"said{i}"), F.count_if(y == i).alias(f"was{i}"), F.avg(F.pow(p[i] - (y == i).cast("int"), 2)).alias(f"b{i}"))]
    g = q.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg((y == z).cast("int")).alias("accuracy"), F.avg(-F.ln(F.get(p, y))).alias("log_loss"), F.avg(rps).alias("rps"), *per)
    part = lambda top, under: sum((F.coalesce(F.try_divide(F.col(f"tp{i}") * top, under(i)), F.lit(0.0)) * F.col(f"was{i}") / F.col("n") for i in range(3)), F.lit(0.0))
    r = lambda c, name: F.round(c, 6).alias(name)
    return g.select("league", "n", r("accuracy", "accuracy"), r("log_loss", "log_loss"), r((F.col("b0") + F.col("b1") + F.col("b2")) / 3, "brier"), r("rps", "rps"), r(part(1, lambda i: F.col(f"said{i}")), "precision"), r(part(1, lambda i: F.col(f"was{i}")), "recall"), r(part(2, lambda i: F.col(f"said{i}") + F.col(f"was{i}")), "f1"))
