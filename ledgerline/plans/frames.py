"""Frames to train on and feature sets of single sports: labels with prices from before the start, closing lines, duels, horses, eligibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.sources.views import MATCHES, QUOTES, RACES, TEAM_ROWS, matches, quotes, races, table, team_rows

from .markets import _VALUE, value_rows
from .registry import query

#: Stand-in: a match starts this many days after its order's date, so that some quotes come too late.
START = 60
AS_OF = "1998-06-15"
#: Stand-in: distances that races are run over.
DISTANCES = (1000, 1100, 1200, 1400, 1600, 2000, 2400)


def r6(c):
    return F.round(c, 6)


def day(c):
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def finished(spark, folder):
    return matches(spark, folder).where("status = 'finished'")


@query(f"""WITH {MATCHES}, {QUOTES}, l AS (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)
SELECT m.match_id, m.season, m.league_id, any_value(CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END) AS match_outcome, round(avg(odds) FILTER (WHERE selection = 'home'), 6) AS odds_home,
 round(avg(odds) FILTER (WHERE selection = 'draw'), 6) AS odds_draw, round(avg(odds) FILTER (WHERE selection = 'away'), 6) AS odds_away, any_value(l_discount) AS feature
FROM m LEFT JOIN q ON q.match_id = m.match_id AND q.captured_at < m.match_date + INTERVAL {START} DAY LEFT JOIN l ON l_orderkey = m.match_id AND rn = 1 WHERE status = 'finished' GROUP BY m.match_id, m.season, m.league_id""")
def d14_soccer_frame(spark, folder):
    """Three-class labels of finished matches with mean prices from before the start and the latest feature row (D14). Stand-ins: a line item is a feature row.

    Prices and features are reduced by match first; matches without any keep their row."""
    m = finished(spark, folder)
    q = quotes(spark, folder).join(m.select("match_id", "match_date"), "match_id").where(F.col("captured_at") < F.col("match_date") + F.expr(f"INTERVAL {START} DAYS"))
    mean = lambda s: r6(F.avg(F.when(F.col("selection") == s, F.col("odds")))).alias(f"odds_{s}")
    latest = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.max_by("l_discount", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("feature"))
    label = F.when(F.col("home_score") > F.col("away_score"), 0).when(F.col("home_score") == F.col("away_score"), 1).otherwise(2)
    rows = m.select("match_id", "season", "league_id", label.alias("match_outcome"))
    return rows.join(q.groupBy("match_id").agg(mean("home"), mean("draw"), mean("away")), "match_id", "left").join(latest, "match_id", "left")


@query(f"""WITH {MATCHES}, w AS (SELECT *, CASE match_id % 6 WHEN 1 THEN 'home' WHEN 2 THEN 'tie' WHEN 3 THEN 'draw' WHEN 4 THEN 'away' WHEN 5 THEN 'unknown' END AS winner, CASE match_id % 9 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS preseason FROM m WHERE status = 'finished'),
 u AS (SELECT match_id, 'moneyline' AS frame, CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 1 END AS label FROM w WHERE preseason IS NOT TRUE
 UNION ALL SELECT match_id, 'regulation', CASE WHEN winner = 'home' THEN 0 WHEN winner IN ('tie', 'draw') THEN 1 WHEN winner = 'away' THEN 2 END FROM w WHERE preseason IS NOT TRUE
 UNION ALL SELECT match_id, 'puck_line', CASE WHEN home_score - away_score > 1.5 THEN 0 ELSE 1 END FROM w WHERE preseason IS NOT TRUE
 UNION ALL SELECT match_id, 'total', CASE WHEN home_score + away_score > 5.5 THEN 0 ELSE 1 END FROM w WHERE preseason IS NOT TRUE)
SELECT * FROM u WHERE label IS NOT NULL""")
def d15_hockey_frames(spark, folder):
    """Labels of four hockey markets (D15): ties have no moneyline, both spellings of a regulation tie count, preseason goes but unmarked matches stay. Stand-ins: winner after regulation and preseason mark from the key."""
    key = F.col("match_id")
    winner = F.get(F.array(*[F.lit(x).cast("string") for x in (None, "home", "tie", "draw", "away", "unknown")]), (key % 6).cast("int"))
    preseason = F.when(key % 9 == 0, True).when(key % 9 == 1, None).otherwise(False)
    gap, total = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    labels = {
        "moneyline": F.when(gap > 0, 0).when(gap < 0, 1), "regulation": F.when(winner == "home", 0).when(winner.isin("tie", "draw"), 1).when(winner == "away", 2),
        "puck_line": F.when(gap > 1.5, 0).otherwise(1), "total": F.when(total > 5.5, 0).otherwise(1),
    }
    rows = finished(spark, folder).where(~F.coalesce(preseason, F.lit(False)))
    return rows.select("match_id", F.inline(F.array(*[F.struct(F.lit(k).alias("frame"), v.alias("label")) for k, v in labels.items()]))).where("label is not null")


@query(f"""WITH {MATCHES}, {QUOTES}, l AS (SELECT match_id, avg(book / 2 + 1.5::DOUBLE) FILTER (WHERE selection = 'home') AS total_line, avg(odds) FILTER (WHERE selection = 'home') AS over_odds, avg(odds) FILTER (WHERE selection = 'draw') AS under_odds, avg(book % 3 - 1.5::DOUBLE) FILTER (WHERE selection = 'away') AS home_line FROM q GROUP BY match_id)
SELECT m.match_id, round(total_line, 6) AS closing_total_line, round(over_odds, 6) AS odds_total_over, round(under_odds, 6) AS odds_total_under, round(home_line, 6) AS closing_spread_home, CASE WHEN total_line IS NOT NULL THEN CASE WHEN home_score + away_score > total_line THEN 0 ELSE 1 END END AS total_label,
 CASE WHEN home_line IS NOT NULL THEN CASE WHEN home_score - away_score > -home_line THEN 0 ELSE 1 END END AS spread_label FROM m JOIN l ON l.match_id = m.match_id WHERE status = 'finished' AND (total_line IS NOT NULL OR home_line IS NOT NULL)""")
def d16_line_frames(spark, folder):
    """Totals and spreads with the mean closing line as the label's threshold (D16): a line hit exactly counts as under and as not covered; matches without a line have no label. Stand-ins: home quotes are overs, draw quotes unders, away quotes spreads."""
    mean = lambda s, c: F.avg(F.when(F.col("selection") == s, c))
    lines = quotes(spark, folder).groupBy("match_id").agg(mean("home", F.col("book") / 2 + 1.5).alias("t"), mean("home", F.col("odds")).alias("o"), mean("draw", F.col("odds")).alias("u"), mean("away", F.col("book") % 3 - 1.5).alias("s"))
    x = finished(spark, folder).join(lines.where("t is not null or s is not null"), "match_id")
    label = lambda line, beaten: F.when(line.isNotNull(), F.when(beaten, 0).otherwise(1))
    total, gap, t, s = F.col("home_score") + F.col("away_score"), F.col("home_score") - F.col("away_score"), F.col("t"), F.col("s")
    return x.select("match_id", r6(t).alias("closing_total_line"), r6("o").alias("odds_total_over"), r6("u").alias("odds_total_under"), r6(s).alias("closing_spread_home"), label(t, total > t).alias("total_label"), label(s, gap > -s).alias("spread_label"))


@query(f"""WITH {RACES}, f AS (SELECT *, CASE WHEN NOT scratched THEN row_number() OVER (PARTITION BY race_id, scratched ORDER BY pace, entrant_id) END AS place FROM e), r AS (SELECT *, CASE WHEN place > 1 OR race_id % 3 <> 0 THEN place END AS finish FROM f)
SELECT race_id, entrant_id, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS won, count(*) OVER (PARTITION BY race_id) AS race_field_size, CASE WHEN entrant_id % 2 = 0 THEN pace END AS pace, round(1 / odds, 6) AS implied FROM r WHERE NOT scratched AND race_id IN (SELECT race_id FROM r WHERE finish = 1)""")
def d17_race_frame(spark, folder):
    """Entrants of races that have a recorded winner, scratched ones left out (D17), each with its own features out of the race's JSON blob, race-level ones with a prefix (X34). Stand-ins: pace gives the places, every third race has no recorded winner, odd entrants no features."""
    runner = F.struct("pace", "entrant_id", "odds")
    race = races(spark, folder).where("not scratched").groupBy("race_id").agg(F.array_sort(F.collect_list(runner)).alias("runners"))  # an order has few line items
    known = F.filter("runners", lambda e: e["entrant_id"] % 2 == 0)
    entrants = F.transform(known, lambda e: F.struct(e["entrant_id"].cast("string").alias("entrant_id"), F.struct(e["pace"].alias("pace")).alias("features")))
    race = race.withColumn("blob", F.to_json(F.struct(F.struct(F.size("runners").alias("field_size")).alias("race_level"), entrants.alias("entrants"))))
    race = race.withColumn("finishes", F.transform("runners", lambda e, i: F.when((i > 0) | (F.col("race_id") % 3 != 0), i + 1))).where(F.array_contains("finishes", 1))
    rows = race.withColumn("b", F.from_json("blob", "race_level struct<field_size: long>, entrants array<struct<entrant_id: string, features: struct<pace: long>>>")).select("race_id", "b", "finishes", F.posexplode("runners").alias("i", "e"))
    own = F.get(F.filter("b.entrants", lambda x: x["entrant_id"] == F.col("e.entrant_id").cast("string")), F.lit(0))
    return rows.select("race_id", "e.entrant_id", F.coalesce(F.get("finishes", F.col("i")) == 1, F.lit(False)).cast("int").alias("won"), F.col("b.race_level.field_size").alias("race_field_size"), own["features"]["pace"].alias("pace"), r6(1 / F.col("e.odds")).alias("implied"))


_EARLIER = "ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query(f"""WITH {TEAM_ROWS}, x AS (SELECT *, {_DAY.format("match_date")} AS day, CASE WHEN gf > ga THEN 1 ELSE 0 END AS win FROM t WHERE status = 'finished'),
 s AS (SELECT match_id, is_home, avg(win) OVER p AS pct, day - max(day) OVER p AS rest, coalesce(sum(win) OVER h, 0) AS wins FROM x WINDOW p AS (PARTITION BY team_id {_EARLIER}), h AS (PARTITION BY team_id, opponent_id {_EARLIER}))
SELECT h.match_id, round(h.pct - a.pct, 6) AS win_pct_diff, h.rest AS home_days_rest, a.rest AS away_days_rest, h.rest - a.rest AS days_rest_diff, CASE WHEN h.rest <= 30 THEN 1.0 WHEN h.rest > 30 THEN 0.0 END::DOUBLE AS home_active_30, CASE WHEN a.rest <= 365 THEN 1.0 WHEN a.rest > 365 THEN 0.0 END::DOUBLE AS away_active_365,
 CAST(h.wins - a.wins AS BIGINT) AS h2h_balance FROM s h JOIN s a ON a.match_id = h.match_id AND h.is_home AND NOT a.is_home""")
def d12_duel_features(spark, folder):
    """Win share, days since the last match, activity within 30 (tennis) or 365 days (MMA) and the pair's balance, each side against the other (D12). Only matches of earlier days count; the share is over all of them."""
    x = team_rows(spark, folder).where("status = 'finished'").select("match_id", "is_home", "team_id", "opponent_id", day("match_date").alias("day"), (F.col("gf") > F.col("ga")).cast("int").alias("win"))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    own, pair = earlier("team_id"), earlier("team_id", "opponent_id")
    s = x.select("match_id", "is_home", F.avg("win").over(own).alias("pct"), (F.col("day") - F.max("day").over(own)).alias("rest"), F.coalesce(F.sum("win").over(pair), F.lit(0)).alias("wins"))
    side = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    active = lambda c, limit: F.when(c <= limit, 1.0).when(c > limit, 0.0)
    both = s.groupBy("match_id").agg(*[side(c, home).alias(f"{'home' if home else 'away'}_{c}") for c in ("pct", "rest", "wins") for home in (True, False)])
    h, a = F.col("home_rest"), F.col("away_rest")
    return both.select("match_id", r6(F.col("home_pct") - F.col("away_pct")).alias("win_pct_diff"), h.alias("home_days_rest"), a.alias("away_days_rest"), (h - a).alias("days_rest_diff"), active(h, 30).alias("home_active_30"), active(a, 365).alias("away_active_365"), (F.col("home_wins") - F.col("away_wins")).alias("h2h_balance"))


@query(f"""WITH {RACES}, r AS (SELECT race_id, entrant_id AS horse, (race_id * 3 + entrant_id) % 211 AS jockey, race_id % 4 AS track, {list(DISTANCES)}[race_id % {len(DISTANCES)} + 1] AS distance, {_DAY.format("o_orderdate")} AS day, CASE WHEN pace % 5 = 0 THEN 1 ELSE 0 END AS won FROM e JOIN orders ON o_orderkey = race_id WHERE NOT scratched AND o_orderstatus = 'F'),
 w AS (SELECT *, count(*) OVER c AS course_starts, coalesce(sum(won) OVER c, 0) AS course_wins, day - max(day) OVER h AS layoff, avg(won) OVER j AS jockey_30d FROM r WINDOW h AS (PARTITION BY horse {_EARLIER}), c AS (PARTITION BY horse, track {_EARLIER}), j AS (PARTITION BY jockey ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 d AS (SELECT a.race_id, a.horse, count(*) AS starts, sum(b.won) AS wins FROM r a JOIN r b ON a.horse = b.horse AND b.day < a.day AND b.distance BETWEEN floor(a.distance * 0.9) AND floor(a.distance * 1.1) GROUP BY ALL)
SELECT w.race_id, w.horse, course_starts, CAST(course_wins AS BIGINT) AS course_wins, coalesce(starts, 0) AS distance_starts, CAST(coalesce(wins, 0) AS BIGINT) AS distance_wins, layoff, round(jockey_30d, 6) AS jockey_30d_win_rate FROM w LEFT JOIN d ON d.race_id = w.race_id AND d.horse = w.horse""")
def d13_horse_features(spark, folder):
    """A horse's starts and wins on the course and at distances within a tenth, days since its last race, the jockey's win rate of 30 days, all before the day (D13). Stand-ins: suppliers are horses, the race's key gives track, distance and jockey.

    A run is repeated for each distance that it counts for (a fixed short list), so the range over distances needs no self-join."""
    o = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("race_id"), day("o_orderdate").alias("day"))
    race = F.col("race_id")
    r = races(spark, folder).where("not scratched").join(o, "race_id").select("race_id", F.col("entrant_id").alias("horse"), F.pmod(race * 3 + F.col("entrant_id"), F.lit(211)).alias("jockey"), (race % 4).alias("track"), F.get(F.array(*map(F.lit, DISTANCES)), (race % len(DISTANCES)).cast("int")).alias("distance"), "day", (F.col("pace") % 5 == 0).cast("int").alias("won"))
    earlier = lambda *keys, days=None: Window.partitionBy(*keys).orderBy("day").rangeBetween(-days if days else Window.unboundedPreceding, -1)
    course, near = earlier("horse", "track"), earlier("horse", "target")
    wins = lambda w: F.coalesce(F.sum("won").over(w), F.lit(0))
    r = r.select("*", F.count("won").over(course).alias("course_starts"), wins(course).alias("course_wins"), (F.col("day") - F.max("day").over(earlier("horse"))).alias("layoff"), r6(F.avg("won").over(earlier("jockey", days=30))).alias("jockey_30d_win_rate"))
    targets = F.filter(F.array(*map(F.lit, DISTANCES)), lambda t: F.col("distance").between(F.floor(t * 0.9), F.floor(t * 1.1)))
    x = r.withColumn("target", F.explode(targets)).select("*", F.count("won").over(near).alias("distance_starts"), wins(near).alias("distance_wins")).where("target = distance")
    return x.select("race_id", "horse", "course_starts", "course_wins", "distance_starts", "distance_wins", "layoff", "jockey_30d_win_rate")


@query(f"""WITH {_VALUE}, {TEAM_ROWS}, n AS (SELECT team_id, league_id, count(*) AS n FROM t WHERE status = 'finished' GROUP BY ALL),
 u AS (SELECT m.match_id, coalesce(h.n, 0) AS home_history, coalesce(a.n, 0) AS away_history, c.p * c.odds - 1 AS ev, c.odds FROM m LEFT JOIN n h ON h.team_id = m.home_id AND h.league_id = m.league_id LEFT JOIN n a ON a.team_id = m.away_id AND a.league_id = m.league_id LEFT JOIN c ON c.match_id = m.match_id
  WHERE m.status = 'scheduled' AND m.match_date >= TIMESTAMP '{AS_OF}' AND m.match_date <= TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY)
SELECT match_id, home_history, away_history, round(ev, 6) AS ev, CASE WHEN least(home_history, away_history) < 10 THEN 'thin history' WHEN odds IS NULL THEN 'no price' WHEN odds >= 5 THEN 'odds too long' WHEN ev > 0.5 THEN 'value too good' WHEN ev < 0.02 THEN 'no value' ELSE 'recommended' END AS verdict FROM u""")
def d38_recommendations(spark, folder):
    """Upcoming matches whose sides both have ten finished matches in the league, priced by consensus and put through the gates (D38); the history of a team at home or away is one equi-join over its rows."""
    history = team_rows(spark, folder).where("status = 'finished'").groupBy("team_id", "league_id").agg(F.count(F.lit(1)).alias("n"))
    now = F.lit(AS_OF).cast("timestamp")
    m = matches(spark, folder).where("status = 'scheduled'").where(F.col("match_date").between(now, now + F.expr("INTERVAL 30 DAYS")))
    for s in ("home", "away"):
        m = m.join(history.select(F.col("team_id").alias(f"{s}_id"), "league_id", F.col("n").alias(f"{s}_history")), [f"{s}_id", "league_id"], "left")
    u = m.join(value_rows(spark, folder), "match_id", "left").fillna(0, ["home_history", "away_history"]).withColumn("ev", F.col("p") * F.col("odds") - 1)
    verdict = F.when(F.least("home_history", "away_history") < 10, "thin history").when(F.col("odds").isNull(), "no price").when(F.col("odds") >= 5, "odds too long").when(F.col("ev") > 0.5, "value too good").when(F.col("ev") < 0.02, "no value").otherwise("recommended")
    return u.select("match_id", "home_history", "away_history", r6("ev").alias("ev"), verdict.alias("verdict"))
