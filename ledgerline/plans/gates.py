"""Consensus and gate queries over stand-in quotes: sixteen orders are a match, its line items quotes of four markets by six books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.gates import SPORT_GATES, STREAM_GATES, consensus, refusals
from ledgerline.sources.views import table

from .registry import query

HOURS = 24.0 * 900
_ONE = "CASE l_partkey % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
_SELECTION = "CASE l_linenumber % 4 WHEN 0 THEN " + _ONE.format("'home'", "'draw'", "'Away '") + " WHEN 1 THEN " + _ONE.format("'home'", "'away'", "'AWAY'") + " WHEN 2 THEN " + _ONE.format("'1X'", "'12'", "'X2'") + " ELSE " + _ONE.format("'over'", "'under'", "'under'") + " END"
_LINE = "CASE l_linenumber % 4 WHEN 1 THEN (l_quantity % 2) / 2 * CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE 1 END WHEN 3 THEN l_quantity % 2 + 1.5 END"
_ODDS = "CASE WHEN l_partkey % 211 = 0 THEN 0 WHEN l_partkey % 97 = 0 THEN 1 ELSE 1.2 + (l_partkey % 300) / 100 END"
_MARKET = "CASE l_linenumber % 4 WHEN 0 THEN '1x2' WHEN 1 THEN 'asian_handicap' WHEN 2 THEN 'double_chance' ELSE 'over_under' END"
_BOUND = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"

_QUOTES = f"""q AS (SELECT l_orderkey // 16 AS match_id, {_MARKET} AS market, l_suppkey % 6 AS book, lower(trim({_SELECTION})) AS selection, CAST({_LINE} AS DOUBLE) + 0.0::DOUBLE AS line, CAST({_ODDS} AS DOUBLE) AS odds, l_shipdate AS moved_at FROM lineitem WHERE l_returnflag <> 'R'),
 o AS (SELECT *, CASE WHEN market = 'asian_handicap' AND selection <> 'home' THEN -line ELSE line END + 0.0::DOUBLE AS on_line FROM (SELECT *, row_number() OVER (PARTITION BY match_id, market, book, selection, line ORDER BY moved_at DESC, odds) AS rn FROM q WHERE moved_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL {int(HOURS)} HOUR) WHERE rn = 1),
 g AS (SELECT match_id, market, on_line, book, count(*) AS n, min(odds) AS low, sum(1 / nullif(odds, 0)) AS s, CASE WHEN market = 'double_chance' THEN 2 ELSE 1 END::DOUBLE AS total FROM o GROUP BY ALL HAVING count(*) >= 2 AND min(odds) > 0 AND (market <> 'double_chance' OR count(*) = 3)),
 k(i, match_id, market, on_line, book, total, low, s, lo, hi) AS (SELECT 0, match_id, market, on_line, book, total, low, s, 0.05::DOUBLE, 50.0::DOUBLE FROM g
 UNION ALL SELECT i + 1, match_id, market, on_line, book, total, low, s, CASE WHEN mass > total THEN mid ELSE lo END, CASE WHEN mass > total THEN hi ELSE mid END
 FROM (SELECT i, k.match_id, k.market, k.on_line, k.book, total, low, s, lo, hi, (lo + hi) / 2 AS mid, sum(pow(1 / o.odds, (lo + hi) / 2)) AS mass FROM k JOIN o ON o.match_id = k.match_id AND o.market = k.market AND o.on_line IS NOT DISTINCT FROM k.on_line AND o.book = k.book WHERE i < 55 GROUP BY ALL)),
 f AS (SELECT o.match_id, o.market, o.selection, o.line, o.book, CASE WHEN low <= 1 OR lo < 0.050001 OR hi > 49.99999 THEN total / o.odds / s ELSE pow(1 / o.odds, lo) * total / sum(pow(1 / o.odds, lo)) OVER (PARTITION BY o.match_id, o.market, o.on_line, o.book) END AS fair FROM o JOIN k ON o.match_id = k.match_id AND o.market = k.market AND o.on_line IS NOT DISTINCT FROM k.on_line AND o.book = k.book WHERE i = 55),
 c AS (SELECT match_id, market, selection, line, count(*) AS books, CASE WHEN count(*) >= 3 THEN avg(fair) END AS prob FROM f GROUP BY ALL)"""


def shown(spark, folder) -> DataFrame:
    """Quotes of matches: market, book, selection, line, odds, when they moved and were seen, whether in play."""
    sql = lambda s: F.expr(s.replace("l_linenumber % 4", "(l_linenumber % 4)"))
    li = table(spark, folder, "lineitem")
    return li.select(
        F.floor(F.col("l_orderkey") / 16).cast("long").alias("match_id"), sql(_MARKET).alias("market"), (F.col("l_suppkey") % 6).cast("string").alias("book"), sql(_SELECTION).alias("selection"),
        sql(_LINE).cast("double").alias("line"), sql(_ODDS).cast("double").alias("odds"), F.col("l_shipdate").alias("moved_at"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate")).alias("seen_at"), (F.col("l_returnflag") == "R").alias("is_live"),
    )


def priced(spark, folder) -> DataFrame:
    q = shown(spark, folder)
    return consensus(q, F.lit(table(spark, folder, "lineitem").agg(F.max("l_shipdate")).first()[0]), HOURS)


@query(f"WITH RECURSIVE {_QUOTES} SELECT match_id, market, selection, line, books, round(prob, 5) AS prob FROM c")
def d36_power_consensus(spark, folder):
    """Consensus of the books that show a selection now, to the rule (D36): a book's latest quote, fresh and not in play, margins removed by powers to one or, for double chance, two; the sides of a handicap
    meet on lines of opposite signs; under three books there is none. Stand-in quotes are fresh for 900 days."""
    return priced(spark, folder).select("match_id", "market", "selection", "line", "books", F.round("prob", 5).alias("prob"))


_STREAMS = [("soccer", None), (" Soccer ", None), ("NFL", None), ("tennis", "moneyline"), ("horse_racing", "win"), ("horse_racing", "place"), ("curling", None), ("tennis", None)]
_SPORTS = "CASE ((match_id * 3 + books) % 9) " + " ".join(f"WHEN {k} THEN '{s}'" for k, (s, _) in enumerate(_STREAMS)) + " END"
_BETS = "CASE ((match_id * 3 + books) % 9) " + " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in enumerate(_STREAMS) if b) + " ELSE upper(market) END"
_PICKS = """p AS (SELECT match_id, market, selection, line, {sports} AS sport, {bets} AS bet_type, CASE WHEN match_id % 13 <> 0 THEN CASE match_id % 7 WHEN 0 THEN 5.0 WHEN 1 THEN 12.0 WHEN 2 THEN 6.0 ELSE 1.5 + match_id % 9 END END AS odds,
 CASE WHEN match_id % 11 <> 0 THEN CASE match_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.41 ELSE 0.1 END END AS ev, CASE WHEN match_id % 10 <> 0 THEN prob + CASE WHEN match_id % 3 = 0 THEN 0.15 ELSE 0.05 END END AS model_prob, prob AS market_prob FROM c)""".format(sports=_SPORTS, bets=_BETS)
_GATES = f"""gs AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{b}', {e}, {_BOUND(o)}, {_BOUND(v)}, {_BOUND(g)})" for s, b, e, o, v, g in STREAM_GATES)}) t(s, b, e, o, v, g)), gd AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {e}, {_BOUND(o)}, {_BOUND(v)}, {_BOUND(g)})" for s, e, o, v, g in SPORT_GATES)}) t(s, e, o, v, g)),
 j AS (SELECT p.*, lower(trim(coalesce(sport, ''))) AS ps, lower(trim(coalesce(bet_type, ''))) AS pb, CASE WHEN gs.s IS NOT NULL THEN 'stream' WHEN gd.s IS NOT NULL THEN 'sport' ELSE 'default' END AS gate_of, CASE WHEN gs.s IS NOT NULL THEN gs.e WHEN gd.s IS NOT NULL THEN gd.e ELSE true END AS e,
 CASE WHEN gs.s IS NOT NULL THEN gs.o ELSE gd.o END AS mo, CASE WHEN gs.s IS NOT NULL THEN gs.v ELSE gd.v END AS mv, CASE WHEN gs.s IS NOT NULL THEN gs.g ELSE gd.g END AS mg FROM p LEFT JOIN gs ON gs.s = lower(trim(coalesce(sport, ''))) AND gs.b = lower(trim(coalesce(bet_type, ''))) LEFT JOIN gd ON gd.s = lower(trim(coalesce(sport, '')))),
 v AS (SELECT *, CASE WHEN NOT e THEN 'stream_disabled:' || ps || ':' || pb WHEN mo IS NOT NULL AND odds IS NULL THEN 'unknown_odds' WHEN odds >= mo THEN 'odds_above_max' WHEN mv IS NOT NULL AND ev IS NULL THEN 'unknown_ev' WHEN ev > mv THEN 'ev_above_max'
 WHEN mg IS NOT NULL AND market_prob IS NULL THEN 'no_market_consensus' WHEN mg IS NOT NULL AND model_prob IS NULL THEN 'unknown_model_prob' WHEN model_prob - market_prob > mg THEN 'gap_above_max' END AS reason FROM j)"""


@query(f"WITH RECURSIVE {_QUOTES}, {_PICKS}, {_GATES} SELECT match_id, market, selection, line, gate_of, reason IS NULL AS allowed, reason FROM v")
def d37_gate_verdicts(spark, folder):
    """The verdict on each pick (D37): the gate of its stream, else of its sport, else the default, and the first rule it breaks; an unknown price, value, consensus or probability under a set bound is refused.

    The gates are two short fixed lists, joined as broadcasts."""
    c = priced(spark, folder)
    c.createOrReplaceTempView("c")
    picks = spark.sql(f"WITH {_PICKS} SELECT match_id, market, selection, line, sport, bet_type, CAST(odds AS DOUBLE) AS odds, CAST(ev AS DOUBLE) AS ev, model_prob, market_prob FROM p")
    return refusals(picks).select("match_id", "market", "selection", "line", "gate_of", "allowed", "reason")
