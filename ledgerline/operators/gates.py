"""Consensus prices and gates on picks: a fair price of each selection over the books that show it now, and the first rule that a pick breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.prices import devig_power

# The books a consensus needs, the hours a quote stays fresh, markets whose sides carry lines of opposite signs, and markets whose selections overlap.
LEAST_BOOKS = 3
FRESH_HOURS = 6.0
SIGNED_MARKETS = ("asian_handicap", "spread")
OVERLAPPING = {"double_chance": (("12", "1x", "x2"), 2.0)}
# Fixed values: (sport, bet type, enabled, first price refused, greatest value, greatest gap to the market) of the streams that have their own gate, then of sports.
STREAM_GATES = [
    ("mma", "moneyline", False, None, None, None),
    ("tennis", "moneyline", False, None, None, None),
    ("soccer", "over_under", False, None, None, None),
    ("soccer", "odd_even", False, None, None, None),
    ("soccer", "1x2", True, 5.0, 0.40, 0.10),
    ("soccer", "asian_handicap", True, 4.0, 0.30, 0.10),
    ("horse_racing", "win", True, 12.0, 1.0, None),
    ("horse_racing", "place", True, 6.0, 1.0, None),
]
SPORT_GATES = [("nfl", False, None, None, None), ("nba", False, None, None, None), ("nhl", False, None, None, None), ("soccer", True, 8.0, 0.40, 0.10)]
_GATE = "enabled boolean, max_odds double, max_ev double, max_gap double"


def plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def consensus(quotes: DataFrame, now: Column, hours: float = FRESH_HOURS, least: int = LEAST_BOOKS) -> DataFrame:
    """match_id, market, selection, line, books, prob of every selection that a book shows; prob is null under `least` books.

    quotes: match_id, market, book, selection, line, odds, is_live, moved_at, seen_at. A book's latest fresh quote of each selection and
    line counts; the sides of a signed market meet on the home side's line; a book with one selection, a price of 0 or less, or part of an
    overlapping market does not count. Two aggregates: prices of a book to an array (a handful), fair prices to a mean."""
    seen = F.coalesce("seen_at", "moved_at").cast("timestamp")
    fresh = quotes.where(~F.col("is_live") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen) <= int(hours * 3.6e9)))
    q = fresh.select("match_id", plain(F.col("market")).alias("market"), plain(F.col("book")).alias("book"), plain(F.col("selection")).alias("selection"), "line", "odds", "moved_at")
    # Of quotes that moved at once the lower price counts.
    latest = q.groupBy("match_id", "market", "book", "selection", "line").agg(F.max(F.struct("moved_at", (-F.col("odds")).alias("k"))).alias("x"))
    home_line = F.when(F.col("market").isin(*SIGNED_MARKETS) & (F.col("selection") != "home"), -F.col("line")).otherwise(F.col("line"))
    # Adding 0 makes one of the two zeros.
    own = latest.select("match_id", "market", "book", "selection", "line", (home_line + F.lit(0.0)).alias("on"), F.coalesce(-F.col("x.k"), F.lit(0.0)).alias("odds"))
    group = own.groupBy("match_id", "market", "on", "book").agg(F.array_sort(F.collect_list(F.struct("selection", "line", "odds"))).alias("p"))
    odds = F.col("p.odds")
    whole, total = F.lit(True), F.lit(1.0)
    for market, (names, makes) in OVERLAPPING.items():
        whole = F.when(F.col("market") == market, F.array_sort(F.col("p.selection")) == F.array(*map(F.lit, names))).otherwise(whole)
        total = F.when(F.col("market") == market, makes).otherwise(total)
    priced = group.where((F.size("p") >= 2) & F.forall("p", lambda x: x["odds"] > 0) & whole).withColumn("fair", devig_power(odds, total))
    each = priced.select("match_id", "market", F.inline(F.arrays_zip("p.selection", "p.line", "fair")).alias("selection", "line", "fair"))
    n = F.count(F.lit(1))
    return each.groupBy("match_id", "market", "selection", "line").agg(n.alias("books"), F.when(n >= least, F.avg("fair")).alias("prob"))


def gate_of(picks: DataFrame) -> DataFrame:
    """picks (sport, bet_type, ...) with the gate that governs them and where it comes from: their stream, their sport or the default, which bounds nothing."""
    spark = picks.sparkSession
    stream = F.broadcast(spark.createDataFrame(STREAM_GATES, f"_s string, _b string, {_GATE}").select("_s", "_b", F.struct("enabled", "max_odds", "max_ev", "max_gap").alias("_stream")))
    sport = F.broadcast(spark.createDataFrame(SPORT_GATES, f"_s string, {_GATE}").select("_s", F.struct("enabled", "max_odds", "max_ev", "max_gap").alias("_sport")))
    none = F.struct(F.lit(True).alias("enabled"), *[F.lit(None).cast("double").alias(c) for c in ("max_odds", "max_ev", "max_gap")])
    x = picks.withColumns({"_s": plain(F.col("sport")), "_b": plain(F.col("bet_type"))}).join(stream, ["_s", "_b"], "left").join(sport, "_s", "left")
    source = F.when(F.col("_stream").isNotNull(), "stream").when(F.col("_sport").isNotNull(), "sport").otherwise("default")
    return x.withColumns({"gate": F.coalesce("_stream", "_sport", none), "gate_of": source}).drop("_stream", "_sport")


def refusals(picks: DataFrame) -> DataFrame:
    """picks (sport, bet_type, odds, ev, model_prob, market_prob) with gate_of, allowed and reason: the first rule broken, in order. What a set bound cannot see is refused."""
    g = lambda c: F.col("gate")[c]
    rules = [
        (~g("enabled"), F.concat(F.lit("stream_disabled:"), "_s", F.lit(":"), "_b")),
        (g("max_odds").isNotNull() & F.col("odds").isNull(), "unknown_odds"),
        (F.col("odds") >= g("max_odds"), "odds_above_max"),
        (g("max_ev").isNotNull() & F.col("ev").isNull(), "unknown_ev"),
        (F.col("ev") > g("max_ev"), "ev_above_max"),
        (g("max_gap").isNotNull() & F.col("market_prob").isNull(), "no_market_consensus"),
        (g("max_gap").isNotNull() & F.col("model_prob").isNull(), "unknown_model_prob"),
        (F.col("model_prob") - F.col("market_prob") > g("max_gap"), "gap_above_max"),
    ]
    reason = F.coalesce(*[F.when(broken, why if isinstance(why, Column) else F.lit(why)) for broken, why in rules])
    x = gate_of(picks).withColumn("reason", reason)
    return x.withColumn("allowed", F.col("reason").isNull()).drop("gate", "_s", "_b")
