"""The engine's event-outcome views over the star-schema tables, each with the SQL that defines the same rows.

match: an order; its sides are derived from customer and order keys, so that 50 teams meet often. quote: a line item as a
bookmaker's price. tick: an event as a price observation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.relational import sides
from ledgerline.sources.work import dealt

TEAMS = 50


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    away = F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey") * 3 + 1, F.lit(TEAMS))
    home = F.pmod("o_custkey", F.lit(TEAMS))
    return o.where(home != away).select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("match_date"), home.alias("home_id"), away.alias("away_id"),
        F.pmod(F.col("o_orderkey") * 3 + F.col("o_custkey"), F.lit(5)).alias("home_score"), F.pmod(F.col("o_orderkey") + F.col("o_custkey") * 2, F.lit(4)).alias("away_score"),
        F.pmod("o_custkey", F.lit(5)).alias("league_id"), F.year("o_orderdate").alias("season"),
        F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("postponed").alias("status"),
    )


MATCHES = f"""m AS (SELECT o_orderkey AS match_id, o_orderdate AS match_date, o_custkey % {TEAMS} AS home_id, (o_custkey * 7 + o_orderkey * 3 + 1) % {TEAMS} AS away_id,
 (o_orderkey * 3 + o_custkey) % 5 AS home_score, (o_orderkey + o_custkey * 2) % 4 AS away_score, o_custkey % 5 AS league_id, CAST(year(o_orderdate) AS INTEGER) AS season,
 CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status
 FROM orders WHERE o_custkey % {TEAMS} <> (o_custkey * 7 + o_orderkey * 3 + 1) % {TEAMS})"""


def team_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each side of each match: goals for and against, points."""
    long = sides(matches(spark, folder), {"team_id": "home_id", "opponent_id": "away_id", "gf": "home_score", "ga": "away_score"}, {"team_id": "away_id", "opponent_id": "home_id", "gf": "away_score", "ga": "home_score"})
    return long.withColumn("pts", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))


TEAM_ROWS = MATCHES + """, t0 AS (SELECT match_id, match_date, league_id, season, status, true AS is_home, home_id AS team_id, away_id AS opponent_id, home_score AS gf, away_score AS ga FROM m
 UNION ALL SELECT match_id, match_date, league_id, season, status, false, away_id, home_id, away_score, home_score FROM m),
 t AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM t0)"""


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each match, book and selection: its last line item. Prices lie in 1.5 .. 6."""
    li = table(spark, folder, "lineitem")
    q = li.select(F.col("l_orderkey").alias("match_id"), F.pmod("l_suppkey", F.lit(6)).alias("book"), F.element_at(F.array(*map(F.lit, ("home", "draw", "away"))), (F.pmod("l_partkey", F.lit(3)) + 1).cast("int")).alias("selection"), (F.lit(1.5) + F.pmod("l_partkey", F.lit(900)) / 200).alias("odds"), F.col("l_shipdate").alias("captured_at"))
    return q.groupBy("match_id", "book", "selection").agg(F.max(F.struct("captured_at", "odds")).alias("x")).select("match_id", "book", "selection", "x.odds", "x.captured_at")


QUOTES = """q0 AS (SELECT l_orderkey AS match_id, l_suppkey % 6 AS book, CASE l_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS selection, 1.5::DOUBLE + (l_partkey % 900)::DOUBLE / 200 AS odds, l_shipdate AS captured_at FROM lineitem),
 q AS (SELECT match_id, book, selection, odds, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY match_id, book, selection ORDER BY captured_at DESC, odds DESC) AS rn FROM q0) WHERE rn = 1)"""


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Price observations: a key, a time, a price on a coarse grid so that repeats occur."""
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("key"), "ts", (F.lit(1.0) + F.floor(F.col("value") / 20) / 4).alias("price"), "event_type", "props")


TICKS = "k AS (SELECT event_id, user_id AS key, ts, 1.0::DOUBLE + floor(value / 20) / 4 AS price, event_type, props FROM events)"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Graded predictions: a probability in 0 .. 1 (both ends occur) and a 0/1 outcome, from labels."""
    return table(spark, folder, "labels").select("doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100).alias("p"), F.when(F.pmod(F.col("doc_id") * 53, F.lit(97)) < F.pmod(F.col("doc_id") * 37, F.lit(101)), 1).otherwise(0).alias("y"), F.pmod("doc_id", F.lit(4)).alias("sport"))


PREDICTIONS = "p AS (SELECT doc_id, (doc_id * 37 % 101)::DOUBLE / 100 AS p, CASE WHEN doc_id * 53 % 97 < doc_id * 37 % 101 THEN 1 ELSE 0 END AS y, doc_id % 4 AS sport FROM labels)"


def races(spark: SparkSession, folder: str) -> DataFrame:
    """Race entrants: an order is a race, its suppliers the runners, with a price and a finishing order. Dealt by race once, into parts of bounded size."""
    li = dealt(table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_partkey").alias("x"))
    return li.select(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("entrant_id"), (F.lit(1.5) + F.pmod("x", F.lit(400)) / 20).alias("odds"), F.pmod(F.col("x") * 31, F.lit(997)).alias("pace"), (F.pmod("x", F.lit(23)) == 0).alias("scratched"))


RACES = "e AS (SELECT l_orderkey AS race_id, l_suppkey AS entrant_id, 1.5::DOUBLE + (max(l_partkey) % 400)::DOUBLE / 20 AS odds, max(l_partkey) * 31 % 997 AS pace, max(l_partkey) % 23 = 0 AS scratched FROM lineitem GROUP BY ALL)"
