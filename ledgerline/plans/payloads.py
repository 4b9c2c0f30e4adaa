"""JSON payloads: nested prices, lists of plays, nested features and merged metadata. The texts are made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.nested import flattened, merged
from ledgerline.sources.views import table

from .registry import query

BOOKS = "array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"


@query("""SELECT l_orderkey AS match_id, 'book' || (l_suppkey % 6) AS book, CASE l_linenumber % 2 WHEN 0 THEN 'h2h' ELSE 'totals' END AS market, l_returnflag AS outcome, round(max(l_discount) + 1, 4) AS price, CASE WHEN l_linenumber % 2 = 1 THEN max(l_quantity) END AS point
 FROM lineitem GROUP BY l_orderkey, l_suppkey % 6, l_linenumber % 2, l_returnflag""")
def s5_nested_prices(spark, folder):
    """Prices out of nested payloads, book to market to outcome, as rows (S5): from_json with the payload's schema, three explodes, no shuffle. The payloads are written from line items first."""
    li = table(spark, folder, "lineitem").withColumns({"b": F.concat(F.lit("book"), (F.col("l_suppkey") % 6).cast("string")), "m": F.when(F.col("l_linenumber") % 2 == 0, "h2h").otherwise("totals")})
    o = li.groupBy("l_orderkey", "b", "m", "l_returnflag").agg(F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    outcomes = o.groupBy("l_orderkey", "b", "m").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), (F.col("d") + 1).alias("price"), F.when(F.col("m") == "totals", F.col("q")).alias("point"))).alias("outcomes"))
    markets = outcomes.groupBy("l_orderkey", "b").agg(F.collect_list(F.struct(F.col("m").alias("key"), "outcomes")).alias("markets"))
    payload = markets.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("b").alias("key"), "markets")).alias("bookmakers"))).alias("payload"))
    x = payload.select(F.col("l_orderkey").alias("match_id"), F.explode(F.from_json("payload", f"bookmakers {BOOKS}")["bookmakers"]).alias("b"))
    x = x.select("match_id", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).select("match_id", "book", F.col("m.key").alias("market"), F.inline("m.outcomes"))
    return x.select("match_id", "book", "market", F.col("name").alias("outcome"), F.round("price", 4).alias("price"), "point")


@query("""SELECT user_id AS team_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS attempts, count(*) FILTER (WHERE event_type = 'click') AS on_goal, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS worth
 FROM events WHERE event_id % 4 <> 3 GROUP BY ALL""")
def s6_plays(spark, folder):
    """Counts of plays of one strength out of lists of plays (S6): a game's list is exploded in its row, filtered and counted. Stand-in: a user and day are a game, every fourth event has another strength."""
    e = table(spark, folder, "events")
    play = F.struct(F.struct("event_type").alias("type"), F.when(F.col("event_id") % 4 == 3, "1451").otherwise("1551").alias("situation"), F.struct("value").alias("details"))
    games = e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.to_json(F.struct(F.collect_list(play).alias("plays"))).alias("payload"))
    plays = games.select(F.col("user_id").alias("team_id"), "day", F.inline(F.from_json("payload", "plays array<struct<type:struct<event_type:string>,situation:string,details:struct<value:double>>>")["plays"]))
    t = F.col("type.event_type")
    even = plays.where("situation = '1551'").groupBy("team_id", "day")
    return even.agg(F.count_if(t.isin("click", "view")).alias("attempts"), F.count_if(t == "click").alias("on_goal"), F.round(F.coalesce(F.sum(F.when(t == "purchase", F.col("details.value"))), F.lit(0.0)), 4).alias("worth"))


@query("""WITH e AS (SELECT *, event_id % 7 AS k FROM events) SELECT event_id, name, value FROM (SELECT event_id, 'feature__race_level__k' AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM e
 UNION ALL SELECT event_id, 'feature__race_level__inner__odds_2_5', round(value, 4) FROM e UNION ALL SELECT event_id, 'feature__won', CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END FROM e UNION ALL SELECT event_id, 'feature__deep__a__b__c', k::DOUBLE FROM e WHERE k < 2) WHERE value IS NOT NULL""")
def x33_nested_features(spark, folder):
    """Numbers of nested JSON objects under the names of their paths (X33): VARIANT values, a level a round, booleans as 0 and 1, text, arrays and nulls left out."""
    e, k = table(spark, folder, "events"), F.col("event_id") % 7
    deep = F.when(k < 2, F.concat(F.lit(', "deep": {"a": {"b": {"c": '), k.cast("string"), F.lit('}, "n": null}}')))
    text = F.concat(
        F.lit('{"race_level": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "inner": {"odds.2.5": '), F.round("value", 4).cast("string"), F.lit(', "list": [1, 2]}, "kind": "'), "event_type",
        F.lit('", "nan": "NaN"}, "won": '), (F.col("event_id") % 2 == 0).cast("string"), F.coalesce(deep, F.lit("")), F.lit("}"),
    )
    return flattened(e.select("event_id", text.alias("blob")), "blob")


@query("""SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'new' END AS note, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS source, CASE WHEN o_orderkey % 3 = 2 THEN true END AS final FROM orders""")
def s10_merged_metadata(spark, folder):
    """Metadata merged on conflict (S10): COALESCE(old, '{}') || new, the new members win and keep their types. Read back by key."""
    o, k = table(spark, folder, "orders"), F.col("o_orderkey")
    old = F.when(k % 5 != 0, F.to_json(F.struct(F.when(k % 3 == 1, F.col("o_orderpriority")).alias("note"), F.col("o_custkey").alias("source"))))
    new = F.when(k % 3 == 1, F.to_json(F.struct(F.col("o_orderpriority").alias("note")))).when(k % 3 == 2, F.to_json(F.struct(F.lit("new").alias("note"), F.lit(True).alias("final"))))
    text = merged(old, new)
    return o.select(k.alias("match_id"), text.alias("t")).select("match_id", F.get_json_object("t", "$.note").alias("note"), F.get_json_object("t", "$.source").cast("long").alias("source"), F.get_json_object("t", "$.final").cast("boolean").alias("final"))
