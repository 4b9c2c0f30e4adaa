"""Streams over the events: picks graded once, sliding rates, limited requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.sources.views import TICKS, table
from ledgerline.streaming.grading import graded_once, limited, sliding
from ledgerline.streaming.ticks import event_stream, finished

from .registry import query

_MATCH = "m AS (SELECT user_id AS match_id, min(ts) + INTERVAL 20 DAY AS match_date, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 1.25 END AS outcome FROM events GROUP BY user_id)"


@query(f"WITH {TICKS}, {_MATCH} SELECT k.event_id AS pick_id, k.key AS match_id, k.price = m.outcome AS is_correct FROM k JOIN m ON m.match_id = k.key WHERE k.ts <= m.match_date")
def r5_graded_stream(spark, folder):
    """Picks of a stream graded exactly once, against a static side of matches, with repeats dropped inside a watermark of 14 days and hindsight left out (R5, D45). Stand-in: events are picks on their user's match."""
    e = table(spark, folder, "events")
    matches = e.groupBy(F.col("user_id").alias("match_id")).agg((F.min("ts").cast("timestamp") + F.expr("interval 20 days")).alias("match_date")).withColumn("outcome", F.when(F.col("match_id") % 2 == 0, 1.0).otherwise(1.25))
    s = event_stream(spark, folder).select(F.col("event_id").alias("pick_id"), F.col("key").alias("match_id"), F.col("price").alias("pick"), F.col("ts").alias("created_at"), F.col("ts").alias("arrived_at"))
    return finished(graded_once(s, matches), "append")


@query(f"""WITH {TICKS}, w AS (SELECT epoch(date_trunc('minute', ts))::BIGINT - 60 * s.s AS start, event_type, price FROM k, (SELECT unnest([0, 1, 2, 3, 4]) AS s) s)
SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(price), 6) AS mean FROM w WHERE start + 300 <= (SELECT floor(epoch_ms(max(ts)) / 1000.0 - 600) FROM k) GROUP BY start""")
def r8_sliding_rates(spark, folder):
    """Requests, errors and mean of five-minute windows that slide by a minute, from a stream with a watermark of ten minutes (R8, N23): each window once, when it is closed."""
    return finished(sliding(event_stream(spark, folder)), "append").withColumn("mean", F.round("mean", 6))


LIMIT, SECONDS = 3, 3600 * 24


@query(f"""WITH RECURSIVE o AS (SELECT event_id, user_id AS key, epoch_us(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 g(key, i, event_id, held, allowed) AS (SELECT key, 0::BIGINT, NULL::BIGINT, []::BIGINT[], false FROM (SELECT DISTINCT key FROM o)
 UNION ALL SELECT o.key, o.i, o.event_id, CASE WHEN len(list_filter(g.held, lambda t: t > o.at - {SECONDS}000000)) < {LIMIT} THEN list_append(list_filter(g.held, lambda t: t > o.at - {SECONDS}000000), o.at) ELSE list_filter(g.held, lambda t: t > o.at - {SECONDS}000000) END,
 len(list_filter(g.held, lambda t: t > o.at - {SECONDS}000000)) < {LIMIT} FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1)
SELECT event_id, key, allowed FROM g WHERE i > 0""")
def n23_rate_limit(spark, folder):
    """Requests of each client allowed or refused by a limit over a sliding window, in a stream (N23): three a day. State is the times of the allowed ones, with a timer on event time."""
    return finished(limited(event_stream(spark, folder), LIMIT, SECONDS, "30 days"), "append")
