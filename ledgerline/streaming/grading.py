"""Streams with bounded state: predictions graded once, sliding rates, and a limiter of requests for each client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def graded_once(picks: DataFrame, matches: DataFrame, days: int = 14, strict: bool = False) -> DataFrame:
    """A stream of picks (pick_id, match_id, pick, created_at, arrived_at) graded against finished matches (match_id, match_date, outcome), each once.

    A pick made after the match began is hindsight and never graded; with strict (bets), nor is one made as it began. A repeated pick is dropped as long as the
    watermark on arrival, days back, may still let it in, which also bounds the state. The matches are a static side: no state is kept for them."""
    in_time = F.col("created_at") < F.col("match_date") if strict else ~F.coalesce(F.col("created_at") > F.col("match_date"), F.lit(False))
    once = picks.withWatermark("arrived_at", f"{days} days").dropDuplicatesWithinWatermark(["pick_id"])
    return once.join(matches, "match_id").where(in_time).select("pick_id", "match_id", (F.col("pick") == F.col("outcome")).alias("is_correct"))


def sliding(stream: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean value of each sliding window of event time (ts, event_type, price); closed windows leave the state."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("price").alias("mean"))
    return w.select(F.unix_seconds("window.start").alias("start"), "n", "errors", "mean")


def limited(stream: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """event_id, key, allowed of each request (event_id, key, ts): it is refused when `limit` allowed ones of its client lie in the `seconds` before it.

    State: the times of a client's allowed requests in the window, `limit` at most; a timer on event time drops a client that is idle for longer."""
    span = int(seconds * 1_000_000)

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, at in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            held = [t for t in held if t > at - span]
            allowed = len(held) < limit
            if allowed:
                held.append(at)
            out.append((event_id, key[0], allowed))
        state.update((held,))
        due = (max(held) + span) // 1000 if held else 0
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["event_id", "key", "allowed"])

    return stream.withWatermark("ts", late).groupBy("key").applyInPandasWithState(judge, "event_id long, key long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
