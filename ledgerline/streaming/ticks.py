"""Streams of price observations: windowed rates with a watermark, and change detection with state for each key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.sources.work import shared_dir


def shared(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events files as a stream; the schema is that of the files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(1.0) + F.floor(F.col("value") / 20) / 4).alias("price"), "event_type")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and read it."""
    spark, path = stream.sparkSession, shared(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-log").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and mean price by type and window of event time; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))
    return w.select("event_type", F.unix_seconds("window.start").alias("day"), "n", "mean")


def streamed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Windowed rates of all events: a window is written once, when the watermark has passed its end, and leaves the state then."""
    return finished(windowed(event_stream(spark, folder)), "append")


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the key's latest time and price. Rows that aren't later than the state are late and change nothing."""
    at, price = state.get if state.exists else (None, None)
    out = []
    for f in frames:
        for r in f.sort_values(["ts", "event_id"]).itertuples():
            if at is not None and r.ts.value // 1000 < at:
                continue
            if price is None or r.price != price:
                out.append((r.event_id, key[0], r.price))
            at, price = r.ts.value // 1000, r.price
    state.update((at, price))
    yield pd.DataFrame(out, columns=["event_id", "key", "price"])


def streamed_moves(stream: DataFrame) -> DataFrame:
    """The change log of a stream: custom state, one small row for each key."""
    return stream.groupBy("key").applyInPandasWithState(_moves, "event_id long, key long, price double", "at long, price double", "append", GroupStateTimeout.NoTimeout)
