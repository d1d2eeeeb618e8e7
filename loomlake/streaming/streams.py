"""Structured Streaming forms of log ingest, health counters and conversion. Sources are any streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def ingest_log(stream: DataFrame, key: str, ts: str, watermark: str = "1 hour") -> DataFrame:
    """The first row of each key; state of keys older than the watermark is dropped."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def event_health(events: DataFrame, ts: str = "ts", window: str = "1 day", watermark: str | None = "1 day") -> DataFrame:
    """Calls, errors and largest token count by window and event type; works on streams and tables alike."""
    df = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    g = df.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("tokens").alias("max_tokens"))
    return g.select(F.col("w.start").alias("start"), "event_type", "calls", "errors", "max_tokens")


def convert_stream(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], keep=None) -> DataFrame:
    """A row-wise conversion over a stream, after an optional condition (such as a key range held out for validation)."""
    return convert(stream if keep is None else stream.where(keep))


def blocks(df: DataFrame, n: int, key: str) -> DataFrame:
    """Adds ``block``: every ``n`` consecutive ids of a dense integer key. Stateless, so a stream gets the same blocks."""
    return df.withColumn("block", F.floor(F.col(key) / n))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there now into Parquet at ``path`` and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Processes all that is there now of an aggregation, and returns the latest row of each of ``keys`` so far.

    Each micro-batch writes the rows it changed into a folder of its own number, over what a failed try may have left; a
    later call goes on from the checkpoint.
    """
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def stream_blocks(stream: DataFrame, key: str, order: str, ts: str, n: int, watermark: str = "1 hour") -> DataFrame:
    """(key, order, ts, place, block): every ``n`` consecutive records of a key form a block, whatever their ids.

    The number of records seen of each key is state that lives on across micro-batches and restarts. A micro-batch's records of a key are
    numbered by (ts, order); records older than the watermark are left out, and the state of a key without records for
    that long is dropped, so its blocks begin anew.
    """
    kinds = dict(stream.select(key, order, ts).dtypes)
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{ts}` {kinds[ts]}, place long, block long"

    def number(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        seen = state.get[0] if state.exists else 0
        latest = state.getCurrentWatermarkMs()
        when = pd.to_datetime(rows[ts]).astype("datetime64[ms]").astype("int64")
        rows = rows[when >= latest].sort_values([ts, order])
        place = range(seen, seen + len(rows))
        state.update((seen + len(rows),))
        last = int(when.max())
        state.setTimeoutTimestamp(max(last, latest) + 1 + idle)
        yield pd.DataFrame({key: rows[key], order: rows[order], ts: rows[ts], "place": place, "block": [p // n for p in place]})

    idle = int(stream.sparkSession.sql(f"select cast(interval {watermark} as interval day to second) as i").first().i.total_seconds() * 1000)
    some = stream.select(key, order, ts).withWatermark(ts, watermark)
    return some.groupBy(key).applyInPandasWithState(number, schema, "seen long", "append", GroupStateTimeout.EventTimeTimeout)
