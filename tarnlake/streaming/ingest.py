"""Streams: ingest, dedup by user, expiry, and consolidation over sliding windows.

Event time is the row's own ts; rows later than the watermark are dropped and that is all the loss there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, TimestampNTZType

from ..functions import text
from ..operators import extraction

LATE = "1 hour"
#: The first instant of 2024, in microseconds.
_YEAR = 1_704_067_200_000_000


def read(spark: SparkSession, path: str, schema: StructType | str, files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def observe(stream: DataFrame, column: str = "content") -> DataFrame:
    """Each observation with its type, the type's confidence and its entities; stateless, for batches too."""
    typed = stream.withColumn("_k", text.memory_type(F.col(column)))
    return typed.withColumns({"memory_type": F.col("_k.memory_type"), "type_confidence": F.col("_k.confidence"), "entities": extraction.entities(F.col(column))}).drop("_k")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def instant(c: Column) -> Column:
    """A time without zone as the instant it is in UTC, whatever the session's zone: what watermarks need."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c))


def sliding(events: DataFrame, width: str = "24 hours", step: str = "12 hours") -> DataFrame:
    """Count and sum by type over overlapping windows, as start_hour since 2024 began; batch or stream.

    A stream needs its watermark set before (see with_watermark) to close windows in append mode.
    """
    w = F.window("ts", width, step)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    start = F.col("w.start")
    if isinstance(events.schema["ts"].dataType, TimestampNTZType):
        start = instant(start)
    start = F.floor((F.unix_micros(start) - _YEAR) / 3_600_000_000).cast("long")
    return out.select(start.alias("start_hour"), "event_type", "n", "total")


def with_watermark(stream: DataFrame, late: str = LATE) -> DataFrame:
    return stream.withWatermark("ts", late)


def dedup_by_user(stream: DataFrame, threshold: float, keep_hours: int = 24 * 30) -> DataFrame:
    """Each row (user_id, id, ts, words: array of text) with the earlier row of its user that it duplicates.

    A user's state holds the word sets of rows that weren't duplicates; a user not heard of for keep_hours
    of event time is forgotten. Rows of a batch are taken by ts, then id. A null user is one user.
    """
    out = "user_id long, id long, duplicate_of long"
    kept = "ids array<long>, words array<array<string>>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, sets = ([list(x) for x in state.get] if state.exists else [[], []])
        known = [(i, set(w)) for i, w in zip(ids, sets, strict=True)]
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        found = []
        for i, w in zip(rows["id"], rows["words"], strict=True):
            own = set(w)
            same = [k for k, s in known if own and len(own & s) >= threshold * len(own | s)]
            if not same:
                known.append((int(i), own))
            found.append((key[0], i, min(same) if same else None))
        state.update(([k for k, _ in known], [sorted(s) for _, s in known]))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + keep_hours * 3_600_000)
        frame = pd.DataFrame(found, columns=["user_id", "id", "duplicate_of"])
        yield frame.astype({"duplicate_of": "Int64"})

    return stream.groupBy("user_id").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def expiring(stream: DataFrame, ttl: str = "30 days") -> DataFrame:
    """First sight of each id (id, ts) within the time to live: state older than that is dropped."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["id"])
