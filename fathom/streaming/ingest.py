"""Streams: payloads ingested once each, and windowed counts with late data dropped by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_payloads(stream: DataFrame, column: str = "value") -> DataFrame:
    """A stream of texts with their fingerprint, each content once."""
    return stream.withColumn("fingerprint", F.sha2(F.col(column), 256)).dropDuplicates(["fingerprint"])


def to_catalog(stream: DataFrame, accept: Callable[[str], object], checkpoint: str, column: str = "value") -> StreamingQuery:
    """Every payload of a stream through a catalog's ingest, batch by batch."""

    def batch(rows: DataFrame, _: int) -> None:
        for r in rows.select(column).toLocalIterator():
            accept(r[0])

    return distinct_payloads(stream, column).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, width: str, by: Sequence[str] = (), value: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts (and sums) of tumbling or sliding windows; works on streams and tables alike."""
    frame = events.withColumn(time, F.col(time).cast("timestamp"))
    if frame.isStreaming:
        frame = frame.withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggregates = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return frame.groupBy(window.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if value else []))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: start, end, events."""
    frame = events.withColumn(time, F.col(time).cast("timestamp"))
    if frame.isStreaming:
        frame = frame.withWatermark(time, late)
    return frame.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
