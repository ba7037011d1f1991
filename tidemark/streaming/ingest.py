"""Incremental ingest: a stream of list or detail rows merged into the store, one commit for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import DETAIL, METADATA, SUMMARY
from tidemark.sources.store import NoticeStore


def merge_stream(rows: DataFrame, store: NoticeStore, checkpoint: str, mode: str = METADATA, clock: Callable[[], datetime] = lambda: datetime.now(UTC), trigger: dict | None = None) -> StreamingQuery:
    """Starts the merge of a streaming table with the columns of list (or detail) rows and seq.

    A micro-batch that is run again after a failure changes nothing but collected_at: its rows have the stored hash,
    so they give no second revision.
    """
    write = {SUMMARY: store.save_summaries, METADATA: store.save_metadata, DETAIL: store.save_details}[mode]

    def publish(batch: DataFrame, _: int) -> None:
        write(batch, clock())

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals_by_window(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by kind and tumbling window, for a stream or a table; on a stream, later rows than ``late`` are left out."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    return timed.groupBy(F.window(time_col, width), kind_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind_col, "n")
