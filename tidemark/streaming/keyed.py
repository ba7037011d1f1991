"""Versions of keys with an expiry, as a stream with state and timers and as a batch: the same rows either way.

A row (duid, at, content_hash) is a write: it gives a revision if the hash differs from the key's hash before it, and it
keeps the body for ``ttl`` more. A body that no write renews in time expires; the hash stays. Rows that give events:
(duid, at, kind, content_hash), kind is revision or expiry. Writes take effect in the order of their time, of equal time
in that of the hash; an expiry at the instant of a write comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import RANGES, carried, in_ranges

EVENTS = "duid string, at timestamp, kind string, content_hash string"
_STATE = "content_hash string, expires long, waiting_at array<long>, waiting_hash array<string>"


def _step(known: tuple[str | None, int | None], waiting: list[tuple[int, str]], until: int, ttl: int) -> tuple[tuple[str | None, int | None], list[tuple[int, str, str]]]:
    """Takes writes in order up to an instant: the key's hash and expiry after them, and the events (at, kind, hash)."""
    content, expires = known
    events = []
    for at, new in [*waiting, (until + 1, None)]:
        if expires is not None and expires <= min(at, until):
            events.append((expires, "expiry", content))
            expires = None
        if new is not None:
            if content is not None and content != new:
                events.append((at, "revision", new))
            content, expires = new, at + ttl
    return (content, expires), events


def version_stream(rows: DataFrame, ttl: timedelta, late: str = "10 minutes") -> DataFrame:
    """Events of a stream of writes, each once, as soon as the watermark has passed it.

    State of a key: its hash, when its body expires, and the writes that the watermark hasn't reached; a timer is set to the
    first of those instants. Writes later than ``late`` are left out, as the watermark passes them by. Writes without key,
    time or hash are left out too.
    """
    span = int(ttl.total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        content, expires, at, hashes = state.get if state.exists else (None, None, [], [])
        waiting = list(zip(at, hashes, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting += zip((frame["at"].astype("int64") // 1000 if frame["at"].dtype == "datetime64[us]" else frame["at"].astype("datetime64[us]").astype("int64") // 1000).tolist(), frame["content_hash"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        due = [x for x in waiting if x[0] <= mark]
        waiting = waiting[len(due) :]
        (content, expires), events = _step((content, expires), due, mark, span)
        state.update((content, expires, [x[0] for x in waiting], [x[1] for x in waiting]))
        ahead = [x for x in (expires, waiting[0][0] if waiting else None) if x is not None]
        if ahead:
            state.setTimeoutTimestamp(max(min(ahead), mark + 1))
        if events:
            yield pd.DataFrame({"duid": key[0], "at": pd.to_datetime([e[0] for e in events], unit="ms"), "kind": [e[1] for e in events], "content_hash": [e[2] for e in events]})

    own = rows.where("duid IS NOT NULL AND at IS NOT NULL AND content_hash IS NOT NULL").select("duid", F.date_trunc("millisecond", "at").alias("at"), "content_hash")
    return own.withWatermark("at", late).groupBy("duid").applyInPandasWithState(run, EVENTS, _STATE, "append", "EventTimeTimeout")


def versions_until(rows: DataFrame, ttl: timedelta, until: datetime, ranges: int = RANGES) -> DataFrame:
    """The same events of a table of writes, up to an instant. A key's writes are dealt by ranges of time."""
    own = rows.where("duid IS NOT NULL AND at IS NOT NULL AND content_hash IS NOT NULL").select("duid", F.date_trunc("millisecond", "at").alias("at"), "content_hash").where(F.col("at") <= F.lit(until))
    dealt = in_ranges(own, "at", ranges)
    order = Window.partitionBy("duid", "_r").orderBy("at", "content_hash")
    ends = dealt.groupBy("duid", "_r").agg(F.max_by("content_hash", F.struct("at", "content_hash")).alias("_last"), F.min("at").alias("_first"))
    ends = carried(carried(ends, ["duid"], "_last", "_hash_before"), ["duid"], "_first", "_at_after", before=False).select("duid", "_r", "_hash_before", "_at_after")
    placed = dealt.withColumns({"_lag": F.lag("content_hash").over(order), "_lead": F.lead("at").over(order)}).join(ends, ["duid", "_r"])
    before, after, expires = F.coalesce("_lag", "_hash_before"), F.coalesce("_lead", "_at_after"), F.col("at") + F.lit(ttl)
    revisions = placed.where(before != F.col("content_hash")).select("duid", "at", F.lit("revision").alias("kind"), "content_hash")
    expiries = placed.where((expires <= F.lit(until)) & (after.isNull() | (expires <= after))).select("duid", expires.alias("at"), F.lit("expiry").alias("kind"), "content_hash")
    return revisions.unionByName(expiries)
