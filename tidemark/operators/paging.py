"""Pages that go on from a cursor instead of counting rows off: a deep page costs what the first one does."""

from __future__ import annotations

import base64
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.errors import StorageInputError
from tidemark.operators.feed import Filters, active, bounded_limit


def cursor_of(posted: date, duid: str) -> str:
    """An opaque cursor behind a row."""
    return base64.urlsafe_b64encode(json.dumps([posted.isoformat(), duid]).encode()).decode()


def _read(cursor: str) -> tuple[date, str]:
    try:
        day, duid = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if not isinstance(duid, str):
            raise ValueError(duid)
        return date.fromisoformat(day), duid
    except (ValueError, TypeError) as error:
        raise StorageInputError("cursor", "malformed") from error


def write_feed(notices: DataFrame, folder: str, files: int = 16) -> DataFrame:
    """The active notices that have a date, in files that are ranges of (posted_date, duid): their statistics tell which a page needs."""
    own = active(notices).where(F.col("posted_date").isNotNull())
    own.repartitionByRange(files, F.col("posted_date").desc(), F.col("duid").desc()).sortWithinPartitions(F.col("posted_date").desc(), F.col("duid").desc()).write.parquet(folder)
    return read_feed(notices.sparkSession, folder)


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def seek_page(feed: DataFrame, after: str | None = None, filters: Filters = Filters(), limit: int = 10) -> DataFrame:
    """The rows that follow a cursor, newest first, ids descending as text among equals; the first ones without a cursor.

    Both bounds reach the scan, so files and row groups that lie before the cursor are not read; rows that were added
    meanwhile before it shift nothing. StorageInputError for a cursor that isn't one.
    """
    rows = filters.of(feed)
    if after is not None:
        day, duid = _read(after)
        rows = rows.where((F.col("posted_date") <= F.lit(day)) & ((F.col("posted_date") < F.lit(day)) | (F.col("duid") < F.lit(duid))))
    return rows.orderBy(F.col("posted_date").desc(), F.col("duid").desc()).limit(bounded_limit(limit))


def next_cursor(page: list) -> str | None:
    """The cursor behind a collected page; None behind an empty one."""
    return cursor_of(page[-1]["posted_date"], page[-1]["duid"]) if page else None
