"""Keyed merge of incoming rows into the current state, with change capture, tombstones and bodies of limited life.

All steps are joins and windows on duid: current rows are never collected, and rows of one key in a batch take
effect in the order of ``seq`` although they are handled together.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import body_expiry
from tidemark.functions.text import clean_body, clean_category, clean_department, clean_title, hash_of_clean
from tidemark.operators.schema import NOTICES, REVISIONS

#: What a batch is: list rows that keep a stored body, list rows that drop it, detail rows that bring one.
SUMMARY, METADATA, DETAIL = "summary", "metadata", "detail"
MODES = (SUMMARY, METADATA, DETAIL)
#: Revisions that one task numbers, and most tasks for it.
ID_BLOCK, MAX_BLOCKS = 100_000, 1_000
#: Rows out of which the cuts between them are taken.
CUT_ROWS = 20_000
_GIVEN = ("duid", "category_id", "category_name", "title", "posted_date", "updated_date", "department", "source_url")


def cleaned(incoming: DataFrame, mode: str) -> DataFrame:
    """The incoming rows that have a duid, cleaned: seq and sub, which order them (sub is 0 where the input has none), the fields of a notice that a row brings, body and content_hash.

    List rows that keep a stored body (SUMMARY) have neither body nor hash yet.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    body = F.lit(None).cast("string")
    if mode == DETAIL:
        body = clean_body(F.coalesce(F.col("body"), F.lit("")) if "body" in incoming.columns else F.lit(""))
    rows = incoming.where("duid IS NOT NULL").select(
        F.col("seq").cast("long").alias("seq"),
        (F.col("sub").cast("long") if "sub" in incoming.columns else F.lit(0).cast("long")).alias("sub"),
        "duid",
        "category_id",
        clean_category(F.col("category_name")).alias("category_name"),
        clean_title(F.col("title")).alias("title"),
        "posted_date",
        "updated_date",
        clean_department(F.col("department")).alias("department"),
        "source_url",
        "attachments_present",
        body.alias("body"),
    )
    hashed = F.lit(None).cast("string") if mode == SUMMARY else _hash(F.col("body"))
    return rows.withColumn("content_hash", hashed)


def _hash(body: Column) -> Column:
    """Of clean fields and a body that was cleaned once: it is cleaned once more."""
    return hash_of_clean(*(F.col(c) for c in _GIVEN), clean_body(F.coalesce(body, F.lit(""))), F.col("attachments_present"))


def changed(clean: DataFrame, current: DataFrame, collected_at: datetime, mode: str) -> DataFrame:
    """Rows of cleaned() as notices, in the order of a key's rows by seq and sub: with both, _before (the hash that a row
    replaces, null for the first row of an unknown key) and _last (whether it is its key's last).

    current needs to hold no more than the keys of the batch. Rows of a key with equal seq are ordered by their values.
    """
    old = current.select("duid", *(F.col(c).alias(f"o_{c}") for c in ("body", "body_expires_at", "content_hash", "tombstone_at", "source_status")))
    rows = clean.join(old, "duid", "left")
    if mode == SUMMARY:
        rows = rows.withColumn("body", clean_body(F.col("o_body"))).withColumn("content_hash", _hash(F.col("body")))
    expiry: Column = F.when(F.col("body").isNotNull(), body_expiry(F.lit(collected_at)))
    if mode == SUMMARY:
        expiry = F.coalesce(expiry, F.col("o_body_expires_at"))
    tombstone = F.lit(None).cast("timestamp") if mode == DETAIL else F.col("o_tombstone_at")
    rows = rows.withColumns(
        {
            "body_expires_at": expiry,
            "collected_at": F.lit(collected_at).cast("timestamp"),
            "tombstone_at": tombstone,
            "source_status": F.when(tombstone.isNotNull(), F.col("o_source_status")).otherwise("active"),
        }
    )
    tie = F.xxhash64(*(c for c in NOTICES.fieldNames() if c != "duid"))
    order = Window.partitionBy("duid").orderBy("seq", "sub", tie)
    return rows.select("seq", "sub", *NOTICES.fieldNames(), F.coalesce(F.lag("content_hash").over(order), F.col("o_content_hash")).alias("_before"), F.lead("duid").over(order).isNull().alias("_last"))


def revised(rows: DataFrame) -> DataFrame:
    """Of rows of changed() those that differ from what they replace, as revisions without ids but with seq."""
    differs = F.col("_before").isNotNull() & (F.col("_before") != F.col("content_hash"))
    return rows.where(differs).select("seq", "sub", *(F.col(c) for c in REVISIONS.fieldNames() if c not in ("revision_id", "changed_at")), F.col("collected_at").alias("changed_at"))


def merge_notices(current: DataFrame, incoming: DataFrame, collected_at: datetime, mode: str) -> tuple[DataFrame, DataFrame]:
    """(new current state, revisions without ids but with seq).

    incoming holds duid, title, category_id, category_name, posted_date, updated_date, department, source_url,
    attachments_present, for details body, seq, a long that orders the rows of the batch, and sub, if it is there, another one
    among rows of equal seq. A revision holds the new
    values of a row whose hash differs from its predecessor's, in the batch or else in the store; the first row of an
    unknown key gives none. Rows without duid are left out.
    """
    rows = changed(cleaned(incoming, mode), current, collected_at, mode)
    new = rows.where("_last").select(*NOTICES.fieldNames())
    untouched = current.select(*NOTICES.fieldNames()).join(new.select("duid"), "duid", "left_anti").select(*NOTICES.fieldNames())
    return untouched.unionByName(new), revised(rows)


def numbered_revisions(revisions: DataFrame, after: int, count: int | None = None, block: int = ID_BLOCK) -> DataFrame:
    """Revisions with ids from after + 1 in order of seq, sub, duid and hash. count is their number, where it is known.

    They are cut into ranges of that whole order, of about equal counts, so a batch of one seq is cut as well; a task numbers
    the rows of a range, and the rows before it are counted by range. Rows are read three times, so they should be a table.
    """
    blocks = min(MAX_BLOCKS, -(-(revisions.count() if count is None else count) // block))
    by = [c for c in ("seq", "sub", "duid", "content_hash") if c in revisions.columns]
    if blocks <= 1:
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))
        return revisions.withColumn("revision_id", (F.lit(after) + rank).cast("long")).select(*REVISIONS.fieldNames())
    # A bounded sample, the same in every run: the rows that hash lowest.
    sample = revisions.select(*by).orderBy(F.xxhash64(*by), *by).limit(CUT_ROWS).orderBy(*by).collect()
    cuts = list(dict.fromkeys(tuple(sample[len(sample) * i // blocks]) for i in range(1, blocks)))
    kinds = [revisions.schema[c].dataType for c in by]
    place = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(by, cut, kinds, strict=True))) for cut in cuts))
    own = revisions.withColumn("_block", F.size(F.filter(place, lambda c: c < F.struct(*by))))
    # At most MAX_BLOCKS rows are in this window.
    before = own.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(*by))
    return own.join(before, "_block").withColumn("revision_id", (F.lit(after) + F.col("_base") + rank).cast("long")).select(*REVISIONS.fieldNames())


def apply_tombstones(current: DataFrame, gone: DataFrame, tombstone_at: datetime) -> DataFrame:
    """Marks stored rows whose duid is in gone; unknown ids change nothing. Absence from a list is no tombstone."""
    marks = gone.select("duid").where("duid IS NOT NULL").distinct().withColumn("_gone", F.lit(True))
    joined = current.join(marks, "duid", "left")
    marked = F.col("_gone").isNotNull()
    return joined.withColumn("tombstone_at", F.when(marked, F.lit(tombstone_at)).otherwise(F.col("tombstone_at"))).withColumn("source_status", F.when(marked, "tombstoned").otherwise(F.col("source_status"))).select(*NOTICES.fieldNames())


def expired_bodies(current: DataFrame, now: datetime) -> DataFrame:
    """Ids of rows whose body is due, the bound included."""
    return current.where(F.col("body").isNotNull() & (F.col("body_expires_at") <= F.lit(now))).select("duid")


def sweep_bodies(current: DataFrame, now: datetime) -> DataFrame:
    """Takes due bodies out. The hash stays as it was, so the next list row of such a key gives a revision."""
    due = F.col("body").isNotNull() & (F.col("body_expires_at") <= F.lit(now))
    keep = F.coalesce(~due, F.lit(True))
    return current.withColumns({"body": F.when(keep, F.col("body")), "body_expires_at": F.when(keep, F.col("body_expires_at"))}).select(*NOTICES.fieldNames())


def ignore_absence(current: DataFrame, listed: DataFrame) -> DataFrame:
    """A key that a list page doesn't show stays as it is."""
    del listed
    return current


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order, unlike dropDuplicates, which keeps any. An aggregation, so that a key with many rows is reduced before it moves."""
    return _of_key(rows, keys, F.min_by(F.struct(*rows.columns), F.struct(*order)))


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in this order: what sequential writes leave."""
    return _of_key(rows, keys, F.max_by(F.struct(*rows.columns), F.struct(*order)))


def _of_key(rows: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(chosen.alias("_row")).select("_row.*")


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from their predecessor's of the same key; the first of a key is no change."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col("_before") != F.col(value))).drop("_before")
