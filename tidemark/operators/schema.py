"""Tables of the notice store: their types, limits and the category catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

NOTICES = T.StructType(
    [
        T.StructField("duid", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("posted_date", T.DateType()),
        T.StructField("updated_date", T.DateType()),
        T.StructField("department", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_expires_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("attachments_present", T.BooleanType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("tombstone_at", T.TimestampType()),
        T.StructField("source_status", T.StringType()),
    ]
)

REVISIONS = T.StructType(
    [
        T.StructField("revision_id", T.LongType()),
        T.StructField("duid", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("posted_date", T.DateType()),
        T.StructField("updated_date", T.DateType()),
        T.StructField("department", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("attachments_present", T.BooleanType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("checkpoint_page", T.IntegerType()),
        T.StructField("pages_seen", T.IntegerType()),
        T.StructField("detail_requests", T.IntegerType()),
        T.StructField("index_requests", T.IntegerType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("block_reason", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)

#: The searchable projection of active notices.
INDEX = T.StructType([T.StructField(c, T.StringType()) for c in ("duid", "title", "category_name", "department", "body")])

TABLES = {"notices": NOTICES, "notice_revisions": REVISIONS, "crawl_runs": RUNS, "notices_index": INDEX}

#: A row of list metadata as it comes in; detail rows also hold body.
SUMMARY = T.StructType(
    [
        T.StructField("duid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("posted_date", T.DateType()),
        T.StructField("updated_date", T.DateType()),
        T.StructField("department", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("attachments_present", T.BooleanType()),
        T.StructField("pinned", T.BooleanType()),
    ]
)
ISSUE = T.StructType([T.StructField("code", T.StringType()), T.StructField("location", T.StringType())])

RUN_STATES = ("running", "success", "blocked", "interrupted", "failed")

# The categories, in the order in which they are shown.
CATEGORIES = (
    ("일반", "general"),
    ("학사", "academic"),
    ("학생", "student"),
    ("봉사", "volunteer"),
    ("등록/장학", "registration-scholarship"),
    ("입학", "admissions"),
    ("시설", "facilities"),
    ("병무", "military"),
    ("외부", "external"),
    ("국제교류", "international-exchange"),
    ("국제학생", "international-student"),
)


def catalog(spark: SparkSession) -> DataFrame:
    """(ord, category_id, category): a fixed handful of rows, so always safe to broadcast."""
    return spark.createDataFrame([(i, key, name) for i, (name, key) in enumerate(CATEGORIES)], "ord int, category_id string, category string")


def category_id_of(name: Column) -> Column:
    """Id of a category name, blanks around it aside; null if unknown."""
    pairs = F.create_map(*[F.lit(x) for name_, key in CATEGORIES for x in (name_, key)])
    return F.try_element_at(pairs, F.trim(F.regexp_replace(name, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")))


def category_issue(name: Column) -> Column:
    """missing_category for an empty or null name, unknown_category for one outside the catalog, else null."""
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "missing_category").when(category_id_of(name).isNull(), "unknown_category")


def conforms(df: DataFrame, table: str) -> bool:
    """Whether a table has exactly the columns and types of the contract, in order."""
    want = TABLES[table]
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want]
