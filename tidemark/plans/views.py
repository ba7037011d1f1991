"""Notice-shaped views of the driver's tables, by formulas that SQL can repeat."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash
from tidemark.functions.urls import DETAIL_QUERY, BoardSite
from tidemark.operators.block_index import BlockIndex
from tidemark.operators.schema import CATEGORIES, NOTICES, RUNS
from tidemark.sources.shared import new_folder

NOW = datetime(2024, 3, 1, tzinfo=UTC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category(index: int):
    return F.element_at(F.array(*[F.lit(c[index]) for c in CATEGORIES]), (F.pmod("doc_id", F.lit(len(CATEGORIES))) + 1).cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored notices. The hash is filled in by notices_hashed, because most queries don't read it."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    posted = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int"))
    collected = F.lit(NOW) - F.make_dt_interval(F.lit(0), F.pmod("doc_id", F.lit(240)).cast("int"))
    gone = F.pmod("doc_id", F.lit(17)) == 0
    return docs.select(
        F.col("doc_id").cast("string").alias("duid"),
        _category(1).alias("category_id"),
        _category(0).alias("category_name"),
        F.substring("text", 1, 60).alias("title"),
        posted.alias("posted_date"),
        F.date_add(posted, F.pmod("doc_id", F.lit(3)).cast("int")).alias("updated_date"),
        F.coalesce("source", F.lit("")).alias("department"),
        F.concat(F.lit(f"{BoardSite().origin}{BoardSite().path}?{DETAIL_QUERY}"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("text").alias("body"),
        (collected + F.expr("INTERVAL 5 DAYS")).alias("body_expires_at"),
        F.lit("").alias("content_hash"),
        (F.pmod("doc_id", F.lit(5)) == 0).alias("attachments_present"),
        collected.alias("collected_at"),
        F.when(gone, F.lit(NOW)).alias("tombstone_at"),
        F.when(gone, "tombstoned").otherwise("active").alias("source_status"),
    ).select(*NOTICES.fieldNames())


_INDEXES: dict[tuple, BlockIndex] = {}


def block_index(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The search index of notices(), built from the documents when a session first asks for it, and anew when they changed.

    Texts of a small table, often a single row group, are dealt anew before they are tokenised; a large one is read in parts.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    state = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, state.getModificationTime(), state.getLen())
    if key not in _INDEXES:
        index = BlockIndex(spark, new_folder(spark, "index"))
        rows, tasks = notices(spark, sf_dir), spark.sparkContext.defaultParallelism
        index.add(rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks))
        _INDEXES[key] = index
    return _INDEXES[key]


def hashed(rows: DataFrame) -> DataFrame:
    own = ("duid", "category_id", "category_name", "title", "posted_date", "updated_date", "department", "source_url", "body", "attachments_present")
    return rows.withColumn("content_hash", content_hash(*[F.col(c) for c in own]))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs."""
    states = F.create_map(*[F.lit(x) for pair in (("purchase", "success"), ("error", "blocked"), ("view", "running"), ("click", "interrupted"), ("signup", "failed")) for x in pair])
    events = table(spark, sf_dir, "events")
    status = F.try_element_at(states, F.col("event_type"))
    updated = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("event_id", F.lit(30)).cast("int"))
    return events.select(
        F.col("event_id").cast("string").alias("run_id"),
        status.alias("status"),
        F.pmod("event_id", F.lit(50)).cast("int").alias("checkpoint_page"),
        F.pmod("event_id", F.lit(50)).cast("int").alias("pages_seen"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("detail_requests"),
        F.pmod("event_id", F.lit(11)).cast("int").alias("index_requests"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("retry_count"),
        F.when(status == "blocked", "captcha").alias("block_reason"),
        F.col("ts").cast("timestamp").alias("started_at"),
        updated.cast("timestamp").alias("updated_at"),
        F.when(status != "running", updated.cast("timestamp")).alias("finished_at"),
    ).select(*RUNS.fieldNames())


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log of writes: key, seq, and a hash of what was written, role and whole text."""
    turns = table(spark, sf_dir, "conversations")
    value = F.sha2(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    return turns.select("conv_id", "turn", value.alias("value_hash"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch: every third notice, of these every second with a new title; and as many unknown keys."""
    own = notices(spark, sf_dir).where("pmod(cast(duid as long), 3) = 0")
    number = F.col("duid").cast("long")
    known = own.withColumn("title", F.when(F.pmod(number, F.lit(6)) == 0, F.concat(F.lit("New "), F.col("title"))).otherwise(F.col("title")))
    unknown = own.withColumn("duid", (number + 900_000_000_000).cast("string"))
    both = known.unionByName(unknown)
    return both.select("duid", "title", "category_id", "category_name", "posted_date", "updated_date", "department", "source_url", "attachments_present", "body", F.col("duid").cast("long").alias("seq"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices as list rows, of four every second one with a new title, every third one with a later day; and as many unknown keys."""
    own = notices(spark, sf_dir)
    number = F.col("duid").cast("long")
    fourth = F.pmod(number, F.lit(4))
    known = own.withColumns({"title": F.when(fourth == 1, F.concat(F.lit("New "), F.col("title"))).otherwise(F.col("title")), "updated_date": F.when(fourth == 2, F.date_add("updated_date", 1)).otherwise(F.col("updated_date"))})
    return known.unionByName(own.withColumn("duid", (number + 900_000_000_000).cast("string"))).select("duid", "title", "category_id", "category_name", "posted_date", "updated_date", "department", "source_url", "attachments_present")
