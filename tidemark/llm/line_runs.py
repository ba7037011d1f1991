"""Operator 6: line dedup with levelled sorted runs of line hashes.

Documents come in batches. A batch's line hashes are grouped to the smallest document that holds each; the groups
are merged, both sides sorted by hash, with the runs of earlier batches; what the runs lack becomes a new run at
level 0. When a level holds ``fanout`` runs they are compacted into one run of the next level, so a hash is
rewritten once a level. A line is dropped where its hash is in an earlier run or belongs to a smaller document
of its batch.

Runs are Parquet tables bucketed and sorted by hash, all into the same number of buckets, so a merge moves the new
batch only. They and the file that lists them by level are in one folder: another session goes on from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm._common import BLANKS, ascii_lower, drop_folder, new_folder

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3


def line_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key: stripped of blanks, A-Z lowered. None for keys of fewer code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(ascii_lower(key).encode("utf-8", "surrogatepass"))


def _hashes(min_chars: int):
    schema = pa.schema([("_doc", pa.int64()), ("_hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = [], []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                if doc is None or not text or len(text) < min_chars:
                    continue
                own = {h for line in text.split("\n") if (h := line_hash(line, min_chars)) is not None}
                docs += [doc] * len(own)
                hashes += own
                if len(docs) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.binary())], schema=schema)
                    docs, hashes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.binary())], schema=schema)

    return run


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _hash): the distinct eligible line hashes of each document that has an id."""
    return docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_hashes(min_chars), "_doc long, _hash binary")


class LineRuns:
    """The hashes seen so far, as bucketed, sorted runs in levels.

    With a folder the runs last: whoever opens it next, in this session or another one, finds them. Without one they are in
    the shared folder until the application ends. One writer at a time. The number of buckets is set when the first run is
    written (that of shuffle partitions unless given) and kept from then on.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, folder: str | None = None, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.folder = folder.rstrip("/") if folder else new_folder(spark, "runs")
        self.levels: list[list[str]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._version = 0
        self._load()

    # The list of runs: a file for each state, of which the newest whole one counts.

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> None:
        files, jvm = self._files(), self.spark.sparkContext._jvm
        names = sorted((x.getPath().getName() for x in files.listStatus(self._at("state"))), reverse=True) if files.exists(self._at("state")) else []
        for name in names:
            stream = files.open(self._at(f"state/{name}"))
            try:
                state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
            self.levels, self.buckets, self._version = state["levels"], state["buckets"], int(name.split(".")[0])
            return

    def _save(self) -> None:
        self._version += 1
        stream = self._files().create(self._at(f"state/{self._version:012d}.json"), False)
        try:
            stream.write(bytearray(json.dumps({"buckets": self.buckets, "levels": self.levels}), "utf-8"))
        finally:
            stream.close()

    # Runs as tables: bucketing is known to a catalog only, so a run has a name there while it is read or written.

    def _named(self, run: str) -> str:
        table = f"tidemark_{uuid.uuid4().hex}"
        columns = "_hash binary, _owner long, _last long, _new boolean" if run in (self.levels[0] if self.levels else ()) else "_hash binary"
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (_hash) SORTED BY (_hash) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return table

    def _write(self, df: DataFrame) -> str:
        run, table = f"run-{uuid.uuid4().hex}", f"tidemark_{uuid.uuid4().hex}"
        try:
            df.write.format("parquet").option("path", f"{self.folder}/{run}").bucketBy(self.buckets, "_hash").sortBy("_hash").saveAsTable(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return run

    def merged(self, lines: DataFrame, tables: list[str]) -> DataFrame:
        """(_hash, _owner, _last, _new) of a batch (_doc, _hash): each hash once, new if none of the runs has it."""
        firsts = lines.groupBy("_hash").agg(F.min("_doc").alias("_owner"), F.max("_doc").alias("_last"))
        seen = F.lit(None).cast("boolean")
        for k, table in enumerate(tables):
            run = self.spark.table(table)
            run = (run.where("_new") if "_new" in run.columns else run).select("_hash", F.lit(True).alias(f"_in{k}"))
            firsts = firsts.join(run, "_hash", "left")
            seen = F.coalesce(seen, F.col(f"_in{k}"))
        return firsts.select("_hash", "_owner", "_last", seen.isNull().alias("_new"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch (_doc, _hash) in; returns the (_doc, _hash) that are to be dropped from it."""
        tables = [self._named(run) for level in self.levels for run in level]
        try:
            run = self._write(self.merged(lines, tables))
        finally:
            for table in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        batch = self.spark.read.schema("_hash binary, _owner long, _last long, _new boolean").parquet(f"{self.folder}/{run}")
        if batch.where("_new").limit(1).count():
            gone = self._push(0, run)
            self._save()
            for name in gone:
                drop_folder(self.spark, f"{self.folder}/{name}")
        # Read as plain files: of the two sides the lines are the larger one, and adaptive execution may split their hot keys.
        shared = batch.where(~F.col("_new") | (F.col("_owner") < F.col("_last")))
        return lines.join(shared, "_hash").where(~F.col("_new") | (F.col("_owner") < F.col("_doc"))).select("_doc", "_hash")

    def _push(self, level: int, run: str) -> list[str]:
        """Returns the runs that are of no more use once the new list of runs is saved."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return self._compact(level) if len(self.levels[level]) >= self.fanout else []

    def _read(self, level: int) -> DataFrame:
        runs = self.spark.read.schema("_hash binary" if level else "_hash binary, _new boolean").parquet(*(f"{self.folder}/{run}" for run in self.levels[level]))
        return (runs if level else runs.where("_new")).select("_hash")

    def _compact(self, level: int) -> list[str]:
        """Runs of a level become one of the next. Those of level 0 stay until vacuum(): answers to batches may still read them."""
        old = self.levels[level]
        run = self._write(self._read(level).repartition(self.buckets, "_hash"))
        self.levels[level] = []
        return [*(old if level else []), *self._push(level + 1, run)]

    def known(self) -> DataFrame:
        """(_hash) of all runs; a hash is in one run only."""
        out = self.spark.createDataFrame([], "_hash binary")
        for level, runs in enumerate(self.levels):
            out = out.unionAll(self._read(level)) if runs else out
        return out

    def vacuum(self) -> None:
        """Deletes the runs and lists that are out of use; no answer that add() gave may be read afterwards."""
        named = {run for level in self.levels for run in level}
        for status in self._files().listStatus(self._at("")):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in named:
                drop_folder(self.spark, f"{self.folder}/{name}")
        for status in self._files().listStatus(self._at("state")):
            if status.getPath().getName() != f"{self._version:012d}.json":
                drop_folder(self.spark, f"{self.folder}/state/{status.getPath().getName()}")


def _rewritten(min_chars: int):
    schema = pa.schema([("_n_lines", pa.int64()), ("_n_dropped", pa.int64()), ("_kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            counts, dropped, kept = [], [], []
            for cell, drops in zip(batch.column(at["_text"]), batch.column(at["_drops"]), strict=True):
                text = cell.as_py() or ""
                lines = text.split("\n")
                counts.append(len(lines))
                if drops.is_valid:
                    out = set(drops.as_py())
                    stay = [line for line in lines if line_hash(line, min_chars) not in out]
                    dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    dropped.append(0)
                    kept.append(text)
            rest = [n for n in batch.schema.names if n not in ("_text", "_drops")]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in rest), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*rest, *schema.names])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, runs: LineRuns | None = None) -> DataFrame:
    """Keeps each line of at least ``min_chars`` code points only in the smallest doc_id that holds it.

    Returns doc_id, _n_lines, _n_dropped and _kept (the text that stays), one row for each input row; with
    ``carry`` also _row, a struct of all input columns. The batches are ranges of doc_id in ascending order, of
    about equal counts. Within the smallest document all its copies of a line stay. With ``runs`` of earlier calls the
    lines of those are dropped too, and the new ones are added.

    Null or empty text: one empty line. Very long texts are taken whole. Rows that share a doc_id are one document, so a
    line never counts as a copy between them. A row without doc_id is left as it is and owns no line. Extra columns may
    have any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = F.col(id_col).cast("long")
    cuts = docs.select(F.percentile_approx(own, [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    path = new_folder(spark, "hashed")
    batch = sum((F.when(F.col("_doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    hashed_lines(docs, min_chars, id_col, text_col).withColumn("_batch", batch).write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema("_doc long, _hash binary, _batch int").parquet(path)
    runs = runs or LineRuns(spark, fanout)
    drops = None
    for i in range(len(cuts) + 1):
        more = runs.add(lines.where(F.col("_batch") == i).select("_doc", "_hash"))
        drops = more if drops is None else drops.unionAll(more)
    drops = drops.groupBy("_doc").agg(F.collect_set("_hash").alias("_drops"))
    rows = docs.select(own.alias("_id"), F.col(text_col).cast("string").alias("_text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []))
    joined = rows.join(drops, rows["_id"] == drops["_doc"], "left").select(F.col("_id").alias("doc_id"), *(["_row"] if carry else []), "_text", "_drops")
    fields = [joined.schema[c] for c in (["doc_id", "_row"] if carry else ["doc_id"])]
    schema = StructType([*fields, StructField("_n_lines", LongType()), StructField("_n_dropped", LongType()), StructField("_kept", StringType())])
    return joined.mapInArrow(_rewritten(min_chars), schema)
