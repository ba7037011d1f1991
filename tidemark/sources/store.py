"""The notice store: layers of Parquet folders behind a manifest.

A version is a manifest file that names the folders of its tables. It is written under a name of its own and then
published under the next number, which fails if that is taken: a commit is atomic, of two writers one is first, and the
other puts its change onto what that one wrote, or does it again if both changed the same table. This takes a file
system with exclusive links or renames (local, HDFS); other ones are only read. Readers stay on the version they opened.

Notices are a base, split into buckets by key, and deltas above it, which hold a row for each key that a commit wrote;
the newest row of a key counts. A commit writes what it changes; deltas are merged by size now and then, and become a
new base when they are a quarter of it. A writer announces itself by an intent before its first folder; vacuum spares
what announced writers wrote and what held versions name. The search index has a layer for each commit, too: postings of the rows written,
of which those count whose notice is still of that version. Revisions are only appended.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import REDACTION_VERSION
from tidemark.operators import merge, runs
from tidemark.operators.errors import ReadOnlyStorageError, SchemaVersionError, SearchUnavailableError, StorageUnavailableError
from tidemark.operators.feed import Filters, by_key, latest_success
from tidemark.operators.schema import NOTICES, SCHEMA_VERSION, TABLES
from tidemark.operators.search import SearchIndex, index_rows, index_sums, indexed_count, indexed_page, search_index

#: Rows of a bucket of the base, and most buckets; postings of a part of an index layer.
BUCKET_ROWS, MAX_BUCKETS, PART_WORDS = 1_000_000, 10_000, 5_000_000
#: Tasks that write into one part.
PART_TASKS = 4
#: Layers of about one size that are merged into one, and the share of the base at which deltas become a new one.
FANOUT, BASE_SHARE = 4, 4
#: Rows from which the first deltas become a base at once.
FIRST_BASE = 10_000
#: Keys of a batch that are listed in the filter of a scan; more are joined.
LISTED_KEYS = 1_000
RETRIES = 5
#: Seconds after which an announced writer, or the holder of a version, counts as dead.
INTENT_SECONDS = 24 * 3600
#: Steps of the ledger that are read one by one before they are folded into one folder.
LEDGER_STEPS = 16
#: File systems on which publishing a manifest can't overwrite another one.
WRITABLE = ("file", "hdfs", "viewfs")

#: What the files hold: notices with the number of the commit that wrote them, and postings.
_VERSION = T.StructField("_version", T.LongType())
STORED = T.StructType([*NOTICES.fields, _VERSION])
POSTINGS = T.StructType(
    [
        T.StructField("duid", T.StringType()),
        _VERSION,
        T.StructField("column", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("size", T.IntegerType()),
    ]
)
#: The ledger as it is written: rows as steps left them, with the version of the step.
STEPS = T.StructType([*TABLES["crawl_runs"].fields, _VERSION])
_FILES = {"notices": STORED, "notice_revisions": TABLES["notice_revisions"], "crawl_runs": STEPS, "postings": POSTINGS}
_EMPTY = {"notices": {"base": None, "deltas": [], "written": 0, "n": 0, "words": 0, "last_revision": 0}, "notice_revisions": [], "postings": [], "crawl_runs": []}
_FAILURES = (PySparkException, Py4JJavaError)


class _Files:
    """The few file operations that a manifest needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/")
        at = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = at.getFileSystem(self._conf)
        self.scheme = self._fs.getUri().getScheme()

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def changed_at(self, name: str) -> int:
        return self._fs.getFileStatus(self.path(name)).getModificationTime()

    def create(self, name: str, text: str) -> bool:
        """Writes under a name that no reader looks at, then publishes. False if the name is taken."""
        if self.scheme not in WRITABLE:
            raise StorageUnavailableError(f"can't publish on {self.scheme}")
        temporary = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(temporary), False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        try:
            return self._link(temporary, name) if self.scheme == "file" else self._rename(temporary, name)
        finally:
            self._fs.delete(self.path(temporary), False)

    def _link(self, source: str, name: str) -> bool:
        try:
            os.link(*(self.path(n).toUri().getPath() for n in (source, name)))
        except FileExistsError:
            return False
        return True

    def _rename(self, source: str, name: str) -> bool:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self._conf)
        without_overwriting = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(source), self.path(name), without_overwriting)
        except Py4JJavaError:
            if self._fs.exists(self.path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def put(self, name: str) -> None:
        """An empty file."""
        self._fs.create(self.path(name), True).close()

    def there(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def age(self, name: str) -> float:
        """Seconds since a file was written; 0 if it is gone meanwhile."""
        try:
            return time.time() - self.changed_at(name) / 1000
        except Py4JJavaError:
            return 0.0


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("duid"), F.lit(buckets)).cast("int")


def _folders(manifest: dict) -> Iterator[tuple[str, str]]:
    """(table, folder) of all that a manifest names."""
    notices = manifest["notices"]
    yield from (("notices", layer["path"]) for layer in ([notices["base"]] if notices["base"] else []) + notices["deltas"])
    yield from ((table, layer["path"]) for table in ("notice_revisions", "postings") for layer in manifest[table])
    yield from (("crawl_runs", path) for path in manifest["crawl_runs"])


def _of_one_size(layers: list[dict]) -> int:
    """How many of the newest layers are to be merged: FANOUT of equal level, if there are so many."""
    newest = layers[-FANOUT:]
    return FANOUT if len(newest) == FANOUT and len({layer["level"] for layer in newest}) == 1 else 0


class NoticeStore:
    """Reads one version; the writing methods move on to the next."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict, files: _Files, read_only: bool):
        self.spark, self.root, self.read_only = spark, root, read_only
        self._files, self._manifest = files, manifest
        self._token: str | None = None

    # Reading

    @property
    def version(self) -> int:
        return self._manifest["version"]

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _read(self, table: str, paths: list[str]) -> DataFrame:
        schema = _FILES[table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if table == "postings":  # each layer has partitions of its own
            return reduce(DataFrame.unionAll, (self.spark.read.schema(schema).parquet(self._at(p)).select(*schema.fieldNames()) for p in paths))
        return self.spark.read.schema(schema).parquet(*map(self._at, paths))

    def _stored(self, chosen: Callable[[DataFrame], DataFrame] = lambda rows: rows, duid: str | None = None) -> DataFrame:
        """Current notices with _version: the newest row of each key that is in a delta, and the base's other keys. ``chosen``
        picks rows by key alone; of one duid only its bucket is read."""
        own = self._manifest["notices"]
        deltas = [chosen(self._read("notices", [layer["path"]])) for layer in own["deltas"]]
        newest = reduce(DataFrame.unionAll, deltas) if deltas else None
        if len(deltas) > 1:
            rest = [c for c in STORED.fieldNames() if c != "duid"]
            newest = newest.groupBy("duid").agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select("duid", "_row.*")
        if not own["base"]:
            return newest if newest is not None else self.spark.createDataFrame([], STORED)
        base = self.spark.read.schema(T.StructType([*STORED.fields, T.StructField("_bucket", T.IntegerType())])).parquet(self._at(own["base"]["path"]))
        if duid is not None:
            base = base.where(F.col("_bucket") == F.pmod(F.xxhash64(F.lit(duid)), F.lit(own["base"]["buckets"])).cast("int"))
        base = chosen(base).select(*STORED.fieldNames())
        return base if newest is None else base.join(newest.select("duid"), "duid", "left_anti").select(*STORED.fieldNames()).unionByName(newest.select(*STORED.fieldNames()))

    def notices(self) -> DataFrame:
        return self._stored().drop("_version")

    def revisions(self) -> DataFrame:
        return self._read("notice_revisions", [layer["path"] for layer in self._manifest["notice_revisions"]])

    def runs(self) -> DataFrame:
        """The ledger: of each run the row of its last step."""
        rest = [c for c in TABLES["crawl_runs"].fieldNames() if c != "run_id"]
        steps = self._read("crawl_runs", self._manifest["crawl_runs"])
        return steps.groupBy("run_id").agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select("run_id", "_row.*")

    def index(self) -> DataFrame:
        return search_index(self.notices())

    def _postings(self, terms: list[str]) -> DataFrame:
        """Postings of these terms, current or not: of each layer their parts are read."""
        found = [self.spark.createDataFrame([], POSTINGS)]
        for layer in self._manifest["postings"]:
            rows = self.spark.read.schema(T.StructType([*POSTINGS.fields, T.StructField("_part", T.IntegerType())])).parquet(self._at(layer["path"]))
            parts = reduce(lambda a, b: a | b, (F.col("_part") == F.pmod(F.xxhash64(F.lit(t)), F.lit(layer["parts"])).cast("int") for t in terms))
            found.append(rows.where(parts & F.col("term").isin(terms)).select(*POSTINGS.fieldNames()))
        return reduce(DataFrame.unionAll, found)

    def search_index(self) -> SearchIndex:
        own = self._manifest["notices"]
        if own["words"] and not self._manifest["postings"]:
            raise SearchUnavailableError("this version of the store has no postings")
        return SearchIndex(self._postings, self._stored(), own["n"], own["words"])

    def search_page(self, query: str = "", filters: Filters = Filters(), limit: int = 10, offset: int = 0) -> DataFrame:
        return indexed_page(self.search_index(), query, filters, limit, offset)

    def search_count(self, query: str = "", filters: Filters = Filters()) -> DataFrame:
        return indexed_count(self.search_index(), query, filters)

    def get(self, duid: str) -> Row | None:
        return next(iter(self.by_key(duid).collect()), None)

    def by_key(self, duid: str) -> DataFrame:
        return by_key(self._stored(lambda rows: rows.where(F.col("duid") == duid), duid).drop("_version"), duid)

    def revision_count(self, duid: str) -> int:
        return self.revisions().where(F.col("duid") == duid).count()

    def table_names(self) -> frozenset[str]:
        return frozenset(TABLES)

    def revision_columns(self) -> tuple[str, ...]:
        return tuple(self.revisions().columns)

    def latest_successful_at(self) -> datetime | None:
        return latest_success(self.runs()).first()["latest_success"]

    def get_run(self, run_id: str) -> Row | None:
        return runs.get_run(self.runs(), run_id)

    def latest_run(self) -> Row | None:
        return next(iter(runs.latest_run(self.runs()).collect()), None)

    def latest_status(self) -> str | None:
        return runs.latest_status(self.runs())

    def restart_checkpoint(self) -> int | None:
        return runs.restart_checkpoint(self.runs()).first()["checkpoint_page"]

    # Writing

    def _writable(self, operation: str) -> None:
        if self.read_only:
            raise ReadOnlyStorageError(operation)

    @contextmanager
    def _announced(self) -> Iterator[None]:
        """While this lasts, folders that carry its token are spared by vacuum."""
        if self._token is not None:
            yield
            return
        self._token = uuid.uuid4().hex
        self._files.put(f"intents/{self._token}")
        try:
            yield
        finally:
            token, self._token = self._token, None
            self._files.delete(f"intents/{token}")

    def _path(self, table: str) -> str:
        return f"data/{table}/{self.version + 1}-{self._token}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, table: str) -> str:
        path = self._path(table)
        df.write.parquet(self._at(path))
        return path

    @contextmanager
    def hold(self) -> Iterator[None]:
        """While this lasts, vacuum keeps the version that this store reads; for readers that may write to its folder."""
        name = f"holds/{self.version}-{uuid.uuid4().hex}"
        self._files.put(name)
        try:
            yield
        finally:
            self._files.delete(name)

    def _publish(self, change: Callable[[], dict | None]) -> None:
        """Publishes the tables that change() makes of the version this store is on; nothing if it makes none.

        If another writer was first, the change goes onto that one's version as it is, unless both changed the same table:
        then it is made anew. Nothing is published once the writer's intent is gone: its folders may be.
        """
        with self._announced():
            self._published(change)

    def _published(self, change: Callable[[], dict | None]) -> None:
        for _ in range(RETRIES):
            base = self._manifest
            tables = change()
            if tables is None:
                return
            while True:
                newest, free = _newest(self._files)
                if any(newest[t] != base[t] for t in tables):
                    self._manifest = newest
                    break
                new = newest | tables | {"version": free}
                if not self._files.there(f"intents/{self._token}"):
                    raise StorageUnavailableError("the writer was given up")
                if self._files.create(_name(free), json.dumps(new)):
                    self._manifest = new
                    return
        raise StorageUnavailableError("other writers were first")

    @contextmanager
    def _staging(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Writes what is read several times once, so that a source that can't be repeated gives one answer."""
        folder = f"data/staged/0-{self._token}-{uuid.uuid4().hex}"

        def stage(df: DataFrame) -> DataFrame:
            path = self._at(f"{folder}/{uuid.uuid4().hex}")
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            self._files.delete(folder)

    def _with_keys(self, keys: DataFrame, some: list[str]) -> DataFrame:
        """Current notices of these keys, with _version; some are the first of the keys, all if they are few."""
        if len(some) <= LISTED_KEYS:
            return self._stored(lambda rows: rows.where(F.col("duid").isin(some)))
        return self._stored(lambda rows: rows.join(keys, "duid", "left_semi"))

    def _layered(self, old: DataFrame, rows: DataFrame) -> dict:
        """The parts of a manifest after rows (NOTICES) took the place of old (STORED): a delta, its postings, the sums."""
        own = self._manifest["notices"]
        written = own["written"] + 1
        path = self._write(rows.select(*NOTICES.fieldNames()).withColumn("_version", F.lit(written).cast("long")).sortWithinPartitions("duid"), "notices")
        delta = self._read("notices", [path])
        sums = {r["which"]: r for r in index_sums(old).withColumn("which", F.lit("before")).unionAll(index_sums(delta).withColumn("which", F.lit("after"))).collect()}
        before, after = sums["before"], sums["after"]
        notices = own | {"deltas": [*own["deltas"], {"path": path, "rows": after["rows"], "level": 0}], "written": written}
        notices |= {k: own[k] + after[k] - before[k] for k in ("n", "words")}
        if not after["words"]:  # tombstones only: nothing to find in them
            return {"notices": notices}
        return {"notices": notices, "postings": [*self._manifest["postings"], self._indexed(index_rows(delta), after["words"])]}

    def _indexed(self, rows: DataFrame, words: int, level: int = 0) -> dict:
        parts = max(1, min(MAX_BUCKETS, words // PART_WORDS))
        path = self._path("postings")
        dealt = rows.select(*POSTINGS.fieldNames()).withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        if parts > 1:  # a frequent term's postings are dealt over several tasks, which all write into its part
            dealt = dealt.repartition("_part", F.pmod(F.xxhash64("duid"), F.lit(PART_TASKS)))
        dealt.sortWithinPartitions("_part", "term").write.partitionBy("_part").parquet(self._at(path))
        return {"path": path, "parts": parts, "words": words, "level": level}

    def _merged(self, incoming: DataFrame, mode: str, collected_at: datetime, gone: DataFrame | None) -> None:
        """All or nothing: rows, revisions, tombstones and postings become visible with one manifest."""
        with self._announced(), self._staging() as stage:
            batch = stage(merge.cleaned(incoming, mode))
            keys = batch.select("duid")
            if gone is not None:
                gone = stage(gone.select("duid").where("duid IS NOT NULL"))
                keys = keys.union(gone)
            keys = keys.distinct()
            some = [r["duid"] for r in keys.limit(LISTED_KEYS + 1).collect()]
            if not some:
                return

            def change() -> dict | None:
                old = self._with_keys(keys, some)
                rows = stage(merge.changed(batch, old, collected_at, mode))
                new = rows.where("_last").select(*NOTICES.fieldNames())
                if gone is not None:
                    others = old.select(*NOTICES.fieldNames()).join(new.select("duid"), "duid", "left_anti").select(*NOTICES.fieldNames())
                    new = merge.apply_tombstones(new.unionByName(others), gone, collected_at)
                tables = self._layered(old, new)
                if not tables["notices"]["deltas"][-1]["rows"]:  # only ids that no notice has
                    return None
                revisions, last = merge.revised(rows), self._manifest["notices"]["last_revision"]
                if n := revisions.count():
                    path = self._write(merge.numbered_revisions(revisions, last, n), "notice_revisions")
                    tables["notice_revisions"] = [*self._manifest["notice_revisions"], {"path": path, "rows": n, "level": 0}]
                    tables["notices"]["last_revision"] = last + n
                return tables

            self._publish(change)
        self._compact()

    def _compact(self) -> None:
        """Merges layers of equal level; of notices all into a new base, where they are much of the old one."""
        self._publish(self._compacted)

    def _compacted(self) -> dict | None:
        tables: dict = {}
        own = self._manifest["notices"]
        deltas, base = own["deltas"], own["base"]
        rows = sum(layer["rows"] for layer in deltas)
        if rows >= FIRST_BASE if not base and len(deltas) < FANOUT else len(deltas) >= FANOUT and rows * BASE_SHARE >= (base["rows"] if base else 0):
            buckets = max(1, min(MAX_BUCKETS, ((base["rows"] if base else 0) + rows) // BUCKET_ROWS))
            path = self._path("notices")
            whole = self._stored().withColumn("_bucket", _bucket(buckets))
            whole.repartitionByRange("_bucket", "duid").sortWithinPartitions("_bucket", "duid").write.partitionBy("_bucket").parquet(self._at(path))
            tables["notices"] = own | {"base": {"path": path, "rows": self.spark.read.parquet(self._at(path)).count(), "buckets": buckets}, "deltas": []}
        elif n := _of_one_size(deltas):
            newest = self._read("notices", [layer["path"] for layer in deltas[-n:]])
            rest = [c for c in STORED.fieldNames() if c != "duid"]
            kept = newest.groupBy("duid").agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select("duid", "_row.*")
            path = self._write(kept.sortWithinPartitions("duid"), "notices")
            merged = {"path": path, "rows": self._read("notices", [path]).count(), "level": deltas[-1]["level"] + 1}
            tables["notices"] = own | {"deltas": [*deltas[:-n], merged]}
        revisions = self._manifest["notice_revisions"]
        if n := _of_one_size(revisions):
            path = self._write(self._read("notice_revisions", [layer["path"] for layer in revisions[-n:]]).sortWithinPartitions("duid"), "notice_revisions")
            tables["notice_revisions"] = [*revisions[:-n], {"path": path, "rows": sum(layer["rows"] for layer in revisions[-n:]), "level": revisions[-1]["level"] + 1}]
        postings = self._manifest["postings"]
        if n := _of_one_size(postings):
            live = self._stored().where("tombstone_at IS NULL").select("duid", "_version")
            kept = self._read("postings", [layer["path"] for layer in postings[-n:]]).join(live, ["duid", "_version"], "left_semi")
            words, level = sum(layer["words"] for layer in postings[-n:]), postings[-1]["level"] + 1
            tables["postings"] = [*postings[:-n], *([self._indexed(kept, words, level)] if kept.limit(1).count() else [])]
            tables.setdefault("notices", own)  # made of these notices: another writer's change to them makes it anew
        return tables or None

    def save_summaries(self, rows: DataFrame, collected_at: datetime) -> None:
        """List rows; a stored body stays and its life starts anew."""
        self._writable("save summaries")
        self._merged(rows, merge.SUMMARY, collected_at, None)

    def save_metadata(self, rows: DataFrame, collected_at: datetime) -> None:
        """List rows; a stored body goes."""
        self._writable("save metadata")
        self._merged(rows, merge.METADATA, collected_at, None)

    def save_details(self, rows: DataFrame, collected_at: datetime, gone: DataFrame | None = None) -> None:
        """Detail rows, which lift a tombstone; then the ids in gone get one."""
        self._writable("save details")
        self._merged(rows, merge.DETAIL, collected_at, gone)

    def mark_gone(self, gone: DataFrame, tombstone_at: datetime) -> None:
        self._writable("mark gone")
        empty = self.spark.createDataFrame([], NOTICES).withColumn("seq", F.lit(0).cast("long"))
        self._merged(empty, merge.DETAIL, tombstone_at, gone)

    def sweep_bodies(self, now: datetime) -> DataFrame:
        """Takes due bodies out; gives the ids (duid), a table that stands until the next vacuum. Only their rows are written."""
        self._writable("sweep bodies")
        swept: list[DataFrame] = []

        def change() -> dict | None:
            path = self._path("swept")
            merge.expired_bodies(self.notices(), now).write.parquet(self._at(path))
            ids = self.spark.read.schema("duid string").parquet(self._at(path))
            swept[:] = [ids]
            if not ids.limit(1).count():
                return None
            old = self._stored().join(ids, "duid", "left_semi").select(*STORED.fieldNames())
            return self._layered(old, merge.sweep_bodies(old, now))

        self._publish(change)
        self._compact()
        return swept[0]

    def _ledger(self, operation: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Appends the rows that a step changes, with its version; many steps are folded into one folder now and then."""
        self._writable(operation)

        def step() -> dict:
            own = self._manifest["crawl_runs"]
            before = self.runs()
            rows = change(before).exceptAll(before)
            if len(own) >= LEDGER_STEPS:
                rows, own = change(before), []
            return {"crawl_runs": [*own, self._write(rows.withColumn("_version", F.lit(self.version + 1).cast("long")), "crawl_runs")]}

        self._publish(step)

    def start_run(self, run_id: str, now: datetime) -> None:
        self._manifest = _newest(self._files)[0] if not self.read_only else self._manifest
        self._ledger("start run", lambda r: runs.start_run(r, run_id, now))

    def update_run(self, run_id: str, now: datetime, **given: int | str | None) -> None:
        self._ledger("update run", lambda r: runs.update_run(r, run_id, now, **given))

    def finish_run(self, run_id: str, status: str, now: datetime) -> None:
        self._ledger("finish run", lambda r: runs.finish_run(r, run_id, status, now))

    def recover_runs(self, now: datetime) -> list[Row]:
        self._ledger("recover runs", lambda r: runs.interrupt_stale(r, now))
        return runs.recovered(self.runs(), now).collect()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests before the newest ``keep`` that nobody holds, and the folders that only they name, also those of writers that died.

        Folders are listed first, then intents, then manifests: what a writer publishes in between is named, what it wrote
        but hasn't published is announced, and what it writes later isn't on the list. An intent that is too old is taken
        away, which stops its writer from publishing; its folders go the next time.
        """
        self._writable("vacuum")
        there = [f"data/{table}/{folder}" for table in self._files.names("data") for folder in self._files.names(f"data/{table}")]
        announced = set(self._files.names("intents"))
        for token in announced:
            if self._files.age(f"intents/{token}") > INTENT_SECONDS:
                self._files.delete(f"intents/{token}")
        held = set()
        for name in self._files.names("holds"):
            if self._files.age(f"holds/{name}") > INTENT_SECONDS:
                self._files.delete(f"holds/{name}")
            else:
                held.add(int(name.split("-")[0]))
        found = {v: m for v in _numbers(self._files) if (m := _whole(self._files, v)) is not None}
        newest = sorted(found)[-1]
        kept = {*sorted(found)[-keep:], *(held & found.keys())}
        named = {path for v in kept for _, path in _folders(found[v])}
        for name in self._files.names("manifest"):
            if _number(name) not in kept and (_number(name) or 0) <= newest and not self._unpublished(name, announced):
                self._files.delete(f"manifest/{name}")
        for path in there:
            if path not in named and not any(token in path for token in announced):
                self._files.delete(path)

    def _unpublished(self, name: str, announced: set[str]) -> bool:
        """Whether a file beside the manifests is one that a writer is about to publish."""
        return _number(name) is None and bool(announced)


def _name(version: int) -> str:
    return f"manifest/{version:012d}.json"


def _number(name: str) -> int | None:
    return int(name[:12]) if name.endswith(".json") and len(name) == 17 and name[:12].isdigit() else None


def _numbers(files: _Files) -> list[int]:
    return sorted(v for n in files.names("manifest") if (v := _number(n)) is not None)


def _whole(files: _Files, version: int) -> dict | None:
    """A manifest, None if its writer died before the end of it."""
    try:
        return json.loads(files.read(_name(version)))
    except ValueError:
        return None


def _newest(files: _Files) -> tuple[dict, int]:
    """The newest manifest that is whole, and the first number after all that are taken."""
    numbers = _numbers(files)
    for version in reversed(numbers):
        found = _whole(files, version)
        if found is not None:
            if found["schema_version"] > SCHEMA_VERSION:
                raise SchemaVersionError(found["schema_version"])
            return found, numbers[-1] + 1
    raise StorageUnavailableError("no store here")


def open_store(spark: SparkSession, root: str) -> NoticeStore:
    """Opens a store for writing and makes it if there is none."""
    files = _Files(spark, root)
    if files.scheme not in WRITABLE:
        raise StorageUnavailableError(f"can't publish on {files.scheme}")
    if not any(_whole(files, v) for v in _numbers(files)):
        taken = _numbers(files)
        first = taken[-1] + 1 if taken else 1
        files.create(_name(first), json.dumps({"schema_version": SCHEMA_VERSION, "redaction_version": REDACTION_VERSION, "version": first} | _EMPTY))
    return NoticeStore(spark, files.root, _newest(files)[0], files, read_only=False)


def open_read_only(spark: SparkSession, root: str) -> NoticeStore:
    """Opens the newest version for reading, all its folders checked against the contract. Never makes a store."""
    try:
        files = _Files(spark, root)
        store = NoticeStore(spark, files.root, _newest(files)[0], files, read_only=True)
        if not is_valid(store):
            raise StorageUnavailableError("schema")
    except (*_FAILURES, OSError, KeyError, TypeError) as error:
        raise StorageUnavailableError("open") from error
    return store


#: Folders that conformed when they were looked at, with their times: folders are never written to again.
_CONFORMING: set[tuple[str, str, int]] = set()


def is_valid(store: NoticeStore) -> bool:
    """Whether every folder on disk has exactly the contract's columns and types."""
    partitions = {"notices": "_bucket", "postings": "_part"}
    for table, path in _folders(store._manifest):
        seen = (store.root, path, store._files.changed_at(path))
        if seen not in _CONFORMING:
            there = [(f.name, f.dataType) for f in store.spark.read.parquet(store._at(path)).schema if f.name != partitions.get(table)]
            if there != [(f.name, f.dataType) for f in _FILES[table]]:
                return False
            _CONFORMING.add(seen)
    return True
