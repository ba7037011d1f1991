"""Helpers that the operators of this subpackage share: text columns, word splitting, shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_OTHER_BLANKS = re.compile("[\x09-\x0d]")

#: Characters of text that a Python worker takes on at once; one longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000
#: Entries after which a worker's word cache starts anew.
CACHE_ENTRIES = 400_000


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for a null text."""
    if not text:
        return []
    return [w for w in _OTHER_BLANKS.sub(" ", text).split(" ") if w]


_LOWER = {i: i + 32 for i in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z to a-z, everything else as it is."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


def lowered(text: str) -> str:
    """As ascii_lower(), faster for long texts that aren't ASCII: lower() of bytes knows A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class WordHashes(dict):
    """Word to its 64-bit hash; bounded, because it forgets everything at CACHE_ENTRIES words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    return x ^ (x >> _S33)


def window_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash for each position of the words at these offsets from it; empty if the text is shorter."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o in offsets:
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[o : o + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def texts_in(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in chunks of about so many characters."""
    at, chunk, chars = 0, [], 0
    for i, cell in enumerate(batch.column(batch.schema.get_field_index(column))):
        text = cell.as_py()
        chunk.append(text)
        chars += len(text or "")
        if chars >= most:
            yield at, chunk
            at, chunk, chars = i + 1, [], 0
    if chunk:
        yield at, chunk


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), whatever else the input holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id"):
    """Column: crc32 of the id as text, mod 5, is 0. A null id is never held out, and never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back. A lost executor costs no more than a read."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_folder = path
    return out


def forget(*tables) -> None:
    """Deletes tables that materialize() wrote, and what maybe_among() sent, when nothing reads them any more."""
    for own in tables:
        if isinstance(own, DataFrame):
            drop_folder(own.sparkSession, own._tidemark_folder)
        else:
            own._tidemark_sent.destroy()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside it Spark deletes the shuffle files of each action as soon as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits, as a power of two, of a table that tells which ids may be in a set, and of its pieces.
ID_BITS, ID_PIECE_BITS = 27, 16


def _id_slots(ids: np.ndarray) -> np.ndarray:
    """Two slots for each id."""
    h = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([h >> np.uint64(64 - ID_BITS), h & np.uint64((1 << ID_BITS) - 1)])


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << (ID_BITS - 3), np.uint8)
    for batch in batches:
        slots = np.unique(_id_slots(batch.column(0).to_numpy()))
        np.bitwise_or.at(table, (slots >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (slots & np.uint64(7)).astype(np.uint8))
    for k, own in enumerate(table.reshape(-1, 1 << (ID_PIECE_BITS - 3))):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["piece", "bits"])


def _id_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(bits), np.uint8)
            pieces[k] = own if k not in pieces else pieces[k] | own
    for k, own in pieces.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["piece", "bits"])


class _IdTable:
    """A table in pieces that stay packed, as they are sent, until a worker first asks for the bits."""

    def __init__(self, pieces: dict[int, bytes]):
        self.pieces = pieces

    @cached_property
    def bits(self) -> np.ndarray:
        pieces, self.pieces = self.pieces, {}
        table = np.zeros((1 << (ID_BITS - ID_PIECE_BITS), 1 << (ID_PIECE_BITS - 3)), np.uint8)
        for k, own in pieces.items():
            table[k] = np.frombuffer(zlib.decompress(own), np.uint8)
        return table.ravel()


def maybe_among(ids: DataFrame):
    """A function of a long column that tells whether the id may be among ids (one long column): never false for one that is, null for null.

    Behind it is a table of 2^ID_BITS bits, of fixed size in a worker's memory whatever the number of ids: it keeps rows out of a
    shuffle that decides exactly, and lets more of them through the more ids there are. It is sent packed, because the driver and
    each executor keep what is sent on disk, until forget() is told that nothing asks it any more.
    """
    spark = ids.sparkSession
    pieces = ids.toDF("id").where("id IS NOT NULL").mapInArrow(_id_pieces, "piece int, bits binary")
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "piece").mapInArrow(_id_union, "piece int, bits binary")
    packed: dict[int, bytes] = {}
    for batch in pieces.toArrow().to_batches():
        packed |= zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    sent = spark.sparkContext.broadcast(_IdTable(packed))

    @F.arrow_udf("boolean")
    def among(own: pa.Array) -> pa.Array:
        slots = _id_slots(own.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        found = sent.value.bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
        return pa.array(found.all(0), pa.bool_(), mask=np.asarray(own.is_null()))

    among._tidemark_sent = sent
    return among


def bounded_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most this many rows, the same ones in every run: those whose ids hash lowest (a distributed top-k)."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(17)), F.col(id_col)).limit(most)
