"""Operator 7: near-duplicate classes with SetSketch registers.

1. A document's set is its distinct five-word shingles. Documents with equal sets are one node.
2. Every node has m SetSketch registers: truncated logarithms, to a base near 1, of exponentially distributed
   minima. They merge by maximum, and equal registers are as likely as the sets are alike, so bands of registers
   are keys of locality-sensitive hashing.
3. In each bucket all nodes are compared with its smallest. The joint likelihood of greater, equal and smaller
   registers estimates the similarity; pairs far below the threshold go, the others are confirmed on full sets.
4. Confirmed links are joined to components. In buckets that still hold several components, the pairs between
   components are compared in blocks of bounded size: first registers alone meet, and only members of a likely pair
   get their texts, which are compared on full sets; only links that join components leave a block. So no bucket is
   capped, and pairs inside a component are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WordHashes, ascii_lower, documents_of, forget, materialize, maybe_among, mixed, texts_in, window_hashes, words_of

SHINGLE = 5
BANDS, ROWS = 26, 5
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
BLOCK = 256
#: Number of the first block of a bucket's largest component.
APART = 1_000_000
#: Members of one bucket's smallest node that a task compares.
SALT_ROWS = 64
#: Tasks over which the rows of one node are dealt where they meet what is known of it.
SALTS = 64


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text's whole sequence counts as one."""
    own = hashes.array(words_of(ascii_lower(text or "")))
    if not len(own):
        return own
    if len(own) < size:
        return mixed(window_hashes(own, tuple(range(len(own)))) + np.uint64(len(own)))
    return np.unique(window_hashes(own, tuple(range(size))))


def _factors(m: int) -> np.ndarray:
    return mixed(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers (len(sets) x m, unsigned 16 bits) of non-empty sets."""
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), m), np.uint64)
    buffer = np.empty_like(values)
    for i, a in enumerate(_factors(m)):
        np.multiply(values, a, out=buffer)
        least[:, i] = np.minimum.reduceat(buffer, starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def _p1(x: np.ndarray) -> np.ndarray:
    return (BASE - 1) / BASE / (1 - x * (BASE - 1) / BASE) / math.log(BASE)


def likelihood_slope(j, u, v, plus, minus, equal) -> np.ndarray:
    """Derivative by the similarity j of the joint log likelihood; it falls with j, so its sign places the estimate."""
    a, b = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    pa_, pb_ = _p(a), _p(b)
    down, over = v * _p1(a), u * _p1(b)
    return -plus * down / pa_ - minus * over / pb_ + equal * (down + over) / np.maximum(1 - pa_ - pb_, 1e-12)


def estimated_similarity(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from registers (rows of ka, kb) and set sizes."""
    plus, minus = (ka > kb).sum(-1), (ka < kb).sum(-1)
    equal = ka.shape[-1] - plus - minus
    u = na / (na + nb)
    v = 1 - u
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):
        mid = (low + high) / 2
        up = likelihood_slope(mid, u, v, plus, minus, equal) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def likely_at_least(cut: float, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the maximum-likelihood similarity is at least cut: the likelihood still rises there. No search is needed."""
    plus, minus = (ka > kb).sum(-1), (ka < kb).sum(-1)
    u = na / (na + nb)
    v = 1 - u
    return (np.minimum(u / v, v / u) >= cut) & (likelihood_slope(cut, u, v, plus, minus, ka.shape[-1] - plus - minus) >= 0)


def prune_below(threshold: float, m: int) -> float:
    """Estimates under this are dropped before the full sets are compared: 4.5 standard errors below the threshold."""
    return max(0.0, threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / m))


def _sketched(m: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in texts_in(batch, most=600_000):
                sets = [shingle_set(t, hashes, size) for t in texts]
                full = [k for k, s in enumerate(sets) if len(s)]
                regs: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, registers([sets[k] for k in full], m), strict=True):
                        regs[k] = row.tobytes()
                same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], schema=schema)

    return run


def _banded(bands: int, rows: int):
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1), bands, rows)
            nodes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, bands))], schema=schema)

    return run


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each row and band; the band is part of it."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(regs), bands)).copy()
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    for i in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def _likely(threshold: float, m: int):
    cut = prune_below(threshold, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at = {f: i for i, f in enumerate(batch.schema.names)}
            na, nb = (batch.column(at[c]).to_numpy().astype(float) for c in ("na", "nb"))
            ka, kb = (np.frombuffer(b"".join(batch.column(at[c]).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("ra", "rb"))
            good = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & likely_at_least(cut, ka, kb, na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(at["a"]), batch.column(at["b"])], names=["a", "b"]).filter(pa.array(good))

    return run


def _confirmed(percent: int, size: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, key = WordHashes(), [], None
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            out: list[tuple[int, int]] = []
            for a, salt, member, node, cell in zip(*(batch.column(at[c]).to_pylist() for c in ("a", "salt", "member", "node")), batch.column(at["text"]), strict=True):
                if (a, salt) != key:
                    held, key = [], (a, salt)
                own = shingle_set(cell.as_py(), hashes, size)
                if not member:
                    held.append(own)
                elif any(linked(own, other, percent) for other in held):
                    out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _per_node(rows: DataFrame, partial: Column, total: Callable[[str], Column]) -> DataFrame:
    """rows (a, b) with _v, an aggregate over all rows of their a.

    Rows of a node with many of them never meet in one task: they are dealt by (a, salt) and aggregated in two steps, and
    what is found goes back to the salts that there are, SALTS for a node at most.
    """
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "_s").agg(partial.alias("_v"))
    whole = parts.groupBy("a").agg(total("_v").alias("_v"))
    # Merged, not broadcast: rounds of components have dozens of these joins, and broadcast tables add up in the executors.
    spread = parts.select("a", "_s").join(whole.hint("merge"), "a")
    return salted.join(spread.hint("merge"), ["a", "_s"]).drop("_s")


def _texts_where(plain: DataFrame, among: Callable) -> DataFrame:
    """(node, text): texts that may be a node's, and only these, move from here to the join that decides."""
    return plain.where(among("doc_id")).withColumnRenamed("doc_id", "node")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs (a, b) that are links. A node with many partners is spread over several tasks."""
    counted = _per_node(pairs, F.count(F.lit(1)), F.sum)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("_v") / SALT_ROWS)).cast("int").alias("salt")
    members = counted.select("a", salt, F.lit(1).alias("member"), F.col("b").alias("node"))
    heads = members.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("node"))
    asked = members.unionByName(heads).join(texts, "node")
    return asked.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(_confirmed(percent, size), "a long, b long")


class _Block:
    """Members of one bucket's pair of blocks, rows (side, node, comp, head, n, regs, ...): side 2 is a block with itself,
    else 0 meets 1. A pair is looked at in the first band that it shares, and not if one of the two is the bucket's head,
    which was compared with all."""

    def __init__(self, bucket: int, members: list[tuple], percent: int, bands: int, rows: int):
        self.bucket, self.percent, self.cut = bucket, percent, prune_below(percent / 100, bands * rows)
        self.left = [r for r in members if r[0] != 1]
        self.right = self.left if self.left and self.left[0][0] == 2 else [r for r in members if r[0] == 1]
        if self.left and self.right:
            self.node, self.comp, self.head, self.n = (np.array([r[k] for r in self.right], np.int64) for k in (1, 2, 3, 4))
            self.regs, self.own = (np.frombuffer(b"".join(r[5] for r in side), np.uint16).reshape(len(side), -1) for side in (self.right, self.left))
            self.keys, self.own_keys = band_keys(self.regs, bands, rows), band_keys(self.own, bands, rows)

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place on the left, places on the right) of pairs between components that the registers let pass."""
        for i, (side, a, comp, _, na, *_) in enumerate(self.left if self.right else []):
            able = (self.comp != comp) & (100 * np.minimum(self.n, na) >= self.percent * np.maximum(self.n, na)) & (self.node != self.head) & (a != self.head)
            if side == 2:
                able &= self.node > a
            at = np.flatnonzero(able)
            if len(at):
                first = (self.keys[at] == self.own_keys[i]).argmax(1)
                at = at[self.keys.view(np.int64)[at, first] == self.bucket]
            if len(at):
                at = at[likely_at_least(self.cut, np.broadcast_to(self.own[i], (len(at), self.own.shape[1])), self.regs[at], np.full(len(at), float(na)), self.n[at].astype(float))]
            if len(at):
                yield i, at


def _by_block(found: Callable[[tuple, list[tuple]], list[tuple]], schema: pa.Schema):
    """Applies found to each group of rows with equal (bucket, i, j); the rows are sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def done() -> pa.RecordBatch:
            rows = found(key, members) if key is not None else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    yield done()
                    key, members = row[:3], []
                members.append(row[3:])
        yield done()

    return run


def _wanted(percent: int, bands: int, rows: int):
    """The members of a pair of blocks that are in a likely pair."""

    def found(key: tuple, members: list[tuple]) -> list[tuple]:
        block = _Block(key[0], members, percent, bands, rows)
        lefts, rights = set(), set()
        for i, at in block.likely():
            lefts.add(i)
            rights.update(at.tolist())
        chosen = [block.left[i] for i in sorted(lefts | rights)] if block.right is block.left else [*(block.left[i] for i in sorted(lefts)), *(block.right[k] for k in sorted(rights))]
        return [(*key, *r) for r in chosen]

    return _by_block(found, pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("head", pa.int64()), ("n", pa.int64()), ("regs", pa.binary())]))


def _blocks(percent: int, bands: int, rows: int, size: int):
    """Links between components in one bucket's pair of blocks; of those that join the same components one."""
    hashes = WordHashes()

    def found(key: tuple, members: list[tuple]) -> list[tuple[int, int]]:
        block = _Block(key[0], members, percent, bands, rows)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        # By place, not by node: rows that share a doc_id may have different texts.
        sets: dict[tuple[bool, int], np.ndarray] = {}

        def of(right: bool, k: int) -> np.ndarray:
            place = right and block.right is not block.left, k
            if place not in sets:
                sets[place] = shingle_set((block.right if right else block.left)[k][6], hashes, size)
            return sets[place]

        out = []
        for i, at in block.likely():
            for k in at.tolist():
                x, y = root(block.left[i][2]), root(int(block.comp[k]))
                if x != y and linked(of(False, i), of(True, k), percent):
                    joined[max(x, y)] = min(x, y)
                    out.append((block.left[i][1], int(block.node[k])))
        return out

    return _by_block(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _between_components(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, plain: DataFrame, percent: int, bands: int, rows: int, size: int) -> DataFrame:
    """Confirmed links (a, b) between different components that share a bucket of three nodes or more.

    A bucket's largest component is not compared with itself: its nodes and the others are put into blocks apart, and
    only pairs of blocks of which one is of the others meet.
    """
    named = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    shares = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = shares.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("size")).where("most < size AND size > 2")
    inside = named.join(several, "bucket").withColumn("apart", F.col("comp") == F.col("largest"))
    # Blocks by hash: as many as bring each to about BLOCK nodes. Those of the largest component are numbered from APART.
    own_blocks = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")
    large_blocks = F.ceil(F.col("most") / BLOCK).cast("int")
    place = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("apart"), large_blocks).otherwise(own_blocks)).cast("int")
    inside = inside.withColumn("block", place + F.when(F.col("apart"), APART).otherwise(0))
    own, large = F.sequence(F.lit(0), own_blocks - 1), F.sequence(F.lit(APART), large_blocks + (APART - 1))
    other = F.explode(F.when(F.col("apart"), own).otherwise(F.concat(own, large))).alias("other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    spread = inside.select("bucket", "node", "comp", "head", "block", other).join(nodes, "node")
    spread = spread.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "node", "comp", "head", "n", "regs")
    block = ["bucket", "i", "j"]
    likely = spread.repartition(*block).sortWithinPartitions(*block).mapInArrow(_wanted(percent, bands, rows), spread.schema)
    wanted = materialize(likely, "wanted")
    among = maybe_among(wanted.select("node"))
    asked = wanted.join(_texts_where(plain, among), "node").select(*spread.columns, "text")
    more = materialize(asked.repartition(*block).sortWithinPartitions(*block).mapInArrow(_blocks(percent, bands, rows, size), "a long, b long"), "more")
    forget(wanted, among)
    return more


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that have a link: comp is the smallest node reachable. Links (a, b), a != b, either way round.

    Alternates two steps that hang neighbours on the smallest one; each round is a table in the shared folder.
    """

    def step(edges: DataFrame) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _per_node(both, F.min("b"), F.min).where("b > a").select(F.col("b").alias("a"), F.least("_v", "a").alias("b")).where("a != b")
        hung = _per_node(large, F.min("b"), F.min)
        return hung.select(F.when(F.col("b") == F.col("_v"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_v").alias("b")).where("a != b").distinct()

    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while (now := mark(edges)) != before:
        before = now
        if not now[0]:
            break
        old, edges = edges, materialize(step(edges), "edges")
        forget(old)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


def near_duplicate_classes(docs: DataFrame, percent: int = 85, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept for each row; with ``only``, a table of one column of distinct ids, for
    each row of these documents, as if there were no others.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets, components are closed
    under links, component_id is the smallest doc_id in it, kept marks that document.

    Null texts and texts without words have an empty set and are linked with nothing. Texts of fewer words than a
    shingle are one shingle. Rows that share a doc_id are one document, which is linked through any of its texts;
    of such rows all have the same kept. A row without doc_id is linked with nothing: component_id null, kept true.
    Very long texts count whole. Other columns are not read, whatever their names. An empty table gives no rows. With the default bands a pair at exactly 85 % is missed with a chance below 1e-6.
    """
    m, threshold = bands * rows, percent / 100
    plain = documents_of(docs, id_col, text_col)
    sketched = materialize(plain.mapInArrow(_sketched(m, size), "doc_id long, n long, same binary, regs binary"), "sketches")
    rows_ = sketched.drop("regs")
    if only is not None:
        rows_ = rows_.join(only.toDF("doc_id"), "doc_id", "left_semi")
    rows_ = materialize(rows_, "rows")
    able = rows_.where("doc_id IS NOT NULL AND n > 0")
    sets = sketched.where("n > 0").groupBy("same").agg(F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = materialize(able.groupBy("same").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).join(sets.hint("merge"), "same"), "nodes")
    # The registers are kept once.
    forget(sketched)
    sketches = nodes.select("node", "n", "regs")
    banded = nodes.select("node", "regs").mapInArrow(_banded(bands, rows), "bucket long, node long")
    heads = banded.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("bucket", "head")
    buckets = materialize(banded.join(heads, "bucket"), "buckets")
    pairs = buckets.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    likely = (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        .select("a", "b", "na", "nb", "ra", "rb")
        .mapInArrow(_likely(threshold, m), "a long, b long")
    )
    likely = materialize(likely, "likely")
    among = maybe_among(likely.select(F.explode(F.array("a", "b"))))
    labels = components(_confirm(likely, _texts_where(plain, among), percent, size))
    forget(among)
    more = _between_components(buckets, labels, sketches, plain, percent, bands, rows, size)
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    # Labels are a table of their own now; of the rest only the rows and nodes are read again.
    forget(buckets, likely, more)
    # Equal sets share a node; a document with several texts joins their nodes.
    own = able.select("doc_id", "same").distinct().join(nodes.select("same", "node"), "same").select("doc_id", "node")
    if own.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").limit(1).count():
        extra = own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b")
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a != b").union(extra))
    where_ = nodes.select("same", "node").join(labels, "node", "left").select("same", F.coalesce("comp", "node").alias("component_id"))
    # Rows without a set, or without an id, don't take part in the join: their null keys would all go to one task.
    linkable = F.col("doc_id").isNotNull() & F.col("same").isNotNull()
    alone = rows_.where(~linkable).select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    got = rows_.where(linkable).select("doc_id", "n", "same").join(where_, "same", "left").select("doc_id", "n", "component_id").unionAll(alone)
    component = F.coalesce("component_id", "doc_id")
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
