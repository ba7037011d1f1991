"""Operator 8: URL rules by a sort-merge range join.

A host's labels in reverse, each closed by a character below all that keys hold otherwise, make a canonical key: a host and
all its subdomains are one interval of keys, and the intervals of rules nest. Pages are dealt into key ranges (with
the page's path and id in the key, so that a host with many pages spans several ranges); a rule goes to each range
that its interval meets. A sweep over the sorted range keeps a stack of the rule hosts that are open at the current
key; the longest rule on the stack whose path starts the page's path decides.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closes a label in a key; and the character after it, which closes an interval.
CLOSE, AFTER = "\x01", "\x02"
#: What stands in a key for characters up to AFTER, and for the first of these marks itself, so that no label holds them.
ESCAPES = (("\x03", "\x03d"), ("\x00", "\x03a"), (CLOSE, "\x03b"), (AFTER, "\x03c"))
DEFAULT_VERDICT = "allow"
#: Rows sampled for each range.
SAMPLE_PER_PART = 20
_SWEEP_NAMES = ["part", "key", "kind", "host", "path", "page_id", "verdict"]
_SWEEP_SCHEMA = "part int, key string, kind int, host string, path string, page_id long, verdict string"


@dataclass(frozen=True)
class Rule:
    """Fits the host, its subdomains, and paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Reversed labels, each followed by CLOSE; empty for an empty host. Characters up to AFTER are escaped in the key."""
    safe = host
    for character, instead in ESCAPES:
        safe = F.replace(safe, F.lit(character), F.lit(instead))
    safe = F.when(host.rlike("[\\x00-\\x03]"), safe).otherwise(host)
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), CLOSE), F.lit(CLOSE)))


def _place(key: str, path: str, page: int | None) -> tuple[str, str, int]:
    return key, path, -(2**63) if page is None else page


def _pages_placed(cuts: list[tuple[str, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            part = [bisect_right(cuts, _place(*x)) for x in zip(*(at[c].to_pylist() for c in ("key", "path", "page_id")), strict=True)]
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), at["key"], pa.array([1] * n, pa.int32()), at["host"], at["path"], at["page_id"], pa.nulls(n, pa.string())], names=_SWEEP_NAMES)

    return run


def _rules_placed(cuts: list[tuple[str, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names)}
            rows = []
            for key, host, path, verdict in zip(at["key"], at["host"], at["path"], at["verdict"], strict=True):
                # The interval: from the key to the key with AFTER for its last CLOSE; the empty key is all.
                first = bisect_right(cuts, _place(key, "", None))
                last = bisect_right(cuts, _place(key[:-1] + AFTER, "", None)) if key else len(cuts)
                rows += [(p, key, 0, host, path, None, verdict) for p in range(first, last + 1)]
            types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_SWEEP_NAMES)

    return run


def _swept(default: str):
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A frame of the stack: host key, {path: (verdict, text)}, path lengths, longest first.
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        part = None
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            out: list[list] = [[] for _ in names]
            for p, key, kind, host, path, page, verdict in zip(*(batch.column(at[c]).to_pylist() for c in ("part", "key", "kind", "host", "path", "page_id", "verdict")), strict=True):
                if p != part:
                    stack, part = [], p
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, paths, lengths = stack[-1]
                    old = paths.get(path)
                    if old is None or (old[0] != "block" and verdict == "block"):
                        paths[path] = (verdict, host + path)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best: tuple[int, bool, str, str] | None = None
                for _, paths, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (found := paths.get(path[:n])):
                            found_ = (len(found[1]), found[0] == "block", found[1], found[0])
                            best = found_ if best is None or found_ > best else best
                            break
                for column, value in zip(out, (page, host, path, best[2] if best else None, best[3] if best else default), strict=True):
                    column.append(value)
            types = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule], default: str = DEFAULT_VERDICT, parts: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns page_id, host, path, rule, verdict, one row for each row of pages.

    A rule fits its host and all subdomains if the page's path starts with the rule's. Of several the longest text
    wins, of equal texts block. Where none fits, rule is null and the verdict is ``default``. rules is a sequence or
    a table (host, path, verdict) of any size; its null cells count as empty, a rule without host fits every host.

    A null url, and one without ://, has empty host and path. Hosts may hold any character, controls too. Very long
    urls are judged whole. Repeated rows are judged each; a null page_id stays null. Other columns are not read, whatever
    their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("key", key_of(F.col("host")))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Cuts of (key, path, id) from a bounded sample; they only even out the ranges, any cuts give right results.
    share = min(1.0, SAMPLE_PER_PART * parts / max(1, own.count()))
    sample = own.where(F.pmod(F.xxhash64("key", "path", "page_id"), F.lit(1_000_000)) < share * 1_000_000).limit(10 * SAMPLE_PER_PART * parts)
    places = sorted(_place(*r) for r in sample.select("key", "path", "page_id").collect())
    cuts = sorted({places[i * len(places) // parts] for i in range(1, parts)}) if places else []
    page_rows = own.mapInArrow(_pages_placed(cuts), _SWEEP_SCHEMA)
    ruled = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path")), F.coalesce(F.col("verdict").cast("string"), F.lit("block")).alias("verdict")).distinct()
    rule_rows = ruled.withColumn("key", key_of(F.col("host"))).mapInArrow(_rules_placed(cuts), _SWEEP_SCHEMA)
    swept = page_rows.unionByName(rule_rows).repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    return swept.mapInArrow(_swept(default), "page_id long, host string, path string, rule string, verdict string")
