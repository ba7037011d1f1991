"""Operator 1: cumulative snapshots of conversations, collapsed to the maximal ones and rendered.

A log often holds a conversation several times, each time a little longer. The hash of a prefix is the hash of the
previous prefix's hash with the next turn. A conversation whose whole hash is among the hashes of proper prefixes of
others is a snapshot of a longer one: an anti-join on the distinct prefix hashes removes it. Of equal conversations
the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize

TEMPLATE_START, TEMPLATE_END = "<|im_start|>", "<|im_end|>"


def turn_bytes(role: str | None, text: str | None) -> bytes:
    """A turn as bytes from which role and text can be told apart; null and empty differ."""
    parts = [b"-" if x is None else b"+" + x.encode("utf-8", "surrogatepass") for x in (role, text)]
    return len(parts[0]).to_bytes(8, "little") + parts[0] + parts[1]


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (conv_id, n, hash, whole): the hash of the first n turns; whole marks a conversation's last one."""
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("hash", pa.binary()), ("whole", pa.bool_())])
    held: tuple[int, int, bytes] | None = None
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            n, last = 0, b""
            if held is not None:
                rows.append((*held, held[0] != conv))
                if held[0] == conv:
                    _, n, last = held
            held = conv, n + 1, xxhash.xxh3_128_digest(last + turn_bytes(role, text))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), schema, strict=True)], schema=schema)


def rendered(turns: Column) -> Column:
    """Turns (structs with role and text) as one text."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(TEMPLATE_START), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(TEMPLATE_END + "\n"))),
        "",
    )


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_id, n_turns, n_equal (conversations equal to it, itself included) and text of the maximal conversations.

    Turns go by turn, then role, then text, nulls first; so ties and repeated rows have one order, and repeated rows
    are turns like others. A null role is rendered as unknown, a null text as empty, but they differ from those when
    conversations are compared. Turns without a conversation id are left out. Very long texts are hashed and rendered
    whole. Other columns are not read, whatever their names. An empty table gives no rows. A conversation is one row
    of the result, so it is the unit that must fit into a task.
    """
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where("conv_id IS NOT NULL")
    in_order = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rolled = materialize(in_order.mapInArrow(_rolled, "conv_id long, n long, hash binary, whole boolean"), "prefixes")
    prefixes = rolled.where("NOT whole").select("hash").distinct()
    maximal = rolled.where("whole").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal")).join(prefixes, "hash", "left_anti")
    texts = own.join(maximal.select("conv_id", "n_equal"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"), F.first("n_equal").alias("n_equal"))
    return texts.select("conv_id", F.size("x").cast("long").alias("n_turns"), "n_equal", rendered(F.col("x")).alias("text"))
