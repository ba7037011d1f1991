import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.best_fit_packing import CAPACITY, END_ID, IdBytes, exact_patterns, fitted_counts, pack_documents, packing_plan


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def best_fit_decreasing(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


TEXTS = [
    "", " ", "\n", "a", "  two  spaces ", "tab\there", " lead", "trail ", "it's 42% o'clock, <|endoftext|> ok", "é l'été  no-break", "x y z",
    "line\nline two\n\n three", "日本語 テキスト", "a" * 5000, "word " * 300, "\x1cab \x1f cd", "mixed\r\nends \r\n here", "“quoted” — dash … end",
]


def test_ids_are_the_tokenizers(tokenizer, spark, sf_dir):
    encode = IdBytes()
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    random.seed(3)
    odd = ["".join(random.choice(" ab'\n\t é1,.! ") for _ in range(40)) for _ in range(300)]
    for text in [*TEXTS, *docs, *odd]:
        got = np.frombuffer(encode(text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_exact_patterns_are_all_pairs_and_triples():
    own = exact_patterns(np.array([2, 3, 4, 5, 10]), 10)
    got = {tuple(sorted(int(x) for x in p if x)) for p in own}
    assert got == {(5, 5), (2, 3, 5), (2, 4, 4), (3, 3, 4)}


def active_set_fit(a, b):
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        slope = a.T @ (b - a @ x)
        if not (~free & (slope > 1e-7)).any():
            return x
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            tried = np.zeros_like(x)
            tried[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (tried <= 1e-9)
            if not low.any():
                x = tried
                break
            x += min(1.0, (x[low] / np.maximum(x[low] - tried[low], 1e-12)).min()) * (tried - x)
            free &= x > 1e-9
            x[~free] = 0


@pytest.mark.parametrize("seed", range(8))
def test_fit_converges_to_the_least_squares_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(12, 40))
    lengths = rng.integers(1, capacity, 400) if seed % 2 else np.minimum(capacity - 1, rng.geometric(3 / capacity, 400))
    hist = np.bincount(lengths, minlength=capacity + 1)
    patterns = exact_patterns(np.flatnonzero(hist), capacity)
    a = np.zeros((capacity + 1, len(patterns)))
    for k in range(3):
        np.add.at(a, (patterns[:, k], np.arange(len(patterns))), 1)
    a[0] = 0
    best = active_set_fit(a, hist.astype(float))
    assert (best >= 0).all()
    # Distances to the histogram, as shares of it. The 200 rounds of the plan stop short of the optimum, by how much is their bound.
    optimum = float(np.linalg.norm(hist - a @ best) / np.linalg.norm(hist))
    for rounds, beyond in ((200, 0.03), (20_000, 0.001)):
        got = fitted_counts(patterns, hist, rounds)
        assert (got >= 0).all() and optimum - 1e-6 <= np.linalg.norm(hist - a @ got) / np.linalg.norm(hist) <= optimum + beyond


def test_long_texts_repeated_rows_and_clashing_names(spark, tokenizer):
    text = "long words and more of them, " * 40_000
    docs = spark.createDataFrame([(1, text, 7, "x"), (2, "short", 8, "y"), (2, "short", 8, "y"), (None, None, 9, None)], "doc_id long, text string, piece int, sequence_id string")
    rows = pack_documents(docs).collect()
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, END_ID]
    own = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert [r["piece"] for r in own] == list(range(-(-len(ids) // CAPACITY))) and sum(r["length"] for r in own) == len(ids)
    for r in own:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and [r["length"] for r in rows if r["doc_id"] is None] == [1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once_and_uses_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 3000) if seed % 2 else np.minimum(1024, rng.geometric(1 / 300, 4000))
    hist = Counter(map(int, lengths))
    runs, n = packing_plan(hist)
    filled = [[] for _ in range(n)]
    for length, own in runs.items():
        assert sum(r[1] for r in own) == hist[length]
        at = 0
        for first, count, sequence, offset in own:
            assert first == at
            at += count
            for k in range(count):
                filled[sequence + k].append((offset, length))
    for own in filled:
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert 0 < end <= CAPACITY
    bound = -(-int(lengths.sum()) // CAPACITY)
    assert n <= max(best_fit_decreasing(lengths.tolist(), CAPACITY), bound + 2) + bound // 500
    assert packing_plan({}) == ({}, 0)


def test_pack_documents_round_trip(spark, tokenizer):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "word " * 2000, "y"), (91, "word " * 2000, "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = pack_documents(docs).collect()
    pieces = sorted((r for r in out if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["piece"]))
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in [*enumerate(TEXTS), (90, "")]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, END_ID], "<u4")
        own = by_doc[i]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == CAPACITY for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(by_doc[91]) == 2 * len([r for r in by_doc[91] if r["piece"] == 0]) or len(by_doc[91]) % 2 == 0
    assert sum(r["doc_id"] is None for r in out) == 1
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= CAPACITY
    assert pack_documents(docs.limit(0)).count() == 0
    json.dumps([r.asDict() for r in out])
