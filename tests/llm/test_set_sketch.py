import random

import numpy as np
import pytest

from tidemark.llm import set_sketch
from tidemark.llm._common import WordHashes, ascii_lower, words_of
from tidemark.llm.set_sketch import BANDS, ROWS, band_keys, components, estimated_similarity, linked, near_duplicate_classes, registers, shingle_set


def brute(rows, percent=85):
    """Components by comparing all pairs of word-shingle sets."""

    def shingles(text):
        w = words_of(ascii_lower(text or ""))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def fixture_rows():
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(12):
        base = [f"t{rng.randrange(4000)}" for _ in range(rng.choice((20, 60, 200)))]
        for n in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            rows.append((i, " ".join(edited(base, n, rng))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one two"), (i + 4, "ONE\ttwo"), (i + 5, "two one"), (i + 6, "a b c d e"), (i + 7, "A b c d e")]
    return rows


def test_classes_equal_brute_force(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n long, same string").selectExpr("*", "1 AS node", "'b' AS bucket", "2 AS regs", "3 AS component_id", "false AS kept", "4 AS head").repartition(5)
    got = {r["doc_id"]: r for r in near_duplicate_classes(docs).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 20
    hashes = WordHashes()
    assert all(got[i]["n_shingles"] == len(shingle_set(t, hashes)) for i, t in rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(edited(base, rng.choice((1, 2, 3, 4)), rng))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(docs).collect()}
    assert got == brute(rows)


def test_null_ids_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z"), (9, "other words"), (9, "x y z"), (12, "other words")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicate_classes(docs).collect()), key=str)
    assert got == sorted([(-1, None, True), (-1, None, True), (5, 5, True), (9, 5, False), (9, 5, False), (12, 5, False)], key=str)
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    m = 1040
    for share in (0.3, 0.7, 0.9):
        both = rng.integers(1, 2**63, 2000, dtype=np.uint64)
        k = int(2000 * share)
        a = np.unique(np.concatenate([both[:k], rng.integers(1, 2**63, 1000 - k // 2, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both[:k], rng.integers(1, 2**63, 500, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = registers([a, b], m)
        got = estimated_similarity(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - true) < 5 * (true * (1 - true) / m) ** 0.5 + 0.01
        assert (registers([np.union1d(a, b)], m)[0] == np.maximum(ra, rb)).all()
    assert band_keys(registers([a], BANDS * ROWS), BANDS, ROWS).shape == (1, BANDS)


@pytest.mark.parametrize("percent, n, same, yes", [(85, 100, 92, True), (85, 100, 91, False), (100, 10, 10, True), (85, 0, 0, False)])
def test_linked_is_exact(percent, n, same, yes):
    a = np.arange(n, dtype=np.uint64)
    b = np.arange(n - same, 2 * n - same, dtype=np.uint64)
    assert linked(a, b, percent) is yes


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(1000, 1002), (1002, 1001)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_components_of_stars_and_hubs(spark):
    links = [(5, k) for k in range(100, 400)] + [(900, k) for k in range(500, 800)] + [(399, 500)] + [(2000 + k, 3000) for k in range(200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys([5, 900, *range(100, 400), *range(500, 800)], 5) | dict.fromkeys([3000, *range(2000, 2200)], 2000)


def template_pages(n, rng, shared=120, own=80):
    base = [f"t{k}" for k in range(shared)]
    return [(k, " ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for k in range(n)]


def test_texts_of_alike_but_unlinked_pages_stay_where_they_are(spark, monkeypatch):
    asked = []
    real = set_sketch.materialize

    def counted(df, label):
        out = real(df, label)
        if label == "wanted":
            asked.append(out.count())
        return out

    monkeypatch.setattr(set_sketch, "materialize", counted)
    rows = template_pages(600, random.Random(2))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i for i, _ in rows}
    assert sum(asked) <= len(rows) // 10


def test_pairs_inside_blocks_with_repeated_ids(spark):
    """Chains inside a bucket whose smallest node is linked with few of them, and documents with two texts."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for g in range(6):
        start = edited(base, 12, rng)
        rows += [(100 * g + k + 1, " ".join(edited(start, k % 4, rng))) for k in range(12)]
    rows += [(700, rows[3][1] + " more"), (700, rows[40][1] + " at the end"), (0, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicate_classes(docs).collect()} == brute(rows)


def test_a_very_long_text_is_read_whole(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(words, 1500, rng))), (3, " ".join(words[:60_000])), (4, " ".join(words[60_000:]))]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (c, _) in got.items()} == brute(rows) and got[1][1] > 110_000
