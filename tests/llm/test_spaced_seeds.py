import random

import numpy as np
import pytest

from tidemark.llm._common import WordHashes
from tidemark.llm import spaced_seeds
from tidemark.llm.spaced_seeds import MASKS, Seeds, allowed, clean_rows, find_passages, lossless, overlap, tokens_of


def brute(docs, items):
    """Every diagonal of every document and item."""
    hashes, out = WordHashes(), {}
    for d, text in docs:
        own = hashes.array(tokens_of(text))
        for i, item in items:
            t = hashes.array(tokens_of(item))
            if i is None or not len(t):
                continue
            for shift in range(-len(t) + 1, len(own)):
                found = overlap(own, t, shift)
                if found and ((d, i) not in out or (found[0], -found[2]) > (out[d, i][0], -out[d, i][2])):
                    out[d, i] = found
    return out


def fixture():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 25, 13, 12, 11, 8, 6, 5, 4, 30, 16, 3, 2, 1))]
    docs = []
    for d in range(90):
        i, item = items[d % len(items)]
        t = item.split()
        if d % 3 == 0:
            lo = rng.randrange(max(1, len(t) - 12))
            t = t[lo : lo + rng.randrange(5, 40)]
        for _ in range(d % 5):
            t[rng.randrange(len(t))] = word()
        docs.append((d, " ".join([*(word() for _ in range(rng.randrange(40))), *(w.upper() + "," for w in t), *(word() for _ in range(20))])))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in items] + [(50, None), (None, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["overlap"], r["first_token"], r["end_token"]) for r in find_passages(df, bench).collect()}
    assert got == brute(docs, items)
    assert len(got) > 40
    dirty = {d for d, _ in got}
    assert {r["doc_id"] for r in clean_rows(df, bench).collect()} == {d for d, _ in docs} - dirty


def test_a_large_benchmark_is_joined_with_the_same_result(spark, monkeypatch):
    docs, items = fixture()
    docs += [docs[0], (None, docs[1][1]), (700, None), (701, "")]
    items += [(items[0][0], items[1][1]), (60, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    order = lambda got: sorted((tuple(-1 if v is None else v for v in r) for r in got))
    once, clean = order(find_passages(df, bench).collect()), order(clean_rows(df, bench).collect())
    monkeypatch.setattr(spaced_seeds, "TASK_CHARS", 20)
    assert order(find_passages(df, bench).collect()) == once and len(once) > 40
    assert order(clean_rows(df, bench).collect()) == clean and clean_rows(df, bench).columns == df.columns


def test_short_items_and_scripts_without_blanks(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "\u6f22\u5b57\u306e\u8a66\u9a13\u554f\u984c"), (3, "xyzzy"), (4, " .")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "zero ONE two, three four five"), (11, "\u3053\u308c\u306f\u6f22\u5b57\u306e\u8a66\u9a13\u554f\u984c\u3067\u3059"), (12, "an Xyzzy!"), (13, "one two three")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in find_passages(docs, bench).collect()) == [(10, 1), (11, 2), (12, 3)]
    assert sorted((r["doc_id"], r["item_id"]) for r in find_passages(docs, bench, min_item=5).collect()) == [(11, 2)]
    assert tokens_of("ab\u6f22\u5b57cd") == ["ab", "\u6f22", "\u5b57", "cd"]


def test_repetitive_texts_list_few_diagonals(monkeypatch):
    hashes = WordHashes()
    seeds = Seeds([(1, "a " * 40), (2, "a " * 39 + "b")])
    own = hashes.array(["a"] * 3000)
    want = seeds.diagonals(own)
    assert len(want) < 2 * 3040
    assert seeds.passages(own)[1] == (40, 40, 0, 40, 40) and seeds.passages(own)[2][0] == 39
    monkeypatch.setattr(spaced_seeds, "LISTED", 1000)
    assert np.array_equal(seeds.diagonals(own), want)


def test_masks_are_lossless():
    assert lossless(MASKS, 12, 2)
    assert not lossless(((0, 1, 2, 3, 4, 5),), 12, 2)
    with pytest.raises(ValueError):
        Seeds([], masks=((0, 1, 2, 3, 4, 5),))
    assert [allowed(n) for n in (5, 6, 11, 12, 50)] == [0, 1, 1, 2, 2]


def test_nulls_empty_tables_repeated_and_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = "word " * 200_000 + item + " word" * 1000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, item), (4, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["matched"]) for r in find_passages(docs, bench).collect())
    assert got == [(0, 7, 13), (3, 7, 13), (3, 7, 13), (4, 7, 13)]
    assert find_passages(docs.limit(0), bench).count() == 0 == find_passages(docs, bench.limit(0)).count()
    assert clean_rows(docs, bench.limit(0)).count() == 6
    assert overlap(np.arange(3, dtype=np.uint64), np.arange(20, dtype=np.uint64), 0) is None
