"""Operator 12 against plain scoring of all documents."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import tiered_search as T

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower)


def ranked_by_hand(docs, items, k=50):
    worded = [(d, w) for d, t in docs if (w := terms(t))]
    n, total = len(worded), sum(len(w) for _, w in worded)
    df = {}
    for _, w in worded:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, w in worded:
            m = 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in own if t in w)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda x: x[:2])


def found(rows):
    return sorted((tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(7, docs[7][1]), (500, docs[9][1]), (501, docs[9][1].upper()), (None, docs[9][1]), (502, None), (503, "!?"), (504, "Äß w1 w1 w2 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(3, "äß w5"), (20, None), (21, "..."), (None, "w1"), (22, docs[9][1])]
    return docs, items


@pytest.mark.parametrize(("k", "few", "candidates"), [(5, 3, 20), (50, 1000, 20), (3, 1, 1)])
def test_equals_plain_scoring(spark, tables, k, few, candidates):
    docs, items = tables
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS rank", "2 AS score", "3 AS length").repartition(3)
    got = T.rank_documents(d, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id"), k=k, few=few, candidates=candidates)
    assert found(got) == ranked_by_hand(docs, items, k)


def test_blocks_of_queries(spark, tables):
    docs, items = tables
    got = T.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=4, few=4, block_items=5)
    assert found(got) == ranked_by_hand(docs, items, 4)


def test_some_items_settle_early(spark, tables):
    docs, _ = tables
    items = T.Items.of([(1, "w77 w78 w79 w80 w81"), (2, "w1 w2 w3 w4 w5 w6")])
    index = T.TieredIndex(spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text"), items, few=20, shares=(1 / 8, 1 / 2))
    rows, settled = T.search(index, 2)
    assert settled[0] == 0 and settled[1] > 0
    names = {k: i for k, i in enumerate(items.ids)}
    got = sorted((names[r["item"]], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())
    assert got == ranked_by_hand(docs, [(1, "w77 w78 w79 w80 w81"), (2, "w1 w2 w3 w4 w5 w6")], 2)


def test_residuals_bound_what_is_behind():
    bins = [(0, 60, 2, 950_000), (0, 30, 100, 480_000), (0, 10, 3000, 170_000), (1, 20, 5, 320_000)]
    tiers = T._tiers_of(bins, 2, 5000, 50, (0.02, 0.1))
    assert tiers.residuals[:, 0].tolist() == [480_000, 170_000, 0] and tiers.residuals[:, 1].tolist() == [0, 0, 0]
    assert (np.diff(tiers.cuts[:, 0]) <= 0).all()


def test_empty_tables(spark, tables):
    docs, items = tables
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert found(T.rank_documents(d.limit(0), q)) == [] and found(T.rank_documents(d, q.limit(0))) == []
    assert found(T.rank_documents(d.where("text IS NULL"), q)) == []


def test_cut_between_terms():
    text = "abc def, " * 100 + "g" * 300
    assert [w for p in T._parts(text, 50) for w in T.terms_of(p)] == T.terms_of(text)
