"""Operator 13 against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrase_sketch as P

SCHEMA = "doc_id long, text string, lang string"


def mined_by_hand(rows, least, max_words=4, subsumed=80, most=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(len(v) > len(w) and m == lang and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= subsumed * a for (m, v), b in found.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, x, y, total[lang], -s) for lang, own in out.items() for k, (s, a, p, x, y) in enumerate(sorted(own)[:most]))


def mined(docs, **how):
    return sorted(tuple(r) for r in P.mine_phrases(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["Red", "red", "fox", "jumps", "ÄB", "äb", "over", "x"]
    out = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "!", ".x "]) for _ in range(rng.randint(0, 60)))
        out.append((i, text, rng.choice(["en", "de", None])))
    out += [(200, None, "en"), (200, "", None), (None, "red fox jumps over " * 4000, "en"), (201, "over, " * 3000, "fr"), (201, "over, " * 3000, "fr")]
    return out


def test_equals_plain_counting(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS phrase", "3 AS words", "4 AS a").repartition(3)
    assert mined(docs, least=5) == mined_by_hand(rows, 5)
    assert mined(docs, least=5, most=3, max_words=3, subsumed=50) == mined_by_hand(rows, 5, 3, 50, 3)


def test_full_sketch_loses_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = mined_by_hand(rows, 5)
    monkeypatch.setattr(P, "WORD_BITS", 3)
    counts, _ = P.count_phrases(docs, 5, word_bits=3, max_bits=4)
    wide, _ = P.count_phrases(docs, 5)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, wide.collect()))
    assert mined(docs, least=5, max_bits=4) == expected


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    hashes = P.mixed(rng.integers(0, 4000, 60_000).astype(np.uint64))
    a, b = P.Sketch(10, 30), P.Sketch(10, 30)
    a.add(hashes[:20_000])
    b.add(hashes[20_000:])
    a.flush()
    b.flush()
    cells = np.minimum(a.cells.astype(int) + b.cells, 255)
    table = np.stack([np.packbits(row >= 30) for row in cells])
    often = {h for h, n in Counter(hashes.tolist()).items() if n >= 30}
    assert P.Sieve(10, table).passes(np.array(sorted(often), np.uint64)).all()
    distinct, n = np.unique(hashes, return_counts=True)
    c = P.Sketch(10, 30)
    c.add_counts(distinct, n)
    assert (c.cells == cells).all()


def test_parts_end_where_pieces_end():
    text = "ab cd. " * 50 + "x" * 400 + "! tail"
    parts = list(P.parts_of(text, 40))
    assert "".join(parts) == text and len(parts) > 5 and all(p[-1] in ".!" for p in parts[:-1])


def test_products_beyond_64_bits(spark):
    a, l, r = 6_000_000_000_000, 7_000_000_000_000, 8_000_000_000_000
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(P.score_of()).first()
    assert row[0] == 2_000_000 * a // (l + r)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == [] and P.mine_phrases(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        P.mine_phrases(empty, max_words=1)
