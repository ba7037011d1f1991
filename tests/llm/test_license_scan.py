import random

from tidemark.llm.license_scan import BAND, TEMPLATES, TemplateIndex, banded_alignment, license_texts, scan_licenses, winnowed, words_in
from tidemark.llm._common import WordHashes, window_hashes


def most_matches(template, words):
    """Longest common subsequence, without a band."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words, 1):
            new.append(row[j - 1] + 1 if w == t else max(row[j], new[-1]))
        row = new
    return row[-1]


def noise(rng, n):
    return [f"x{rng.randrange(500)}" for _ in range(n)]


def fixture():
    rng = random.Random(6)
    docs, want = [], {}
    for d in range(150):
        t = TEMPLATES[d % len(TEMPLATES)]
        own = words_in(t.text)
        needed = {i for i, w in enumerate(own) if w in t.needed}
        spots = [i for i in range(len(own)) if i not in needed]
        edits = rng.sample(spots, min(len(spots), round(len(own) * rng.choice((0, 0, 0.1, 0.35)))))
        out = ["zz" if i in edits and d % 2 else None if i in edits else w for i, w in enumerate(own)]
        out = [w for w in out if w is not None]
        docs.append((d, " ".join([*noise(rng, rng.randrange(60)), *out, *noise(rng, 30)])))
        want[d] = (t, len(own) - len(edits))
    return docs, want


def test_planted_templates_are_found_with_coverage_and_span(spark):
    docs, want = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, license string").repartition(3)
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = dict(docs)
    missed = 0
    for d, (t, left) in want.items():
        own = words_in(t.text)
        found = [r for r in got.get(d, ()) if r["license"] == t.license and r["template"] == t.name]
        if left >= 0.8 * len(own):
            if not found:
                missed += not any(r["license"] == t.license for r in got.get(d, ()))
            for r in found:
                assert r["matched"] >= left and abs(r["coverage"] - r["matched"] / len(own)) < 1e-9
                span = words_in(texts[d][r["start_char"] : r["end_char"]])
                assert most_matches(own, span) >= r["matched"]
        else:
            assert not found
    assert missed == 0


def test_equals_alignment_of_every_template_everywhere(spark):
    """Documents and licenses found are those for which some window of the document aligns well enough."""
    docs, _ = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(df).collect()}
    want = set()
    for d, text in docs:
        words = words_in(text)
        for t in TEMPLATES:
            own = words_in(t.text)
            reach = len(own) + 2 * BAND
            for at in range(0, len(words), BAND):
                near = words[at : at + reach]
                pairs = banded_alignment(own, near, -len(own), len(near))
                if len(pairs) >= 0.8 * len(own) and pairs[-1][1] - pairs[0][1] < len(own) + BAND and {*t.needed} <= {own[i] for i, _ in pairs}:
                    want.add((d, t.license))
                    break
    assert got == want


def test_winnowing_keeps_a_fingerprint_of_every_three_words():
    rng = random.Random(1)
    hashes = WordHashes()
    for _ in range(200):
        words = [rng.choice("abcdef") for _ in range(30)]
        marks = window_hashes(hashes.array(words), (0, 1))
        kept = set(winnowed(marks).tolist())
        assert all({i, i + 1} & kept for i in range(len(marks) - 1))
        # The choice between two neighbours depends on them alone, so both texts choose alike.
        for i in range(len(marks) - 1):
            assert (i if marks[i] <= marks[i + 1] else i + 1) in kept


def test_nulls_empty_ties_and_casefolding(spark):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, line + "\n" + line), (None, "İİ ß " + line), (4, "Released under the BSD License."), (5, "word " * 100_000 + line)]
    got = sorted(((r["doc_id"] or 0, r["license"], r["template"], r["start_char"], r["end_char"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, "MIT", "short", 5, 35), (3, "MIT", "short", 0, 30), (3, "MIT", "short", 32, 62), (5, "MIT", "short", 500_000, 500_030)]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert TemplateIndex([]).matches(["a", "b"], WordHashes()) == []


def test_whole_texts_are_found_with_edits(spark):
    rng = random.Random(9)
    texts = license_texts()
    assert {t.license for t in texts} >= {"MIT", "ISC", "BSD-3-Clause", "Zlib"}
    docs, want = [], {}
    for d in range(24):
        t = texts[d % len(texts)]
        own = words_in(t.text)
        spots = [i for i, w in enumerate(own) if w not in t.needed]
        edits = set(rng.sample(spots, round(len(own) * rng.choice((0, 0.05, 0.12)))))
        docs.append((d, " ".join([*noise(rng, 50), *("zz" if i in edits else w for i, w in enumerate(own)), *noise(rng, 50)])))
        want[d] = (t.license, len(own) - len(edits))
    got = {(r["doc_id"], r["license"]): r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).where("template = 'whole text'").collect()}
    assert {(d, license) for d, (license, _) in want.items()} == set(got)
    assert all(got[d, license]["matched"] >= left for d, (license, left) in want.items())


def test_one_other_word_in_a_short_notice(spark):
    docs = [(1, "Licensed under this MIT License"), (2, "Released under our MIT License, see there"), (3, "Licensed under CC BY-NC 4.0")]
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0")}


def test_many_notices_in_one_text():
    index, hashes = TemplateIndex(), WordHashes()
    words = words_in("Released under the MIT License. Some other words here. " * 4000)
    found = index.matches(words, hashes)
    assert len(found) == 4000 and all(a.last < b.first for a, b in zip(found, found[1:]))


def test_whole_licenses_are_found_and_told_apart():
    rng = random.Random(12)
    texts = {t.license: t.text for t in license_texts()}
    assert {"Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0"} <= texts.keys()
    index, hashes = TemplateIndex(license_texts()), WordHashes()
    for license, text in texts.items():
        words = words_in(text)
        if not 500 <= len(words) <= 3_000:
            continue  # the others have tests of their own, or take a minute
        other = [f"w{rng.randrange(999)}" if rng.random() < 0.08 else w for w in words]
        found = index.matches(words_in("some words before ") + other + words_in(" and of the others after"), hashes)
        assert [m.template.license for m in found] == [license] and found[0].coverage >= 0.88 and found[0].first <= 10
    half = words_in(texts["MPL-2.0"])
    assert not [m for m in index.matches(half[: len(half) // 2], hashes) if m.template.license == "MPL-2.0"]
    # Words that any text has are no hits of the long ones.
    assert index.matches("of the and to the of this in the is the".split() * 50, hashes) == []


def test_columns_of_any_name_beside(spark):
    rows = [(1, "Released under the MIT License."), (2, "nothing of that kind"), (3, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    named = plain.selectExpr("*", "'x' AS license", "1 AS matched", "2 AS coverage", "3 AS template", "4 AS start_char", "5 AS end_char")
    assert sorted(map(tuple, scan_licenses(named).collect())) == sorted(map(tuple, scan_licenses(plain).collect())) != []
