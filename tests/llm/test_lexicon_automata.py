"""Operator 11 against plain Levenshtein distances, and on held-out labels."""

import random

import pytest

from tidemark.llm.lexicon_automata import QUOTED, Automaton, Entry, Lexicon, _Words, choose_entries, features, finds_of, fit_lexicon, score_toxicity
from tidemark.llm.registry import QUERIES

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, toxic int"
WORDS = [Entry("idiot", True, 5.0), Entry("disgusting", True, 4.0), Entry("scum", True, 3.0), Entry("vermi", False, 2.0)]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def by_hand(word: str, entries: list[Entry]):
    found = [(0, -e.weight, k) for k, e in enumerate(entries) if not e.whole and word.startswith(e.text)]
    found += [(d, -e.weight, k) for k, e in enumerate(entries) if e.whole and (d := distance(word, e.text)) <= e.errors]
    return None if not found else (min(found)[2], min(found)[0])


def test_automaton_equals_distances():
    rng = random.Random(7)
    entries = [*WORDS, *(Entry(t, True, 1 + k / 100) for k, t in enumerate({"".join(rng.choices("abc", k=rng.randint(3, 11))) for _ in range(60)}))]
    machine = Automaton(entries)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 13))) for _ in range(1500)]
    words += ["idiot", "idiots", "1diot", "idi0t", "idoit", "diot", "scum", "scumm", "vermin", "verm", "disgustng", "dsgustingg", "disgostink", "xdisgust", ""]
    assert [machine.find(w) for w in words] == [by_hand(w, entries) for w in words]


def test_states_made_anew_change_nothing(monkeypatch):
    monkeypatch.setattr("tidemark.llm.lexicon_automata.CACHE_ENTRIES", 3)
    machine = Automaton(WORDS)
    for w in ("idiots", "digusting", "verminous", "scumm", "idi"):
        assert machine.find(w) == by_hand(w, WORDS)


def test_quotation_and_neighbours():
    words = _Words(Lexicon(WORDS))
    assert finds_of('You idiot! They said "what an idi0t" to me', words) == (9, [(1, 0, 0, False), (6, 0, 1, True)])
    # A mark that is never closed, or too late, quotes nothing.
    assert finds_of('"so idiot', words)[1] == [(1, 0, 0, False)]
    assert finds_of('"so idiot ' + "word " * 70 + 'end"', words)[1] == [(1, 0, 0, False)]
    assert finds_of("“scum”, he wrote", words)[1] == [(0, 2, 0, True)]
    n, plain = 100, [(3, 0, 0, False)]
    assert features(n, [(3, 0, 0, True)], WORDS)[1] < features(n, plain, WORDS)[1]
    assert features(n, [(3, 0, 0, False), (5, 0, 0, False)], WORDS)[2] > features(n, [(3, 0, 0, False), (60, 0, 0, False)], WORDS)[2]
    assert QUOTED < 1


def test_harmless_variants_are_no_finds():
    assert finds_of("idiom idiox", _Words(Lexicon(WORDS, frozenset({"idiom"}))))[1] == [(1, 0, 1, False)]


def test_long_texts_go_part_by_part(monkeypatch):
    text = "idiot " * 500 + "x" * 90 + " scum"
    whole = finds_of(text, _Words(Lexicon(WORDS)))
    monkeypatch.setattr("tidemark.llm.lexicon_automata._parts", lambda t: [t[i : i + 60] for i in range(0, 2940, 60)] + [t[2940:]])
    assert finds_of(text, _Words(Lexicon(WORDS))) == whole and whole[0] == 502


def test_entries_are_prefix_free():
    rows = [("idi", 90, 30, 3, 3), ("idiot", 90, 30, 2, 2), ("idiot\0", 90, 30, 0, 0), ("the\0", 99, 30, 99, 40), ("abc", 8, 2, 0, 0)]
    assert [(e.text, e.whole) for e in choose_entries(rows, 40, 100)] == [("idiot", True)]


def test_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    out = QUERIES["op11_lexicon_automata"](spark, d).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(p == 1 for p, y in held if y == 1) >= 0.8 * sum(y for _, y in held)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, ("you utter blockhead " if i % 2 else "a calm and plain day ") + f"word{i} and more") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)


def test_odd_rows(spark, small):
    docs, labels = small
    more = spark.createDataFrame([(100, None), (101, ""), (102, "blockheadd blockhead utter"), (102, "blockheadd blockhead utter"), (None, "utter blockhead"), (103, "day " * 200_000 + "utter")], SCHEMA)
    both = docs.unionByName(more).selectExpr("*", "'1' AS score", "1 AS label", "2 AS toxic", "0 AS n_finds")
    rows = score_toxicity(both, labels.unionByName(spark.createDataFrame([(None, 1), (5, None)], LABELS))).collect()
    assert len(rows) == 66
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[100][0]["score"] == by[101][0]["score"] == by[0][0]["score"] and by[100][0]["predicted"] == 0
    assert by[102][0] == by[102][1] and by[102][0]["predicted"] == 1
    assert by[None][0]["held_out"] is False and by[None][0]["predicted"] == 1
    assert by[103][0]["n_finds"] == 1


def test_empty_tables(spark, small):
    docs, labels = small
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in score_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert fit_lexicon(docs, labels.limit(0)).entries == []
