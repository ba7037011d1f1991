import random
import zlib

import numpy as np
import pytest

from tidemark.llm.language_mixture import UNKNOWN, LanguageModel, fit_languages, identify_languages, trigram_counts
from tidemark.llm.line_crf import FEATURES, LineModel, _Chains, base_counts, content_share, fit_chains, fit_lines, likelihood, line_features, rule_quality, viterbi
from tidemark.llm import neighbour_quality
from tidemark.llm.neighbour_quality import DIM, fit_neighbours, score_quality, term_counts

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd_rows(spark, schema="doc_id long, text string, lang string, source string, label int"):
    rows = [(1, None, "en", "s", 1), (2, "", None, None, None), (3, " \n ", "en", "s", 0), (4, "12 34 !!", "fr", "s", 1), (None, "a text without id", "en", "s", 1), (5, "x " * 200_000, "de", "s", 1), (6, "same", "en", "s", 1), (6, "same", "en", "s", 1)]
    return spark.createDataFrame(rows, schema)


# Language


def test_languages_of_held_out_documents(spark, tables):
    docs, _ = tables
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 150 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 and abs(sum(m["share"] for m in r["languages"]) - 1) < 1e-6 for r in got)


def test_mixtures_are_split_by_proportion(spark, tables):
    docs, _ = tables
    model = fit_languages(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) BETWEEN 3000 AND 6000").collect() if held(r["doc_id"])}
    pred, score, mix = model.mixture(texts["fr"][:3000] + " " + texts["de"][:1500])
    assert pred == "fr" and [m[0] for m in mix] == ["fr", "de"] and abs(score - 2 / 3) < 0.1
    assert [m[0] for m in model.mixture(texts["es"])[2]] == ["es"]


def test_language_sets_equal_a_search_over_all_sets(spark, tables):
    docs, _ = tables
    model = fit_languages(docs)
    rows = [r for r in docs.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").collect() if held(r["doc_id"])]
    by_lang = {k: [r["text"] for r in rows if r["lang"] == k] for k in model.languages}
    rng = random.Random(7)
    texts = [rng.choice(by_lang[k])[: rng.randrange(60, 900)] for k in model.languages for _ in range(4)]
    texts += [" ".join(rng.choice(by_lang[k])[: rng.randrange(100, 900)] for k in rng.sample(model.languages, n)) for n in (2, 2, 2, 3, 3, 3, 4) for _ in range(3)]
    for text in texts:
        counts = trigram_counts(text)
        grams = np.flatnonzero(counts)
        n, probs = counts[grams].astype(float), np.exp(model.log_probs[:, grams])
        price = model.penalty * np.log(n.sum() + 1)
        worth = {}
        for mask in range(1, 2 ** len(model.languages)):
            own = [k for k in range(len(model.languages)) if mask >> k & 1]
            theta = np.full(len(own), 1 / len(own))
            for _ in range(400):
                theta = theta * (probs[own] @ (n / (theta @ probs[own]))) / n.sum()
            worth[frozenset(model.languages[k] for k in own)] = n @ np.log(theta @ probs[own]) - price * len(own)
        got = frozenset(k for k, _ in model.mixture(text)[2])
        assert worth[got] >= max(worth.values()) - 0.5, text[:80]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    from tidemark.llm import language_mixture

    monkeypatch.setattr(language_mixture, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "some text", f"l{k % 4}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        fit_languages(docs)


def test_language_edge_cases(spark):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(odd_rows(spark)).collect()}
    assert {(i, UNKNOWN, 0.0) for i in (1, 2, 3, 4)} <= got
    assert identify_languages(odd_rows(spark).limit(0)).count() == 0
    assert LanguageModel((), np.zeros((0, 4))).mixture("abc") == (UNKNOWN, 0.0, [])
    text = "Übung macht den Meister. " * 90_000
    assert trigram_counts(text).sum() == trigram_counts("Übung macht den Meister. ").sum() * 90_000


# Neighbours


def test_quality_of_held_out_documents(spark, tables):
    docs, labels = tables
    got = score_quality(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len(out) > 50 and sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)


def test_votes_equal_plain_cosines(spark, tables):
    docs, labels = tables
    model = fit_neighbours(docs, labels, max_docs=40)
    assert 0 < len(model.labels) <= 80 and model.space.shape[0] == DIM
    terms = np.stack([term_counts(r["text"]) for r in docs.limit(30).collect()] + [term_counts("")])
    got = model.scores(terms)
    for row, score in zip(model.project(terms), got, strict=True):
        near = [float(row @ v) for v in model.vectors]
        top = sorted(range(len(near)), key=lambda i: -near[i])[: model.neighbours]
        weight = [max(near[i], 0) ** 8 * model.counts[i] for i in top]
        want = sum(w * model.labels[i] for w, i in zip(weight, top, strict=True)) / sum(weight) if sum(weight) > 1e-12 else np.average(model.labels, weights=model.counts)
        assert abs(score - want) < 1e-3


def test_quality_edge_cases(spark):
    docs = odd_rows(spark)
    labels = docs.select("doc_id", docs["label"].alias("quality"))
    got = score_quality(docs, labels)
    assert got.count() == docs.count() and got.where("score IS NULL").count() == 0
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_terms_of_long_texts_have_no_seams(monkeypatch):
    text = "".join(random.Random(4).choice("aB1 .é\n") for _ in range(500))
    whole = term_counts(text)
    for part in (1, 2, 7, 100):
        monkeypatch.setattr(neighbour_quality, "PART", part)
        assert np.array_equal(term_counts(text), whole)


def test_labels_of_texts_without_words_decide_on_them(spark):
    words = [(k, f"Some plain text number {k}, with an end.") for k in range(30)]
    docs = spark.createDataFrame([*words, *((100 + k, (None, "", " \n")[k % 3]) for k in range(30))], "doc_id long, text string")
    for bad in (0, 1):
        labels = docs.selectExpr("doc_id", f"CASE WHEN doc_id >= 100 THEN {1 - bad} ELSE {bad} END AS quality")
        empty = {r["predicted"] for r in score_quality(docs, labels).where("doc_id >= 100").collect()}
        assert empty == {1 - bad}


def test_votes_count_what_they_stand_for(spark):
    docs = spark.createDataFrame([(k, "one text") for k in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 320) AS quality")
    model = fit_neighbours(docs, labels, max_docs=20)
    taught = [k for k in range(400) if not held(k)]
    assert len(model.labels) == 40 and model.scores(np.stack([np.zeros(DIM)]))[0] == pytest.approx(sum(k < 320 for k in taught) / len(taught))


# Rules and lines


def plain_counts(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    spots = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(spots)


def test_base_counts_equal_plain_counting():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a a a a", "\n\n", "x\x85y z\xa0w", "a b c\na b c\n\na b c"]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "\t", "#", "|", "é"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    for text in texts:
        assert base_counts(text) == plain_counts(text), repr(text)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 8):
        scores, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        assert value(viterbi(scores, moves).tolist()) == pytest.approx(max(map(value, paths)))


def test_chain_training_separates_states():
    good, bad = line_features(["A plain sentence of some words, and more."] * 6), line_features(["MENU!! | HOME!! | ABOUT!! | #### $$$"] * 6)
    model = fit_chains([(good, 1), (bad, 0)] * 5)
    both = ["A plain sentence of some words, and more."] * 3 + ["MENU!! | HOME!! | ABOUT!! | #### $$$"] * 3
    assert model.states(both).tolist() == [1, 1, 1, 0, 0, 0]
    share, content, lines = content_share("\n".join(both), model)
    assert 0 < share < 1 and (content, lines) == (3, 6)
    assert good.shape[1] == len(FEATURES)
    assert fit_chains([]).states(["anything"]).tolist() == [1]


def test_slope_equals_finite_differences():
    rng = np.random.default_rng(4)
    chains = [(rng.normal(size=(n, len(FEATURES))), rng.integers(0, 2, n)) for n in (1, 2, 5, 9)]
    groups = [_Chains.of(chains[:2], 0.7), _Chains.of(chains[2:], 0.2)]
    theta = rng.normal(size=2 * len(FEATURES) + 4) * 0.3
    _, slope = likelihood(theta, groups, 0.01)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert (likelihood(theta + step, groups, 0.01)[0] - likelihood(theta - step, groups, 0.01)[0]) / 2e-5 == pytest.approx(slope[i], abs=1e-6)
    # The partition sum of a short chain is that of all its paths.
    f, y = chains[2]
    w, m = theta[: 2 * len(FEATURES)].reshape(-1, 2), theta[2 * len(FEATURES) :].reshape(2, 2)
    scores = f @ w
    worth = lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))
    total = np.logaddexp.reduce([worth([(k >> i) & 1 for i in range(5)]) for k in range(32)])
    assert likelihood(theta, [_Chains.of([(f, y)], 1.0)], 0.0)[0] == pytest.approx((worth(y.tolist()) - total) / 5)


def test_planted_boilerplate_lines_are_found(spark, tables):
    """Lines with bars, marks or repeated words of held-out documents of label 0, put into held-out ones of label 1."""
    docs, labels = tables
    model = fit_lines(docs, labels)
    out = [(r["text"], r["quality"]) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect() if held(r["doc_id"])]
    lines = lambda text: [x for x in text.split("\n") if x.strip()]
    marked = [x for t, q in out if not q for x in lines(t) if "|" in x or "!!" in x or set(x) & set("#*$%&") or any(a == b for a, b in zip(x.split(), x.split()[1:]))]
    rng, counts = random.Random(1), np.zeros((2, 2), int)
    for own in (lines(t) for t, q in out if q):
        for n in (1, 3, 8):
            if len(own) >= 4:
                start, at = rng.randrange(max(1, len(marked) - n)), rng.randrange(len(own) + 1)
                planted = marked[start : start + n]
                truth = [1] * at + [0] * len(planted) + [1] * (len(own) - at)
                np.add.at(counts, (truth, model.states([*own[:at], *planted, *own[at:]])), 1)
    recall, precision = counts[0, 0] / counts[0].sum(), counts[0, 0] / counts[:, 0].sum()
    print(f"boilerplate lines: recall {recall:.3f}, precision {precision:.3f}; content lines kept {counts[1, 1] / counts[1].sum():.3f}")
    assert counts[0].sum() > 300 and recall >= 0.9 and precision >= 0.9


def test_rules_keep_good_documents_and_drop_junk(spark, tables):
    docs, labels = tables
    got = rule_quality(docs, fit_lines(docs, labels)).join(labels, "doc_id").collect()
    sound = [r for r in got if not r["base_failed"] and held(r["doc_id"])]
    assert sum(r["kept"] == bool(r["quality"]) for r in sound) >= 0.97 * len(sound)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rule_edge_cases(spark):
    docs = odd_rows(spark)
    model = LineModel(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    got = rule_quality(docs, model).collect()
    assert len(got) == docs.count() and all(r["base_failed"] for r in got)
    assert rule_quality(docs.limit(0), model).count() == 0
    labels = docs.select("doc_id", docs["label"].alias("quality"))
    assert fit_lines(docs.limit(0), labels.limit(0)).states(["a"]).tolist() == [1]


def test_latent_space_is_that_of_a_plain_svd(spark):
    """Cosines of the labelled vectors equal those in the space of a full singular value decomposition, cut at the same rank."""
    rng = random.Random(6)
    kinds = ("the quick brown fox of the wood", "BUY NOW!!! 50% off, click $$$ here", "eins zwei drei vier fünf sechs", "a | b | c | 1 | 2 | 3")
    rows = [(i, " ".join(rng.choice(kinds[i % 4].split()) for _ in range(30)), int(i % 4 in (0, 2))) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = fit_neighbours(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), rank=4)
    taught = sorted(i for i, _, _ in rows if not held(i))
    x = (np.stack([term_counts(rows[i][1]) for i in taught]).astype(np.float32) * model.weights).astype(float)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    low = x @ right[:4].T
    low /= np.linalg.norm(low, axis=1, keepdims=True)
    assert np.allclose(model.vectors @ model.vectors.T, low @ low.T, atol=0.02)
