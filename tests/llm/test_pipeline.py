import os

import corpus_pipeline
import duckdb
import pytest

from pyspark.sql import functions as F

from tidemark.llm import registry
from tidemark.llm._common import BLANKS, ascii_lower, materialize, words_of
from tidemark.llm.language_mixture import fit_languages

from .test_line_runs import brute as brute_lines
from .test_set_sketch import brute as brute_copies
from .test_spaced_seeds import brute as brute_passages


def rows(df):
    return order(tuple(r) for r in df.select("doc_id", "text").collect())


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0], r[1] or ""))


def test_every_stage_equals_its_plain_form(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [r["text"] for r in docs.orderBy("doc_id").limit(3).collect()]
    extra = [(900_001, None, None, "s", 0), (900_002, "12 34", "en", None, 5), (900_003, "a b c d e " * 300, None, "s", 2)]
    extra += [(900_004, some[0], "en", "s", 0), (900_005, some[1] + "\nThe end of it, in a line of its own.", "en", "s", 0), (900_006, some[2], "en", "s", 0), (900_006, "Of two rows the second one has other words than the first.", "en", "s", 0)]
    extra += [(900_007, "The words of a long text are here and they are many. " * 800, "en", "s", 0), (None, some[0], "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("_row", F.lit(1)).withColumn("_kept", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = fit_languages(docs)
    judged = [(i, t, *model.mixture(t)[:2]) for i, t in rows(docs)]
    one = materialize(corpus_pipeline.language_stage(spark, docs, sf_dir), "one")
    assert rows(one) == order((i, t) for i, t, lang, share in judged if lang != "und" and share >= 0.5)
    assert one.where("lang IS NULL").count() == 0

    two = materialize(corpus_pipeline.line_stage(spark, one, sf_dir), "two")
    before = rows(one)
    after = [brute_lines(before, keep_order=True)[k][3] for k in range(len(before))]
    assert rows(two) == order((i, new) for (i, old), new in zip(before, after, strict=True) if new == old or new.strip(BLANKS))
    assert {900_006, 900_007} <= {i for i, _ in rows(two)} and not keys([r for r in rows(two) if r[0] == 900_004]) and 900_005 not in {i for i, t in rows(two) if some[1] in t}
    assert keys(before) == keys(rows(two))
    assert two.where("n_chars <> length(text)").count() == 0

    three = materialize(corpus_pipeline.near_copy_stage(spark, two, str(tmp_path)), "three")
    assert rows(three) == near_by_hand(rows(docs), rows(two))

    four = materialize(corpus_pipeline.benchmark_stage(spark, three, sf_dir), "four")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute_passages(rows(three), items)}
    assert rows(four) == [(i, t) for i, t in rows(three) if i not in dirty]
    for stage in (one, two, three, four):
        assert stage.columns == list(corpus_pipeline.COLUMNS)

    packed = corpus_pipeline.packing_stage(spark, four, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows(four)}


def keys(found):
    return {k for _, t in found for line in (t or "").split("\n") if len(k := line.strip(BLANKS).lower()) >= 10}


def near_by_hand(was, now):
    """The near-copy stage on rows (doc_id, text): all as they were before lines went, and those left as they are."""
    ids = {i for i, _ in now if i is not None}
    classes = brute_copies(was, corpus_pipeline.NEAR_PERCENT)
    first = {}
    for i in sorted(ids):
        first.setdefault(classes[i], i)
    copies = {i for i in ids if first[classes[i]] != i}
    same = {}
    for i, t in now:
        if i is not None and i not in copies and (w := words_of(ascii_lower(t or ""))):
            same.setdefault(tuple(w), set()).add(i)
    copies |= {i for own in same.values() for i in own if i != min(own)}
    holders = {}
    for i, t in was:
        for k in keys([(i, t)]) if i in ids else ():
            holders.setdefault(k, set()).add(classes[i])
    needed = {i for i, t in now if any(holders.get(k, set()) - {classes.get(i)} for k in keys([(i, t)]))}
    return [(i, t) for i, t in now if i is None or i not in copies or i in needed]


def staged(spark, folder, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    two = materialize(corpus_pipeline.line_stage(spark, docs, str(folder)), "two")
    return rows(two), rows(corpus_pipeline.near_copy_stage(spark, two, str(folder)))


def test_what_only_one_document_holds_stays(spark, tmp_path):
    line = lambda who, k: f"{who} has this as line number {k} of its text"
    # Document 9 shares 400 lines with eight others, 50 with each, and has 35 of its own.
    texts = [(i, "\n".join(line(f"document {i}", k) for k in range(50))) for i in range(1, 9)]
    texts.append((9, "\n".join([*(t for _, t in texts), *(line("number nine", k) for k in range(35))])))
    # 12 is a near copy of 11 with one more line, which 13 has as well.
    texts += [(11, "\n".join(line("eleven", k) for k in range(20))), (12, "\n".join([*(line("eleven", k) for k in range(20)), "a line that nothing else holds"])), (13, "a line that nothing else holds\n" + "\n".join(line("thirteen", k) for k in range(9)))]
    # 15 is a near copy of 14, and nobody lost a line to it.
    texts += [(14, "\n".join(line("fourteen", k) for k in range(20))), (15, "\n".join([*(line("fourteen", k) for k in range(20)), "what only the copy says"]))]
    # 22 is a copy of 21 but for a short line, 24 one of 23 but for its end: what is left of 22 and 24 is the same, 21 and 23 aren't.
    words = " ".join(f"word{k}" for k in range(60))
    texts += [(21, words + "\n" + words.upper()[::-1]), (22, words + "\n" + words.upper()[::-1] + "\nshort"), (23, words + "\nshort and sweet enough"), (24, words + "\nshort")]
    two, three = staged(spark, tmp_path, texts)
    assert keys(two) == keys(texts)
    assert keys(three) == keys(texts) - {"what only the copy says"}
    assert {i for i, _ in three} == {*range(1, 10), 11, 12, 13, 14, 21, 23}
    assert dict(three)[9] == "\n".join(line("number nine", k) for k in range(35)) and dict(two)[22] == "short"


def test_what_is_left_is_compared_as_well(spark, tmp_path):
    line = lambda who, k: f"{who} has this as line number {k} of its text"
    own = [f"word{k}" for k in range(100)]
    texts = [(i, "\n".join(line(f"document {i}", k) for k in range(40))) for i in (1, 2)]
    # 3 and 4 lose all but one line, to different documents; these lines differ in a word.
    texts += [(3, texts[0][1] + "\n" + " ".join(own)), (4, texts[1][1] + "\n" + " ".join([*own[:50], "other", *own[51:]]))]
    _, three = staged(spark, tmp_path, texts)
    assert {i for i, _ in three} == {1, 2, 3}


def test_documents_that_went_before_link_nothing(spark, tmp_path):
    words = [f"word{k}" for k in range(100)]
    # 6 is a near copy of 5 and of 7, which are none of each other.
    texts = [(5, words), (6, [*words[:-8], *(f"six{k}" for k in range(8))]), (7, [*(f"seven{k}" for k in range(8)), *words[8:-8], *(f"six{k}" for k in range(8))])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {i for i, _ in rows(corpus_pipeline.near_copy_stage(spark, docs, str(tmp_path)))} == {5}
    assert {i for i, _ in rows(corpus_pipeline.near_copy_stage(spark, docs.where("doc_id <> 6"), str(tmp_path)))} == {5, 7}


def test_ids_of_documents_that_went_are_not_taken_for_remains(spark, tmp_path):
    words = [f"word{k}" for k in range(100)]
    texts = [(5, words), (5 ^ 1 << 62, [*words[:-8], *(f"six{k}" for k in range(8))]), (7, [*(f"seven{k}" for k in range(8)), *words[8:-8], *(f"six{k}" for k in range(8))])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = docs.where("doc_id < 10").withColumn("text", F.concat("text", F.lit("\n"), F.col("doc_id").cast("string")))
    assert {i for i, _ in rows(corpus_pipeline.near_copy_stage(spark, own, str(tmp_path)))} == {5, 7}


def test_near_copies_leave_no_shuffles_and_small_tables_of_ids_on_disk(spark, sf_dir):
    def held():
        files = [f.getPath() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())]
        sent = sum(e.stat().st_size for e in os.scandir(spark.sparkContext._temp_dir))
        return {f for f in files if "/shuffle_" in f}, sent

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shuffles, sent = held()
    found = corpus_pipeline.near_copy_stage(spark, docs, sf_dir)
    more, now = held()
    assert not more - shuffles and now - sent < 1_000_000
    assert found.count() > 0


def test_batches_for_python_are_bounded(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in (("64m", f"{corpus_pipeline.BATCH_BYTES}b"), ("1m", "1m")):
            spark.conf.set(key, own)
            corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5), sf_dir)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_run_chains_the_stages_and_empty_documents_pass(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_registry_has_all_thirteen():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]
