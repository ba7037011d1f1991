import hashlib
from datetime import date, timedelta

from tests.test_text import MAIL, NUM, plain_redact
from tidemark.operators.schema import CATEGORIES
from tidemark.plans.registry import _DETAIL, QUERIES

TEXTS = [
    (1, "One title, one body"), (1, "One title, another body"), (1, "Another title, one body"), (2, f"Write {MAIL}, or call {NUM}"), (3, "The title  is clean. " * 5 + f"The body\nhas {NUM}"),
    (4, None), (5, ""), (60, "x " * 5_000), (7, "k" * 70 + " 900101" + "-" + "1234567"),
]


def plain(doc_id, text, source):
    """The hash of a document's notice, made without Spark."""
    name, key = CATEGORIES[doc_id % len(CATEGORIES)]
    clean = lambda value, cap: " ".join(plain_redact(value or "").split())[:cap]
    posted = date(2024, 1, 1) + timedelta(doc_id % 60)
    fields = (str(doc_id), key, clean(name, 64), clean((text or "")[:60], 500), str(posted), str(posted + timedelta(doc_id % 3)), clean(source, 200), f"{_DETAIL}{doc_id}", clean(text, 4000), str(doc_id % 5 == 0))
    return str(doc_id), hashlib.sha256("\x1f".join(fields).encode()).hexdigest()


def test_hash_reads_title_and_body(spark, tmp_path):
    spark.createDataFrame([(i, t, "src") for i, t in TEXTS], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["content_hash"](spark, str(tmp_path)).collect())
    assert got == sorted(plain(i, t, "src") for i, t in TEXTS)
    assert len({h for d, h in got if d == "1"}) == 3


def test_hash_of_the_documents_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").where("doc_id IS NOT NULL").collect()
    assert sorted(tuple(r) for r in QUERIES["content_hash"](spark, sf_dir).collect()) == sorted(plain(*r) for r in docs)
