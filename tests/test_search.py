import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.operators.errors import StorageInputError, StorageUnavailableError
from tidemark.operators.feed import Filters
from tidemark.operators.search import phrases_of, postings, search_count, search_index, search_page, tokens
from tidemark.plans import views


@pytest.fixture(scope="module")
def notices(spark, sf_dir):
    return views.notices(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def fts(notices):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(duid UNINDEXED, title, category_name, department, body)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in search_index(notices).collect()])
    return con


QUERIES = ["the", "thing", "the thing", "of-the", '"of the" and', "src1 the", "SRC1", "wort", "è", "cióN", "일반", "title:the", "the*", "NEAR the", "' the", "x OR 1=1 --", "zzz", "' --", "the of and"]


@pytest.mark.parametrize("query", QUERIES)
def test_hits_and_scores_equal_fts5(notices, fts, query):
    quoted = " ".join('"' + t.replace('"', '""') + '"' for t in query.split())
    want = dict(fts.execute("SELECT duid, bm25(f) FROM f WHERE f MATCH ?", (quoted,)).fetchall())
    from tidemark.operators.search import ranked

    got = {r["duid"]: r["score"] for r in ranked(notices, query).select("duid", "score").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_tokens_fold_and_split(spark):
    row = spark.sql("SELECT 'CAFÉ naïve foo_bar it''s 장학금 x1Ǖ' AS t").select(tokens(F.col("t")).alias("w")).first()["w"]
    assert row[:6] == ["cafe", "naive", "foo", "bar", "it", "s"] and row[6] == "장학금"
    assert phrases_of("CAFÉ foo-bar ' x") == [["cafe"], ["foo", "bar"], ["x"]]
    with pytest.raises(StorageUnavailableError):
        phrases_of("a\x00b")


def test_page_order_limits_and_counts(notices):
    page = search_page(notices, "the", limit=500).collect()
    assert len(page) == 50
    assert [(r["score"], -r["updated_date"].toordinal()) for r in page] == sorted((r["score"], -r["updated_date"].toordinal()) for r in page)
    rest = search_page(notices, "the", limit=10, offset=40).collect()
    assert [r["duid"] for r in rest] == [r["duid"] for r in page[40:]]
    whole = search_count(notices, "the").first()["n"]
    assert whole >= 50 and search_count(notices, " ").first()["n"] == notices.where("tombstone_at IS NULL").count()
    some = search_page(notices, "the", Filters("general"), limit=50).collect()
    assert {r["category_id"] for r in some} == {"general"} and search_count(notices, "the", Filters("general")).first()["n"] == len(some)
    for bad in (("x" * 201, 10, 0), ("x", 0, 0), ("x", 10, 501), ("x", 10, -1), (3, 10, 0), ("x", True, 0)):
        with pytest.raises(StorageInputError):
            search_page(notices, bad[0], limit=bad[1], offset=bad[2])


def test_postings_hold_every_position(notices):
    own = postings(notices).where("term = 'the'").agg(F.sum(F.size("positions")).alias("n")).first()["n"]
    words = search_index(notices).select(*[F.size(F.filter(tokens(F.col(c)), lambda w: w == "the")).alias(c) for c in ("title", "category_name", "department", "body")])
    assert own == words.agg(F.sum(F.col("title") + F.col("category_name") + F.col("department") + F.col("body")).alias("n")).first()["n"]
