import pytest
from pyspark.sql import functions as F

from tidemark.operators.block_index import BlockIndex, _posting_rows, block_page
from tidemark.operators.feed import Filters
from tidemark.operators.search import ranked, search_count, search_page
from tidemark.plans import views


@pytest.fixture(scope="module")
def notices(spark, sf_dir):
    return views.notices(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def index(spark, notices, tmp_path_factory):
    own = BlockIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/a")
    own.add(notices.repartition(3))
    return own


def by_scan(notices, query, filters=Filters(), limit=10, offset=0):
    return [(r["duid"], round(r["score"], 9)) for r in search_page(notices, query, filters, limit, offset).collect()]


@pytest.mark.parametrize("query", ["the thing", "of-the src1", "zzz the"])
def test_pages_equal_the_scan(notices, index, query):
    got = [(r["duid"], round(r["score"], 9)) for r in index.top(query, limit=20, offset=5, first_blocks=1).collect()]
    assert got == by_scan(notices, query, limit=20, offset=5)
    assert index.count(query).first()["n"] == search_count(notices, query).first()["n"]


def test_filters_and_whole_rows(notices, index):
    some = Filters("general")
    assert [(r["duid"], round(r["score"], 9)) for r in block_page(index, notices, "the", some, 50).select("duid", "score").collect()] == by_scan(notices, "the", some, 50)
    assert block_page(index, notices, "zzz").columns == [*notices.columns, "score"]


def test_rows_read_are_those_of_the_terms(index, notices):
    every = index._layers("postings", "layer int, term string, block long").count()
    of_terms = index.postings(["thing", "src1"]).count()
    blocks = index._layers("docs", "layer int, block long").count()
    assert 0 < of_terms <= 2 * blocks and of_terms * 50 < every
    plan = index.postings(["thing"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    # A page of a single word reads no places.
    read = index._frequencies(None, ["thing"], [["thing"]])._jdf.queryExecution().executedPlan().toString()
    assert "p:array<int>" not in read


def test_blocks_that_cant_reach_the_page_are_skipped(spark, tmp_path):
    notices = views.notices(spark, "/root/testdata/sf0.001").limit(0)
    rows = [(str(i), "general", "G", "rare word", None, None, "d", "u", ("word " * 40 if i < 5 else "word " + "other " * 300), None, "", False, None, None, "active") for i in range(3000)]
    batch = spark.createDataFrame(rows, notices.schema).coalesce(1)
    index = BlockIndex(spark, f"file://{tmp_path}/i")
    index.add(batch)
    got = [r["duid"] for r in index.top("word", limit=5, first_blocks=1).collect()]
    assert sorted(got) == ["0", "1", "2", "3", "4"]
    phrases = [["word"]]
    bounds = [r["tf0"] for r in index._blocks(["word"], phrases).collect()]
    assert len(bounds) == 12 and sorted(bounds)[-2:] == [2, 41]


def test_words_move_once(index, notices):
    """Grouping inside blocks needs no exchange besides the one that brings a block together."""
    own = index._layers("keys", "layer int, duid string, block long, o int, size int").withColumn("_words", F.array(F.array(F.lit("a"))))
    plan = _posting_rows(own, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(block" in plan


def test_places_of_a_phrase_move_in_blocks(index):
    plan = index._frequencies(None, ["of", "the"], [["of", "the"]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(layer" in plan and ", o#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_layers_replace_and_take_away(spark, notices, index, tmp_path):
    own = BlockIndex(spark, f"file://{tmp_path}/b")
    number = F.pmod(F.col("duid").cast("long"), F.lit(5))
    first = notices.where(number != 0)
    own.add(first)
    changed = notices.where(number < 2).withColumn("body", F.when(number == 1, F.concat(F.lit("brandnew the "), F.col("body"))).otherwise(F.col("body")))
    own.add(changed)
    gone = notices.where(number == 2).withColumn("tombstone_at", F.current_timestamp())
    own.add(gone)
    now = notices.where(number > 2).unionByName(changed)
    again = BlockIndex(spark, own.folder)
    assert again.upto == 2
    for query in ("brandnew", "the", "the thing", "of-the"):
        want = {r["duid"]: round(r["score"], 9) for r in ranked(now, query).select("duid", "score").collect()}
        assert [(r["duid"], round(r["score"], 9)) for r in again.top(query, limit=50).collect()] == by_scan(now, query, limit=50)
        assert again.count(query).first()["n"] == len(want)
    sums = again.sums()
    assert sums["n"] == now.where("tombstone_at IS NULL").count()


def test_a_layer_without_sums_does_not_count(spark, notices, tmp_path):
    own = BlockIndex(spark, f"file://{tmp_path}/c")
    own.add(notices.limit(20))
    before = [tuple(r) for r in own.top("the", limit=50).collect()]
    # What a writer leaves that is lost halfway.
    own._write(spark.read.parquet(f"{own.folder}/postings/layer=0"), "postings", "layer", 1)
    own._write(spark.read.parquet(f"{own.folder}/docs/layer=0"), "docs", "layer", 1)
    assert [tuple(r) for r in BlockIndex(spark, own.folder).top("the", limit=50).collect()] == before
    empty = BlockIndex(spark, f"file://{tmp_path}/d")
    empty.add(notices.limit(0))
    assert empty.top("the").collect() == [] and empty.count("the").first()["n"] == 0
