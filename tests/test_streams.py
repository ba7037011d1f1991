"""Streams against their batch forms, also after a restart, and sketches, levels and cursors."""

import random
from datetime import date, datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.operators.errors import StorageInputError
from tidemark.operators.feed import Filters, active
from tidemark.operators.levels import level_counts
from tidemark.operators.paging import cursor_of, next_cursor, seek_page, write_feed
from tidemark.operators.sketches import DISTINCT_ERROR, RANK_ERROR, estimated, merged, sketched
from tidemark.plans import views
from tidemark.streaming.keyed import version_stream, versions_until
from tidemark.streaming.sessions import session_stream, sessions

T0 = datetime(2024, 1, 1)
WRITES = "duid string, at timestamp, content_hash string"


def drained(spark, tmp_path, batches, schema, stream):
    """Feeds batches one after the other, each with a query started anew from the checkpoint; returns the rows of the sink."""
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    return spark.read.parquet(sink)


@pytest.fixture(scope="module")
def writes():
    """Writes in three batches; those of one batch are late by at most nine minutes, and a last one moves the watermark far on."""
    rng = random.Random(2)
    rows = sorted((rng.choice(["a", "a", "a", "b", "c"]), T0 + timedelta(minutes=rng.randrange(600)), rng.choice("xyz")) for _ in range(90))
    rows = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randrange(9)))
    return [rows[:40], rows[40:70], [*rows[70:], ("z", T0 + timedelta(days=3), "end"), (None, T0, "x")]]


def test_version_stream_equals_batch_after_restarts(spark, tmp_path, writes):
    ttl = timedelta(minutes=45)
    got = drained(spark, tmp_path, writes, WRITES, lambda rows: version_stream(rows, ttl, "10 minutes"))
    every = spark.createDataFrame([r for b in writes for r in b], WRITES)
    for ranges in (1, 5):
        want = versions_until(every, ttl, T0 + timedelta(days=3) - timedelta(minutes=10), ranges)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kinds = {r["kind"] for r in got.collect()}
    assert kinds == {"revision", "expiry"}


def test_versions_by_hand(spark):
    m = lambda n: T0 + timedelta(minutes=n)
    rows = spark.createDataFrame([("a", m(0), "x"), ("a", m(10), "x"), ("a", m(40), "y"), ("a", m(40), "y"), ("b", m(5), "q"), (None, m(0), "x"), ("c", None, "x"), ("d", m(1), None)], WRITES)
    got = sorted(map(tuple, versions_until(rows, timedelta(minutes=30), m(69)).collect()))
    assert got == [("a", m(40), "expiry", "x"), ("a", m(40), "revision", "y"), ("b", m(35), "expiry", "q")]
    assert versions_until(rows.limit(0), timedelta(minutes=30), m(69)).count() == 0


def sessions_by_hand(rows, gap):
    out = []
    for key in {k for k, _ in rows if k is not None}:
        own = sorted(t for k, t in rows if k == key and t is not None)
        for t in own:
            if out and out[-1][0] == key and t - out[-1][2] <= gap:
                out[-1][2], out[-1][3] = t, out[-1][3] + 1
            else:
                out.append([key, t, t, 1])
    return sorted((k, s, e + gap, n) for k, s, e, n in out)


def test_sessions_and_their_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2]), T0 + timedelta(seconds=rng.randrange(40_000))) for _ in range(120)]
    # Two sessions that the last batch joins with a late row, and rows exactly a gap apart.
    rows += [(7, T0 + timedelta(hours=9)), (7, T0 + timedelta(hours=9, minutes=18)), (8, T0), (8, T0 + timedelta(minutes=10)), (8, T0 + timedelta(minutes=20, seconds=1))]
    late, end = (7, T0 + timedelta(hours=9, minutes=9)), (99, T0 + timedelta(days=2))
    schema, gap = "user_id long, ts timestamp", timedelta(minutes=10)
    every = [*rows, late]
    batch = sorted(map(tuple, sessions(spark.createDataFrame([*every, (None, T0), (1, None)], schema), gap_seconds=600).collect()))
    assert batch == sessions_by_hand(every, gap)
    assert any(r[0] == 7 and r[3] == 3 for r in batch)
    stream = drained(spark, tmp_path, [rows, [late], [end]], schema, lambda s: session_stream(s, gap_seconds=600, late="12 hours"))
    assert sorted(map(tuple, stream.collect())) == batch


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 30).alias("d"), (F.col("id") % 9_000).cast("string").alias("v"), (F.col("id") * 7919 % 50_000).alias("x"))
    days = sketched(rows, ["g", "d"], "v", "x").cache()
    one = estimated(merged(days, []), [0.1, 0.5, 0.9]).first()
    two = estimated(merged(merged(days.repartition(3, "d"), ["d"]).orderBy(F.col("d").desc()), []), [0.5]).first()
    assert one["n"] == two["n"] == 60_000 and abs(two["quantiles"][0] / 50_000 - 0.5) <= RANK_ERROR
    assert all(abs(x["distinct_estimate"] - 9_000) <= DISTINCT_ERROR * 9_000 for x in (one, two))
    for rank, value in zip((0.1, 0.5, 0.9), one["quantiles"], strict=True):
        assert abs(value / 50_000 - rank) <= RANK_ERROR
    assert merged(days, ["g"]).count() == 7 and merged(days.limit(0), ["g"]).count() == 0


def test_levels_have_zero_rows(spark, sf_dir):
    notices = active(views.notices(spark, sf_dir)).where("category_id <> 'general'")
    rows = level_counts(notices, views.runs(spark, sf_dir), views.NOW).collect()
    by = {(r["category_id"], r["month"], r["freshness"]): r["n"] for r in rows}
    assert len(by) == len(rows) and by[None, None, None] == notices.count() and by["general", None, None] == 0
    assert {r["level"] for r in rows} == set(range(8))
    months = {r["month"] for r in rows if r["month"]}
    assert all(("general", m, None) in by for m in months)
    assert sum(n for (c, m, f), n in by.items() if c and m and f) == notices.count()
    plan = level_counts(notices, views.runs(spark, sf_dir), views.NOW, zeros=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1


def test_walking_pages_gives_each_row_once(spark, sf_dir, tmp_path):
    notices = views.notices(spark, sf_dir)
    feed = write_feed(notices, f"{tmp_path}/feed", files=8)
    some, cursor, seen = Filters("general"), None, []
    while page := seek_page(feed, cursor, some, limit=7).select("posted_date", "duid").collect():
        seen += [(r["posted_date"], r["duid"]) for r in page]
        cursor = next_cursor(page)
        if len(seen) == 7:  # what is added before the cursor shifts nothing
            notices.where("duid = '1'").withColumns({"category_id": F.lit("general"), "posted_date": F.lit(date(2030, 1, 1)), "tombstone_at": F.lit(None).cast("timestamp")}).write.mode("append").parquet(f"{tmp_path}/feed")
            feed = spark.read.parquet(f"{tmp_path}/feed")
    want = sorted(((r["posted_date"], r["duid"]) for r in active(notices).where("category_id = 'general'").collect()), reverse=True)
    assert seen == want
    assert next_cursor([]) is None
    for bad in ("", "x", cursor_of(date(2024, 1, 1), "5")[:-4], "WzEsMl0="):
        with pytest.raises(StorageInputError):
            seek_page(feed, bad)


def test_deep_pages_read_fewer_files(spark, sf_dir, tmp_path):
    feed = write_feed(views.notices(spark, sf_dir), f"{tmp_path}/feed", files=8)
    files = feed.select(F.input_file_name().alias("f")).distinct().count()
    deep = seek_page(feed, cursor_of(date(2024, 1, 8), "5"), limit=10)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(posted_date" in plan and files == 8
    # The files that hold a row which the bounds let through: those whose statistics reach down to them.
    read = feed.where(F.col("posted_date") <= F.lit(date(2024, 1, 8))).select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 3


def test_product_of_dimensions_is_whole(spark, sf_dir):
    rows = level_counts(views.notices(spark, sf_dir), views.runs(spark, sf_dir), views.NOW).where("level = 0").select("category_id", "month", "freshness").collect()
    beside = {(r["month"], r["freshness"]) for r in rows}
    assert {tuple(r) for r in rows} == {(c, *b) for c, b in product({r["category_id"] for r in rows}, beside)}
