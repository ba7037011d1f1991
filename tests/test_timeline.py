"""As-of joins, overlaps, kept views and histories against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.operators.asof import asof_join
from tidemark.operators.history import coalesced, fold_history, state_at
from tidemark.operators.intervals import _dealt, at_once, most_at_once, overlap_counts, overlap_pairs
from tidemark.operators.upkeep import VIEWS, Upkeep, batch_of
from tidemark.plans import views

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def looked_up(spark):
    """One key and one instant with more than a third of all rows, repeated rows, nulls."""
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([50, 50, rng.randrange(100), None]), i) for i in range(300)]
    right = [(rng.choice([1, 1, 1, 2, None]), rng.choice([40, rng.randrange(5, 100), None]), rng.randrange(10**6)) for _ in range(200)]
    return left, right + right[:5], spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right + right[:5], "k long, at long, v long")


@pytest.mark.parametrize("keyed, ranges", [(True, 1), (True, 7), (False, 7)])
def test_asof(looked_up, keyed, ranges):
    left, right, a, b = looked_up
    want = []
    for k, t, i in left:
        able = [(at, v) for q, at, v in right if at is not None and t is not None and at <= t and (not keyed or (q is not None and q == k))]
        want.append((i, *(max(able) if able else (None, None))))
    b = b if keyed else b.drop("k")
    got = asof_join(a, b, "t", "at", ["at", "v"], ["k"] if keyed else None, ["v"], ranges).select("i", "at", "v").collect()
    assert sorted(map(tuple, got)) == want


def test_asof_empty_sides(looked_up):
    _, _, a, b = looked_up
    assert {r["v"] for r in asof_join(a, b.limit(0), "t", "at", ["v"], ["k"]).collect()} == {None}
    assert asof_join(a.limit(0), b, "t", "at", ["v"], ["k"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a.withColumn("_t", F.lit(1)), b, "t", "at", ["v"])


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        s = T0 + timedelta(minutes=rng.randrange(3000))
        rows.append((i, rng.choice(["a", "a", "b"]), s, s + timedelta(minutes=rng.choice([0, 1, 10, 90, 2000]))))
    rows += [(i, "a", T0 + timedelta(minutes=60), T0 + timedelta(minutes=120)) for i in range(200, 240)]
    rows += [(300, "a", None, T0), (301, "a", T0, None), (302, "a", T0 + timedelta(hours=2), T0), (303, None, T0, T0 + timedelta(days=9)), (304, "b", T0 + timedelta(minutes=120), T0 + timedelta(minutes=180))]
    return rows, spark.createDataFrame(rows, "i long, k string, s timestamp, e timestamp")


def whole(rows):
    return [r for r in rows if r[2] and r[3] and r[2] < r[3]]


@pytest.mark.parametrize("width", [600, 7200])
def test_pairs_once_over_many_bins(spans, width):
    rows, df = spans
    own = [r for r in whole(rows) if r[1]]
    want = sorted((a[1], a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in own for b in own if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted(map(tuple, overlap_pairs(df, "i", "s", "e", ["k"], width).collect())) == want


def test_pairs_by_length(spans):
    rows, df = spans
    own = [r for r in whole(rows) if r[1]]
    want = sorted((a[1], a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in own for b in own if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted(map(tuple, overlap_pairs(df, "i", "s", "e", ["k"]).collect())) == want


def test_what_meets_grows_with_what_overlaps(spark):
    """10,000 short intervals an instant apart, of which none overlaps another, and a long one over all of them."""
    begin = F.col("id") * 200_000
    own = spark.range(10_000).select(F.col("id").alias("_id"), F.timestamp_micros(begin).alias("_s"), F.timestamp_micros(begin + F.when(F.col("id") == 0, 3_000_000_000).otherwise(100_000)).alias("_e"))
    assert overlap_pairs(own, "_id", "_s", "_e").count() == 9_999
    touched, begins = _dealt(own, [], None)
    assert touched.join(begins, ["_w", "_b"]).count() < 4 * 10_000


@pytest.mark.parametrize("held", [3, 20_000])
def test_pairs_of_whole_numbers(spans, monkeypatch, held):
    """Ranges, blocks of one instant's beginnings, repeated rows and batches of a few pairs against plain Python."""
    for name, n in (("HELD", held), ("PAIRS", 7 if held == 3 else 100_000), ("DEALT", 5)):
        monkeypatch.setattr(intervals, name, n)
    rows, df = spans
    own = whole(rows)
    want = sorted((a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in own for b in own if a[0] < b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted(map(tuple, overlap_pairs(df, "i", "s", "e").collect())) == want
    hot = df.withColumn("s", F.lit(min(r[2] for r in own)))
    own = whole([(*r[:2], min(r[2] for r in own), r[3]) for r in rows])
    want = sorted((a[0], b[0], a[2], min(a[3], b[3])) for a in own for b in own if a[0] < b[0])
    assert sorted(map(tuple, overlap_pairs(hot, "i", "s", "e").collect())) == want
    assert overlap_pairs(df.limit(0), "i", "s", "e").count() == 0


def test_pairs_move_little(spark):
    """Intervals of five powers of two in length: each moves about twice, without what is shown of its instants."""
    begin = F.col("id") * 200_000
    own = spark.range(20_000).select("id", F.timestamp_micros(begin).alias("s"), F.timestamp_micros(begin + 60_000 * F.expr("CAST(pow(2, id % 5) AS BIGINT)")).alias("e"))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("moved", "moved")
    try:
        overlap_pairs(own, "id", "s", "e", shown=lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)).write.format("noop").mode("overwrite").save()
        stages = {s for j in tracker.getJobIdsForGroup("moved") for s in tracker.getJobInfo(j).stageIds}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    known = [tracker.getStageInfo(s) for s in stages]
    assert any(known)
    moved = sum(context._jsc.sc().statusStore().lastStageAttempt(i.stageId).shuffleWriteRecords() for i in known if i)
    assert 20_000 < moved < 3 * 20_000


@pytest.mark.parametrize("ranges", [1, 9])
def test_counts_and_most_at_once(spans, ranges):
    rows, df = spans
    own = whole(rows)
    counts = {r["i"]: r["n"] for r in overlap_counts(df, "i", "s", "e", ranges=ranges).collect()}
    assert counts == {a[0]: sum(a[2] < b[3] and b[2] < a[3] for b in own) - 1 for a in own}
    instants = sorted({x for r in own for x in r[2:]})
    open_ = [(sum(r[2] <= t < r[3] for r in own), t) for t in instants]
    assert sorted((r["at"], r["n"]) for r in at_once(df, "s", "e", ranges=ranges).collect()) == [(t, n) for n, t in open_]
    best = max(n for n, _ in open_)
    assert most_at_once(df, "s", "e", ranges=ranges).collect()[0].asDict() == {"n": best, "at": min(t for n, t in open_ if n == best)}
    assert {r["k"]: r["n"] for r in most_at_once(df.where("k IS NOT NULL"), "s", "e", ["k"], ranges).collect()}.keys() == {"a", "b"}
    assert most_at_once(df.limit(0), "s", "e").count() == 0


def replayed(points):
    by = {}
    for k, at, v in points:
        by.setdefault(k, {})[at] = v
    out = []
    for k, own in by.items():
        times = sorted(own)
        out += [(k, t, (times + [None])[i + 1], own[t]) for i, t in enumerate(times)]
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 6])
def test_history_with_late_changes_equals_replay(spark, ranges):
    rng = random.Random(9)
    batches = [[(rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), rng.choice(["x", "y", ""])) for _ in range(40)] for _ in range(3)]
    batches[2] += [(1, 500, "x"), (None, 3, "x"), (4, None, "y")]
    folded, seen = None, {}
    for batch in batches:
        own = {}
        for k, at, v in batch:
            if k is not None and at is not None:
                own[k, at] = max(v, own.get((k, at), ""))
        seen |= own
        folded = spark.createDataFrame(fold_history(folded, spark.createDataFrame(batch, "key long, at long, value string"), ranges).collect(), "key long, valid_from long, valid_to long, value string")
        assert sorted(map(tuple, folded.collect())) == replayed([(k, at, v) for (k, at), v in seen.items()])
    for t in (-1, 0, 77, 199, 10_000):
        want = {}
        for (k, at), v in sorted(seen.items()):
            if at <= t:
                want[k] = v
        assert {r["key"]: r["value"] for r in state_at(folded, t).collect()} == want
    runs = sorted(map(tuple, coalesced(folded, ranges).collect()))
    assert all(a[3] != b[3] and a[2] == b[1] for a, b in zip(runs, runs[1:], strict=False) if a[0] == b[0]) and len(runs) < folded.count()


def test_a_late_change_splits_an_interval_of_equal_values(spark):
    rows = lambda x: spark.createDataFrame(x, "key string, at int, value string")
    first = fold_history(None, rows([("k", 1, "A"), ("k", 5, "A")]))
    late = fold_history(first, rows([("k", 3, "B")]))
    assert sorted(map(tuple, late.collect())) == [("k", 1, 3, "A"), ("k", 3, 5, "B"), ("k", 5, None, "A")]
    assert sorted(map(tuple, coalesced(first).collect())) == [("k", 1, None, "A")]


def test_views_equal_recounting_after_each_batch(spark, sf_dir, tmp_path):
    stored = views.notices(spark, sf_dir).cache()
    number = F.col("duid").cast("long")
    own = Upkeep(spark, f"file://{tmp_path}/v")

    def check(now):
        for name, (keys, sums, of) in VIEWS.items():
            counted = of(now).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)) if keys else of(now).agg(*(F.sum(c).alias(c) for c in sums))
            assert sorted(map(str, own.read(name).select(*keys, *sums).collect())) == sorted(map(str, counted.select(*keys, *sums).collect())), name

    first = stored.where(F.pmod(number, F.lit(4)) != 3)
    own.apply(0, stored.limit(0), first)
    check(first)
    moved = stored.where(F.pmod(number, F.lit(4)) >= 2).withColumn("posted_date", F.date_add("posted_date", 1))
    own.apply(1, *batch_of(first, moved))
    own.apply(1, *batch_of(first, moved))  # run again after a failure
    now = first.join(moved.select("duid"), "duid", "left_anti").select(*stored.columns).unionByName(moved)
    check(now)
    gone = now.where(F.pmod(number, F.lit(3)) == 0).withColumn("tombstone_at", F.current_timestamp())
    own.apply(2, *batch_of(now, gone))
    after = now.where(F.pmod(number, F.lit(3)) != 0)
    check(after)
    own = own.compact(f"file://{tmp_path}/w", 2)
    check(after)
