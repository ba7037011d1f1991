from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.errors import ReadOnlyStorageError, RunBusyError, SchemaVersionError, StorageInputError, StorageUnavailableError
from tidemark.operators.feed import all_categories, freshness_histogram, latest_page, needs_detail, with_freshness
from tidemark.operators.schema import NOTICES, RUNS, TABLES
from tidemark.sources import store as stores
from tidemark.sources.store import open_read_only, open_store

T0 = datetime(2024, 3, 1, 9, tzinfo=UTC)
DAY = timedelta(days=1)


def rows(spark, *given):
    """(duid, title[, body[, category]]) in order."""
    full = []
    for k, (duid, title, *more) in enumerate(given):
        body, category = (*more, None, None)[:2]
        full.append((duid, title, category or "general", "일반", date(2024, 3, 1), date(2024, 3, 1), "Desk", f"u{duid}", False, body, k))
    return spark.createDataFrame(full, "duid string, title string, category_id string, category_name string, posted_date date, updated_date date, department string, source_url string, attachments_present boolean, body string, seq long")


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, f"{tmp_path}/store")


def test_details_metadata_summaries(spark, store):
    store.save_details(rows(spark, ("1", "One", "the  body"), ("2", "Two", "")), T0)
    one = store.get("1")
    assert (one["body"], one["source_status"], one["body_expires_at"].replace(tzinfo=UTC)) == ("the body", "active", T0 + 30 * DAY)
    assert store.get("2")["body"] == "" and store.get("3") is None and store.revision_count("1") == 0

    store.save_summaries(rows(spark, ("1", "One")), T0 + DAY)
    one = store.get("1")
    assert (one["body"], one["body_expires_at"].replace(tzinfo=UTC), one["collected_at"].replace(tzinfo=UTC)) == ("the body", T0 + 31 * DAY, T0 + DAY)
    assert store.revision_count("1") == 0

    store.save_metadata(rows(spark, ("1", "One")), T0 + 2 * DAY)
    assert store.get("1")["body"] is None and store.get("1")["body_expires_at"] is None
    assert store.revision_count("1") == 1 and store.revision_count("2") == 0
    assert "body" not in store.revision_columns()


def test_rows_of_one_key_take_effect_in_order(spark, store):
    store.save_metadata(rows(spark, ("1", "a"), ("1", "a"), ("1", "b"), ("2", "x"), ("1", "a")), T0)
    assert store.get("1")["title"] == "a" and store.revision_count("1") == 2 and store.revision_count("2") == 0
    store.save_metadata(rows(spark, ("1", "a"), ("1", "c")), T0 + DAY)
    got = store.revisions().orderBy("revision_id").collect()
    assert [(r["revision_id"], r["title"]) for r in got] == [(1, "b"), (2, "a"), (3, "c")]
    assert got[-1]["content_hash"] == store.get("1")["content_hash"]


def test_tombstones(spark, store):
    store.save_details(rows(spark, ("1", "One", "b"), ("2", "Two", "b")), T0)
    store.mark_gone(spark.createDataFrame([("1",), ("nobody",)], "duid string"), T0 + DAY)
    assert store.get("1")["source_status"] == "tombstoned" and store.index().count() == 1 and store.notices().count() == 2
    store.save_metadata(rows(spark, ("1", "One")), T0 + 2 * DAY)
    assert (store.get("1")["source_status"], store.get("1")["tombstone_at"].replace(tzinfo=UTC)) == ("tombstoned", T0 + DAY)
    store.save_details(rows(spark, ("1", "One", "b")), T0 + 3 * DAY)
    assert store.get("1")["source_status"] == "active" and store.get("1")["tombstone_at"] is None
    store.save_details(rows(spark, ("1", "One", "b")), T0 + 4 * DAY, spark.createDataFrame([("1",), ("2",)], "duid string"))
    assert {r["source_status"] for r in store.notices().collect()} == {"tombstoned"}
    listed = store.notices().limit(0)
    assert merge.ignore_absence(store.notices(), listed).count() == 2


def test_bodies_have_a_bounded_life_and_the_hash_stays(spark, store):
    store.save_details(rows(spark, ("1", "One", "target"), ("2", "Two", "other")), T0)
    old = store.get("1")["content_hash"]
    assert store.sweep_bodies(T0 + 30 * DAY - timedelta(seconds=1)).count() == 0
    assert sorted(r["duid"] for r in store.sweep_bodies(T0 + 30 * DAY).collect()) == ["1", "2"]
    assert store.get("1")["body"] is None and store.get("1")["content_hash"] == old
    store.save_metadata(rows(spark, ("1", "One")), T0 + 31 * DAY)
    assert store.revision_count("1") == 1


def test_hash_is_of_the_twice_cleaned_body_and_safe_text(spark, store):
    secret = "some.one" + "@" + "mail.example.org"
    store.save_details(rows(spark, ("1", f"By {secret}", f"Write {secret} now")), T0)
    one = store.get("1")
    assert one["title"] == "By [REDACTED_EMAIL]" and one["body"] == "Write [REDACTED_EMAIL] now"
    store.save_details(rows(spark, ("1", f"By {secret}", f"Write {secret} now")), T0 + DAY)
    assert store.revision_count("1") == 0


def test_a_commit_writes_in_proportion_to_its_batch(spark, store):
    many = spark.range(100_000).selectExpr("cast(id as string) AS duid", "'t' AS title", "'general' AS category_id", "'x' AS category_name", "date'2024-03-01' AS posted_date", "date'2024-03-01' AS updated_date", "'Desk' AS department", "'u' AS source_url", "false AS attachments_present", "id AS seq")
    store.save_metadata(many, T0)
    for k in range(3):
        known = {path for _, path in stores._folders(store._manifest)}
        store.save_metadata(rows(spark, *[(str((k * 7919 + i * 997) % 100_000), f"new {k}") for i in range(100)]), T0 + k * DAY)
        fresh = [path for table, path in stores._folders(store._manifest) if path not in known and table == "notices"]
        assert sum(spark.read.parquet(f"{store.root}/{path}").count() for path in fresh) <= 100 * stores.FANOUT
    own = store.notices()
    assert own.count() == 100_000 and own.where("title = 'new 2'").count() == 100 and own.select("duid").distinct().count() == 100_000
    assert store.get("997")["title"] == "new 0" and store.get("1")["title"] == "t" and store.get("100000") is None
    assert store.search_count("new").first()["n"] == own.where("title LIKE 'new%'").count()


def test_layers_are_merged_and_become_a_base(spark, store):
    want = {}
    for k in range(11):
        batch = [(str(i), f"t{k}") for i in range(k, 40, 3)]
        want |= dict(batch)
        store.save_metadata(rows(spark, *batch), T0 + k * DAY)
    own = store._manifest["notices"]
    assert own["base"] and len(own["deltas"]) < stores.FANOUT and len(store._manifest["postings"]) <= 2 * stores.FANOUT
    assert {r["duid"]: r["title"] for r in store.notices().collect()} == want
    ids = [r["revision_id"] for r in store.revisions().orderBy("revision_id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and len(ids) > 50
    assert store.search_count("t10").first()["n"] == sum(v == "t10" for v in want.values()) and store.search_count("t0").first()["n"] == sum(v == "t0" for v in want.values())
    store.vacuum(keep=1)
    assert {r["duid"]: r["title"] for r in open_store(spark, store.root).notices().collect()} == want
    assert len(list((__import__("pathlib").Path(store.root) / "data" / "notices").iterdir())) == 1 + len(own["deltas"])


def test_search_by_the_kept_index_equals_search_of_the_notices(spark, store, sf_dir):
    from tidemark.operators.feed import Filters
    from tidemark.operators.search import ranked, search_count, search_page
    from tidemark.plans import views

    own = views.notices(spark, sf_dir).withColumn("seq", F.col("duid").cast("long"))
    store.save_details(own, T0)
    store.save_details(own.where("seq % 3 = 0").withColumn("body", F.concat(F.lit("thing of the new text "), F.col("body"))), T0 + DAY)
    store.mark_gone(own.where("seq % 17 = 0").select("duid"), T0 + DAY)
    store.save_metadata(own.where("seq % 5 = 0"), T0 + 2 * DAY)
    notices = store.notices()
    for query in ("thing of-the", "new-text src1", "of of-the", "' --", "일반"):
        for filters in (Filters("general", posted_from=date(2024, 1, 10)) if query == "일반" else Filters(),):
            page = [(r["duid"], pytest.approx(r["score"], abs=1e-9)) for r in search_page(notices, query, filters, 20, 5).collect()]
            assert [(r["duid"], r["score"]) for r in store.search_page(query, filters, 20, 5).collect()] == page
            assert store.search_count(query, filters).first()["n"] == search_count(notices, query, filters).first()["n"]
    index = store.search_index()
    assert (index.n, index.n > 0) == (notices.where("tombstone_at IS NULL").count(), True) and ranked(notices, "the").count() > 50
    plan = index.postings(["thing"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,thing)]" in plan and "PartitionFilters: [isnotnull(_part" in plan


def test_a_torn_manifest_is_passed_over(spark, store):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    torn = store.version + 1
    for n, text in ((torn, ""), (torn + 1, '{"version":')):
        open(f"{store.root}/{stores._name(n)}", "w").write(text)
    store.start_run("a", T0)
    assert store.version == torn + 2 and open_read_only(spark, store.root).get_run("a")["status"] == "running"
    again = open_store(spark, store.root)
    again.finish_run("a", "success", T0)
    again.save_metadata(rows(spark, ("2", "Two")), T0)
    assert open_read_only(spark, store.root).notices().count() == 2


def test_a_store_of_torn_manifests_only_is_made_anew(spark, tmp_path):
    (tmp_path / "s" / "manifest").mkdir(parents=True)
    (tmp_path / "s" / stores._name(1)).write_text("")
    assert open_store(spark, f"{tmp_path}/s").version == 2


def test_publishing_by_renaming_never_overwrites(spark, store):
    files = store._files
    assert files.create("manifest/x", "one") and not files.create("manifest/x", "two") and files.read("manifest/x") == "one"
    files._fs.create(files.path("manifest/y.tmp"), False).close()
    assert files._rename("manifest/y.tmp", "manifest/y") and files.names("manifest").count("y") == 1
    files._fs.create(files.path("manifest/z.tmp"), False).close()
    assert not files._rename("manifest/z.tmp", "manifest/x") and files.read("manifest/x") == "one"


def test_an_incoming_batch_is_read_once(spark, store):
    """A source that gives other rows each time it is read leaves a state and revisions that belong together."""
    store.save_metadata(rows(spark, *[(str(k), "t") for k in range(20)]), T0)
    moving = rows(spark, *[(str(k), "x") for k in range(20)]).withColumn("title", F.concat(F.lit("n"), F.expr("uuid()")))
    store.save_metadata(moving, T0 + DAY)
    state = {r["duid"]: (r["title"], r["content_hash"]) for r in store.notices().collect()}
    assert {r["duid"]: (r["title"], r["content_hash"]) for r in store.revisions().collect()} == state


def test_numbers_follow_seq_whatever_its_values(spark):
    given = [(hash((k, 1)) % 2**61 - 2**60, str(k)) for k in range(300)] + [(5, "b"), (5, "a")]
    frame = spark.createDataFrame(given, "seq long, duid string")
    for c in stores.TABLES["notice_revisions"]:
        if c.name not in ("duid", "revision_id"):
            frame = frame.withColumn(c.name, F.lit(None).cast(c.dataType))
    got = [r["duid"] for r in merge.numbered_revisions(frame, 7, block=20).orderBy("revision_id").collect()]
    assert got == [d for _, d in sorted(given)]
    assert [r["revision_id"] for r in merge.numbered_revisions(frame, 7, block=20).orderBy("revision_id").collect()] == list(range(8, 310))


def test_a_batch_of_one_seq_is_numbered_in_blocks(spark):
    given = [(1, k % 2, str(k)) for k in range(300)]
    frame = spark.createDataFrame(given, "seq long, sub long, duid string")
    for c in stores.TABLES["notice_revisions"]:
        if c.name not in ("duid", "revision_id"):
            frame = frame.withColumn(c.name, F.lit(None).cast(c.dataType))
    got = [(r["revision_id"], r["duid"]) for r in merge.numbered_revisions(frame, 0, block=20).orderBy("revision_id").collect()]
    assert got == [(i + 1, d) for i, (_, _, d) in enumerate(sorted(given))]


def _names(store, folder):
    return {f"{folder}/{n}" for n in store._files.names(folder)}


@pytest.mark.parametrize("when", ["before the manifest", "after the first folder"])
def test_vacuum_spares_what_a_writer_is_about_to_publish(spark, store, monkeypatch, when):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    store.save_metadata(rows(spark, ("1", "Uno")), T0)
    other = open_store(spark, store.root)
    done = []

    def vacuum_once():
        if not done:
            done.append(1)
            other.vacuum(keep=1)

    if when == "before the manifest":
        create = store._files.create
        monkeypatch.setattr(store._files, "create", lambda *a: (vacuum_once(), create(*a))[1])
    else:
        write = store._write
        monkeypatch.setattr(store, "_write", lambda *a: (write(*a), vacuum_once())[0])
    store.save_details(rows(spark, ("2", "Two", "b")), T0)
    assert done and {r["duid"]: r["title"] for r in open_read_only(spark, store.root).notices().collect()} == {"1": "Uno", "2": "Two"}
    assert store.search_count("two").first()["n"] == 1 and _names(store, "intents") == set()


def test_vacuum_deletes_after_the_writer_is_done_or_dead(spark, store, monkeypatch):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    dead = open_store(spark, store.root)
    dead._token = "dead"
    dead._files.put("intents/dead")
    left = dead._write(dead.notices(), "notices")
    store.vacuum(keep=1)
    assert left in _names(store, "data/notices")
    monkeypatch.setattr(stores, "INTENT_SECONDS", -1)
    store.vacuum(keep=1)
    assert left in _names(store, "data/notices") and _names(store, "intents") == set()
    with pytest.raises(StorageUnavailableError):
        dead._published(lambda: {"notices": dead._manifest["notices"]})
    store.vacuum(keep=1)
    assert left not in _names(store, "data/notices") and open_read_only(spark, store.root).notices().count() == 1


def test_vacuum_keeps_held_versions(spark, store):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    reader = open_store(spark, store.root)
    with reader.hold():
        for k in range(5):
            store.save_metadata(rows(spark, ("1", f"v{k}")), T0)
        store.vacuum(keep=1)
        assert reader.get("1")["title"] == "One"
    store.vacuum(keep=1)
    assert len(stores._numbers(store._files)) == 1


def test_ledger_steps_are_appended_and_folded(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "LEDGER_STEPS", 4)
    for k in range(3):
        store.start_run(f"r{k}", T0 + k * DAY)
        store.update_run(f"r{k}", T0 + k * DAY, pages_seen=k)
        store.finish_run(f"r{k}", "success", T0 + k * DAY)
    assert len(store._manifest["crawl_runs"]) <= 4
    assert sorted((r["run_id"], r["status"], r["pages_seen"]) for r in store.runs().collect()) == [(f"r{k}", "success", k) for k in range(3)]
    store.start_run("last", T0 + 9 * DAY)
    step = spark.read.parquet(f"{store.root}/{store._manifest['crawl_runs'][-1]}")
    assert step.count() == 1 and open_read_only(spark, store.root).get_run("r1")["pages_seen"] == 1


def test_versions_conflicts_and_read_only(spark, store):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    reader = open_read_only(spark, store.root)
    other = open_store(spark, store.root)
    store.save_metadata(rows(spark, ("2", "Two")), T0)
    assert reader.notices().count() == 1 and open_read_only(spark, store.root).notices().count() == 2
    other.save_metadata(rows(spark, ("3", "Three"), ("2", "Two!")), T0)  # a handle that lost a race goes on from what was written
    assert store.notices().count() == 2 and other.notices().count() == 3 and other.revision_count("2") == 1
    store.start_run("r", T0)
    other.save_metadata(rows(spark, ("4", "Four")), T0)
    store.save_metadata(rows(spark, ("5", "Five")), T0)
    assert open_read_only(spark, store.root).notices().count() == 5 and other.get_run("r")["status"] == "running"
    for write in (lambda: reader.save_metadata(rows(spark), T0), lambda: reader.sweep_bodies(T0), lambda: reader.start_run("a", T0), lambda: reader.vacuum()):
        with pytest.raises(ReadOnlyStorageError):
            write()
    store.vacuum(keep=1)
    assert open_read_only(spark, store.root).notices().count() == 5
    assert store.table_names() == frozenset(TABLES)


def test_opening_for_reading_never_makes_a_store(spark, tmp_path):
    with pytest.raises(StorageUnavailableError):
        open_read_only(spark, f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    made = open_store(spark, f"{tmp_path}/new")
    assert made.notices().schema.fieldNames() == NOTICES.fieldNames() and made.notices().count() == 0
    manifest = next((tmp_path / "new" / "manifest").glob("*.json"))
    manifest.write_text(manifest.read_text().replace('"schema_version": 1', '"schema_version": 9'))
    (tmp_path / "new" / "manifest" / f".{manifest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(SchemaVersionError):
        open_store(spark, f"{tmp_path}/new")


def test_a_foreign_schema_is_refused(spark, store):
    store.save_metadata(rows(spark, ("1", "One")), T0)
    store.save_metadata(rows(spark, ("2", "Two")), T0)
    path = next(stores._folders(store._manifest))[1]  # the first one, not the last
    spark.range(1).write.mode("overwrite").parquet(f"{store.root}/{path}")
    with pytest.raises(StorageUnavailableError):
        open_read_only(spark, store.root)


# Ledger


def test_lease(spark, store):
    store.start_run("a", T0)
    with pytest.raises(RunBusyError):
        store.start_run("b", T0 + timedelta(minutes=15))
    store.update_run("a", T0 + timedelta(minutes=1), checkpoint_page=7, pages_seen=2)
    store.update_run("a", T0 + timedelta(minutes=1), checkpoint_page=None, retry_count=3)
    a = store.get_run("a")
    assert (a["checkpoint_page"], a["pages_seen"], a["retry_count"], a["status"]) == (7, 2, 3, "running")
    store.start_run("b", T0 + timedelta(minutes=17))
    assert store.get_run("a")["status"] == "interrupted" and store.restart_checkpoint() == 7
    with pytest.raises(StorageInputError):
        store.finish_run("b", "running", T0)
    with pytest.raises(StorageInputError):
        store.finish_run("b", "odd", T0)
    with pytest.raises(StorageInputError):
        store.update_run("zz", T0)
    store.finish_run("b", "success", T0 + timedelta(minutes=20))
    assert store.latest_successful_at().replace(tzinfo=UTC) == T0 + timedelta(minutes=20) and store.latest_status() == "success"
    with pytest.raises(StorageInputError):
        store.start_run("a", T0 + DAY)


def test_recovery(spark, store):
    store.start_run("a", T0)
    assert store.recover_runs(T0 + timedelta(minutes=15)) == []
    assert [r["run_id"] for r in store.recover_runs(T0 + timedelta(minutes=16))] == ["a"]
    assert store.latest_run()["finished_at"] is not None and store.latest_successful_at() is None


# Feed


def test_freshness_bounds(spark):
    ages = {"a": timedelta(hours=24), "b": timedelta(hours=24, seconds=1), "c": timedelta(days=7), "d": timedelta(days=7, seconds=1), "e": -DAY}
    own = spark.createDataFrame([(k, T0 - v) for k, v in ages.items()], "duid string, collected_at timestamp")
    ran = spark.createDataFrame([("x", "success", 0, 0, 0, 0, 0, None, T0, T0, T0)], RUNS)
    got = {r["duid"]: r["freshness"] for r in with_freshness(own, ran, T0).collect()}
    assert got == {"a": "fresh", "b": "stale", "c": "stale", "d": "expired", "e": "fresh"}
    assert {r["freshness"] for r in with_freshness(own, ran.withColumn("status", F.lit("interrupted")), T0).collect()} == {"expired"}


def test_feed_of_a_small_store(spark, store):
    store.save_metadata(rows(spark, ("9", "t"), ("10", "t"), ("11", "t", None, "student")), T0)
    assert [r["duid"] for r in latest_page(store.notices()).collect()] == ["9", "11", "10"]
    counts = all_categories(store.notices()).collect()
    assert len(counts) == 11 and {r["category_id"]: r["n"] for r in counts if r["n"]} == {"general": 2, "student": 1}
    assert [(r["freshness"], r["n"]) for r in freshness_histogram(store.notices(), store.runs(), T0).collect()] == [("fresh", 0), ("stale", 0), ("expired", 3)]
    asked = rows(spark, ("9", "t"), ("10", "changed"), ("12", "t"))
    assert sorted(r["duid"] for r in needs_detail(asked, store.notices()).collect()) == ["10", "12"]
