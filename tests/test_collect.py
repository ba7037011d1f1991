import io
import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.urls import BoardSite
from tidemark.plans.collect import Collector, RunConfig, collect_captured
from tidemark.plans.service import NoticeService, as_json, next_start
from tidemark.plans.settings import BadConfiguration, load_settings
from tidemark.sources.robots import METADATA_ONLY
from tidemark.sources.store import open_read_only, open_store
from tidemark.sources.wire import MAX_BODY, NOTICE, ROBOTS, Budget, BudgetExceeded, ConnectionFailed, Fetcher, Response, ResponseTooLarge, target_issue

SITE = BoardSite()
T0 = datetime(2024, 3, 4, 9, tzinfo=UTC)
HTML = {"Content-Type": "text/html; charset=UTF-8"}
META = RunConfig(mode=METADATA_ONLY)


def page(*rows):
    own = "".join(f'<li><b class="category">[일반]</b><a href="?DUID={d}">{t}</a><p class="info">v | 2024-03-01 | {u} | Desk</p></li>' for d, t, u in rows)
    return Response(200, HTML, f'<div class="board-list-box"><ul>{own}</ul></div>'.encode())


def detail(title, body="text", updated="2024-03-01"):
    return Response(200, HTML, f'<article><h1 class="title">{title}</h1><b class="category">일반</b><i class="posted-date">2024-03-01</i><i class="updated-date">{updated}</i><i class="writer">Desk</i><div class="body">{body}</div></article>'.encode())


ROBOTS_OK = Response(200, {"content-type": "text/plain"}, b"User-agent: *\nAllow: /\nCrawl-delay: 5")


class Wire:
    """Answers in order; an exception is raised."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def request(self, url):
        self.asked.append(url)
        answer = self.answers.pop(0)
        if isinstance(answer, BaseException):
            raise answer
        return answer


class Clock:
    def __init__(self, step=0.0):
        self.now, self.step = T0, step

    def __call__(self):
        self.now += timedelta(seconds=self.step)
        return self.now


def collector(store, *answers, step=0.0, **more):
    wire, slept = Wire(*answers), []
    own = Collector(store, wire, sleep=slept.append, clock=Clock(step), **more)
    own.slept = slept
    return own


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, f"{tmp_path}/store")


# Fetching


def fetcher(*answers, **more):
    slept = []
    own = Fetcher(Wire(*answers), sleep=slept.append, **more)
    own.slept = slept
    return own


LIST = f"{SITE.origin}{SITE.path}?x"


def redirect(to):
    return Response(302, {"Location": to} if to else {}, b"")


@pytest.mark.parametrize(
    "answers, reason",
    [
        ([Response(403, {}, b"")], "forbidden"), ([Response(403, {}, b"Access denied")], "captcha"), ([Response(429, {}, b"")], "rate_limit"), ([Response(500, {}, b"")], "http_failure"), ([Response(199, {}, b"")], "http_failure"),
        ([redirect(None)], "invalid_redirect_target"), ([redirect("https://x.org/")], "cross_host_redirect"), ([redirect("/x")], "disallowed_redirect_path"), ([redirect(LIST + "#a")], "invalid_redirect_target"),
        ([redirect(LIST)] * 6, "redirect_hop_cap"), ([ConnectionFailed()] * 3, "transport_failure"), ([TimeoutError(), ConnectionResetError(), Response(200, HTML, b"ok")], None), ([Response(404, {}, b"")], None), ([redirect(LIST)] * 5 + [Response(200, HTML, b"ok")], None),
    ],
)
def test_fetch(answers, reason):
    own = fetcher(*answers)
    got = own.fetch(LIST, NOTICE, 1.0)
    assert got.reason == reason and (got.response is None) == (reason is not None)
    assert own.transport.answers == [] and own.slept == [2.0] * len(answers) and own.counters.requests == own.budget.used == len(answers)
    assert own.counters.retries == min(2, sum(isinstance(a, BaseException) for a in answers))


def test_fetch_limits():
    assert fetcher().fetch("http://x", NOTICE).reason == "invalid_scheme"
    with pytest.raises(ResponseTooLarge):
        fetcher(Response(200, HTML, b"x" * (MAX_BODY + 1))).fetch(LIST, NOTICE)
    with pytest.raises(BudgetExceeded):
        fetcher(ConnectionFailed(), budget=Budget(1)).fetch(LIST, NOTICE)
    own = fetcher(ROBOTS_OK)
    assert own.fetch(SITE.robots, ROBOTS, 9.0).response is ROBOTS_OK and own.slept == [9.0]
    assert target_issue(LIST, ROBOTS) == "disallowed_path" and target_issue("https://[", NOTICE) == "malformed_target"


# Runs


def test_metadata_run(store):
    own = collector(store, page(("1", "One", "2024-03-02"), ("2", "Two", "x"), ("1", "Again", "2024-03-02")))
    got = own.run("a", META)
    assert (got.status, got.reason, got.requests) == ("success", None, 1)
    assert own.transport.asked == [f"{SITE.origin}{SITE.path}?srCategoryId=&mode=list&searchKey=1&searchVal=&tpage=1"]
    run = store.get_run("a")
    assert (run["status"], run["checkpoint_page"], run["pages_seen"], run["detail_requests"], run["index_requests"]) == ("success", 1, 1, 0, 1)
    assert {r["duid"]: r["title"] for r in store.notices().collect()} == {"1": "One", "2": "Two"}


@pytest.mark.parametrize(
    "answer, reason",
    [
        (Response(200, HTML, b"<p>other</p>"), "markup"), (Response(200, {"content-type": "text/plain"}, b"x"), "markup"), (Response(200, HTML, b"\xff"), "markup"), (Response(404, HTML, b""), "markup"), (Response(429, {}, b""), "rate_limit"),
        (page(("1", "One", "2024-03-02"), ("x", "Bad", "2024-03-02")), "markup"), (Response(200, HTML, b"x" * (MAX_BODY + 1)), "oversized"), (ValueError("odd"), "raise"), (RuntimeError("odd"), "collector_failure"),
    ],
)
def test_a_run_that_meets_anything_unclear_writes_no_notice(store, answer, reason):
    own = collector(store, answer)
    if reason == "raise":
        with pytest.raises(ValueError):
            own.run("a", META)
        return
    got = own.run("a", META)
    assert (got.status, got.reason) == ("blocked", reason)
    assert store.get_run("a")["status"] == ("failed" if reason == "collector_failure" else "blocked") and store.get_run("a")["block_reason"] == reason
    assert store.notices().count() == 0


def test_busy_and_time(store):
    store.start_run("other", T0)
    assert collector(store).run("a", META).status == "busy"
    store.finish_run("other", "success", T0)
    got = collector(store, step=600.0).run("b", META)
    assert (got.status, got.reason, got.requests) == ("budget_exceeded", "time_budget", 0) and store.get_run("b")["status"] == "blocked"


def test_full_run(store):
    own = collector(store, ROBOTS_OK, page(("1", "One", "2024-03-01"), ("2", "Two", "2024-03-01"), ("3", "Three", "2024-03-01")), detail("One", "target"), Response(404, {}, b""), detail("Three"))
    got = own.run("a", RunConfig())
    assert (got.status, got.requests) == ("success", 5) and own.slept == [2.0, 5.0, 5.0, 5.0, 5.0]
    assert {r["duid"]: r["body"] for r in store.notices().collect()} == {"1": "target", "3": "text"}
    assert (store.get_run("a")["detail_requests"], store.get_run("a")["checkpoint_page"]) == (3, 1)
    again = collector(store, ROBOTS_OK, page(("1", "One", "2024-03-01"), ("2", "Two", "2024-03-01"), ("3", "Three!", "2024-03-01")), Response(404, {}, b""), Response(404, {}, b""))
    assert again.run("b", RunConfig()).status == "success"
    assert {r["duid"]: r["source_status"] for r in store.notices().collect()} == {"1": "active", "3": "tombstoned"}


@pytest.mark.parametrize(
    "answers, config, status, reason",
    [
        ([Response(200, {"content-type": "text/plain"}, b"User-agent: *\nDisallow: /")], RunConfig(), "blocked", "robots_disallowed"), ([Response(403, {}, b"")], RunConfig(), "blocked", "forbidden"),
        ([ROBOTS_OK, page(("1", "One", "2024-03-01"), ("2", "Two", "2024-03-01")), detail("One")], RunConfig(max_details=1), "budget_exceeded", "detail_budget"),
        ([ROBOTS_OK, page(("1", "One", "2024-03-01")), Response(500, {}, b"")], RunConfig(), "blocked", "http_failure"), ([ROBOTS_OK, page(("1", "One", "2024-03-01")), Response(200, HTML, b"<p>")], RunConfig(), "blocked", "markup"),
    ],
)
def test_a_full_run_publishes_all_or_nothing(store, answers, config, status, reason):
    got = collector(store, *answers).run("a", config)
    assert (got.status, got.reason) == (status, reason) and store.notices().count() == 0 and store.get_run("a")["status"] == "blocked"


def test_captured_responses(spark):
    def line(k, kind, duid, answer):
        return k, kind, duid, LIST, answer.status, dict(answer.headers), answer.body, None

    rows = [
        line(1, "index", None, page(("1", "One", "2024-03-01"), ("2", "Two", "2024-03-01"))), line(2, "index", None, page(("3", "Three", "2024-03-01"), ("x", "Bad", "2024-03-01"))),
        line(3, "detail", "7", detail("Seven")), line(4, "detail", "8", Response(404, {}, b"")), line(5, "index", None, Response(403, {}, b"")),
    ]
    got = collect_captured(spark.createDataFrame(rows, "page_id long, kind string, duid string, url string, status_code int, headers map<string,string>, body binary, error string"))
    assert sorted(r["duid"] for r in got.records.collect()) == ["1", "2"]
    assert [r["duid"] for r in got.details.collect()] == ["7"] and [r["duid"] for r in got.gone.collect()] == ["8"]
    assert {r["page_id"]: r["reason"] for r in got.blocked.collect()} == {2: "markup", 5: "forbidden"}


# Reading


@pytest.fixture
def served(spark, store):
    rows = [("1001", "general", 1), ("1002", "academic", 2), ("1003", "general", 3)]
    own = spark.createDataFrame([(d, f"Title {d}", c, "일반" if c == "general" else "학사", T0.date().replace(day=k), T0.date(), "Desk", "u", False, f"body {d}", k) for d, c, k in rows], "duid string, title string, category_id string, category_name string, posted_date date, updated_date date, department string, source_url string, attachments_present boolean, body string, seq long")
    store.save_details(own, T0)
    store.start_run("r", T0)
    store.finish_run("r", "success", T0)
    return NoticeService(spark, store.root, clock=lambda: T0 + timedelta(hours=1)), store


def test_search_and_latest(served):
    service, _ = served
    got = service.search_notices("", published_from="2024-03-01", published_to="2024-03-02")
    assert sorted(i["duid"] for i in got.items) == ["1001", "1002"] and got.error is None and got.next_offset is None
    one = service.search_notices("body 1003").items
    assert [i["duid"] for i in one] == ["1003"] and one[0]["freshness"] == "fresh" and one[0]["collected_at"] == "2024-03-04T09:00:00+00:00"
    assert set(one[0]) == {"duid", "title", "category_id", "category", "posted_date", "updated_date", "department", "source_url", "attachments_present", "collected_at", "freshness"}
    latest = service.list_latest_notices(limit=2)
    assert [i["duid"] for i in latest.items] == ["1003", "1002"] and (latest.has_more, latest.next_offset) == (True, 2)
    assert [i["duid"] for i in service.list_latest_notices("학사").items] == ["1002"]
    assert "query" not in as_json(latest) and as_json(got)["query"] == ""
    assert service.search_notices('" OR 1=1 --').items == []


def test_notice_and_categories(spark, served):
    service, store = served
    assert service.get_notice("1001").body == "body 1001" and service.get_notice("9").error.code == "not_found"
    assert as_json(service.get_notice("1001"))["notice"]["summary"]["title"] == "Title 1001"
    counts = service.list_categories()
    assert [c["count"] for c in counts.categories] == [2, 1, *[0] * 9] and counts.error is None
    store.mark_gone(spark.createDataFrame([("1001",)], "duid string"), T0)
    store.start_run("s", T0 + timedelta(hours=1))
    store.finish_run("s", "blocked", T0 + timedelta(hours=1))
    assert service.get_notice("1001").error.code == "tombstoned" and service.get_notice("9").error.code == "blocked"
    for answer in (service.get_notice("1002"), service.list_categories(), service.list_latest_notices(), service.search_notices("x")):
        assert answer.error.code == "blocked" and answer.error.retryable


@pytest.mark.parametrize(
    "arguments, name",
    [
        ({"query": "x" * 201, "limit": 0}, "query"), ({"query": 5}, "query"), ({"limit": 0}, "limit"), ({"limit": 51, "category": "zz"}, "limit"), ({"limit": True}, "limit"), ({"offset": 501}, "offset"), ({"category": " general"}, "category"), ({"category": "zz", "published_from": "x"}, "category"),
        ({"published_from": "2024-1-1"}, "published_from"), ({"published_to": "2024-02-30"}, "published_to"), ({"published_from": "2024-03-02", "published_to": "2024-03-01"}, "published_from"),
    ],
)
def test_invalid_arguments(spark, arguments, name):
    got = NoticeService(spark, "/nowhere/at/all").search_notices(**arguments)
    assert got.error.code == "invalid_input" and got.error.message.startswith(f"{name}:") and got.items == []


@pytest.mark.parametrize("total, limit, offset, shown, want", [(561, 50, 450, 50, 500), (561, 50, 500, 50, None), (561, 1, 499, 1, 500), (561, 1, 500, 1, None), (0, 10, 0, 0, None), (25, 10, 10, 10, 20), (20, 10, 10, 10, None)])
def test_next_page(total, limit, offset, shown, want):
    assert next_start(total, limit, offset, shown) == want


def test_a_missing_store_is_unavailable(spark, tmp_path):
    service = NoticeService(spark, f"{tmp_path}/none")
    for answer in (service.search_notices("x"), service.get_notice("1"), service.list_latest_notices(), service.list_categories(), service.search_notices("a\x00b")):
        assert answer.error.code == "storage_unavailable"
    assert service.get_notice("12345678901234").error.code == service.get_notice("x").error.code == "invalid_input"
    assert not (tmp_path / "none").exists()


# Command line


def test_commands(spark, tmp_path, capsys, monkeypatch):
    at = ["--store", f"{tmp_path}/db"]
    assert cli.main(["init-db", *at], spark) == 0 and "initialized" in capsys.readouterr().out
    wire = Wire(page(("1", "One", "2024-03-02")))
    assert cli.main(["crawl", "--metadata-only", *at], spark, wire, sleep=lambda s: None) == 0
    out = capsys.readouterr()
    assert out.out == "" and json.loads(out.err.strip().splitlines()[-1])["status"] == "success"
    assert cli.main(["status", *at], spark) == 0
    line = capsys.readouterr().out
    assert "notices=1" in line and "freshness=fresh:1,stale:0,expired:0" in line and "crawl=success" in line
    assert cli.main(["crawl", *at], spark, Wire(Response(403, {}, b"")), sleep=lambda s: None) == 10
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["block_reason"] == "forbidden"
    open_store(spark, f"{tmp_path}/db").start_run("held", datetime.now(UTC))
    assert cli.main(["crawl", *at], spark, Wire(), sleep=lambda s: None) == 11
    assert cli.main(["crawl", "--max-pages", "99", *at], spark) == 12
    (tmp_path / "file").write_text("x")
    assert cli.main(["status", "--store", f"{tmp_path}/file"], spark) == 12
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": given}} for name, given in (("list_categories", {}), ("get_notice", {"duid": "1"}))]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(map(json.dumps, asked))))
    assert cli.main(["serve", *at], spark) == 0
    answers = [json.loads(x)["result"]["structuredContent"] for x in capsys.readouterr().out.splitlines()]
    assert len(answers[0]["categories"]) == 11 and answers[1]["notice"]["summary"]["title"] == "One"


def test_settings(tmp_path):
    got = load_settings({"max_pages": "3"}, {"TIDEMARK_MAX_PAGES": "9", "TIDEMARK_LOG_LEVEL": "DEBUG", "tidemark_store": f"{tmp_path}/x"})
    assert (got.max_pages, got.log_level, got.store) == (3, "DEBUG", f"{tmp_path}/x") and got.run_config().mode == METADATA_ONLY
    (tmp_path / "link").symlink_to(tmp_path)
    for name, bad in (("log_level", "LOUD"), ("user_agent", "short"), ("user_agent", "with\ttab in it"), ("max_pages", 0), ("max_pages", "zzz"), ("max_detail_requests", 101), ("max_duration_seconds", 0.5), ("store", ".."), ("store", f"{tmp_path}/link")):
        with pytest.raises(BadConfiguration) as caught:
            load_settings({name: bad}, {})
        assert caught.value.parameter.startswith(name) and str(bad) not in str(caught.value)


# Streaming


def test_stream_merges_batch_by_batch(spark, store, tmp_path):
    from tidemark.operators.schema import SUMMARY
    from tidemark.streaming.ingest import merge_stream

    source = f"{tmp_path}/in"
    for k, title in enumerate(("a", "b", "b")):
        row = spark.createDataFrame([("1", title, "general", "일반", T0.date(), T0.date(), "Desk", "u", False, False)], SUMMARY).withColumn("seq", F.lit(k).cast("long"))
        row.write.mode("append").parquet(source)
        stream = spark.readStream.schema(row.schema).parquet(source)
        query = merge_stream(stream, store, f"{tmp_path}/cp", clock=lambda: T0)
        query.awaitTermination(120)
    assert store.get("1")["title"] == "b" and store.revision_count("1") == 1
    assert open_read_only(spark, store.root).notices().count() == 1
