import hashlib
from datetime import date

import pytest

from tidemark.functions.urls import BoardSite
from tidemark.sources.html import detail_pages, list_issues, list_page_rows, list_records, page_contents, parse_html
from tidemark.sources.robots import decide, judge_response, rule_matches

SITE = BoardSite()

PACKED = """
<!doctype html><body><div class="board-list-box"><ul>
<li class="top notice"><strong class="category">[ 등록/장학 ]</strong>
  <div><a href="?BoardMode=view&amp;DUID=501"><!-- hidden --> Grants &amp; loans <span class="ico-new">new</span> for <b>all</b> 2024<![CDATA[zz]]></a></div>
  <span class="ico-file"></span><p class="info">views 3 | 2024-03-02 | 2024.03.05 | Student Office | x</p></li>
<li><strong class="category">[일반]</strong><a href="/view?DUID=7&DUID=502#a">Plain</a><p class="info">v | 2024/03/01 | soon | Desk</p></li>
<li><strong class="category">[일반]</strong><a href="?DUID=502">Plain again</a><p class="info">v | 2024/03/01 | 2024/03/01 | Desk</p></li>
<li>no link here</li>
</ul></div></body>
"""
PLAIN = """
<section class="board-list-box pinned"><a class="title" href="?DUID=1">First <i>one</i></a><span class="kind">Notice</span><span class="category"> 학사 </span>
 <span class="posted-date">posted 2024-01-05</span><span class="updated-date">2024-01-06</span><em class="department">Call 010-1234-5678</em></section>
<section class="board-list-box"><a class="title" data-duid="22">Second</a><span data-category>병무</span><span class="reg-date">2024.02.01</span></section>
<section class="board-list-box"></section>
"""


def rows_of(spark, *pages):
    return list_page_rows(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_packed_rows(spark):
    rows = rows_of(spark, PACKED)
    assert list_issues(rows).count() == 0
    a, b = list_records(rows).orderBy("row_index").collect()
    assert (a["duid"], a["title"], a["category_id"], a["category_name"]) == ("501", "Grants & loans for 2024", "registration-scholarship", "등록/장학")
    assert (a["posted_date"], a["updated_date"], a["department"]) == (date(2024, 3, 2), date(2024, 3, 5), "Student Office")
    assert a["attachments_present"] and a["pinned"] and a["source_url"] == f"{SITE.origin}{SITE.path}?BoardMode=view&DUID=501"
    assert (b["duid"], b["title"], b["updated_date"], b["attachments_present"], b["pinned"]) == ("502", "Plain", date(2024, 3, 1), False, False)


def test_plain_boxes(spark):
    rows = rows_of(spark, PLAIN)
    a, b = list_records(rows).orderBy("row_index").collect()
    assert (a["duid"], a["title"], a["category_id"], a["department"], a["pinned"]) == ("1", "First one", "academic", "Call [REDACTED_PHONE]", True)
    assert (b["duid"], b["title"], b["category_id"], b["posted_date"], b["updated_date"], b["pinned"]) == ("22", "Second", "military", date(2024, 2, 1), date(2024, 2, 1), False)


def row(duid="?DUID=5", title="T", category="일반", posted="2024-01-05"):
    return f'<div class="board-list-box"><ul><li data-x><a href="{duid}">{title}</a><i class="category">{category}</i><i class="posted-date">{posted}</i></li></ul></div>'


@pytest.mark.parametrize(
    "page, code, place",
    [
        ("", "malformed_markup", "html"), (None, "malformed_markup", "html"), ("<p>x</p>", "malformed_markup", "list"), (row("?x=1"), "missing_duid", "list-row-0"), (row("?DUID=1x"), "malformed_duid", "list-row-0"),
        (row("?DUID=1234567890123"), "malformed_duid", "list-row-0"), (row(title=""), "missing_title", "list-row-0"), (row(category=""), "missing_category", "list-row-0"), (row(category="전체"), "unknown_category", "list-row-0"),
        (row(posted=""), "missing_date", "list-row-0-posted"), (row(posted="2024-1-5"), "malformed_date", "list-row-0-posted"), (row(posted="2024-02-30"), "malformed_date", "list-row-0-posted"), (row(posted="x"), "malformed_date", "list-row-0-posted"),
        (row("?x=1", title=""), "missing_duid", "list-row-0"), (row(title="", category=""), "missing_title", "list-row-0"), (row(category="", posted=""), "missing_category", "list-row-0"),
    ],
)
def test_issues(spark, page, code, place):
    rows = rows_of(spark, page)
    assert [(r["code"], r["location"]) for r in list_issues(rows).collect()] == [(code, place)]
    assert list_records(rows).count() == 0


def test_an_empty_box_is_no_issue_and_deep_pages_end(spark):
    deep = "<div>" * 30_000 + row()
    rows = rows_of(spark, '<div class="board-list-box"></div>', deep)
    assert list_issues(rows).count() == 0
    assert [r["page_id"] for r in list_records(rows).collect()] == [1]


DETAIL = """<html><body><nav>not this</nav><article><h1 class="title">A  title</h1><b class="category">외부</b><i class="posted-date">2024-01-05</i><i class="updated-date">?</i><i class="writer">Desk</i>
<div class="body"><p>Keep <b>this</b>.</p><a href="x">gone</a><div class="file">gone</div><script>gone</script><!-- gone --><p>Mail some.one@mail.example.org now</p></div></article></body></html>"""


def test_detail(spark):
    pages = [("12", DETAIL), ("13", DETAIL.replace('class="body"', 'class="other"')), ("x", DETAIL), ("", DETAIL), (None, DETAIL), ("14", ""), ("15", "<p>x</p>"), ("16", DETAIL.replace("2024-01-05", "")), ("17", DETAIL.replace("외부", "없음"))]
    got = {r["raw_duid"]: r for r in detail_pages(spark.createDataFrame(pages, "duid string, html string")).collect()}
    a = got["12"]
    assert a["issue"] is None and (a["title"], a["category_id"], a["updated_date"], a["department"], a["attachments_present"], a["pinned"]) == ("A title", "external", date(2024, 1, 5), "Desk", True, False)
    assert a["body"] == "Keep this . Mail [REDACTED_EMAIL] now"
    assert got["13"]["body"] == "" and got["13"]["attachments_present"] is False
    issues = {k: tuple(r["issue"]) for k, r in got.items() if r["issue"]}
    assert issues == {
        "x": ("malformed_duid", "detail"), "": ("missing_duid", "detail"), None: ("missing_duid", "detail"), "14": ("malformed_markup", "html"), "15": ("malformed_markup", "detail"), "16": ("missing_date", "detail-posted"), "17": ("unknown_category", "detail"),
    }


def test_tree_and_page_contents(spark):
    top = parse_html("<p>a<br>b</p></div><ul><li>x<li>y</ul>z<img src=q/>")
    assert top.text() == "a b x y z"
    assert [e.name for e in top.walk()] == ["p", "br", "ul", "li", "li", "img"]
    pages = spark.createDataFrame([(1, "<title>T &amp; u</title><a href='x'>l</a><p>m</p><style>n</style>"), (2, None)], "page_id long, html string")
    a, b = page_contents(pages).orderBy("page_id").collect()
    assert (a["title"], a["links"], b["title"], b["links"], b["text"]) == ("T & u", ["x"], None, [], "")


# Robots

PATH = SITE.path


@pytest.mark.parametrize(
    "text, allowed, reason",
    [
        ("User-agent: *\nDisallow:", True, None), ("User-agent: *\nDisallow: /", False, "robots_disallowed"), ("User-agent: *\nDisallow: /ko/\nAllow: /ko/life/", True, None), ("User-agent: *\nDisallow: /ko/life/\nAllow: /ko/", False, "robots_disallowed"),
        ("User-agent: *\nDisallow: /ko/\nAllow: /ko/", True, None), ("User-agent: *\nDisallow: *.jsp$", False, "robots_disallowed"), ("User-agent: *\nDisallow: /ko$", True, None), ("User-agent: bot\nDisallow: /\n\nUser-agent: *\nAllow: /", True, None),
        ("User-agent: *\nAllow: /\nUser-agent: bot\nDisallow: /", True, None), ("Disallow: /", False, "robots_malformed"), ("User-agent: *\nnonsense", False, "robots_malformed"), ("User-agent: *\nFoo: x", False, "robots_malformed"),
        ("User-agent: *\nCrawl-delay: x", False, "robots_malformed"), ("User-agent: *\nCrawl-delay: -1", False, "robots_malformed"), ("User-agent: *\nCrawl-delay: inf", False, "robots_malformed"), ("", False, "robots_malformed"), ("# c\nUser-agent: * # d\nSitemap: x\nHost: y", True, None),
    ],
)
def test_robots_text(text, allowed, reason):
    got = decide(text, PATH)
    assert (got.allowed, got.block_reason) == (allowed, reason)


def test_robots_responses():
    good = b"User-agent: *\nCrawl-delay: 7\nAllow: /"
    assert judge_response(200, "Text/Plain; charset=x", good).crawl_delay == 7
    for status, kind, body, reason in ((200, None, good, "robots_invalid_content_type"), (404, "text/plain", good, "robots_http_failure"), (503, "text/html", b"please solve the CAPTCHA", "robots_captcha"), (200, "text/plain", b"\xff", "robots_malformed")):
        got = judge_response(status, kind, body)
        assert (got.allowed, got.block_reason, got.crawl_delay, got.mode) == (False, reason, 2.0, None)
    assert rule_matches("/a*c", "/abbc/d") and not rule_matches("/a*c$", "/abbc/d") and rule_matches("/a.c", "/a.c") and not rule_matches("/a.c", "/abc")


def test_the_page_that_stands_for_a_missing_file(monkeypatch):
    from tidemark.sources import robots

    page = b"<html>\r\nno such page\r\n</html>"
    lines = page.replace(b"\r\n", b"\n")
    monkeypatch.setattr(robots, "MISSING_ROBOTS_BYTES", len(lines))
    monkeypatch.setattr(robots, "MISSING_ROBOTS_SHA256", hashlib.sha256(lines).hexdigest())
    got = robots.judge_response(200, "text/html", page)
    assert (got.allowed, got.block_reason, got.mode) == (False, "robots_missing", "metadata_only")
    assert robots.judge_response(200, "text/html", page + b" ").block_reason == "robots_invalid_content_type"


def test_of_repeated_attributes_the_last_counts():
    assert parse_html('<a href="x" href="?DUID=5" HREF="?DUID=7">t</a>').first("a").attrs == {"href": "?DUID=7"}
