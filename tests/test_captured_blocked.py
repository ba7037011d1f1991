from tests.test_collect import page
from tidemark.plans.registry import QUERIES
from tidemark.sources.html import parse_html
from tidemark.sources.robots import has_challenge
from tidemark.sources.wire import MAX_BODY

BOARD = page(("1", "One", "2024-03-01"), ("2", "Two", "2024-03-01")).body
PAGES = [
    (0, BOARD, None), (1, b"<p>no board</p>", "markup"), (2, page(("x", "Bad key", "2024-03-01")).body, "markup"), (3, BOARD + b"<p>Access Denied</p>", "captcha"), (4, BOARD + b" " * 4096 + b"captcha", None),
    (5, BOARD + b"\xff\xfe", "markup"), (6, BOARD + b" " * MAX_BODY, "oversized"), (7, b"", "markup"), (8, None, "markup"), (9, b"behind a WAF.", "captcha"), (10, BOARD + b" " * (MAX_BODY - len(BOARD)), None),
]


def blocked(spark, path):
    return sorted(tuple(r) for r in QUERIES["captured_blocked"](spark, path).select("page_id", "reason").collect())


def test_reasons_come_from_each_page(spark, tmp_path):
    spark.createDataFrame([(k, f"https://h{k}.example.org/", body) for k, body, _ in PAGES], "page_id long, url string, html binary").write.parquet(f"{tmp_path}/pages.parquet")
    assert blocked(spark, str(tmp_path)) == [(k, why) for k, _, why in PAGES if why]


def test_reasons_of_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    # Every third page has a board in it.
    why = {k: None if k % 3 == 0 else "oversized" if len(html.encode()) > MAX_BODY else "captcha" if has_challenge(html.encode()) else "markup" if parse_html(html).first(".board-list-box") is None else None for k, html in pages}
    assert blocked(spark, sf_dir) == sorted((k, r) for k, r in why.items() if r)
