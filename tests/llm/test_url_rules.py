import random

from tidemark.llm.registry import URL_RULES
from tidemark.llm.url_rules import Rule, judge_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([len(rest), *(rest.index(c) for c in "?#" if c in rest)])]
    fits = [r for r in rules if (r.host == "" or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.verdict == "block", r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://x.net/a", "http://xnet/a", "https://a.b.example.net/en/x?y#z", "https://example.net/en", "http://EXAMPLE.com/de/",
    "http://m.example.com/de/1", "http://example.com/dex", "ftp://q.org/fr/1", "http://org/fr/", "http://org?fr=/fr/", "http://a.org#/fr/", "x://y://z/fr/", "http://example.net./en/", "http://.net/", "http://net:80/",
    "http://é.net/é", "http://a..net/x", "http://x\nnet/a", "http://a.net/" + "p" * 300_000, "http://" + "h" * 300_000 + ".net/x",
    "http://example\x01x.net/en/a", "http://example.\x01net/", "http://net\x01/", "http://a\x02.net/", "http://a\x00.net/x", "http://\x03.net/", "http://net.\x00/", "http://\x01.org/fr/", "http://x.example\x02.net/en/",
]


def check(spark, urls, rules, parts):
    df = spark.createDataFrame([(i, u, "k", 3) for i, u in enumerate(urls)], "page_id long, url string, key string, part int").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules, parts=parts).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_contract_rules_equal_brute_force(spark):
    check(spark, URLS, URL_RULES, 4)


def test_hosts_of_any_character(spark):
    rng = random.Random(5)
    host = lambda n: "".join(rng.choice("\x00\x01\x02\x03\x04ab..") for _ in range(n))
    rules = list({h: Rule(h, "", rng.choice(("allow", "block"))) for h in (host(rng.randrange(1, 4)) for _ in range(60))}.values())
    check(spark, [f"x://{host(rng.randrange(1, 7))}/" for _ in range(400)], rules, 5)


def test_many_nested_rules_and_a_hot_host(spark):
    rng = random.Random(9)
    labels = ["a", "b", "c", "com", "net", "a-b", "ab"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(0, 3)))
    rules = list({(h, p): Rule(h, p, rng.choice(("allow", "block"))) for h, p in ((host(), rng.choice(("", "/", path()))) for _ in range(150))}.values()) + [Rule("", "/z", "block")]
    urls = [f"http://{host()}{path()}" for _ in range(500)] + [f"http://hot.com{path()}" for _ in range(500)]
    check(spark, urls, rules, 7)


def test_null_ids_repeated_rows_empty_tables(spark):
    df = spark.createDataFrame([(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert sorted((r["page_id"] or 0, r["rule"]) for r in judge_urls(df, URL_RULES).collect()) == [(0, "net/"), (1, "net/"), (1, "net/")]
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in judge_urls(df, none, default="block").collect()} == {"block"}
