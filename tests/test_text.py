import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text

NUM = "010" + "-1234-" + "5678"
MAIL = "some.one" + "@" + "mail.example.org"


def plain_redact(value):
    """The same masks with re, in the same order; pattern syntax differs in three places."""
    for pattern, mask in (
        (text.LABELLED, r"\g<label>\g<separator>[REDACTED_IDENTIFIER]"),
        (text.RESIDENT, "[REDACTED_RESIDENT_ID]"),
        (text.EMAIL, "[REDACTED_EMAIL]"),
        (text.MOBILE, "[REDACTED_PHONE]"),
        (text.LANDLINE, "[REDACTED_PHONE]"),
        (text.SERVICE, "[REDACTED_PHONE]"),
        (text.INTERNATIONAL, "[REDACTED_PHONE]"),
    ):
        value = re.sub(pattern.removeprefix("(?U)").replace("(?<l", "(?P<l").replace("(?<s", "(?P<s").replace("(?<v", "(?P<v").replace(r"\x{FF1A}", "："), mask, value)

    def account(m):
        before = m.string[max(0, m.start() - 8) : m.start()]
        return m[0] if "공지" in before or "notice" in before.lower() else "[REDACTED_ACCOUNT]"

    return re.sub(r"(?<![\d-])\d{10,14}(?![\d-])", account, value)


CASES = [
    "", "plain words 2024-03-01 and 12,000 won", MAIL, f"({MAIL})", MAIL + ".", MAIL + ",", "가" + MAIL, f"tel {NUM} end", NUM.replace("-", ""), "02-123-4567", "(031) 123-4567", "1588-1234", "070-1234-5678", "+82 10 1234 5678",
    "900101" + "-" + "1234567", "학번: 2024123456", "사번 A-1234 x", "계좌 번호= 110-222-333333", "주민등록번호：900101", "notice 12345678901", "NOTICE no 1234567890", "공지 1234567890123", "공지사항 번호 12345678901", "run 12345678901 run", "123456789", "123456789012345", "٠١٠-١٢٣٤-٥٦٧٨", "a b\x1cc \n d",
]


def columns(spark, values, *made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[m(F.col("v")).alias(f"c{k}") for k, m in enumerate(made)]).orderBy("i").collect()]


def test_redaction_equals_re(spark):
    rng = random.Random(1)
    parts = [*CASES, " ", "-", ".", "notice", "공지", "@", "x"]
    values = CASES + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    for value, (got,) in zip(values, columns(spark, values, text.redact_text), strict=True):
        assert got == plain_redact(value), repr(value)


def test_redaction_of_the_documents_equals_re(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.redact_text(F.col("text")).alias("got"), text.clean_body(F.col("text")).alias("body")).collect()
    for r in docs:
        want = plain_redact(r["text"])
        assert r["got"] == want and r["body"] == " ".join(want.split())[:4000]


@pytest.mark.parametrize("value, want", [(MAIL + ".", MAIL + "."), (MAIL + ",", "[REDACTED_EMAIL],")])
def test_an_address_before_a_full_stop_stays_by_default(spark, value, want):
    ((plain, strict),) = columns(spark, [value], text.redact_text, lambda c: text.redact_text(c, strict_email=True))
    assert plain == want and strict.startswith("[REDACTED_EMAIL]")


def test_caps_and_white_space(spark):
    values = ["a b\x1cc \n d ", "x" * 5000, "é " * 600]
    got = columns(spark, values, text.clean_title, text.clean_category, text.clean_department, text.clean_body)
    for value, cells in zip(values, got, strict=True):
        assert cells == tuple(" ".join(value.split())[:cap] for cap in (500, 64, 200, 4000))


def test_hash_counts_a_null_body_as_empty_and_tells_fields_apart(spark):
    df = spark.sql("SELECT '1' d, 'general' c, '일반' n, 't' t, date'2024-01-01' p, date'2024-01-02' u, 'o' o, 'u' s, cast(null as string) b, true a")
    own = [F.col(x) for x in "dcntpuosba"]
    base = text.content_hash(*own)
    empty = text.content_hash(*own[:8], F.lit(""), own[9])
    other = text.content_hash(*own[:9], ~own[9])
    moved = text.content_hash(*own[:3], F.lit(""), *own[4:8], own[3], own[9])
    row = df.select(base.alias("a"), empty.alias("b"), other.alias("c"), moved.alias("d")).first()
    import hashlib

    want = hashlib.sha256("\x1f".join(["1", "general", "일반", "t", "2024-01-01", "2024-01-02", "o", "u", "", "True"]).encode()).hexdigest()
    assert row["a"] == row["b"] == want and len({*row}) == 3
