"""Text and privacy functions as Column expressions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTION_VERSION = "v1"

# The character caps of the human-written fields.
TITLE_CAP, CATEGORY_CAP, DEPARTMENT_CAP, BODY_CAP = 500, 64, 200, 4000

# Patterns of what is masked, in the order in which they apply. (?U) gives \w, \d and \s their Unicode meaning.
# Look-aheads in front are for speed alone: most positions fail there before anything is looked at behind them.
LABELLED = r"(?U)(?<label>학번|사번|계좌|주민등록번호)(?<separator>\s*(?:번호\s*)?[:\x{FF1A}=#-]?\s*)(?<value>[A-Za-z0-9][A-Za-z0-9 -]{2,19})"
RESIDENT = r"(?U)(?=\d{6})(?<!\d)\d{6}[- ]\d{7}(?!\d)"
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])"
MOBILE = r"(?U)(?=01)(?<!\d)01[016789][- ]?\d{3,4}[- ]?\d{4}(?!\d)"
LANDLINE = r"(?U)(?=[(0])(?<!\d)\(?(?:02|031|032|033|041|042|043|044|051|052|053|054|055|061|062|063|064)\)?[- ]?\d{3,4}[- ]?\d{4}(?!\d)"
SERVICE = r"(?U)(?=[01])(?<!\d)(?:1[568]\d{2}[- ]\d{4}|0(?:50|60|70|80)[- ]?\d{3,4}[- ]\d{4})(?!\d)"
INTERNATIONAL = r"(?U)(?=\+)(?<!\d)\+\d{1,3}[ -]?\d{1,4}(?:[ -]?\d{3,4}){2}(?!\d)"
#: A run of digits stays if 공지 or notice (in any case) is within the eight characters before it.
ACCOUNT = r"(?U)(?=\d{10})(?<![\d-])(?<!공지[\s\S]{0,6})(?<!(?-U:(?i:notice))[\s\S]{0,2})\d{10,14}(?![\d-])"

_MASKS = (
    (LABELLED, "${label}${separator}[REDACTED_IDENTIFIER]"),
    (RESIDENT, "[REDACTED_RESIDENT_ID]"),
    (EMAIL, "[REDACTED_EMAIL]"),
    (MOBILE, "[REDACTED_PHONE]"),
    (LANDLINE, "[REDACTED_PHONE]"),
    (SERVICE, "[REDACTED_PHONE]"),
    (INTERNATIONAL, "[REDACTED_PHONE]"),
    (ACCOUNT, "[REDACTED_ACCOUNT]"),
)
#: A text without four digits in a row and without any of these holds nothing that a pattern masks.
DIGITS, MARKS = r"(?U)\d{4}", ("@", "+", "학번", "사번", "계좌", "주민등록번호")
#: As EMAIL, but an address before a full stop or a hyphen is masked too. Opt-in: see redact_text.
EMAIL_STRICT = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"


def normalize_text(value: Column, cap: int) -> Column:
    """Runs of Unicode white space become one space, ends are trimmed, and at most cap characters stay."""
    return F.substring(F.trim(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " ")), 1, cap)


def redact_text(value: Column, strict_email: bool = False) -> Column:
    """Masks identifiers, e-mail addresses, phone numbers and account runs, in a fixed order."""
    masked = value
    for pattern, mask in _MASKS:
        masked = F.regexp_replace(masked, EMAIL_STRICT if strict_email and pattern is EMAIL else pattern, mask)
    suspect = reduce(Column.__or__, (value.contains(mark) for mark in MARKS), value.rlike(DIGITS))
    return F.when(~suspect, value.cast("string")).otherwise(masked)


def redact_and_cap(value: Column, cap: int) -> Column:
    return normalize_text(redact_text(value), cap)


def clean_title(value: Column) -> Column:
    return redact_and_cap(value, TITLE_CAP)


def clean_category(value: Column) -> Column:
    return redact_and_cap(value, CATEGORY_CAP)


def clean_department(value: Column) -> Column:
    return redact_and_cap(value, DEPARTMENT_CAP)


def clean_body(value: Column) -> Column:
    return redact_and_cap(value, BODY_CAP)


def content_hash(duid: Column, category_id: Column, category_name: Column, title: Column, posted: Column, updated: Column, department: Column, url: Column, body: Column, attachments: Column) -> Column:
    """SHA-256 over ten fields joined by U+001F. Human-written fields are cleaned here, a null body counts as empty."""
    return hash_of_clean(duid, category_id, clean_category(category_name), clean_title(title), posted, updated, clean_department(department), url, clean_body(F.coalesce(body, F.lit(""))), attachments)


def hash_of_clean(duid: Column, category_id: Column, category_name: Column, title: Column, posted: Column, updated: Column, department: Column, url: Column, body: Column, attachments: Column) -> Column:
    """content_hash of fields that are clean already."""
    days = (F.date_format(day, "yyyy-MM-dd") for day in (posted, updated))
    fields = (duid, category_id, category_name, title, *days, department, url, body, F.when(attachments, F.lit("True")).otherwise(F.lit("False")))
    # concat_ws would leave nulls out and so move the fields behind them.
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)
