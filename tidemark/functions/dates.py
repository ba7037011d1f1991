"""Dates, instants and freshness as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BODY_TTL_DAYS = 30
FRESH_HOURS, STALE_DAYS = 24, 7
FRESHNESS = ("fresh", "stale", "expired")

_DATE = r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}"


def source_date(value: Column) -> Column:
    """The first date in a text, if it is strict yyyy-MM-dd after its separators are made hyphens; else null."""
    found = F.translate(F.regexp_extract(value, _DATE, 0), "./", "--")
    # A cast would take 2026-7-1 too.
    return F.when(found.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(found, "yyyy-MM-dd"))


def date_issue(value: Column) -> Column:
    """missing_date for an empty or null text, malformed_date for one without a valid date, else null."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "missing_date").when(source_date(value).isNull(), "malformed_date")


def body_expiry(collected_at: Column) -> Column:
    return collected_at + F.expr(f"INTERVAL {BODY_TTL_DAYS} DAYS")


def freshness(collected_at: Column, latest_success: Column, now: Column) -> Column:
    """expired without any successful run; else by age, bounds included; an age below zero is fresh."""
    age = now.cast("double") - collected_at.cast("double")
    return (
        F.when(collected_at.isNull() | latest_success.isNull(), "expired")
        .when(age <= FRESH_HOURS * 3600, "fresh")
        .when(age <= STALE_DAYS * 86400, "stale")
        .otherwise("expired")
    )


def stored_instant(value: Column) -> Column:
    """ISO text with microseconds and +00:00 (session time zone UTC)."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def shown_instant(value: Column) -> Column:
    """As stored_instant, without a fraction of zero."""
    return F.regexp_replace(stored_instant(value), r"\.000000\+", "+")
