"""Queries of the notice engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import feed, merge, search
from tidemark.operators import runs as ledger
from tidemark.operators.schema import CATEGORIES, NOTICES
from tidemark.plans import views
from tidemark.plans.collect import collect_captured
from tidemark.plans.views import NOW, table
from tidemark.sources import html, robots, wire
from tidemark.streaming.ingest import arrivals_by_window

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SITE = urls.BoardSite()
_DETAIL = f"{_SITE.origin}{_SITE.path}?{urls.DETAIL_QUERY}"
_LIST = f"{_SITE.origin}{_SITE.path}?{urls.LIST_QUERY}"
_LATER = NOW + timedelta(days=2)

# Parts of the SQL side: the views of tidemark.plans.views.
_IDS = ", ".join(f"'{key}'" for _, key in CATEGORIES)
_NAMES = ", ".join(f"'{name}'" for name, _ in CATEGORIES)
_NOTICES = f"""
notices AS (
  SELECT CAST(doc_id AS VARCHAR) AS duid, doc_id, ([{_IDS}])[CAST(doc_id % 11 AS INT) + 1] AS category_id,
         ([{_NAMES}])[CAST(doc_id % 11 AS INT) + 1] AS category_name, substr(text, 1, 60) AS title,
         DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS posted_date,
         DATE '2024-01-01' + CAST(doc_id % 60 + doc_id % 3 AS INT) AS updated_date,
         coalesce(source, '') AS department, '{_DETAIL}' || doc_id AS source_url, text AS body,
         TIMESTAMP '2024-03-01' - to_hours(CAST(doc_id % 240 AS INT)) AS collected_at,
         TIMESTAMP '2024-03-01' - to_hours(CAST(doc_id % 240 AS INT)) + INTERVAL 5 DAY AS body_expires_at,
         doc_id % 5 = 0 AS attachments_present, doc_id % 17 = 0 AS gone,
         CASE WHEN doc_id % 17 = 0 THEN 'tombstoned' ELSE 'active' END AS source_status
  FROM documents WHERE doc_id IS NOT NULL)"""
_RUNS = """
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id,
         CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'running'
                         WHEN 'click' THEN 'interrupted' WHEN 'signup' THEN 'failed' END AS status,
         CAST(event_id % 50 AS INT) AS checkpoint_page, CAST(event_id % 7 AS INT) AS detail_requests,
         ts + to_minutes(CAST(event_id % 30 AS INT)) AS updated_at FROM events)"""
_SHOWN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def _instant(column, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


_PAGE_COLUMNS = "duid, category_id, category_name, title, strftime(posted_date, '%Y-%m-%d') AS posted_date, strftime(updated_date, '%Y-%m-%d') AS updated_date, department, source_url, attachments_present"


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("duid", "category_id", "category_name", "title", _day("posted_date"), _day("updated_date"), "department", "source_url", "attachments_present")


# Pages and counts


@query(f"WITH {_NOTICES} SELECT {_PAGE_COLUMNS} FROM notices WHERE NOT gone ORDER BY posted_date DESC, duid DESC LIMIT 50")
def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(feed.latest_page(views.notices(spark, sf_dir), limit=50))


@query(f"WITH {_NOTICES} SELECT {_PAGE_COLUMNS} FROM notices WHERE NOT gone AND category_id = 'general' ORDER BY posted_date DESC, duid DESC LIMIT 20")
def latest_page_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(feed.latest_page(views.notices(spark, sf_dir), feed.Filters("general"), limit=20))


@query(f"WITH {_NOTICES} SELECT {_PAGE_COLUMNS} FROM notices WHERE NOT gone ORDER BY posted_date DESC, duid DESC LIMIT 25 OFFSET 75")
def latest_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(feed.latest_page(views.notices(spark, sf_dir), limit=25, offset=75))


@query(
    f"WITH {_NOTICES} SELECT {_PAGE_COLUMNS} FROM notices WHERE NOT gone AND category_id = 'academic' AND updated_date BETWEEN DATE '2024-01-10' AND DATE '2024-02-20'"
    " AND posted_date BETWEEN DATE '2024-01-12' AND DATE '2024-02-18' ORDER BY updated_date DESC, duid DESC LIMIT 50"
)
def search_blank_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = feed.Filters("academic", date(2024, 1, 10), date(2024, 2, 20), date(2024, 1, 12), date(2024, 2, 18))
    return _page(search.search_page(views.notices(spark, sf_dir), "  ", filters, limit=50))


@query(f"WITH {_NOTICES} SELECT {_PAGE_COLUMNS} FROM notices WHERE duid = '42'")
def notice_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(feed.by_key(views.notices(spark, sf_dir), "42"))


@query(f"WITH {_NOTICES}, names AS (SELECT unnest([{_IDS}]) AS category_id, unnest([{_NAMES}]) AS category, unnest(range(11)) AS ord) SELECT CAST(ord AS INT) AS ord, n.category_id, category, count(doc_id) FILTER (WHERE NOT gone) AS n FROM names n LEFT JOIN notices x ON x.category_id = n.category_id GROUP BY ALL")
def category_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.all_categories(views.notices(spark, sf_dir))


@query(f"WITH {_NOTICES} SELECT count(*) AS n FROM notices WHERE NOT gone")
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.active_count(views.notices(spark, sf_dir))


@query(f"WITH {_NOTICES} SELECT count(*) AS n FROM notices WHERE NOT gone AND category_id = 'student' AND posted_date BETWEEN DATE '2024-01-05' AND DATE '2024-02-05'")
def active_count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.active_count(views.notices(spark, sf_dir), feed.Filters("student", posted_from=date(2024, 1, 5), posted_to=date(2024, 2, 5)))


_FRESH = "CASE WHEN s IS NULL THEN 'expired' WHEN age <= 86400 THEN 'fresh' WHEN age <= 604800 THEN 'stale' ELSE 'expired' END"
_AGED = f"{_NOTICES}, {_RUNS}, aged AS (SELECT *, epoch(TIMESTAMP '2024-03-01') - epoch(collected_at) AS age, (SELECT max(updated_at) FROM runs WHERE status = 'success') AS s FROM notices)"


@query(f"WITH {_AGED} SELECT duid, {_FRESH} AS freshness FROM aged")
def freshness_by_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.with_freshness(views.notices(spark, sf_dir), views.runs(spark, sf_dir), NOW).select("duid", "freshness")


@query(
    f"WITH {_AGED}, top AS (SELECT {_FRESH} AS freshness FROM aged WHERE NOT gone ORDER BY posted_date DESC, duid DESC LIMIT 50), names(ord, freshness) AS (VALUES (0, 'fresh'), (1, 'stale'), (2, 'expired'))"
    " SELECT CAST(n.ord AS INT) AS ord, n.freshness, count(t.freshness) AS n FROM names n LEFT JOIN top t ON t.freshness = n.freshness GROUP BY ALL"
)
def freshness_histogram_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.freshness_histogram(views.notices(spark, sf_dir), views.runs(spark, sf_dir), NOW)


@query()
def latest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response form of a page. Redaction has look-arounds, which the other side lacks; tests compare it with re."""
    page = feed.latest_page(views.notices(spark, sf_dir), limit=50)
    return feed.summary_view(feed.with_freshness(page, views.runs(spark, sf_dir), NOW))


# Runs


@query(f"WITH {_RUNS} SELECT run_id, status, checkpoint_page, {_SHOWN.format('updated_at')} AS updated_at FROM runs ORDER BY runs.updated_at DESC, run_id DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_run(views.runs(spark, sf_dir)).select("run_id", "status", "checkpoint_page", _instant("updated_at"))


@query(f"WITH {_RUNS} SELECT {_SHOWN.format('max(updated_at)')} AS latest_success FROM runs WHERE status = 'success'")
def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.latest_success(views.runs(spark, sf_dir)).select(_instant("latest_success"))


@query(f"WITH {_RUNS} SELECT checkpoint_page FROM runs WHERE status = 'interrupted' ORDER BY updated_at DESC, run_id DESC LIMIT 1")
def newest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.restart_checkpoint(views.runs(spark, sf_dir))


_MIDDLE = datetime(2024, 1, 15, tzinfo=UTC)


@query(f"WITH {_RUNS}, stale AS (SELECT *, status = 'running' AND updated_at < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE AS s FROM runs) SELECT run_id, CASE WHEN s THEN 'interrupted' ELSE status END AS status, checkpoint_page, {_SHOWN.format("CASE WHEN s THEN TIMESTAMP '2024-01-15' ELSE updated_at END")} AS updated_at FROM stale")
def stale_runs_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.interrupt_stale(views.runs(spark, sf_dir), _MIDDLE).select("run_id", "status", "checkpoint_page", _instant("updated_at"))


@query(f"WITH {_RUNS} SELECT run_id, checkpoint_page FROM runs WHERE status = 'running' AND updated_at < TIMESTAMP '2024-01-15' - INTERVAL 15 MINUTE")
def recovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recovered(ledger.interrupt_stale(views.runs(spark, sf_dir), _MIDDLE), _MIDDLE).select("run_id", "checkpoint_page")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS wire_requests, count(*) FILTER (WHERE event_id % 4 = 0) AS retries, count(*) FILTER (WHERE event_type = 'view' AND event_id % 4 <> 0) AS pages, count(*) FILTER (WHERE event_type = 'click' AND event_id % 4 <> 0) AS details FROM events GROUP BY user_id")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "index").when(F.col("event_type") == "click", "detail").otherwise("robots")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), kind.alias("kind"), (F.pmod("event_id", F.lit(4)) == 0).alias("retry"))
    return ledger.run_counters(log)


# Logs of writes

_LOG = "log AS (SELECT conv_id, turn, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS value_hash FROM conversations)"


@query(f"WITH {_LOG} SELECT conv_id, turn, value_hash FROM (SELECT *, lag(value_hash) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM log) WHERE b IS NOT NULL AND b <> value_hash")
def revisions_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.changes(views.change_log(spark, sf_dir), ["conv_id"], ["turn"], "value_hash")


@query(f"WITH {_LOG} SELECT conv_id, turn, value_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM log) WHERE k = 1")
def current_state_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_by_key(views.change_log(spark, sf_dir), ["conv_id"], ["turn"])


@query(f"WITH {_LOG} SELECT conv_id, turn, value_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM log) WHERE k = 1")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_by_key(views.change_log(spark, sf_dir), ["conv_id"], ["turn"])


@query(f"WITH {_LOG} SELECT CAST(conv_id AS VARCHAR) AS duid, count(*) AS n FROM (SELECT *, lag(value_hash) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM log) WHERE b <> value_hash GROUP BY conv_id")
def revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.revision_counts(merge.changes(views.change_log(spark, sf_dir), ["conv_id"], ["turn"], "value_hash").select(F.col("conv_id").cast("string").alias("duid")))


# Merges: all that they leave. SQL can't repeat the masking, so title, body and hash are compared where a text has nothing
# that could be masked (no digit and no @), and are null elsewhere; tests compare masked ones with plain Python.

_INCOMING = f"""{_NOTICES},
batch AS (SELECT duid, doc_id AS seq, true AS known FROM notices WHERE doc_id % 3 = 0
          UNION ALL SELECT CAST(doc_id + 900000000000 AS VARCHAR), doc_id + 900000000000, false FROM notices WHERE doc_id % 3 = 0),
merged AS (
  SELECT coalesce(b.duid, n.duid) AS duid, b.duid IS NOT NULL AS written, n.duid IS NOT NULL AS stored, n.gone, n.body IS NOT NULL AS had_body, n.body_expires_at, n.collected_at, n.source_status
  FROM notices n FULL JOIN batch b ON b.duid = n.duid),
filled AS (
  SELECT m.*, o.category_id, o.category_name, o.posted_date, o.updated_date, o.department, o.source_url, o.attachments_present, o.body,
         CASE WHEN written AND stored AND o.doc_id % 6 = 0 THEN 'New ' ELSE '' END || o.title AS title, NOT coalesce(regexp_matches(o.body, '[0-9@]'), false) AS plain
  FROM merged m JOIN notices o ON o.doc_id = CAST(m.duid AS BIGINT) % 900000000000)"""


def _clean(value: str, cap: int) -> str:
    return f"substr(trim(regexp_replace({value}, '\\s+', ' ', 'g')), 1, {cap})"


def _merged(gone: str, status: str, body: str, expiry: str) -> str:
    """body: what a written row holds, null if nothing."""
    given = f"CASE WHEN written THEN {body} ELSE body END"
    # A written body is cleaned before it is stored and once more for the hash; a stored one of the view for the hash only.
    hashed = ", ".join(
        f"coalesce({x}, '')"
        for x in (
            *("duid", "category_id", "category_name", _clean("title", text.TITLE_CAP), "strftime(posted_date, '%Y-%m-%d')", "strftime(updated_date, '%Y-%m-%d')", _clean("department", text.DEPARTMENT_CAP), "source_url"),
            f"CASE WHEN written THEN {_clean(body, text.BODY_CAP).replace('substr(', 'trim(substr(', 1)}) ELSE {_clean('body', text.BODY_CAP)} END",
            "CASE WHEN attachments_present THEN 'True' ELSE 'False' END",
        )
    )
    return (
        f"WITH {_INCOMING} SELECT duid, {gone} AS tombstoned, {status} AS source_status, ({given}) IS NOT NULL AS has_body, {_SHOWN.format(expiry)} AS body_expires_at,"
        f" {_SHOWN.format("CASE WHEN written THEN TIMESTAMP '2024-03-03' ELSE collected_at END")} AS collected_at, category_id, category_name,"
        " strftime(posted_date, '%Y-%m-%d') AS posted_date, strftime(updated_date, '%Y-%m-%d') AS updated_date, source_url, attachments_present,"
        f" CASE WHEN written THEN {_clean('department', text.DEPARTMENT_CAP)} ELSE department END AS department,"
        f" CASE WHEN plain AND written THEN {_clean('title', text.TITLE_CAP)} WHEN plain THEN title END AS title,"
        f" CASE WHEN plain AND written THEN sha256({_clean(body, text.BODY_CAP)}) WHEN plain THEN sha256(body) END AS body_sha256,"
        f" CASE WHEN plain THEN sha256(concat_ws(chr(31), {hashed})) END AS content_hash FROM filled"
    )


def _left(rows: DataFrame, *more) -> DataFrame:
    return rows.select("duid", F.col("tombstone_at").isNotNull().alias("tombstoned"), "source_status", F.col("body").isNotNull().alias("has_body"), _instant("body_expires_at"), _instant("collected_at"), *more)


def _merge(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = merge.merge_notices(views.hashed(views.notices(spark, sf_dir)), views.incoming(spark, sf_dir), _LATER, mode)[0]
    plain = views.notices(spark, sf_dir).select(F.col("duid").cast("long").alias("_id"), F.coalesce(~F.col("body").rlike("[0-9@]"), F.lit(True)).alias("_plain"))
    rows = rows.join(plain, F.pmod(F.col("duid").cast("long"), F.lit(900_000_000_000)) == F.col("_id"))
    shown = {"title": F.col("title"), "body_sha256": F.sha2("body", 256), "content_hash": F.col("content_hash")}
    return _left(rows, "category_id", "category_name", _day("posted_date"), _day("updated_date"), "source_url", "attachments_present", "department", *(F.when(F.col("_plain"), c).alias(k) for k, c in shown.items()))


@query(_merged(gone="coalesce(gone, false)", status="coalesce(source_status, 'active')", body="CAST(NULL AS VARCHAR)", expiry="CASE WHEN NOT written THEN body_expires_at END"))
def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, merge.METADATA)


@query(_merged(gone="coalesce(gone, false)", status="coalesce(source_status, 'active')", body="CASE WHEN stored THEN body END", expiry="CASE WHEN written AND had_body THEN TIMESTAMP '2024-04-02' ELSE body_expires_at END"))
def upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, merge.SUMMARY)


@query(_merged(gone="NOT written AND gone", status="CASE WHEN written THEN 'active' ELSE source_status END", body="coalesce(body, '')", expiry="CASE WHEN written THEN TIMESTAMP '2024-04-02' ELSE body_expires_at END"))
def upsert_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, merge.DETAIL)


@query(f"WITH {_NOTICES} SELECT row_number() OVER (ORDER BY doc_id) + 100 AS revision_id, duid, '2024-03-03 00:00:00' AS changed_at FROM notices WHERE doc_id % 3 = 0 AND doc_id % 6 = 0")
def upsert_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of details that keeps the bodies: only new titles give revisions. Stored fields are cleaned first, as a store's are."""
    stored = views.notices(spark, sf_dir).withColumns({"title": text.clean_title(F.col("title")), "body": text.clean_body(F.col("body"))})
    _, revisions = merge.merge_notices(views.hashed(stored), views.incoming(spark, sf_dir), _LATER, merge.DETAIL)
    return merge.numbered_revisions(revisions, 100).select("revision_id", "duid", _instant("changed_at"))


@query(f"WITH {_NOTICES} SELECT duid, gone OR doc_id % 7 = 0 AS tombstoned, CASE WHEN gone OR doc_id % 7 = 0 THEN 'tombstoned' ELSE 'active' END AS source_status, body IS NOT NULL AS has_body, {_SHOWN.format('body_expires_at')} AS body_expires_at, {_SHOWN.format('collected_at')} AS collected_at FROM notices")
def tombstone_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").where("pmod(doc_id, 7) = 0").select(F.explode(F.array(F.col("doc_id").cast("string"), F.concat(F.lit("unknown"), F.col("doc_id")))).alias("duid"))
    return _left(merge.apply_tombstones(views.notices(spark, sf_dir), ids, NOW))


@query(f"WITH {_NOTICES}, due AS (SELECT *, body IS NOT NULL AND body_expires_at <= TIMESTAMP '2024-03-01' AS d FROM notices) SELECT duid, gone AS tombstoned, source_status, body IS NOT NULL AND NOT d AS has_body, {_SHOWN.format('CASE WHEN NOT d THEN body_expires_at END')} AS body_expires_at, {_SHOWN.format('collected_at')} AS collected_at FROM due")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left(merge.sweep_bodies(views.notices(spark, sf_dir), NOW))


@query(f"WITH {_NOTICES} SELECT duid FROM notices WHERE body IS NOT NULL AND body_expires_at <= TIMESTAMP '2024-03-01'")
def ttl_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.expired_bodies(views.notices(spark, sf_dir), NOW)


@query(f"WITH {_NOTICES} SELECT duid FROM notices WHERE doc_id % 4 IN (1, 2) UNION ALL SELECT CAST(doc_id + 900000000000 AS VARCHAR) FROM notices")
def needs_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices as list rows, of which a quarter have another title and a quarter another day, and as many unknown keys."""
    return feed.needs_detail(views.listed(spark, sf_dir), views.notices(spark, sf_dir)).select("duid")


@query()
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hashed(views.notices(spark, sf_dir)).select("duid", "content_hash")


# Search

_FIELDS = ("title", "category_name", "department", "body")
_TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_WORDS = f"{_NOTICES}, words AS (SELECT *, [{', '.join(_TOKENS.format(c) for c in _FIELDS)}] AS w FROM notices WHERE NOT gone)"


def _tf(phrase: list[str]) -> str:
    whole = ", ".join(f"'{p}'" for p in phrase)
    return f"list_sum(list_transform(w, lambda c: len(list_filter(range(1, len(c) - {len(phrase)} + 2), lambda i: c[i:i + {len(phrase) - 1}] = [{whole}]))))"


@query(f"WITH {_WORDS} SELECT duid, CAST({_tf(['thing'])} AS BIGINT) AS tf FROM words WHERE {_tf(['thing'])} > 0")
def fts_match_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.block_index(spark, sf_dir).hits("Thing").select("duid", F.col("_tf")[0].cast("long").alias("tf"))


@query(f"WITH {_WORDS} SELECT duid, CAST({_tf(['of', 'the'])} AS BIGINT) AS tf FROM words WHERE {_tf(['of', 'the'])} > 0")
def fts_match_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.block_index(spark, sf_dir).hits("of-THE").select("duid", F.col("_tf")[0].cast("long").alias("tf"))


@query(f"WITH {_WORDS} SELECT count(*) AS n FROM words WHERE {_tf(['of', 'the'])} > 0 AND {_tf(['src1'])} > 0 AND posted_date >= DATE '2024-01-10'")
def fts_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.block_index(spark, sf_dir).count("of-the src1", feed.Filters(updated_from=date(2024, 2, 20), posted_from=date(2024, 1, 10)))


_BM25 = (
    "ln((n - df{0} + 0.5) / (df{0} + 0.5)) AS i{0}",
    "(CASE WHEN i{0} > 0 THEN i{0} ELSE 1e-6 END) * t{0} * 2.2 / (t{0} + 1.2 * (0.25 + 0.75 * size / mean))",
)


@query(
    f"WITH {_WORDS}, counted AS (SELECT duid, category_id, updated_date, CAST(list_sum(list_transform(w, lambda c: len(c))) AS DOUBLE) AS size, CAST({_tf(['thing'])} AS DOUBLE) AS t0, CAST({_tf(['of', 'the'])} AS DOUBLE) AS t1 FROM words),"
    f" corpus AS (SELECT *, {_BM25[0].format(0)}, {_BM25[0].format(1)} FROM (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE t0 > 0) AS df0, count(*) FILTER (WHERE t1 > 0) AS df1 FROM counted)),"
    f" scored AS (SELECT duid, updated_date, -({_BM25[1].format(0)} + {_BM25[1].format(1)}) AS score FROM counted, corpus WHERE t0 > 0 AND t1 > 0 AND category_id <> 'none')"
    " SELECT duid, round(score, 9) AS score FROM scored ORDER BY scored.score, updated_date DESC, duid DESC LIMIT 50"
)
def fts_bm25_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.block_index(spark, sf_dir).top("thing of-the", limit=50).select("duid", F.round("score", 9).alias("score"))


@query(
    f"WITH {_WORDS}, counted AS (SELECT duid, updated_date, CAST(list_sum(list_transform(w, lambda c: len(c))) AS DOUBLE) AS size, CAST({_tf(['thing'])} AS DOUBLE) AS t0 FROM words),"
    f" corpus AS (SELECT *, {_BM25[0].format(0)} FROM (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE t0 > 0) AS df0 FROM counted)),"
    f" scored AS (SELECT duid, updated_date, -({_BM25[1].format(0)}) AS score FROM counted, corpus WHERE t0 > 0)"
    " SELECT duid, round(score, 9) AS score FROM scored ORDER BY scored.score, updated_date DESC, duid DESC LIMIT 10"
)
def fts_top_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a single word: blocks that can't reach its tenth score aren't scored."""
    return views.block_index(spark, sf_dir).top("thing", limit=10).select("duid", F.round("score", 9).alias("score"))


@query(f"WITH {_WORDS} SELECT t AS term, count(*) AS n FROM (SELECT unnest(flatten(w)) AS t FROM words) GROUP BY t")
def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(views.notices(spark, sf_dir)).groupBy("term").agg(F.sum(F.size("positions")).alias("n"))


@query(f"WITH {_NOTICES} SELECT duid, title, category_name, department, coalesce(body, '') AS body FROM notices WHERE NOT gone")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_index(views.notices(spark, sf_dir))


# Scalar functions over made-up values

_DATES = "CASE doc_id % 6 WHEN 0 THEN '2024-02-29' WHEN 1 THEN 'posted 2024.03.01 late' WHEN 2 THEN '2024-7-1' WHEN 3 THEN '2023/02/29' WHEN 4 THEN '' ELSE 'soon' END"


@query(f"WITH raw AS (SELECT doc_id, {_DATES} AS v FROM documents), found AS (SELECT doc_id, v, replace(replace(regexp_extract(v, '[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}'), '.', '-'), '/', '-') AS d FROM raw), parsed AS (SELECT doc_id, v, CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(d AS DATE) END AS p FROM found) SELECT doc_id, strftime(p, '%Y-%m-%d') AS parsed, CASE WHEN v = '' THEN 'missing_date' WHEN p IS NULL THEN 'malformed_date' END AS issue FROM parsed")
def strict_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DATES.replace("doc_id % 6", "pmod(doc_id, 6)")).alias("v"))
    return own.select("doc_id", F.date_format(dates.source_date(F.col("v")), "yyyy-MM-dd").alias("parsed"), dates.date_issue(F.col("v")).alias("issue"))


@query(f"SELECT doc_id, '{_DETAIL}' || doc_id AS detail_url, CASE WHEN doc_id >= 1 THEN '{_LIST}' || doc_id END AS list_url FROM documents")
def url_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", urls.detail_url(F.col("doc_id").cast("string")).alias("detail_url"), urls.list_url(F.col("doc_id")).alias("list_url"))


# Addresses of the given pages, as they are and put onto the board's host, path and queries.
_ON_BOARD = f"""CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '{_DETAIL}' || page_id WHEN 2 THEN '{_LIST}' || page_id % 3 WHEN 3 THEN '{_SITE.origin}' || path WHEN 4 THEN '{_DETAIL}' || page_id || '#' || host
  WHEN 5 THEN 'https://' || host || '@{_SITE.host}{_SITE.path}?{urls.DETAIL_QUERY}' || page_id WHEN 6 THEN 'https://{_SITE.host}:' || (443 + page_id % 2) || '{_SITE.path}?{urls.DETAIL_QUERY}' || page_id ELSE '{_SITE.origin}{_SITE.path}' || path END"""
_SPLIT = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path"
_ADDRESSED = f"addressed AS (SELECT page_id, path, {_ON_BOARD} AS address FROM (SELECT page_id, url, {_SPLIT} FROM pages))"


@query(
    f"WITH {_ADDRESSED} SELECT page_id, address,"
    f" CASE page_id % 8 WHEN 0 THEN CASE WHEN address LIKE 'https:%' THEN 'wrong_host' ELSE 'wrong_scheme' END WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'wrong_query' END WHEN 3 THEN 'wrong_path' WHEN 4 THEN 'wrong_path' WHEN 5 THEN 'wrong_host' WHEN 6 THEN CASE WHEN page_id % 2 = 1 THEN 'wrong_host' END WHEN 7 THEN CASE WHEN path = '' THEN 'wrong_query' ELSE 'wrong_path' END END AS source_issue,"
    f" CASE page_id % 8 WHEN 0 THEN CASE WHEN address LIKE 'https:%' THEN 'invalid_host' ELSE 'invalid_scheme' END WHEN 3 THEN 'disallowed_path' WHEN 4 THEN 'fragment' WHEN 5 THEN 'userinfo' WHEN 6 THEN CASE WHEN page_id % 2 = 1 THEN 'invalid_port' END WHEN 7 THEN CASE WHEN path <> '' THEN 'disallowed_path' END END AS target_issue FROM addressed"
)
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses, as they are and put onto the board, judged as sources and as targets."""
    pages = table(spark, sf_dir, "pages").withColumns({"host": F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), "path": F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)})
    own = pages.select("page_id", F.expr(_ON_BOARD).alias("address"))
    return own.select("page_id", "address", urls.source_url_issue(F.col("address")).alias("source_issue"), urls.wire_target_issue(F.col("address"), robots=False).alias("target_issue"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN CAST(doc_id + 1 AS VARCHAR) END AS duid FROM documents")
def duid_from_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys out of links: plain, twice (the last counts), and none that is a key."""
    n = F.col("doc_id")
    third = F.pmod(n, F.lit(3))
    href = F.when(third == 0, F.concat(F.lit("?BoardMode=view&DUID="), n)).when(third == 1, F.concat(F.lit("/a?DUID="), n, F.lit("&x=1&DUID="), n + 1, F.lit("#top"))).otherwise(F.concat(F.lit("?DUID=x"), n))
    return table(spark, sf_dir, "documents").select("doc_id", urls.duid_from_href(href).alias("duid"))


@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.redact_text(F.col("text")).alias("redacted"), text.clean_title(F.col("text")).alias("title"), text.clean_body(F.col("text")).alias("body"))


# Pages

_ROW = "concat('<li class=\"', if(pmod(doc_id, 9) = 0, 'pinned', 'row'), '\"><strong class=\"category\">[', category_name, ']</strong><a href=\"?BoardMode=view&DUID=', duid, '\"><!-- new --> Notice ', duid, '<span class=\"{0}\"></span></a><p class=\"info\">no | ', date_format(posted_date, 'yyyy-MM-dd'), ' | ', if(pmod(doc_id, 4) = 0, 'later', date_format(updated_date, 'yyyy.MM.dd')), ' | Office ', pmod(doc_id, 8), '</p></li>')"


@query(f"WITH {_NOTICES} SELECT doc_id // 20 AS page_id, duid, 'Notice ' || duid AS title, category_id, category_name, strftime(posted_date, '%Y-%m-%d') AS posted_date, strftime(CASE WHEN doc_id % 4 = 0 THEN posted_date ELSE updated_date END, '%Y-%m-%d') AS updated_date, 'Office ' || (doc_id % 8) AS department, source_url, attachments_present, doc_id % 9 = 0 AS pinned FROM notices")
def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages of twenty notices each, written as HTML and parsed again."""
    own = views.notices(spark, sf_dir).withColumn("doc_id", F.col("duid").cast("long"))
    row = F.when(F.col("attachments_present"), F.expr(_ROW.format("ico-file"))).otherwise(F.expr(_ROW.format("ico-new")))
    pages = own.select(F.floor(F.col("doc_id") / 20).alias("page_id"), F.struct("doc_id", row.alias("row")).alias("x")).groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pages = pages.select("page_id", F.concat(F.lit('<html><body><div class="board-list-box"><ul>'), F.array_join("x.row", ""), F.lit("</ul></div></body></html>")).alias("html"))
    found = html.list_records(html.list_page_rows(pages))
    return found.select("page_id", "duid", "title", "category_id", "category_name", _day("posted_date"), _day("updated_date"), "department", "source_url", "attachments_present", "pinned")


_BROKEN = "CASE doc_id % 6 WHEN 0 THEN 'missing_duid' WHEN 1 THEN 'malformed_duid' WHEN 2 THEN 'missing_title' WHEN 3 THEN 'unknown_category' WHEN 4 THEN 'missing_date' ELSE 'malformed_date' END"


@query(f"SELECT doc_id AS page_id, 0 AS row_index, {_BROKEN} AS code, CASE WHEN doc_id % 6 >= 4 THEN 'list-row-0-posted' ELSE 'list-row-0' END AS location FROM documents")
def board_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod("doc_id", F.lit(6))
    key = F.when(n == 0, "?x=1").when(n == 1, "?DUID=12a").otherwise("?DUID=12")
    title = F.when(n == 2, "").otherwise("A title")
    category = F.when(n == 3, "일반이 아닌").otherwise("일반")
    posted = F.when(n == 4, "").when(n == 5, "2024-1-5").otherwise("2024-01-05")
    page = F.concat(F.lit('<div class="board-list-box"><ul><li data-duid=""><a href="'), key, F.lit('">'), title, F.lit('</a><b class="category">'), category, F.lit('</b><i class="posted-date">'), posted, F.lit("</i></li></ul></div>"))
    return html.list_issues(html.list_page_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html"))))


@query(f"WITH {_NOTICES} SELECT duid, 'Notice ' || duid AS title, category_id, strftime(posted_date, '%Y-%m-%d') AS posted_date, department, doc_id % 5 = 0 AS attachments_present, 'Keep this. And ' || doc_id % 100 || ' that.' AS body FROM notices")
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages written as HTML and parsed again: links and frames leave the body, but mark attachments."""
    own = views.notices(spark, sf_dir)
    short = F.pmod(F.col("duid").cast("long"), F.lit(100)).cast("string")
    page = F.concat(
        F.lit('<html><body><article><h1 class="title">Notice '), F.col("duid"), F.lit('</h1><span class="category">'), F.col("category_name"), F.lit('</span><span class="posted-date">'), F.date_format("posted_date", "yyyy/MM/dd"),
        F.lit('</span><span class="writer">'), F.col("department"), F.lit('</span><div class="body"><p>Keep this.</p>'), F.when(F.col("attachments_present"), '<a href="f.pdf">a file</a>').otherwise("<a>no file</a>"),
        F.lit("<script>var x;</script><p>And "), short, F.lit(" that.</p></div></article></body></html>"),
    )
    found = html.detail_pages(own.select("duid", page.alias("html"))).where(F.col("issue").isNull())
    return found.select("duid", "title", "category_id", _day("posted_date"), "department", "attachments_present", "body")


@query(
    f"WITH {_NOTICES}, last AS (SELECT doc_id % 500 AS k, max(doc_id) FILTER (WHERE doc_id % 7 <> 0) AS shown, max(doc_id) FILTER (WHERE doc_id % 7 = 0) AS gone, count(*) FILTER (WHERE doc_id % 7 <> 0) AS n FROM notices GROUP BY ALL)"
    " SELECT CAST(k AS VARCHAR) AS duid, 'Capture of ' || x.category_name AS title, x.category_id, x.category_name, strftime(x.posted_date, '%Y-%m-%d') AS posted_date, strftime(x.posted_date, '%Y-%m-%d') AS updated_date,"
    f" 'Office ' || (shown % 8) AS department, '{_DETAIL}' || k AS source_url, 'Body of ' || (shown % 11) AS body, false AS attachments_present, last.gone IS NOT NULL AS tombstoned,"
    " sha256(concat_ws(chr(31), CAST(k AS VARCHAR), x.category_id, x.category_name, 'Capture of ' || x.category_name, strftime(x.posted_date, '%Y-%m-%d'), strftime(x.posted_date, '%Y-%m-%d'), 'Office ' || (shown % 8),"
    f" '{_DETAIL}' || k, 'Body of ' || (shown % 11), 'False')) AS content_hash, n - 1 AS n_overwritten FROM last JOIN notices x ON x.doc_id = shown"
)
def captured_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured detail responses with repeated ids, parsed and merged: of each id the last capture stays, and a 404 of it is a tombstone. The markup is written here."""
    own = views.notices(spark, sf_dir).withColumn("doc_id", F.col("duid").cast("long"))
    page = F.concat(
        F.lit('<article><h1 class="title">Capture of '), F.col("category_name"), F.lit('</h1><span class="category">'), F.col("category_name"), F.lit('</span><span class="posted-date">'), F.date_format("posted_date", "yyyy-MM-dd"),
        F.lit('</span><span class="writer">Office '), F.pmod("doc_id", F.lit(8)).cast("string"), F.lit('</span><div class="body">Body of '), F.pmod("doc_id", F.lit(11)).cast("string"), F.lit("</div></article>"),
    )
    key, missing = F.pmod("doc_id", F.lit(500)).cast("string"), F.pmod("doc_id", F.lit(7)) == 0
    responses = own.select(
        F.col("doc_id").alias("page_id"), F.lit("detail").alias("kind"), key.alias("duid"), F.concat(F.lit(_DETAIL), key).alias("url"), F.when(missing, 404).otherwise(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), page.cast("binary").alias("body"), F.lit(None).cast("string").alias("error"),
    )
    got = collect_captured(responses)
    rows, _ = merge.merge_notices(spark.createDataFrame([], NOTICES), got.details, _LATER, merge.DETAIL)
    counts = got.details.groupBy("duid").agg((F.count(F.lit(1)) - 1).alias("n_overwritten"))
    rows = merge.apply_tombstones(rows, got.gone, _LATER).join(counts, "duid")
    columns = ("title", "category_id", "category_name", _day("posted_date"), _day("updated_date"), "department", "source_url", "body", "attachments_present")
    return rows.select("duid", *columns, F.col("tombstone_at").isNotNull().alias("tombstoned"), "content_hash", "n_overwritten")


@query()
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links and text of raw pages. SQL has no HTML parser; a test compares titles with a pattern."""
    return html.page_contents(table(spark, sf_dir, "pages"))


# Responses

# The given pages as captured answers: the status follows from the number, the body is the page's markup.
_STATUSES = (200, 403, 404, 429, 500, 302, 200, None)
_MARKER = " OR ".join(f"contains(head, '{m}')" for m in urls.CHALLENGE_MARKERS if m != "waf") + " OR regexp_matches(head, '(^|[^a-z0-9])waf([^a-z0-9]|$)')"
_ANSWERS = f"answers AS (SELECT page_id, page_id % 8 AS k, {_MARKER} AS marked FROM (SELECT page_id, lower(left(html, {urls.CHALLENGE_BYTES})) AS head FROM pages))"


@query(
    f"WITH {_ANSWERS} SELECT page_id, CASE WHEN k = 7 OR marked OR k IN (1, 3, 4, 5) THEN 'blocked' WHEN k = 2 THEN 'gone' WHEN k = 6 THEN 'markup' ELSE 'page' END AS outcome,"
    " CASE WHEN k = 7 THEN 'transport_failure' WHEN marked THEN 'captcha' WHEN k = 1 THEN 'forbidden' WHEN k = 3 THEN 'rate_limit' WHEN k = 4 THEN 'http_failure' WHEN k = 5 THEN 'cross_host_redirect' END AS reason FROM answers"
)
def response_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as answers with each kind of status; redirects lead to the page's own address, every eighth is sent as plain text."""
    k = F.pmod("page_id", F.lit(len(_STATUSES))).cast("int")
    own = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit(_LIST), "page_id").alias("url"), F.array(*map(F.lit, _STATUSES))[k].alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.when(k == 6, "text/plain").otherwise("text/html; charset=utf-8"), F.lit("location"), F.regexp_replace("url", "^[a-z]+:", "https:")).alias("headers"),
        F.col("html").cast("binary").alias("body"), F.when(k == 7, "timeout").alias("error"),
    )
    return wire.classified(own).select("page_id", "outcome", "reason")


_PATH = _SITE.path


@query(
    f"WITH {_ANSWERS}, files AS (SELECT a.page_id, a.page_id % 4 AS k, marked, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM answers a JOIN pages p ON p.page_id = a.page_id),"
    f" judged AS (SELECT page_id, CASE WHEN k >= 2 AND marked THEN 'robots_captcha' WHEN k = 0 AND path <> '' AND starts_with('{_PATH}', path) THEN 'robots_disallowed' WHEN k = 1 THEN 'robots_disallowed' WHEN k = 2 THEN 'robots_malformed' WHEN k = 3 THEN 'robots_invalid_content_type' END AS block_reason FROM files)"
    " SELECT page_id, block_reason IS NULL AS allowed, CASE WHEN block_reason IS NULL THEN CAST(page_id % 9 AS DOUBLE) ELSE 2.0 END AS crawl_delay, block_reason FROM judged"
)
def robots_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files out of the pages: rules with the page's own path, with the board's, and the page's markup sent as a file."""
    k, path = F.pmod("page_id", F.lit(4)), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    rules = F.concat(F.lit("User-agent: *\n"), F.when(k == 0, F.concat(F.lit("Disallow: "), path)).otherwise(F.concat(F.lit("Allow: "), path, F.lit("\nDisallow: /ko/"))), F.lit("\nCrawl-delay: "), F.pmod("page_id", F.lit(9)).cast("string"))
    own = table(spark, sf_dir, "pages").select("page_id", F.lit(200).alias("status_code"), F.when(k == 3, "text/html").otherwise("text/plain").alias("content_type"), F.when(k < 2, rules).otherwise(F.col("html")).cast("binary").alias("body"))
    return robots.robots_decisions(own).select("page_id", "decision.allowed", "decision.crawl_delay", "decision.block_reason")


@query("SELECT page_id, 'markup' AS reason FROM pages WHERE page_id % 3 <> 0")
def captured_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages as captured list responses, each with its own address; every third one has a notice board put before its markup. Those without one are blocked."""
    board = F.concat(
        F.lit('<div class="board-list-box"><ul><li><strong class="category">[일반]</strong><a href="?BoardMode=view&DUID='), F.col("page_id").cast("string"), F.lit('">Notice '), F.col("page_id").cast("string"),
        F.lit('</a><p class="info">no | 2024-01-05 | 2024.01.06 | Office</p></li></ul></div>'),
    )
    page = F.when(F.pmod("page_id", F.lit(3)) == 0, F.regexp_replace("html", "<body[^>]*>", F.concat(F.lit("<body>"), board))).otherwise(F.col("html"))
    own = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("index").alias("kind"), F.lit(None).cast("string").alias("duid"), "url", F.lit(200).alias("status_code"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), page.cast("binary").alias("body"), F.lit(None).cast("string").alias("error"),
    )
    return collect_captured(own).blocked


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrivals_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals_by_window(table(spark, sf_dir, "events")).select(_instant("window_start"), "event_type", "n")
