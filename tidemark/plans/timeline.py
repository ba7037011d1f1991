"""Queries of what happens over time: as-of joins, overlaps, kept views, histories, sessions, sketches, paging; and their SQL."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, history, intervals
from tidemark.operators.feed import active
from tidemark.operators.levels import level_counts
from tidemark.operators.paging import next_cursor, seek_page, write_feed
from tidemark.operators.sketches import DISTINCT_ERROR, RANK_ERROR, estimated, merged, sketched
from tidemark.operators.upkeep import Upkeep, batch_of
from tidemark.plans import views
from tidemark.plans.registry import _IDS, _NOTICES, _RUNS, _SHOWN, query
from tidemark.plans.views import NOW, table
from tidemark.sources.shared import new_folder, written
from tidemark.streaming import keyed
from tidemark.streaming.sessions import sessions

_MICROS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def _micros(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# As-of joins


@query(
    f"WITH {_NOTICES}, {_RUNS}, done AS (SELECT updated_at, max_by(run_id, run_id) AS run_id FROM runs WHERE status = 'success' GROUP BY updated_at), collected AS (SELECT duid, collected_at - INTERVAL 40 DAY AS t FROM notices)"
    f" SELECT duid, {_SHOWN.format('t')} AS t, run_id, {_MICROS.format('updated_at')} AS finished_at FROM collected ASOF LEFT JOIN done ON t >= updated_at"
)
def notices_with_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notice with the last run that was successful by an instant forty days before it was collected, which is when the given events are."""
    own = views.notices(spark, sf_dir).select("duid", (F.col("collected_at") - F.expr("INTERVAL 40 DAYS")).alias("t"))
    done = views.runs(spark, sf_dir).where("status = 'success'").select("run_id", "finished_at")
    found = asof.asof_join(own, done, "t", "finished_at", ["run_id", "finished_at"])
    return found.select("duid", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), "run_id", _micros("finished_at"))


@query(
    f"WITH bought AS (SELECT user_id, ts, max_by(event_id, event_id) AS bought_id, max_by(value, event_id) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ALL)"
    f" SELECT e.event_id, CAST(b.bought_id AS VARCHAR) AS bought_id, coalesce(b.bought, -1) AS bought FROM events e ASOF LEFT JOIN bought b ON e.user_id = b.user_id AND e.ts >= b.ts"
)
def events_with_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase at or before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("bought_id"), F.col("value").alias("bought"))
    return asof.asof_join(events, bought, "ts", "at", ["bought_id", "bought"], ["user_id"]).select("event_id", F.col("bought_id").cast("string").alias("bought_id"), F.coalesce("bought", F.lit(-1.0)).alias("bought"))


# Overlaps of runs

_SPANS = "spans AS (SELECT event_id, event_type, ts AS s, ts + to_minutes(CAST(event_id % 30 AS INT)) AS e FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.runs(spark, sf_dir).select(F.col("run_id").cast("long").alias("event_id"), F.col("started_at").alias("s"), F.col("updated_at").alias("e"))


@query(f"WITH {_SPANS} SELECT a.event_id AS first_id, b.event_id AS second_id, {_MICROS.format('greatest(a.s, b.s)')} AS overlap_from, {_MICROS.format('least(a.e, b.e)')} AS overlap_to FROM spans a JOIN spans b ON a.event_type = b.event_type AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e WHERE a.event_type = 'view'")
def lease_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the lease: pairs of runs in state running whose times overlap."""
    running = views.runs(spark, sf_dir).where("status = 'running'").select(F.col("run_id").cast("long").alias("run_id"), "started_at", "updated_at")
    return intervals.overlap_pairs(running, "run_id", "started_at", "updated_at", shown=_micros)


@query(f"WITH {_SPANS}, whole AS (SELECT * FROM spans WHERE s < e) SELECT a.event_id, count(b.event_id) - 1 AS n FROM whole a JOIN whole b ON a.s < b.e AND b.s < a.e GROUP BY a.event_id")
def runs_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other runs each run has beside it at some time."""
    return intervals.overlap_counts(_spans(spark, sf_dir), "event_id", "s", "e").select("event_id", "n")


@query(
    f"WITH {_SPANS}, whole AS (SELECT * FROM spans WHERE s < e), steps AS (SELECT t, sum(d) AS d FROM (SELECT s AS t, 1 AS d FROM whole UNION ALL SELECT e, -1 FROM whole) GROUP BY t), open AS (SELECT t, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS n FROM steps)"
    f" SELECT n, {_MICROS.format('t')} AS at FROM open ORDER BY n DESC, t LIMIT 1"
)
def most_runs_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.most_at_once(_spans(spark, sf_dir), "s", "e").select("n", _micros("at"))


# Views kept up by three batches: all notices, moved ones, gone ones

_AFTER = f"{_NOTICES}, kept AS (SELECT * EXCLUDE (category_id, title), CASE WHEN doc_id % 6 = 0 THEN 'general' ELSE category_id END AS category_id, CASE WHEN doc_id % 6 = 0 THEN 'Moved ' || title ELSE title END AS title FROM notices WHERE NOT gone AND NOT doc_id % 7 = 0)"


def upkeep(spark: SparkSession, sf_dir: str) -> Upkeep:
    """The views after three batches. Each reads what is stored of its own keys only."""
    own = Upkeep(spark, new_folder(spark, "upkeep"))
    stored = views.notices(spark, sf_dir)
    number = F.col("duid").cast("long")
    own.apply(0, stored.limit(0), stored)
    moved = stored.where(F.pmod(number, F.lit(6)) == 0).withColumns({"category_id": F.lit("general"), "title": F.concat(F.lit("Moved "), F.col("title"))})
    own.apply(1, *batch_of(stored, moved))
    before = stored.where(F.pmod(number, F.lit(6)) != 0).unionByName(moved)
    gone = before.where(F.pmod(number, F.lit(7)) == 0).withColumn("tombstone_at", F.lit(NOW))
    own.apply(2, *batch_of(before, gone))
    return own


@query(f"WITH {_AFTER} SELECT category_id, strftime(posted_date, '%Y-%m-%d') AS posted_date, count(*) AS n FROM kept GROUP BY ALL")
def kept_counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep(spark, sf_dir).read("by_day").select("category_id", F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"), "n")


_KEPT_WORDS = "[" + ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')" for c in ("title", "category_name", "department", "body")) + "]"


@query(f"WITH {_AFTER}, words AS (SELECT duid, list_distinct(flatten({_KEPT_WORDS})) AS w FROM kept) SELECT t AS term, count(*) AS n FROM (SELECT unnest(w) AS t FROM words) GROUP BY t")
def kept_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep(spark, sf_dir).read("by_term")


@query(f"WITH {_AFTER} SELECT count(*) AS n, CAST(sum(len(flatten({_KEPT_WORDS}))) AS BIGINT) AS words FROM kept")
def kept_corpus_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep(spark, sf_dir).read("corpus")


# Histories folded out of three batches of the change log, in which a third of the changes come late

_LOG = "log AS (SELECT conv_id AS key, turn, sha256(concat_ws(chr(31), coalesce(role, ''), coalesce(text, ''))) AS value FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), points AS (SELECT key, turn, max(value) AS value FROM log GROUP BY ALL)"


def log_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.change_log(spark, sf_dir).select(F.col("conv_id").alias("key"), F.col("turn").alias("at"), F.col("value_hash").alias("value"))
    folded, folder = None, new_folder(spark, "history")
    for k in (0, 2, 1):
        folded = written(history.fold_history(folded, log.where(F.pmod("at", F.lit(3)) == k)), f"{folder}/{k}")
    return folded


@query(f"WITH {_LOG} SELECT key, turn AS valid_from, CAST(lead(turn) OVER (PARTITION BY key ORDER BY turn) AS VARCHAR) AS valid_to, value FROM points")
def history_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_history(spark, sf_dir).select("key", "valid_from", F.col("valid_to").cast("string").alias("valid_to"), "value")


@query(f"WITH {_LOG} SELECT key, max_by(value, turn) AS value FROM points WHERE turn <= 4 GROUP BY key")
def state_at_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's state was after turn 4: a read as of an instant."""
    return history.state_at(log_history(spark, sf_dir), 4)


# Events of keys with state and timers, sessions

_WRITES = "writes AS (SELECT CAST(user_id AS VARCHAR) AS duid, date_trunc('millisecond', ts) AS t, event_type AS h FROM events WHERE user_id IS NOT NULL), placed AS (SELECT *, lag(h) OVER w AS before, lead(t) OVER w AS after, t + INTERVAL 1 DAY AS x FROM writes WHERE t <= TIMESTAMP '2024-01-29' WINDOW w AS (PARTITION BY duid ORDER BY t, h))"


@query(
    f"WITH {_WRITES} SELECT duid, {_MICROS.format('t')} AS at, 'revision' AS kind, h AS content_hash FROM placed WHERE before <> h"
    f" UNION ALL SELECT duid, {_MICROS.format('x')}, 'expiry', h FROM placed WHERE x <= TIMESTAMP '2024-01-29' AND (after IS NULL OR x <= after)"
)
def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of their user's state: revisions, and bodies that no write renews within a day. The stream form gives the same rows, which tests show."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("duid"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("content_hash"))
    return keyed.versions_until(own, timedelta(days=1), datetime(2024, 1, 29, tzinfo=UTC)).select("duid", _micros("at"), "kind", "content_hash")


@query(
    f"WITH placed AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), named AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM placed)"
    f" SELECT user_id, {_MICROS.format('min(ts)')} AS session_start, {_MICROS.format('max(ts) + INTERVAL 12 HOUR')} AS session_end, count(*) AS n FROM named GROUP BY user_id, s"
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sessions(table(spark, sf_dir, "events"), gap_seconds=12 * 3600)
    return own.select("user_id", _micros("session_start"), _micros("session_end"), "n")


# Sketches, levels, cursors


@query(f"WITH {_NOTICES} SELECT coalesce(category_id, 'all') AS category_id, count(*) AS n, count(DISTINCT title) AS titles, true AS distinct_within, true AS median_within FROM notices WHERE NOT gone GROUP BY GROUPING SETS ((category_id), ())")
def sketches_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by category and day, merged to categories and to all, beside exact counts: whether the estimates are within their bounds."""
    own = active(views.notices(spark, sf_dir)).select("category_id", "posted_date", "title", F.length("body").alias("size"))
    days = written(sketched(own, ["category_id", "posted_date"], "title", "size"), f"{new_folder(spark, 'sketches')}/days")
    categories = merged(days, ["category_id"])
    both = categories.unionByName(merged(categories, []).withColumn("category_id", F.lit("all")))
    guessed = estimated(both, [0.5]).select("category_id", "n", "distinct_estimate", F.col("quantiles")[0].alias("median"))
    exact = own.cube("category_id").agg(F.count_distinct("title").alias("titles"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("category_id")).alias("category_id"), "titles")
    sizes = own.select(F.explode(F.array("category_id", F.lit("all"))).alias("category_id"), "size")
    below = sizes.join(guessed.select("category_id", "median"), "category_id").groupBy("category_id").agg(F.avg((F.col("size") < F.col("median")).cast("double")).alias("low"), F.avg((F.col("size") <= F.col("median")).cast("double")).alias("high"))
    rows = guessed.join(exact, "category_id").join(below, "category_id")
    near = F.abs(F.col("distinct_estimate") - F.col("titles")) <= F.greatest(F.lit(1.0), DISTINCT_ERROR * F.col("titles"))
    middle = F.coalesce((F.col("low") - RANK_ERROR <= 0.5) & (F.col("high") + RANK_ERROR >= 0.5), F.lit(True))
    return rows.select("category_id", "n", "titles", near.alias("distinct_within"), middle.alias("median_within"))


_LEVELS = "counted AS (SELECT category_id, month, freshness, CAST(grouping(category_id, month, freshness) AS INT) AS level, count(*) AS n FROM own GROUP BY CUBE (category_id, month, freshness))"


@query(
    f"WITH {_NOTICES}, {_RUNS}, own AS (SELECT category_id, strftime(posted_date, '%Y-%m') AS month, CASE WHEN s IS NULL THEN 'expired' WHEN age <= 86400 THEN 'fresh' WHEN age <= 604800 THEN 'stale' ELSE 'expired' END AS freshness FROM (SELECT *, epoch(TIMESTAMP '2024-03-01') - epoch(collected_at) AS age, (SELECT max(updated_at) FROM runs WHERE status = 'success') AS s FROM notices WHERE NOT gone)),"
    f" {_LEVELS}, zeros AS (SELECT c.category_id, month, freshness, level - 4 AS level, 0 AS n FROM counted, (SELECT unnest([{_IDS}]) AS category_id) c WHERE level >= 4)"
    " SELECT category_id, month, freshness, level, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM counted UNION ALL SELECT * FROM zeros) GROUP BY ALL"
)
def counts_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(views.notices(spark, sf_dir), views.runs(spark, sf_dir), NOW)


@query(f"WITH {_NOTICES} SELECT duid, category_id, title, strftime(posted_date, '%Y-%m-%d') AS posted_date FROM notices WHERE NOT gone ORDER BY notices.posted_date DESC, duid DESC LIMIT 50 OFFSET 150")
def fourth_page_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of fifty, each from the cursor behind the one before."""
    feed, cursor = write_feed(views.notices(spark, sf_dir), f"{new_folder(spark, 'feed')}/rows"), None
    for _ in range(3):
        cursor = next_cursor(seek_page(feed, cursor, limit=50).select("posted_date", "duid").collect()) or cursor
    return seek_page(feed, cursor, limit=50).select("duid", "category_id", "title", F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"))
