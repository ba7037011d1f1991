"""The run ledger as a table: lease, counters, recovery. Each function gives the ledger after the step."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.errors import RunBusyError, StorageInputError
from tidemark.operators.schema import RUN_STATES, RUNS

#: A running row not updated for longer is stale.
LEASE_MINUTES = 15


def _stale(now: datetime):
    return (F.col("status") == "running") & (F.col("updated_at") < F.lit(now) - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"))


def interrupt_stale(runs: DataFrame, now: datetime) -> DataFrame:
    """Stale running rows become interrupted, updated and finished now; their checkpoint stays."""
    stale = F.coalesce(_stale(now), F.lit(False))
    new = {"status": F.lit("interrupted"), "updated_at": F.lit(now), "finished_at": F.lit(now)}
    return runs.withColumns({c: F.when(stale, v).otherwise(F.col(c)) for c, v in new.items()}).select(*RUNS.fieldNames())


def recovered(runs: DataFrame, now: datetime) -> DataFrame:
    """Rows that were interrupted at this instant, newest first."""
    return runs.where((F.col("status") == "interrupted") & (F.col("finished_at") == F.lit(now))).orderBy(F.col("updated_at").desc(), F.col("run_id").desc())


def start_run(runs: DataFrame, run_id: str, now: datetime) -> DataFrame:
    """Takes the lease: RunBusyError if a run that isn't stale holds it, StorageInputError for an id that is taken."""
    after = interrupt_stale(runs, now)
    holder = after.where("status = 'running'").limit(1).collect()
    if holder:
        raise RunBusyError(holder[0]["run_id"])
    if after.where(F.col("run_id") == run_id).limit(1).collect():
        raise StorageInputError("run_id", run_id)
    new = runs.sparkSession.createDataFrame([(run_id, "running", 0, 0, 0, 0, 0, None, now, now, None)], RUNS)
    return after.unionByName(new)


def get_run(runs: DataFrame, run_id: str) -> Row | None:
    return next(iter(runs.where(F.col("run_id") == run_id).limit(1).collect()), None)


def update_run(runs: DataFrame, run_id: str, now: datetime, **given: int | str | None) -> DataFrame:
    """Sets counters, checkpoint_page and block_reason; what is None keeps its value. StorageInputError for an unknown run."""
    allowed = {"checkpoint_page", "pages_seen", "detail_requests", "index_requests", "retry_count", "block_reason"}
    if not set(given) <= allowed:
        raise StorageInputError("update", ", ".join(sorted(set(given) - allowed)))
    if get_run(runs, run_id) is None:
        raise StorageInputError("run_id", run_id)
    own = F.col("run_id") == run_id
    new = {c: F.when(own, F.lit(v).cast(RUNS[c].dataType)).otherwise(F.col(c)) for c, v in given.items() if v is not None}
    return runs.withColumns(new | {"updated_at": F.when(own, F.lit(now)).otherwise(F.col("updated_at"))}).select(*RUNS.fieldNames())


def finish_run(runs: DataFrame, run_id: str, status: str, now: datetime) -> DataFrame:
    """Closes a run with a state other than running."""
    if status not in RUN_STATES or status == "running":
        raise StorageInputError("status", str(status))
    if get_run(runs, run_id) is None:
        raise StorageInputError("run_id", run_id)
    own = F.col("run_id") == run_id
    new = {"status": F.lit(status), "updated_at": F.lit(now), "finished_at": F.lit(now)}
    return runs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in new.items()}).select(*RUNS.fieldNames())


def latest_run(runs: DataFrame) -> DataFrame:
    """The row updated last, as a table of one row at most; among equals the greatest id."""
    return runs.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(1)


def latest_status(runs: DataFrame) -> str | None:
    return next((r["status"] for r in latest_run(runs).collect()), None)


def restart_checkpoint(runs: DataFrame) -> DataFrame:
    """One row: checkpoint_page of the interrupted run updated last, null without one."""
    return runs.where("status = 'interrupted'").agg(F.max_by("checkpoint_page", F.struct("updated_at", "run_id")).alias("checkpoint_page"))


def run_counters(wire_log: DataFrame) -> DataFrame:
    """(run_id, wire_requests, retries, pages, details) out of a log of requests (run_id, kind, retry)."""
    return wire_log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("wire_requests"),
        F.count_if(F.col("retry")).alias("retries"),
        F.count_if((F.col("kind") == "index") & ~F.col("retry")).alias("pages"),
        F.count_if((F.col("kind") == "detail") & ~F.col("retry")).alias("details"),
    )
