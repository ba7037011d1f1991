"""Command line: init-db, status, crawl, serve. Results go to standard output, logs to standard error as JSON lines."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Row, SparkSession

from tidemark.operators.errors import StorageError
from tidemark.operators.feed import active_count, freshness_histogram
from tidemark.plans.collect import Collector, RunResult
from tidemark.plans.service import NoticeService
from tidemark.plans.settings import BadConfiguration, Settings, load_settings
from tidemark.server import serve
from tidemark.sources.store import open_store
from tidemark.sources.wire import Transport, UrlTransport

# Exit codes.
EXIT_OK, EXIT_BLOCKED, EXIT_BUSY, EXIT_CONFIG, EXIT_INFRASTRUCTURE = 0, 10, 11, 12, 13
EXIT_CODES = {"success": EXIT_OK, "blocked": EXIT_BLOCKED, "budget_exceeded": EXIT_BLOCKED, "busy": EXIT_BUSY}


def logger(level: str) -> logging.Logger:
    log = logging.getLogger("tidemark")
    log.handlers.clear()
    log.propagate = False
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(message)s"))
    log.addHandler(handler)
    log.setLevel(level)
    return log


# Event names and keys of the log lines.


def log_run(log: logging.Logger, result: RunResult, run: Row | None) -> None:
    """Counters and outcome of a run, nothing of what was fetched."""
    log.info(
        json.dumps(
            {
                "event": "crawl.finished",
                "run_id": result.run_id,
                "status": result.status,
                "page_count": run["pages_seen"] if run else 0,
                "detail_count": run["detail_requests"] if run else 0,
                "wire_requests": result.requests,
                "retry_count": result.retries,
                "block_reason": result.reason,
            },
            ensure_ascii=False,
            sort_keys=True,
        )
    )


def log_failure(log: logging.Logger, status: str, reason: str) -> None:
    log.error(json.dumps({"event": "cli.failure", "run_id": None, "status": status, "page_count": 0, "detail_count": 0, "block_reason": reason}, ensure_ascii=False, sort_keys=True))


def status_line(spark: SparkSession, settings: Settings, now: datetime) -> str:
    store = open_store(spark, settings.store)
    run = store.latest_run()
    buckets = ",".join(f"{r['freshness']}:{r['n']}" for r in freshness_histogram(store.notices(), store.runs(), now).collect())
    return " ".join(
        (
            f"db={settings.store}",
            f"notices={active_count(store.notices()).first()['n']}",
            f"freshness={buckets}",
            "search=available",
            f"crawl={run['status'] if run else 'none'}",
            f"run_id={run['run_id'] if run else '-'}",
            f"pages={run['pages_seen'] if run else 0}",
            f"details={run['detail_requests'] if run else 0}",
            f"block_reason={(run['block_reason'] if run else None) or '-'}",
        )
    )


def crawl(spark: SparkSession, settings: Settings, transport: Transport | None = None, run_id: str | None = None, **collector) -> tuple[RunResult, Row | None]:
    store = open_store(spark, settings.store)
    # The user agent is checked, but requests carry the transport's own one.
    result = Collector(store, transport or UrlTransport(), settings.site(), **collector).run(run_id or uuid.uuid4().hex, settings.run_config())
    return result, store.get_run(result.run_id)


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init-db", "status", "crawl", "serve"):
        own = commands.add_parser(name)
        for option in ("store", "log-level", "user-agent"):
            own.add_argument(f"--{option}")
        if name == "crawl":
            for option in ("max-pages", "max-detail-requests", "max-duration-seconds"):
                own.add_argument(f"--{option}")
            own.add_argument("--metadata-only", action="store_true", help="taken for clearness: the command line always collects metadata only")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, transport: Transport | None = None, **collector) -> int:
    asked = vars(_parser().parse_args(arguments))
    command = asked.pop("command")
    asked.pop("metadata_only", None)
    try:
        settings = load_settings(asked)
        spark = spark or _session()
        if command == "init-db":
            open_store(spark, settings.store)
            print(f"initialized db={settings.store} search=available")
        elif command == "status":
            print(status_line(spark, settings, datetime.now(UTC)))
        elif command == "serve":
            logger(settings.log_level)
            serve(NoticeService(spark, settings.store), sys.stdin, sys.stdout)
        else:
            result, run = crawl(spark, settings, transport, **collector)
            log_run(logger(settings.log_level), result, run)
            return EXIT_CODES[result.status]
    except BadConfiguration:
        log_failure(logger("ERROR"), "invalid_config", "invalid configuration")
        return EXIT_CONFIG
    except (StorageError, OSError, PySparkException, Py4JJavaError):
        log_failure(logger("ERROR"), "infrastructure", command.replace("-", "_"))
        return EXIT_INFRASTRUCTURE
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(main())
