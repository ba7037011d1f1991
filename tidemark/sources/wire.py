"""Fetching under limits: a driver-side client, and the same rules over tables of captured responses."""

from __future__ import annotations

import http.client
import time
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import BoardSite, challenged, content_type, decoded_html, status_reason, wire_target_issue
from tidemark.sources.robots import has_challenge

# Limits of fetching.
MAX_BODY = 4 * 1024 * 1024
MAX_ATTEMPTS, MAX_HOPS, MAX_REQUESTS = 3, 5, 500
MIN_DELAY = 2.0
CONNECT_TIMEOUT, READ_TIMEOUT = 5.0, 30.0
BODY_SECONDS = 120.0
USER_AGENT = "tidemark/0.1 (+local metadata collector)"
ROBOTS, NOTICE = "robots", "notice"


class WireError(ConnectionError):
    """A failure of fetching."""


class ConnectionFailed(WireError):
    """Connection or timeout: may be tried again."""


class ResponseTooLarge(WireError):
    """More than MAX_BODY bytes."""


class BudgetExceeded(WireError):
    """The next request would be one too many for the run."""


@dataclass(frozen=True)
class Response:
    status: int
    headers: Mapping[str, str]
    body: bytes

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name), None)

    @property
    def media_type(self) -> str | None:
        value = self.header("content-type")
        return None if value is None else value.partition(";")[0].strip().lower()

    def html(self) -> str | None:
        try:
            return self.body.decode("utf-8")
        except UnicodeDecodeError:
            return None


class Transport(Protocol):
    def request(self, url: str) -> Response: ...


class UrlTransport:
    """One GET over the standard library, without redirects, read up to MAX_BODY. Runs on the driver only.

    Connecting has CONNECT_TIMEOUT, each wait for bytes READ_TIMEOUT, the whole body ``body_seconds``. A body that
    breaks off before its declared end counts as a failed connection.
    """

    def __init__(self, user_agent: str = USER_AGENT, body_seconds: float = BODY_SECONDS):
        def timed(kind: type) -> type:
            class Timed(kind):
                def connect(self):
                    super().connect()
                    self.sock.settimeout(READ_TIMEOUT)

            return Timed

        plain, secure = timed(http.client.HTTPConnection), timed(http.client.HTTPSConnection)

        class Plain(urllib.request.HTTPHandler):
            def http_open(self, asked):
                return self.do_open(plain, asked)

        class Secure(urllib.request.HTTPSHandler):
            def https_open(self, asked):
                return self.do_open(secure, asked)

        class AsIs(urllib.request.HTTPErrorProcessor):
            def http_response(self, _, reply):
                return reply

            https_response = http_response

        self._opener = urllib.request.build_opener(Plain, Secure, AsIs)
        self._opener.addheaders = [("User-Agent", user_agent)]
        self._body_seconds = body_seconds

    def request(self, url: str) -> Response:
        try:
            with self._opener.open(url, timeout=CONNECT_TIMEOUT) as reply:
                body, until = bytearray(), time.monotonic() + self._body_seconds
                while part := reply.read1(64 * 1024):
                    body += part
                    if len(body) > MAX_BODY:
                        raise ResponseTooLarge
                    if time.monotonic() > until:
                        raise TimeoutError
                if reply.length:
                    raise http.client.IncompleteRead(bytes(body), reply.length)
                return Response(reply.status, dict(reply.headers), bytes(body))
        except WireError:
            raise
        except (OSError, http.client.HTTPException) as error:
            raise ConnectionFailed from error


@dataclass
class Budget:
    maximum: int = MAX_REQUESTS
    used: int = 0

    def take(self) -> None:
        if self.used >= self.maximum:
            raise BudgetExceeded
        self.used += 1


@dataclass
class Counters:
    requests: int = 0
    retries: int = 0
    pages: int = 0
    details: int = 0


@dataclass(frozen=True)
class Fetched:
    """A response, or the reason why there is none."""

    response: Response | None
    reason: str | None


def target_issue(url: str, role: str, site: BoardSite = BoardSite()) -> str | None:
    """The first fault of an address by scheme, host, user, port, fragment, path; None if it may be fetched."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return "malformed_target"
    path = "/robots.txt" if role == ROBOTS else site.path
    faults = {
        "invalid_scheme": parts.scheme != "https",
        "invalid_host": parts.hostname != site.host,
        "userinfo": parts.username is not None or parts.password is not None,
        "invalid_port": port not in (None, 443),
        "fragment": bool(parts.fragment),
        "disallowed_path": parts.path != path,
    }
    return next((name for name, is_one in faults.items() if is_one), None)


_REDIRECT_REASONS = {"invalid_host": "cross_host_redirect", "disallowed_path": "disallowed_redirect_path"}


@dataclass
class Fetcher:
    """Delay before each attempt, three attempts a hop, five hops, a budget for the run."""

    transport: Transport
    site: BoardSite = field(default_factory=BoardSite)
    sleep: Callable[[float], None] = time.sleep
    budget: Budget = field(default_factory=Budget)
    counters: Counters = field(default_factory=Counters)

    def _attempt(self, url: str, delay: float) -> Response | None:
        """None after the last failed attempt."""
        for last in (*[False] * (MAX_ATTEMPTS - 1), True):
            self.budget.take()
            self.sleep(max(MIN_DELAY, delay))
            self.counters.requests += 1
            try:
                return self.transport.request(url)
            except ResponseTooLarge:
                raise
            except (ConnectionError, TimeoutError):
                if not last:
                    self.counters.retries += 1
        return None

    def fetch(self, url: str, role: str, delay: float = MIN_DELAY) -> Fetched:
        """A 404 is a response; other failures are reasons. A challenge counts before a redirect, and that before the status."""
        issue = target_issue(url, role, self.site)
        if issue:
            return Fetched(None, issue)
        for hop in range(MAX_HOPS + 1):
            got = self._attempt(url, delay)
            if got is None:
                return Fetched(None, "transport_failure")
            if len(got.body) > MAX_BODY:
                raise ResponseTooLarge
            if has_challenge(got.body):
                return Fetched(None, "captcha")
            if not 300 <= got.status < 400:
                if got.status == 404 or 200 <= got.status < 300:
                    return Fetched(got, None)
                return Fetched(None, {403: "forbidden", 429: "rate_limit"}.get(got.status, "http_failure"))
            where = got.header("location")
            if not where:
                return Fetched(None, "invalid_redirect_target")
            if hop == MAX_HOPS:
                break
            url = urljoin(url, where)
            issue = target_issue(url, role, self.site)
            if issue:
                return Fetched(None, _REDIRECT_REASONS.get(issue, "invalid_redirect_target"))
        return Fetched(None, "redirect_hop_cap")


# The same rules over tables of captured responses: url, status_code, headers (map), body (binary), error.


def redirect_targets(responses: DataFrame) -> DataFrame:
    """Adds target, the address that a redirect leads to; null for every other response.

    Joining addresses has no built-in form. The Python workers get the two addresses in batches, and nulls where
    nothing is to be joined; headers and bodies stay out of them.
    """

    @F.arrow_udf("string")
    def joined(url: pa.Array, where: pa.Array) -> pa.Array:
        return pa.array([urljoin(u.as_py(), w.as_py()) if w.is_valid and u.is_valid else None for u, w in zip(url, where, strict=True)], pa.string())

    headers = F.map_filter("headers", lambda k, _: F.lower(k) == "location")
    redirect = (F.col("status_code") >= 300) & (F.col("status_code") < 400)
    where = F.when(redirect, F.nullif(F.try_element_at(F.map_values(headers), F.lit(1)), F.lit("")))
    return responses.withColumn("target", joined(F.when(where.isNotNull(), F.nullif("url", F.lit(""))), where))


def response_reason(status: Column, body: Column, error: Column, target: Column, robots: bool = False, site: BoardSite = BoardSite()) -> Column:
    """Why a captured response is no use; null if it is one (a 404 among them)."""
    redirect = (status >= 300) & (status < 400)
    fault = wire_target_issue(target, robots, site)
    return (
        F.when(error.isNotNull() | status.isNull(), "transport_failure")
        .when(F.length(body) > MAX_BODY, "oversized")
        .when(challenged(body), "captcha")
        .when(redirect & target.isNull(), "invalid_redirect_target")
        .when(redirect & (fault == "invalid_host"), "cross_host_redirect")
        .when(redirect & (fault == "disallowed_path"), "disallowed_redirect_path")
        .when(redirect & fault.isNotNull(), "invalid_redirect_target")
        .when(redirect, "redirect")
        .when((status == 404) | ((status >= 200) & (status < 300)), F.lit(None).cast("string"))
        .otherwise(status_reason(status))
    )


def classified(responses: DataFrame, robots: bool = False, site: BoardSite = BoardSite()) -> DataFrame:
    """Adds target, reason, media_type, html (decoded, of usable HTML answers) and outcome: page, gone, markup or blocked."""
    own = redirect_targets(responses)
    own = own.withColumn("reason", response_reason(F.col("status_code"), F.col("body"), F.col("error"), F.col("target"), robots, site)).withColumn("media_type", content_type(F.col("headers")))
    usable = F.col("reason").isNull() & (F.col("status_code") != 404) & (F.col("media_type") == "text/html")
    own = own.withColumn("html", F.when(usable, decoded_html(F.col("body"))))
    outcome = F.when(F.col("reason").isNotNull(), "blocked").when(F.col("status_code") == 404, "gone").when(F.col("html").isNull(), "markup").otherwise("page")
    return own.withColumn("outcome", outcome)
