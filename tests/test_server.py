"""The tool protocol over lines, and the transport's limits over a local socket."""

import io
import json
import socket
import threading
import time
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.schema import NOTICES
from tidemark.plans.service import NoticeService, as_json
from tidemark.server import INVALID_PARAMS, INVALID_REQUEST, MAX_LINE, NO_METHOD, PARSE_ERROR, TOOLS, VERSIONS, ToolServer, serve
from tidemark.sources import wire
from tidemark.sources.store import open_store
from tidemark.sources.wire import ConnectionFailed, ResponseTooLarge, UrlTransport

T0 = datetime(2024, 3, 4, 9, tzinfo=UTC)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("served") / "db")
    given = {"duid": "1001", "title": "Notice", "category_id": "general", "category_name": "일반", "posted_date": date(2024, 3, 1), "updated_date": date(2024, 3, 1), "department": "Desk", "source_url": "u", "body": "Body", "attachments_present": False, "pinned": False}
    row = spark.createDataFrame([tuple(given.get(f) for f in NOTICES.fieldNames())], NOTICES).withColumn("seq", F.lit(0).cast("long"))
    open_store(spark, root).save_details(row, T0)
    return NoticeService(spark, root, clock=lambda: T0)


def asked(method, params=None, key=1, **more):
    return json.dumps({"jsonrpc": "2.0", "id": key, "method": method} | ({} if params is None else {"params": params}) | more)


def called(server, name, arguments):
    return server.answer(asked("tools/call", {"name": name, "arguments": arguments}))["result"]


def test_handshake_and_list(service):
    server = ToolServer(service)
    for wanted, got in ((VERSIONS[2], VERSIONS[2]), ("1999-01-01", VERSIONS[0]), (None, VERSIONS[0])):
        reply = server.answer(asked("initialize", {"protocolVersion": wanted, "capabilities": {}, "clientInfo": {"name": "t", "version": "0"}}, key="a"))
        assert reply["id"] == "a" and reply["result"]["protocolVersion"] == got and "tools" in reply["result"]["capabilities"]
    assert server.answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert server.answer(asked("ping"))["result"] == {}
    tools = server.answer(asked("tools/list"))["result"]["tools"]
    assert [t["name"] for t in tools] == ["search_notices", "get_notice", "list_latest_notices", "list_categories"]
    assert tools[1]["inputSchema"]["required"] == ["duid"] and set(tools[0]["inputSchema"]["properties"]) == {"query", "category", "published_from", "published_to", "limit", "offset"}


def test_calls_answer_as_the_service(service):
    server = ToolServer(service)
    for name, given in (("search_notices", {"query": "Notice"}), ("get_notice", {"duid": "1001"}), ("list_latest_notices", {"limit": 1, "category": None}), ("list_categories", {})):
        got = called(server, name, given)
        assert got["isError"] is False and json.loads(got["content"][0]["text"]) == json.loads(json.dumps(got["structuredContent"]))
        assert got["structuredContent"] == as_json(getattr(service, name)(**given)) and got["structuredContent"]["error"] is None
    assert called(server, "get_notice", {"duid": "1001"})["structuredContent"]["notice"]["body"] == "Body"
    # A value of the right type that the query refuses is an answer of the query.
    refused = called(server, "search_notices", {"limit": 99})
    assert refused["isError"] is False and refused["structuredContent"]["error"]["code"] == "invalid_input"


def test_malformed_input_is_bounded_and_the_server_stays_usable(service):
    server, secret = ToolServer(service), "not-to-be-repeated"
    for name, given in (("search_notices", {"query": [secret]}), ("get_notice", {}), ("get_notice", {"duid": 5}), ("list_latest_notices", {"limit": secret}), ("list_latest_notices", {"offset": True})):
        got = called(server, name, given)
        assert got["isError"] is True and "Traceback" not in str(got) and secret not in str(got)
    codes = {
        "nonsense": PARSE_ERROR,
        "[" * 100_000: PARSE_ERROR,
        "[]": INVALID_REQUEST,
        '{"id": 1, "method": "ping"}': INVALID_REQUEST,
        asked("ping", key=[1]): INVALID_REQUEST,
        asked(7): INVALID_REQUEST,
        " " * MAX_LINE + "{}": INVALID_REQUEST,
        asked("resources/list"): NO_METHOD,
        asked("tools/call", [1]): INVALID_PARAMS,
        asked("tools/call", {"name": "drop"}): INVALID_PARAMS,
        asked("tools/call", {"name": ["drop"]}): INVALID_PARAMS,
        asked("tools/call", {"name": "list_categories", "arguments": [1]}): INVALID_PARAMS,
    }
    for line, code in codes.items():
        assert server.answer(line)["error"]["code"] == code, line[:80]
    assert server.answer('{"jsonrpc": "2.0", "id": 3, "result": {}}') is None
    assert called(server, "list_categories", {})["isError"] is False


def test_a_failing_tool_is_an_answer():
    class Broken:
        def list_categories(self):
            raise RuntimeError("secret")

    got = called(ToolServer(Broken()), "list_categories", {})
    assert got["isError"] is True and "secret" not in str(got)


def test_lines_in_and_out(spark, tmp_path):
    gone = NoticeService(spark, f"{tmp_path}/none")
    out = io.StringIO()
    given = [asked("tools/call", {"name": "list_categories"}), "", '{"jsonrpc": "2.0", "method": "notifications/x"}', '"' + "x" * (3 * MAX_LINE) + '"', asked("ping", key=2)]
    serve(gone, io.StringIO("\n".join(given)), out)
    replies = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, None, 2] and replies[1]["error"]["code"] == INVALID_REQUEST
    assert replies[0]["result"]["structuredContent"]["error"]["code"] == "storage_unavailable" and not (tmp_path / "none").exists()
    assert set(TOOLS) == {"search_notices", "get_notice", "list_latest_notices", "list_categories"}


# Transport


def answering(*parts, pause=0.0, close=True):
    """The address of a server that sends these bytes to one caller and, if asked for, then closes."""
    listener = socket.create_server(("127.0.0.1", 0))

    def run():
        own, _ = listener.accept()
        own.recv(65536)
        try:
            for part in parts:
                own.sendall(part)
                time.sleep(pause)
            if not close:
                time.sleep(5)
        except OSError:
            pass
        own.close()
        listener.close()

    threading.Thread(target=run, daemon=True).start()
    return f"http://127.0.0.1:{listener.getsockname()[1]}/x"


def test_transport_limits(monkeypatch):
    for name in ("http_proxy", "HTTP_PROXY", "all_proxy", "ALL_PROXY"):
        monkeypatch.delenv(name, raising=False)
    got = UrlTransport().request(answering(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\n", b"ok"))
    assert (got.status, got.body, got.media_type) == (200, b"ok", "text/html")
    for status in (302, 404, 503):
        got = UrlTransport().request(answering(b"HTTP/1.1 %d X\r\nLocation: /y\r\nContent-Length: 1\r\n\r\nz" % status))
        assert (got.status, got.body, got.header("location")) == (status, b"z", "/y")
    chunked = answering(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n")
    assert UrlTransport().request(chunked).body == b"abc"
    monkeypatch.setattr(wire, "MAX_BODY", 1000)
    assert len(UrlTransport().request(answering(b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1000)).body) == 1000
    with pytest.raises(ResponseTooLarge):
        UrlTransport().request(answering(b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1001))
    monkeypatch.setattr(wire, "READ_TIMEOUT", 0.3)
    broken = {
        "cut short": answering(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc"),
        "cut in a chunk": answering(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc"),
        "no reply": answering(close=False),
        "body stops": answering(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc", close=False),
        "not HTTP": answering(b"hello\r\n\r\n"),
    }
    for name, at in broken.items():
        with pytest.raises(ConnectionFailed):
            UrlTransport().request(at), name
    began = time.monotonic()
    with pytest.raises(ConnectionFailed):  # each byte comes in time, the whole doesn't
        UrlTransport(body_seconds=0.5).request(answering(b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n", *[b"x"] * 90, pause=0.1))
    assert time.monotonic() - began < 3
