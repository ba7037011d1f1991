"""The four read queries as tools over standard input and output: JSON-RPC 2.0, one message a line.

Protocol: initialize, ping, tools/list and tools/call of the Model Context Protocol, written against its public text,
because no library for it is there. Output carries answers only. Whatever comes in, the server stays usable: a line
that isn't JSON, a wrong message and an unknown method have the codes of JSON-RPC; arguments of a wrong type and
failures inside a tool are answers with ``isError`` and a text that repeats nothing of what came in.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from typing import Any, TextIO

from tidemark.plans.service import NoticeService, as_json

# Of the protocol, newest version first.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

#: A longer line is refused unread; the longest sensible call has some thousand characters.
MAX_LINE = 1 << 20

_MAYBE_TEXT = {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}
_PAGE = {"limit": {"type": "integer", "default": 10}, "offset": {"type": "integer", "default": 0}}


def _tool(description: str, required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"description": description, "inputSchema": {"type": "object", "properties": properties, "required": list(required)}}


TOOLS = {
    "search_notices": _tool(
        "Ranked search of stored notices, narrowed by category and days of publication.",
        query={"type": "string", "default": ""}, category=_MAYBE_TEXT, published_from=_MAYBE_TEXT, published_to=_MAYBE_TEXT, **_PAGE,
    ),
    "get_notice": _tool("One stored notice with its body, by its number.", ("duid",), duid={"type": "string"}),
    "list_latest_notices": _tool("Stored notices, newest publication first.", category=_MAYBE_TEXT, **_PAGE),
    "list_categories": _tool("All categories of the catalog with their numbers of stored notices."),
}

_TYPES = {"string": lambda v: isinstance(v, str), "null": lambda v: v is None, "integer": lambda v: isinstance(v, int) and not isinstance(v, bool)}


class _Fault(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def _misfits(tool: dict, given: dict) -> list[str]:
    """Names of declared arguments that are missing or of a wrong type. Arguments beyond those are let pass."""
    schema = tool["inputSchema"]
    wrong = [name for name in schema["required"] if name not in given]
    for name, own in schema["properties"].items():
        if name in given and not any(_TYPES[one["type"]](given[name]) for one in own.get("anyOf", [own])):
            wrong.append(name)
    return wrong


def _said(text: str, **more: Any) -> dict:
    return {"content": [{"type": "text", "text": text}], **more}


class ToolServer:
    def __init__(self, service: NoticeService, name: str = "tidemark", version: str = "0.1"):
        self._service, self._info = service, {"name": name, "version": version}
        self._methods = {"initialize": self._initialize, "ping": lambda _: {}, "tools/list": self._list, "tools/call": self._call}

    def _initialize(self, params: dict) -> dict:
        wanted = params.get("protocolVersion")
        return {"protocolVersion": wanted if wanted in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": self._info}

    def _list(self, _: dict) -> dict:
        return {"tools": [{"name": name, **tool} for name, tool in TOOLS.items()]}

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments")
        given = {} if given is None else given
        if not isinstance(name, str) or name not in TOOLS:
            raise _Fault(INVALID_PARAMS, "no such tool")
        if not isinstance(given, dict):
            raise _Fault(INVALID_PARAMS, "arguments wants an object")
        if wrong := _misfits(TOOLS[name], given):
            return _said(f"missing or of a wrong type: {', '.join(wrong)}", isError=True)
        known = {k: v for k, v in given.items() if k in TOOLS[name]["inputSchema"]["properties"]}
        try:
            answer = as_json(getattr(self._service, name)(**known))
        except Exception:  # the next call must find a server; the cause goes to the log alone
            logging.getLogger("tidemark").exception("tool failed")
            return _said("the tool failed", isError=True)
        return _said(json.dumps(answer, ensure_ascii=False), structuredContent=answer, isError=False)

    def answer(self, line: str) -> dict | None:
        """The answer to one line; None to a notification."""
        key = None
        try:
            if len(line) > MAX_LINE:
                raise _Fault(INVALID_REQUEST, "message too long")
            try:
                asked = json.loads(line)
            except (ValueError, RecursionError) as error:
                raise _Fault(PARSE_ERROR, "not JSON") from error
            if not isinstance(asked, dict) or asked.get("jsonrpc") != "2.0":
                raise _Fault(INVALID_REQUEST, "not a JSON-RPC 2.0 message")
            if isinstance(own := asked.get("id"), str | int | float) and not isinstance(own, bool):
                key = own
            elif "id" in asked:
                raise _Fault(INVALID_REQUEST, "id wants text or a number")
            if "method" not in asked and ("result" in asked or "error" in asked):
                return None  # an answer; this server asks nothing
            method, params = asked.get("method"), asked.get("params")
            if not isinstance(method, str):
                raise _Fault(INVALID_REQUEST, "method wants text")
            if "id" not in asked:
                return None
            if method not in self._methods:
                raise _Fault(NO_METHOD, "no such method")
            params = {} if params is None else params
            if not isinstance(params, dict):
                raise _Fault(INVALID_PARAMS, "params wants an object")
            return {"jsonrpc": "2.0", "id": key, "result": self._methods[method](params)}
        except _Fault as fault:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": fault.code, "message": fault.message}}


def _lines(source: TextIO) -> Iterable[str]:
    """Lines of the input. One that is longer than MAX_LINE comes as its first part alone, still too long; the rest is skipped."""
    while line := source.readline(MAX_LINE + 1):
        part = line
        while len(part) > MAX_LINE and not part.endswith("\n"):
            part = source.readline(MAX_LINE + 1)
        yield line


def serve(service: NoticeService, source: TextIO, out: TextIO) -> None:
    """Answers line by line until the input ends."""
    server = ToolServer(service)
    for line in _lines(source):
        if line.strip() and (reply := server.answer(line)) is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
