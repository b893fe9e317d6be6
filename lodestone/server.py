"""Tool server: the three query tools as JSON-RPC 2.0 over lines of standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import TextIO

from lodestone.operators.search import Retriever

_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
TOOLS = {
    "search_documents": ("Search the collection for passages.", {"query": _TEXT, "top_k": _NUMBER, "min_math_density": _NUMBER}, "query"),
    "search_code": ("Search the collection for code, with the class around a method.", {"query": _TEXT, "language": _TEXT, "top_k": _NUMBER}, "query"),
    "lookup_index": ("Find where a concept is defined.", {"concept": _TEXT}, "concept"),
}


def listed() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": [r]}} for n, (d, p, r) in TOOLS.items()]


def call(tools: Retriever, name: str, given: dict) -> str:
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    args = {"top" if k == "top_k" else k: int(v) if k == "top_k" else v for k, v in given.items() if k in TOOLS[name][1]}
    return getattr(tools, name)(**args)


def answer(tools: Retriever, message: dict) -> dict | None:
    """The reply to a message; none to a notification."""
    if "id" not in message:
        return None
    reply, params = {"jsonrpc": "2.0", "id": message["id"]}, message.get("params") or {}
    try:
        match message.get("method"):
            case "initialize":
                result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": listed()}
            case "tools/call":
                result = {"content": [{"type": "text", "text": call(tools, params.get("name"), params.get("arguments") or {})}]}
            case other:
                return reply | {"error": {"code": -32601, "message": f"unknown method: {other}"}}
    except Exception as e:  # a failed call must not end the server
        return reply | {"error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:500]}}
    return reply | {"result": result}


def serve(tools: Retriever, source: Iterable[str] = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer messages, one on a line, until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        else:
            reply = answer(tools, message)
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)
