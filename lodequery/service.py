"""Tools over a store or a memory for programs that talk JSON-RPC, one message a line.

A tool is a Python function; its parameters' annotations are its contract: the JSON type, and for numbers a range.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, get_type_hints

from pyspark.sql import functions as F

from lodequery.functions.text import describe_age
from lodequery.operators.documents import find_passages, ingest_files, source_listing
from lodequery.operators.memory import MemoryStore
from lodequery.sources.store import VectorStore

# Fixed values of the protocol.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
MOST_RESULTS = 20

_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", list[str]: "array"}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: Any
    required: bool
    least: int | None = None
    most: int | None = None

    def schema(self) -> dict:
        own: dict[str, Any] = {"type": _JSON[self.kind]}
        if self.kind == list[str]:
            own["items"] = {"type": "string"}
        return own | {k: v for k, v in (("minimum", self.least), ("maximum", self.most)) if v is not None}

    def problem(self, value: Any) -> str | None:
        base = list if self.kind == list[str] else (int, float) if self.kind is float else self.kind
        if not isinstance(value, base) or (isinstance(value, bool) and self.kind is not bool):
            return f"{self.name} is no {_JSON[self.kind]}"
        if self.kind == list[str] and not all(isinstance(x, str) for x in value):
            return f"an item of {self.name} is no string"
        if self.least is not None and value < self.least:
            return f"{self.name} is below {self.least}"
        if self.most is not None and value > self.most:
            return f"{self.name} is above {self.most}"
        return None


class Tool:
    """``limits`` gives (least, most) by parameter. Defaults of None make a parameter optional."""

    def __init__(self, run: Callable[..., str], **limits: tuple[int, int]):
        self.run, self.name, self.about = run, run.__name__, (run.__doc__ or "").strip()
        hints = get_type_hints(run)
        self.parameters = {
            p.name: Parameter(p.name, hints[p.name].__args__[0] if type(None) in getattr(hints[p.name], "__args__", ()) else hints[p.name], p.default is p.empty, *limits.get(p.name, (None, None)))
            for p in inspect.signature(run).parameters.values()
        }

    def describe(self) -> dict:
        needed = [p.name for p in self.parameters.values() if p.required]
        return {
            "name": self.name,
            "description": self.about,
            "inputSchema": {"type": "object", "properties": {n: p.schema() for n, p in self.parameters.items()}, "required": needed},
        }

    def problems(self, arguments: Any) -> list[str]:
        if not isinstance(arguments, dict):
            return ["the arguments are no object"]
        missing = [f"{n} is missing" for n, p in self.parameters.items() if p.required and n not in arguments]
        unknown = [f"{n} is unknown" for n in arguments if n not in self.parameters]
        wrong = [x for n, v in arguments.items() if n in self.parameters and (x := self.parameters[n].problem(v))]
        return missing + unknown + wrong

    def call(self, arguments: Any) -> tuple[str, bool]:
        """(text, whether it failed). No failure of a tool ends the session."""
        if bad := self.problems(arguments):
            return f"{self.name}: {'; '.join(bad)}", True
        try:
            return self.run(**arguments), False
        except Exception as e:  # noqa: BLE001
            return f"{self.name}: {e}", True


class Session:
    def __init__(self, name: str, version: str, tools: Iterable[Tool]):
        self.info, self.tools = {"name": name, "version": version}, {t.name: t for t in tools}

    def _initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": self.info}

    def _call(self, params: dict) -> dict:
        tool = self.tools.get(params.get("name"))
        if tool is None:
            raise LookupError(f"no tool {params.get('name')!r}")
        text, failed = tool.call(params.get("arguments") or {})
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def answer(self, message: Any) -> Any:
        """The reply to a decoded message; None where none is due."""
        error = lambda i, code, text: {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}}
        if isinstance(message, list) and message:
            return [r for r in map(self.answer, message) if r is not None] or None
        own = message if isinstance(message, dict) else {}
        if not isinstance(own.get("method"), str):
            return error(own.get("id"), INVALID_REQUEST, "no request")
        if "id" not in own:
            return None
        methods = {
            "initialize": self._initialize,
            "ping": lambda _: {},
            "tools/list": lambda _: {"tools": [t.describe() for t in self.tools.values()]},
            "tools/call": self._call,
        }
        if own["method"] not in methods:
            return error(own["id"], METHOD_NOT_FOUND, f"no method {own['method']}")
        params = own.get("params") or {}
        if not isinstance(params, dict):
            return error(own["id"], INVALID_PARAMS, "params are no object")
        try:
            return {"jsonrpc": "2.0", "id": own["id"], "result": methods[own["method"]](params)}
        except LookupError as e:
            return error(own["id"], INVALID_PARAMS, str(e))

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
            except ValueError:
                yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "no JSON"}})
                continue
            if (reply := self.answer(message)) is not None:
                yield json.dumps(reply, ensure_ascii=False)


def document_tools(store: VectorStore, read_only: bool = False) -> list[Tool]:
    def search(question: str, k: int = 5, namespace: str | None = None, source: str | None = None) -> str:
        """Passages that are nearest to a question."""
        rows = find_passages(store, question, k, namespace, source).collect()
        text = [f"{i}. {r['source']} [{r['heading'] or '-'}] {1 - r['distance']:.3f}\n{r['snippet']}" for i, r in enumerate(rows, 1)]
        return "\n".join(text) or "nothing found"

    def ingest(paths: list[str], namespace: str | None = None) -> str:
        """Take in files or folders; what is known already is skipped, what has changed is reported."""
        r = ingest_files(store.spark, store, paths, namespace)
        return f"{r.new} new files, {r.passages} passages; {r.unchanged} unchanged; {r.changed} changed and left as they were"

    def status() -> str:
        """What the collection holds."""
        got = source_listing(store.sources(), "space", "passages").first()
        return f"{got['files']} files, {got['passages']} passages, namespaces: {got['namespaces'] or 'none'}, last write {store.state['seq']}"

    tools = [Tool(search, k=(1, MOST_RESULTS)), Tool(status)]
    return tools if read_only else [*tools, Tool(ingest)]


def memory_tools(memory: MemoryStore) -> list[Tool]:
    def recall(query: str, k: int = 5, tags: list[str] | None = None) -> str:
        """Memories that are most like a query, recent ones a little preferred."""
        found = memory.recall(query, k, tags)
        ages = memory.spark.createDataFrame([(i, max(0.0, memory.clock() - m["created"])) for i, m in enumerate(found)], "i int, s double")
        said = [r[0] for r in ages.orderBy("i").select(describe_age(F.col("s"))).collect()]
        return "\n".join(f"{m['memory_id']} ({age}): {m['text']}" for m, age in zip(found, said, strict=True)) or "nothing remembered"

    def remember(text: str, tags: list[str] | None = None, replaces: list[str] | None = None) -> str:
        """Keep a text, in place of others if named."""
        new, stored = memory.remember(text, tags, replaces)
        return f"remembered as {new}" if stored else f"known already as {new}"

    def forget(memory_id: str) -> str:
        """Take a memory back."""
        memory.forget(memory_id)
        return f"forgot {memory_id}"

    return [Tool(recall, k=(1, MOST_RESULTS)), Tool(remember), Tool(forget)]


