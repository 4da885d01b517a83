import json

import pytest

from lodequery import cli
from lodequery.operators.memory import MemoryStore
from lodequery.service import Session, Tool, document_tools, memory_tools
from lodequery.sources.store import VectorStore


def echo(text: str, k: int = 1, tags: list[str] | None = None, loud: bool = False) -> str:
    """Say it again."""
    if text == "bad":
        raise RuntimeError("broke")
    return text * k


def test_arguments_are_checked():
    t = Tool(echo, k=(1, 3))
    assert t.describe()["inputSchema"]["required"] == ["text"] and t.describe()["inputSchema"]["properties"]["k"] == {"type": "integer", "minimum": 1, "maximum": 3}
    assert t.call({"text": "a", "k": 2}) == ("aa", False)
    for bad in ({}, {"text": 1}, {"text": "a", "k": True}, {"text": "a", "k": 4}, {"text": "a", "k": 0}, {"text": "a", "tags": [1]}, {"text": "a", "x": 1}, [], {"text": "bad"}):
        assert t.call(bad)[1]


def test_messages():
    s = Session("n", "1", [Tool(echo)])
    ask = lambda method, **params: s.answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "2025-06-18"
    assert ask("ping")["result"] == {} and ask("tools/list")["result"]["tools"][0]["name"] == "echo"
    assert ask("tools/call", name="echo", arguments={"text": "a"})["result"]["content"][0]["text"] == "a"
    assert ask("tools/call", name="none")["error"]["code"] == -32602 and ask("none")["error"]["code"] == -32601
    assert s.answer({"method": "ping"}) is None and s.answer([])["error"]["code"] == -32600 and s.answer(3)["error"]["code"] == -32600
    assert len(s.answer([{"id": 1, "method": "ping"}, {"method": "ping"}])) == 1
    lines = list(s.serve(["{", "", '{"id": 2, "method": "ping"}']))
    assert [json.loads(x).get("error", {}).get("code") for x in lines] == [-32700, None]


def test_tools_over_stores(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Cats\n\nCats purr at night.\n")
    tools = {t.name: t for t in document_tools(VectorStore(spark, str(tmp_path / "s")))}
    assert tools["ingest"].call({"paths": [str(tmp_path / "a.md")]}) == ("1 new files, 1 passages; 0 unchanged; 0 changed and left as they were", False)
    assert "Cats purr" in tools["search"].call({"question": "cats"})[0] and tools["status"].call({})[0].startswith("1 files, 1 passages")
    assert "ingest" not in {t.name for t in document_tools(VectorStore(spark, str(tmp_path / "s")), True)}
    m = {t.name: t for t in memory_tools(MemoryStore(spark, str(tmp_path / "m"), "ann"))}
    new = m["remember"].call({"text": "tea at four"})[0].split()[-1]
    assert m["recall"].call({"query": "tea"})[0] == f"{new} (just now): tea at four"
    assert m["forget"].call({"memory_id": new}) == (f"forgot {new}", False) and m["forget"].call({"memory_id": new})[1]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "w.txt").write_text("king 1 0\nqueen 0.9 0.1\npear 0 1\n")
    home = ["--home", str(tmp_path / "h")]
    assert cli.main([*home, "load", str(tmp_path / "w.txt"), "--dim", "2"]) == 0
    assert cli.main([*home, "load", str(tmp_path / "w.txt"), "--dim", "2"]) == 1
    assert cli.main([*home, "similar", "King", "-k", "1"]) == 0 and "queen" in capsys.readouterr().out
    assert cli.main([*home, "similar", "none"]) == 1
    docs = ["--home", str(tmp_path / "d")]
    (tmp_path / "b.txt").write_text("Rockets fly.")
    assert cli.main([*docs, "ingest", str(tmp_path / "b.txt")]) == 0
    assert cli.main([*docs, "search", "rockets", "--where", "chunk=0"]) == 0 and "Rockets fly" in capsys.readouterr().out
    assert cli.main([*docs, "search", "rockets", "--full"]) == 0 and "Rockets fly" in capsys.readouterr().out
    assert cli.main([*docs, "ingest", str(tmp_path / "b.txt"), "--chunk-chars", "100", "--overlap", "10"]) == 0 and "1 unchanged" in capsys.readouterr().out
    assert cli.main([*docs, "ops", "check"]) == 0 and cli.main([*docs, "repair", "--dry-run"]) == 0 and "Nothing to repair" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", iter(['{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "probe_search"}}']))
    assert cli.main([*docs, "serve", "--ops"]) == 0 and "hold nothing to search" in capsys.readouterr().out
    assert cli.main([*docs, "compact"]) == 0 and cli.main([*docs, "status"]) == 0
    assert cli.main([*docs, "memory", "--owner", "ann", "remember", "tea"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])
