"""Command line: python -m lodequery.cli --home FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from lodequery import __version__
from lodequery.functions.filters import parse_where
from lodequery.functions.text import hash_embed
from lodequery.operations import Journal, Operations, run_runbook
from lodequery.operators.documents import ingest_files
from lodequery.operators.memory import MemoryStore
from lodequery.operators.replicas import Replicas
from lodequery.service import Session, document_tools, memory_tools
from lodequery.session import local_session
from lodequery.sources.files import read_word_vectors
from lodequery.sources.store import VectorStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodequery", description="Search vectors, documents and memories.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--home", default="data/store", help="folder of the store")
    p.add_argument("--shards", type=int, default=4, help="of a new store")
    c = p.add_subparsers(dest="command", required=True)
    load = c.add_parser("load", help="word vectors of a text file, the first ones")
    load.add_argument("file")
    load.add_argument("--dim", type=int, default=100)
    load.add_argument("--words", type=int, default=100_000)
    similar = c.add_parser("similar", help="words like a word")
    similar.add_argument("word")
    ingest = c.add_parser("ingest", help="files or folders")
    ingest.add_argument("paths", nargs="+")
    ingest.add_argument("--embedder", default="hash")
    ingest.add_argument("--chunk-chars", type=int, default=1000)
    ingest.add_argument("--overlap", type=int, default=150)
    search = c.add_parser("search", help="passages for a question")
    search.add_argument("question")
    search.add_argument("--full", action="store_true", help="whole passages instead of snippets")
    search.add_argument("--where", action="append", default=[], metavar="FIELD=VALUE")
    for x in (similar, search):
        x.add_argument("-k", type=int, default=5)
    for x in (ingest, search):
        x.add_argument("--namespace")
    c.add_parser("status", help="what the store holds")
    c.add_parser("compact", help="fold the log into a new base")
    serve = c.add_parser("serve", help="JSON-RPC on standard input and output")
    serve.add_argument("--read-only", action="store_true")
    serve.add_argument("--owner", help="serve this owner's memory instead of documents")
    serve.add_argument("--ops", action="store_true", help="serve the tools that look after copies of shards")
    repair = c.add_parser("repair", help="bring copies of shards in the home folder up to date")
    ops = c.add_parser("ops", help="look after copies of shards in the home folder")
    ops.add_argument("action", choices=["check", "fix"])
    for x in (repair, ops):
        x.add_argument("--dry-run", action="store_true")
    memory = c.add_parser("memory")
    memory.add_argument("--owner", required=True)
    m = memory.add_subparsers(dest="action", required=True)
    remember = m.add_parser("remember")
    remember.add_argument("text")
    remember.add_argument("--tag", action="append", dest="tags")
    remember.add_argument("--replaces", action="append")
    recall = m.add_parser("recall")
    recall.add_argument("query")
    recall.add_argument("-k", type=int, default=5)
    recall.add_argument("--tag", action="append", dest="tags")
    m.add_parser("forget").add_argument("memory_id")
    return p


def similar_words(store: VectorStore, word: str, k: int) -> list[tuple[str, float]]:
    """The k nearest words but itself: one more is asked for."""
    own = store.rows().where(f"get_json_object(payload, '$.word') = '{word.lower()}'" if "'" not in word else "false").select("vec").limit(1).collect()
    if not own:
        raise ValueError(f"no word {word!r}")
    hits = store.search(own[0]["vec"], k + 1).selectExpr("get_json_object(payload, '$.word') as word", "1 - distance as similarity").collect()
    return [(h["word"], h["similarity"]) for h in hits if h["word"] != word.lower()][:k]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    try:
        if a.command == "memory" or (a.command == "serve" and a.owner):
            tools = {t.name: t for t in memory_tools(MemoryStore(spark, f"{a.home}/memory", a.owner))}
            if a.command == "memory":
                names = tools[a.action].parameters
                text, failed = tools[a.action].call({k: v for k, v in vars(a).items() if k in names and v is not None})
                print(text, file=sys.stderr if failed else sys.stdout)
                return int(failed)
        if a.command in ("repair", "ops"):
            look = Operations(Replicas(spark, f"{a.home}/copies", a.shards), Journal(f"{a.home}/journal.jsonl"), a.dry_run)
            if a.command == "repair":
                print(look.repair())
            elif a.action == "check":
                print(look.cluster_status())
                return int(bool(look.problems()))
            else:
                print(run_runbook(look))
            return 0
        if a.command == "serve" and a.ops:
            tools = {t.name: t for t in Operations(Replicas(spark, f"{a.home}/copies", a.shards), Journal(f"{a.home}/journal.jsonl")).tools()}
        store = VectorStore(spark, a.home, a.shards)
        if a.command == "serve":
            chosen = tools.values() if a.owner or a.ops else document_tools(store, a.read_only)
            for line in Session("lodequery", __version__, chosen).serve(sys.stdin):
                print(line, flush=True)
        elif a.command == "load":
            if store.state["seq"]:
                raise ValueError("the store isn't empty")
            words = read_word_vectors(spark, a.file, a.dim).orderBy("id").limit(a.words)
            store.add(words.selectExpr("id", "vec", "to_json(struct(word)) as payload"), "vec", "payload", order="id")
            print(f"{store.state['next_id']} words")
        elif a.command == "similar":
            for rank, (word, similarity) in enumerate(similar_words(store, a.word, a.k), 1):
                print(f"{rank:3} {word} {similarity:.4f}")
        elif a.command == "ingest":
            r = ingest_files(spark, store, a.paths, a.namespace, a.embedder, a.chunk_chars, a.overlap)
            print(f"{r.new} new files, {r.passages} passages; {r.unchanged} unchanged; {r.changed} changed and left as they were")
        elif a.command == "search" and (a.where or a.full):
            for r in store.search(hash_embed(a.question), a.k, parse_where(a.where) or None, a.namespace).collect():
                print(f"{1 - r['distance']:.4f} {r['payload']}")
        elif a.command == "compact":
            store.compact()
        else:
            tool = {t.name: t for t in document_tools(store)}[a.command]
            text, failed = tool.call({k: v for k, v in vars(a).items() if k in tool.parameters and v is not None})
            print(text, file=sys.stderr if failed else sys.stdout)
            return int(failed)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
