import json
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import evals, health, memory
from lodequery.operators.documents import find_passages, ingest_files, source_listing
from lodequery.plans import texts
from lodequery.sources import files
from lodequery.sources.store import OutOfOrderWrite, VectorStore
from lodequery.sources.wal import LogWriter, Record, WalDataSource, append_log, read_log
from lodequery.streaming.ingest import Watch, read_replayed, replay

GUIDE = "Intro line.\n\n# Guide\n\nText of the guide.\n\n## Install\n\n```\n# not a heading\n```\n\n## Usage\n### Search ##\nAsk it!\n"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_hashed_vectors_agree(spark):
    texts = ["The cats and the cat", "Glass classes, 42!", "the and of", "", None, "a" * 5000 + " word"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", T.hashed_vector("t").alias("a"), T.hash_embed_udf()("t").alias("b")).collect()
    for r in rows:
        want = T.hash_embed(texts[r["id"]])
        assert np.allclose(r["b"], want) and (r["a"] is None or np.allclose(r["a"], want))
    sparse = {(r[0], r[1]): r[2] for r in T.hashed_weights(df, "id", "t").collect()}
    assert {k[0] for k in sparse} == {0, 1, 5} and all(math.isclose(T.hash_embed(texts[i])[b], w) for (i, b), w in sparse.items())
    assert T.hash_embed("Cats") == T.hash_embed("cat") and T.hash_embed("glass") != T.hash_embed("glas")
    assert not any(T.hash_embed("the and of"))
    assert (zlib.crc32(b"cat") % 512) in {k[1] for k in sparse if k[0] == 0}
    with pytest.raises(ValueError, match="hash"):
        T.get_embedder("none")
    with pytest.raises(T.EmbedderUnavailable):
        T.get_embedder("onnx", model_path="/none", tokenizer_path="/none")


def test_small_texts(spark):
    ages = [(5.0, "just now"), (60.0, "1 minute ago"), (7199.0, "1 hour ago"), (3 * 86400.0, "3 days ago")]
    assert [one(spark, s, T.describe_age("x"), "double") for s, _ in ages] == [t for _, t in ages]
    assert one(spark, "a  b\nc", T.snippet("x")) == "a b c"
    long = one(spark, "word " * 100, T.snippet("x"))
    assert long.endswith("word ...") and len(long) <= 244
    assert one(spark, "x\n **Outcome:** fixed \nOutcome: Nothing wrong.", T.claimed_outcome("x")) == "nothing wrong"
    assert one(spark, "fixed", T.claimed_outcome("x")) is None
    assert one(spark, "One. Two! three? (Four)", T.sentences("x")) == ["One.", "Two! three?", "(Four)"]
    assert one(spark, "/a/b/c.md", T.display_path("x", "/a/b")) == "c.md" and one(spark, "/z", T.display_path("x", "/a")) == "/z"
    assert T.parse_address("h:1=p:2") == ("h", 1, "p:2") and T.parse_address("h:1") == ("h", 1, "h:1")
    assert T.parse_addresses("h:1, g:2=p:3,") == [("h", 1, "h:1"), ("g", 2, "p:3")]
    with pytest.raises(ValueError):
        T.parse_address("nothing")


def test_files(spark, tmp_path):
    (tmp_path / ".cache").mkdir()
    for name, body in (("guide.md", GUIDE), ("notes.txt", "# just text\nMore."), ("image.png", "x"), (".cache/hidden.md", "x"), (".dot.md", "x")):
        (tmp_path / name).write_text(body)
    found = files.find_documents(spark, [str(tmp_path), str(tmp_path / "image.png"), str(tmp_path / "guide.md")])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["guide.md", "image.png", "notes.txt"]
    with pytest.raises(FileNotFoundError):
        files.find_documents(spark, [str(tmp_path / "none")])
    (tmp_path / "words.txt").write_text("the 1 2\ncat 3 4\n")
    assert [tuple(r) for r in files.read_word_vectors(spark, str(tmp_path / "words.txt"), 2).orderBy("id").collect()] == [(0, "the", [1.0, 2.0]), (1, "cat", [3.0, 4.0])]
    with pytest.raises(Exception, match="3 parts"):
        files.read_word_vectors(spark, str(tmp_path / "words.txt"), 3).collect()
    (tmp_path / "q.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in files.read_jsonl(spark, str(tmp_path / "q.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "log").write_text("\n".join(map(str, range(300))))
    assert [r["value"] for r in files.tail(spark, str(tmp_path / "log"), 3).collect()] == ["297", "298", "299"]
    assert files.tail(spark, str(tmp_path / "log"), 1000).count() == 100
    (tmp_path / "env").write_text("# c\nexport A='1 2'\nB=x=y\nbad\nC=9\n")
    assert files.read_env(str(tmp_path / "env"), {"C": "1"}) == {"A": "1 2", "B": "x=y"}
    base, held = files.hold_out(spark.range(100), "id", 50, 10, 3)
    held_ids = {r[0] for r in held.collect()}
    assert len(held_ids) == 10 and [r[0] for r in base.orderBy("id").collect()] == [i for i in range(100) if i not in held_ids][:50]
    assert files.make_vectors(spark, 5, 3, 1).select(F.size("vec")).distinct().collect() == [(3,)]


def test_ingest_once_by_content(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "guide.md").write_text(GUIDE)
    (docs / "cats.txt").write_text("Cats purr and sleep. Rockets don't.")
    store = VectorStore(spark, str(tmp_path / "store"), 2)
    first = ingest_files(spark, store, [str(docs)], "alice")
    assert first.new == 2 and first.passages == 5
    again = ingest_files(spark, store, [str(docs)], "alice")
    assert not again.new and again.unchanged == 2 and again.passages == 0
    (docs / "cats.txt").write_text("Dogs bark.")
    (docs / "blank.txt").write_text(" \n")
    third = ingest_files(spark, store, [str(docs)], "alice")
    assert third.new == 1 and third.passages == 0 and ingest_files(spark, store, [str(docs)], "alice").new == 0
    assert [r["key"].rsplit("/", 1)[1] for r in third.files.where("state = 'changed'").collect()] == ["cats.txt"]
    hit = find_passages(store, "do cats purr?", 1, "alice").first()
    assert hit["snippet"].startswith("Cats purr") and hit["chunk"] == 0
    assert find_passages(store, "cats", 3, "nobody").count() == 0
    assert ingest_files(spark, store, [str(docs)], "bob").new == 3


def test_store(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((30, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], json.dumps({"n": i % 3}) if i % 4 else None) for i, r in enumerate(x)], "k int, vec array<double>, p string")
    store = VectorStore(spark, str(tmp_path / "s"), 4)
    assert store.search([1.0] * 8, 3).count() == 0
    assert store.add(df.where("k < 20"), "vec", "p", order="k") == 1 and store.add(df.where("k >= 20"), "vec", "p", "alice", "k") == 2
    with pytest.raises(OutOfOrderWrite):
        store.add(df, "vec", seq=9)
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([([1.0],)], "vec array<double>"))
    with pytest.raises(ValueError):
        store.add(df.withColumn("p", F.lit('{"_namespace": "x"}')), "vec", "p")
    with pytest.raises(ValueError):
        store.add(df, "vec", namespace="")
    rows = store.rows()
    assert sorted(r[0] for r in rows.select("id").collect()) == list(range(30))
    assert {r[0] for r in rows.where("namespace = 'alice'").select("shard").distinct().collect()} == {3}
    q = [float(v) for v in x[21]]
    got = store.search(q, 4, namespace="alice").collect()
    assert got[0]["id"] == 21 and all(json.loads(r["payload"])["_namespace"] == "alice" for r in got)
    assert store.search(q, 50, {"n": 1}).count() == sum(1 for i in range(30) if i % 4 and i % 3 == 1)
    before = [tuple(r) for r in store.search(q, 9).collect()]
    assert store.records_after(1).count() == 10
    store.compact()
    assert [tuple(r) for r in VectorStore(spark, str(tmp_path / "s")).search(q, 9).collect()] == before
    assert store.records_after(1) is None and store.records_after(2).count() == 0
    store.export(str(tmp_path / "e"))
    other = VectorStore(spark, str(tmp_path / "o"), 4)
    other.install(str(tmp_path / "e"), 2)
    assert [tuple(r) for r in other.search(q, 9).collect()] == before and other.state["next_id"] == 30


def test_log_source_stops_at_damage(spark, tmp_path):
    spark.dataSource.register(WalDataSource)
    x = np.arange(20, dtype=np.float32).reshape(10, 2)
    path = str(tmp_path / "a.log")
    assert len(Record(1, list(range(10)), np.zeros((10, 16))).encode()) == 8 + 16 + 10 * 8 + 10 * 16 * 4
    append_log(path, Record(1, list(range(10)), x), Record(2, [10], x[:1], ["ä"]), Record(3, [], x[:0]))
    df = spark.read.format("lodequery_wal").load(path)
    assert df.count() == 11 and df.where("seq = 2").first()["payload"] == "ä"
    assert spark.read.format("lodequery_wal").option("after", 1).load(str(tmp_path)).count() == 1
    data = bytearray((tmp_path / "a.log").read_bytes())
    (tmp_path / "b.log").write_bytes(bytes(data[:-3]))
    assert [r.seq for r in read_log(str(tmp_path / "b.log"))] == [1, 2]
    data[30] ^= 1
    (tmp_path / "c.log").write_bytes(bytes(data))
    assert list(read_log(str(tmp_path / "c.log"))) == []
    whole = (tmp_path / "a.log").read_bytes()
    (tmp_path / "torn.log").write_bytes(whole[:-3])
    with LogWriter(str(tmp_path / "torn.log")) as log:  # what was torn goes, what comes after can be read
        log.append(Record(7, [1], x[:1]))
        log.append(Record(8, [2], x[:1]))
        assert [r.seq for r in read_log(str(tmp_path / "torn.log"))] == [1, 2, 7, 8]
        log.reset()
        log.append(Record(9, [2], x[:1]))
    assert [r.seq for r in read_log(str(tmp_path / "torn.log"))] == [9]


def test_memory(spark, tmp_path):
    now = [1.8e9]
    store = memory.MemoryStore(spark, str(tmp_path / "m"), "ann", clock=lambda: now[0])
    assert store.recall("anything") == []
    first, stored = store.remember(" The printer is on floor two ", ["b", "a", "b"])
    assert stored and store.remember("the printer is on floor two!") == (first, False)
    now[0] += 60 * 86400
    second, _ = store.remember("The printer moved to floor five", replaces=[first, first])
    got = store.recall("where is the printer", 3)
    assert [m["memory_id"] for m in got] == [second]
    with pytest.raises(ValueError):
        store.remember("x", replaces=[first])
    with pytest.raises(ValueError):
        store.forget(first)
    with pytest.raises(ValueError):
        store.remember("  ")
    store.forget(second)
    assert store.recall("printer") == []
    assert memory.MemoryStore(spark, str(tmp_path / "m"), "bob").recall("printer") == []
    for bad in ("", " ", "x" * 129, 7):
        with pytest.raises(ValueError):
            memory.MemoryStore(spark, str(tmp_path / "m"), bad)
    ages = spark.createDataFrame([(0.0,), (30 * 86400.0,), (-5.0,)], "a double").select(memory.recency(F.col("a"))).collect()
    assert [round(r[0], 4) for r in ages] == [0.03, 0.015, 0.03]


def test_health(spark):
    schema = "shard int, replica int, up boolean, process boolean, size bigint, last_seq bigint, snapshot_seq bigint"
    df = spark.createDataFrame(
        [(0, 0, True, True, 5, 3, 0), (0, 1, True, True, 4, 2, 0), (1, 0, False, False, 0, 0, 0), (1, 1, False, True, 0, 0, 0), (2, 0, True, True, 9, 9, 7), (2, 1, True, True, 1, 2, 0)],
        schema,
    )
    got = [r["problem"] for r in health.find_problems(df).orderBy("shard", "kind", "replica").collect()]
    assert got == [
        "replicas of shard 0 are out of sync (replica 0 at seq 3, replica 1 at seq 2)",
        "shard 1 replica 0 is down",
        "shard 1 replica 1 does not answer, although its process is running",
        "shard 1 has no live replica: searches that need it fail",
        "replicas of shard 2 are out of sync (replica 0 at seq 9, replica 1 at seq 2)",
    ]
    plan = {tuple(r) for r in health.repair_plan(df).collect()}
    assert plan == {(0, 1, 0, "log", 1), (2, 1, 0, "snapshot", 7)}
    assert tuple(health.status(df).first()) == (6, 4, 3, 14)
    assert health.find_problems(df.limit(0)).count() == 0
    seen = []
    watch = Watch(seen.append)
    watch.look(df)
    watch.look(df)
    watch.look(df.where("shard = 1"))
    assert len(seen) == 2
    log = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 5), (1, 2), (None, 1), (1, None)], "s int, q bigint")
    assert {tuple(r) for r in health.sequence_gaps(log, "s", "q").collect()} == {(0, 2, 5), (1, 0, 2)}


def test_measures(spark):
    bounds = spark.createDataFrame([(5, 10), (10, 10), (0, 0)], "s int, n int").select(*evals.wilson(F.col("s"), F.col("n"))).collect()
    assert [(round(a, 3), round(b, 3)) for a, b in bounds] == [(0.237, 0.763), (0.722, 1.0), (0.0, 1.0)]
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id int, row_id int")
    found = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1)], "query_id int, row_id int")
    assert tuple(evals.recall_at_k(found, truth).first()) == (2, 3, 0.666667, 0.75)
    assert evals.recall_at_k(found, truth.limit(0)).first()["recall"] is None
    q = spark.createDataFrame([(1, "keyword", "Cats"), (2, "paraphrase", "Rockets"), (3, "keyword", "x")], "qid int, kind string, want string")
    hits = spark.createDataFrame([(1, 1, "Cats"), (2, 1, "Cats"), (2, 3, "Rockets"), (2, 4, "Rockets")], "qid int, rank int, got string")
    rows = {r["kind"]: r for r in evals.rank_measures(evals.first_correct(hits, q, "qid", "rank", "got", "want"), "kind").collect()}
    assert rows["all"]["questions"] == 3 and rows["paraphrase"]["mrr"] == 0.333333 and rows["keyword"]["hit_at_1"] == 0.5
    s = spark.createDataFrame([("k1", "n", 3), ("k2", None, 4)], "k string, space string, p int")
    assert tuple(source_listing(s, "space", "p").first()) == (2, 7, "n")


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(0, 100, 1, 3).write.parquet(src)
    replay(spark, src, out, ck).awaitTermination()
    assert read_replayed(spark, out).select("seq").distinct().count() == 3
    spark.range(100, 120, 1, 1).write.mode("append").parquet(src)
    replay(spark, src, out, ck).awaitTermination()
    assert sorted(r["id"] for r in read_replayed(spark, out).collect()) == list(range(120))


def test_near_duplicates_have_no_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "_COPIES", 7)
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "a > b", words if i % 3 else f"{words} more{i}") for i in range(50, 201)]
    rows += [(i, "other", f"text number {i} of its own {i * i}") for i in range(201, 301)] + [(400, None, None), (500, "x", "")]
    spark.createDataFrame(rows, "passage_id bigint, heading string, text string").write.parquet(f"{tmp_path}/passages.parquet")
    got = texts.near_duplicates(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"create view passages as select * from read_parquet('{tmp_path}/passages.parquet/*.parquet')")
    want = db.execute(texts.SQL["near_duplicates"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len([r for r in got if r["query_id"] == 100]) == 150 and len(want) >= 300
