import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.llm import packing
from lodequery.llm.packing import PATTERN, TOKENIZERS, VOCABULARY, _encoding, corpus_shares, fill_containers, mixture, pack, pack_documents, room_left, token_counts

SIZES, LIMITS = "doc_id bigint, source string, n_tokens bigint", "limit_name string, capacity_tokens bigint, part int"


def test_containers_hold_everything_once():
    rng = random.Random(3)
    for cap in (10, 97, 512):
        sizes = [[rng.randrange(0, cap + 1) for _ in range(rng.randrange(0, 120))] for _ in range(5)]
        share = np.array([sum(s) for s in sizes], float) / max(1, sum(map(sum, sizes)))
        got = fill_containers(sizes, share, np.zeros(5), cap)
        assert sorted(x for c in got for x in c) == [(s, i) for s in range(5) for i in range(len(sizes[s]))]
        assert all(sum(sizes[s][i] for s, i in c) <= cap for c in got)
        total = sum(map(sum, sizes))
        assert len(got) <= 1.07 * total / cap + 2
    assert fill_containers([[], []], np.zeros(2), np.zeros(2), 5) == []


def test_windows_keep_the_mixture():
    rng = random.Random(4)
    sizes = [[rng.randrange(1, 60) for _ in range(n)] for n in (3000, 1500, 500)]
    share = np.array([sum(s) for s in sizes], float) / sum(map(sum, sizes))
    got = fill_containers(sizes, share, np.zeros(3), 512)
    for w in range(0, len(got) - 32, 32):
        own = np.array([sum(sizes[s][i] for c in got[w : w + 32] for s, i in c if s == k) for k in range(3)], float)
        assert np.abs(own / own.sum() - share).max() < 0.08
    owed = fill_containers([[10] * 50, [10] * 50], np.array([0.5, 0.5]), np.array([200.0, -200.0]), 100)
    assert [s for c in owed[:2] for s, _ in c] == [0] * 20  # what is owed from before comes first


def test_given_targets_hold_until_a_source_is_used_up():
    rng = np.random.default_rng(1)
    sizes = [np.minimum(2048, np.maximum(1, rng.lognormal(5.3, 1.1, n).astype(int))) for n in (9000, 5000, 4000)]
    share = np.array([0.2, 0.2, 0.6])
    got = fill_containers(sizes, share, np.zeros(3), 2048)
    left = np.array([s.sum() for s in sizes], float)
    assert len(got) <= 1.001 * left.sum() / 2048 + 1
    windows = 0
    for w in range(0, len(got), 64):
        own = np.array([sum(int(sizes[s][i]) for c in got[w : w + 64] for s, i in c if s == k) for k in range(3)], float)
        left -= own
        if (left <= 0).any():
            break
        assert np.abs(own / own.sum() - share).max() < 0.02
        windows += 1
    assert windows > 10


def test_the_best_fit_of_very_many_sources_is_found():
    rng = random.Random(6)
    sizes = [[rng.randrange(1, 300) for _ in range(3)] for _ in range(500)]
    share = np.array([sum(s) for s in sizes], float) / sum(map(sum, sizes))
    got = fill_containers(sizes, share, np.zeros(500), 512)
    assert sorted(x for c in got for x in c) == [(s, i) for s in range(500) for i in range(3)]
    assert len(got) <= 1.01 * sum(map(sum, sizes)) / 512 + 1


def test_pieces_and_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(3000)] + [(7, "a", 40)]
    limits = spark.createDataFrame([("s", 100, 1), ("s", 100, 1), ("l", 700, 2), ("none", 0, 3), ("null", None, 4)], LIMITS)
    out = pack(spark.createDataFrame(rows, SIZES), limits, items=500).cache()
    for name, cap in (("s", 100), ("l", 700)):
        own = out.where(F.col("limit_name") == name)
        assert own.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > cap).count() == 0
        pieces = own.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("piece_no").alias("p")).collect()
        want = {}
        for d, _, n in rows:
            want.setdefault(d, []).append(n)
        assert {r["doc_id"]: r["t"] for r in pieces} == {d: sum(n) for d, n in want.items()}
        assert all(r["n"] == sum(max(1, -(-n // cap)) for n in want[r["doc_id"]]) for r in pieces)
        assert own.where((F.col("n_tokens") < cap) & (F.col("piece_no") > 0) & (F.col("first_token") != F.col("piece_no") * cap)).count() == 0
    room = {r["limit_name"]: r["empty_share"] for r in room_left(out).collect()}
    assert set(room) == {"s", "l"} and max(room.values()) < 0.05
    assert pack(spark.createDataFrame([], SIZES), limits).count() == 0
    assert pack(spark.createDataFrame(rows, SIZES), limits.where("part > 2")).count() == 0


def test_targets(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(400)]
    targets = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double")
    limits = spark.createDataFrame([("x", 100, 0)], LIMITS)
    out = pack(spark.createDataFrame(rows, SIZES), limits, targets)
    first = out.where("container_id < 10").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    assert {r["source"]: r["t"] for r in first}["a"] >= 850


def test_partitions_share_tasks_and_windows_are_measured(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(1, 90)) for i in range(6000)]
    sizes, limits = spark.createDataFrame(rows, SIZES), spark.createDataFrame([("x", 100, 0), ("y", 300, 0)], LIMITS)
    many = pack(sizes, limits, items=400).orderBy("limit_name", "container_id", "place").collect()
    monkeypatch.setattr(packing, "MOST_TASKS", 3)
    out = pack(sizes, limits, items=400).cache()
    assert out.orderBy("limit_name", "container_id", "place").collect() == many
    whole = pack(sizes, limits).cache()  # one partition, so that no window but the last is short
    got = {r["limit_name"]: r for r in mixture(whole, corpus_shares(whole)).collect()}
    assert set(got) == {"x", "y"} and all(r["mean_off"] < 0.03 and r["windows"] > 10 for r in got.values()), got


def test_tokens_of_whole_texts(spark):
    long = ("alpha beta " * 30_000) + "x" * 5000
    rows = [(1, "hello world", "s"), (2, None, None), (3, "", "s"), (4, long, "s"), (None, "x", "s"), (5, "😀 é\n\n  z", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text", "source").collect()}
    e = _encoding(TOKENIZERS, VOCABULARY)
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t, _ in rows if i}
    packed = pack_documents(df, spark.createDataFrame([("x", 512, 0)], LIMITS))
    assert packed.select("doc_id").distinct().count() == 5 and packed.where("doc_id = 4").count() == -(-got[4] // 512)
    assert PATTERN.endswith("\\s+")


def test_too_many_limits(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], SIZES), spark.range(1, 1200).select(F.lit("x").alias("limit_name"), F.col("id").alias("capacity_tokens")))
