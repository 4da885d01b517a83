import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions.filters import decode_filter, encode_filter, lookup, matches, normalize_filter, parse_where, plan_query, postings
from lodequery.functions.hnsw import HNSW, draw_levels, select_closest, select_diverse, unit
from lodequery.functions.vectors import cosine_distance, norm, normalize
from lodequery.operators import knn, routing
from lodequery.operators.ann import IVF, build_graphs, links_per_node, lsh_search, megabytes, search_graphs, search_graphs_batch
from lodequery.plans import search
from lodequery.sources import store as store_module
from lodequery.sources.store import VectorStore


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def exact(x, q, k):
    d = 1 - unit(x) @ unit(q[None, :])[0]
    return np.lexsort((np.arange(len(x)), np.round(d, 6)))[:k].tolist()


def test_nearest_directions(spark):
    degrees = [0, 35, 80, 170, 300]
    compass = frame(spark, [[7 * math.cos(math.radians(a)), 7 * math.sin(math.radians(a))] for a in degrees])
    for at in (60, 190, 320):
        far = [min(abs(at - a), 360 - abs(at - a)) for a in degrees]
        got = knn.top_k(compass, [math.cos(math.radians(at)), math.sin(math.radians(at))], 3, "id", "vec").collect()
        assert [r["id"] for r in got] == sorted(range(5), key=lambda i, far=far: far[i])[:3]
        assert all(math.isclose(r["distance"], 1 - math.cos(math.radians(far[r["id"]])), abs_tol=1e-6) for r in got)


def test_zero_vectors_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, [0.0, 0.0]), (2, [2.0, 0.0]), (1, [1.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "id bigint, vec array<float>")
    got = [(r["id"], r["distance"]) for r in knn.top_k(df, [3, 0], 9, "id", "vec").collect()]
    assert got == [(1, 0.0), (2, 0.0), (3, 1.0), (5, 2.0)]
    q = spark.createDataFrame([(7, [3.0, 0.0]), (8, None), (9, [1.0])], "qid bigint, qvec array<float>")
    many = knn.top_k_batch(df, q, 9, "id", "vec", "qid", "qvec").orderBy("rank").collect()
    assert [(r["query_id"], r["row_id"], r["distance"]) for r in many] == [(7, 1, 0.0), (7, 2, 0.0), (7, 3, 1.0), (7, 5, 2.0)]
    row = df.where("id = 3").select(norm("vec"), normalize("vec"), cosine_distance("vec", "vec")).first()
    assert row[0] == 0 and row[1] == [0.0, 0.0] and row[2] == 1.0
    assert knn.top_k(df.limit(0), [1, 0], 3, "id", "vec").count() == 0
    assert knn.top_k_batch(df, q.limit(0), 3, "id", "vec", "qid", "qvec").count() == 0


def test_batch_equals_single_and_shards_equal_whole(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((520, 12)).astype(np.float32)
    asked = 77
    best = exact(x, x[asked], 15)
    shard = rng.integers(0, 6, 520)
    shard[best] = 4  # the whole answer lies in one shard, which must give all of it
    df = spark.createDataFrame([(i, [float(v) for v in r], int(h)) for i, (r, h) in enumerate(zip(x, shard, strict=True))], "id bigint, vec array<float>, shard int")
    q = [float(v) for v in x[asked]]
    assert [r["id"] for r in knn.top_k(df, q, 15, "id", "vec").collect()] == best
    lists = knn.local_top_k(df, q, 15, "id", "vec", "shard").cache()
    assert lists.groupBy("shard").count().where("count <> 15").count() == 0
    assert [r["id"] for r in knn.merge_top_k(lists, 15, "id").collect()] == best
    chosen = [3, 77, 260, 519]
    queries = df.where(F.col("id").isin(chosen)).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    many = knn.top_k_batch(df.repartition(3), queries, 5, "id", "vec", "qid", "qvec").orderBy("query_id", "rank").collect()
    assert [r["row_id"] for r in many] == [i for j in chosen for i in exact(x, x[j], 5)]
    small = knn.QUERY_BYTES
    try:
        knn.QUERY_BYTES = 200  # several passes
        again = knn.top_k_batch(df, queries, 5, "id", "vec", "qid", "qvec").orderBy("query_id", "rank").collect()
    finally:
        knn.QUERY_BYTES = small
    assert [r["row_id"] for r in again] == [r["row_id"] for r in many]
    down = spark.createDataFrame([(4,), (0,)], "shard int")
    left = [i for i in exact(x, x[asked], 520) if shard[i] not in (0, 4)][:15]
    part = knn.partial_top_k(df, down, q, 15, "id", "vec", "shard").collect()
    assert sorted(r["id"] for r in part) == sorted(left) and {r["missing"] for r in part} == {"0,4"}


def test_routing(spark):
    words = ["", "a", "Zürich", "tenant-17", "日本", "x" * 128]
    for shards in (1, 4, 13):
        got = spark.createDataFrame([(w,) for w in words], "n string").select("n", routing.by_namespace("n", shards).alias("s")).collect()
        assert all(r["s"] == zlib.crc32(r["n"].encode()) % shards == routing.namespace_shard_of(r["n"], shards) for r in got)
    sizes = [r["vectors"] for r in routing.shard_sizes(spark.range(1001), routing.by_id("id", 7)).collect()]
    assert sorted(sizes) == [143] * 7 and {r["vectors"] for r in routing.shard_sizes(spark.range(30), routing.by_id("id", 7)).collect()} == {4, 5}
    assert routing.next_id(spark.range(3, 9), "id").first()[0] == 9 and routing.next_id(spark.range(0), "id").first()[0] == 0
    ids = routing.with_dense_ids(spark.range(0, 1000, 1, 7).withColumn("k", -F.col("id")), "new", 50, "k").orderBy("k").select("new").collect()
    assert [r[0] for r in ids] == list(range(50, 1050))
    assert not routing.with_dense_ids(spark.range(0), "new", 0, "id").collect()


PAYLOADS = [
    {"color": "red", "size": 1, "tags": ["a", 7, True]},
    {"color": "blue", "size": 2, "tags": ["b"], "flag": True},
    None,
    {"color": "red", "size": 1, "text": "x" * 500, "score": 0.5, "meta": {"color": "red"}},
    {"color": ["red", "blue"], "flag": 1, "size": "1", "a b.c": "dot", "deep": [["red"]]},
]


def payloads(spark):
    rows = [(i, None if p is None else json.dumps(p)) for i, p in enumerate(PAYLOADS)]
    return spark.createDataFrame([*rows, (5, "{broken"), (6, "[1]"), (7, "")], "id bigint, payload string")


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ({"color": "red"}, [0, 3, 4]),
        ({"color": ["red", "blue"], "size": 1}, [0, 3]),
        ({"flag": True}, [1]),
        ({"flag": 1}, [4]),
        ({"size": "1"}, [4]),
        ({"tags": [True]}, [0]),
        ({"tags": 7}, [0]),
        ({"a b.c": "dot"}, [4]),
        ({"deep": "red"}, []),
        ({"meta": "red"}, []),
        ({"none": 1}, []),
        ({}, list(range(8))),
    ],
)
def test_filters_are_type_strict(spark, where, ids):
    df = payloads(spark)
    assert [r["id"] for r in df.where(matches("payload", where)).orderBy("id").collect()] == ids
    if where:
        assert sorted(r[0] for r in lookup(postings(df, "id", "payload"), where).collect()) == ids


@pytest.mark.parametrize("bad", [{"a": 0.5}, {"a": "x" * 129}, {"a": {"b": 1}}, {"a": []}, {"a": None}, {1: "x"}, ["a"], "a", {"a": 2**70}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        normalize_filter(bad)


def test_filter_text_and_conditions():
    assert decode_filter(encode_filter({"a": "ä", "b": [1, True]})) == {"a": ["ä"], "b": [1, True]}
    assert encode_filter({}) == "" and decode_filter("") is None
    got = parse_where(["a=1", "a=x", "b=true", 'c="5"', "d=0.5", "e=null", "f=[1]", "g=a=b"])
    assert got == {"a": [1, "x"], "b": [True], "c": ["5"], "d": ["0.5"], "e": ["null"], "f": ["[1]"], "g": ["a=b"]}
    for bad in ("x", "=1"):
        with pytest.raises(ValueError):
            parse_where([bad])
    for bad in ({"_namespace": "x"}, None):
        with pytest.raises(ValueError):
            plan_query(bad, "" if bad is None else None, 4)


def test_filtered_search_prunes_partitions(spark, tmp_path):
    df = frame(spark, np.eye(8)).withColumn("namespace", F.lit("bob")).withColumn("payload", F.lit(None).cast("string"))
    df.withColumn("shard", routing.by_namespace("namespace", 4)).write.partitionBy("shard").parquet(str(tmp_path / "v"))
    shard, rest = plan_query(None, "bob", 4)
    plan = spark.read.parquet(str(tmp_path / "v")).where(shard).where(rest)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in text and "(shard" in text.split("PartitionFilters")[1]
    assert plan.count() == 8


def test_filter_strategy(spark):
    rows = spark.createDataFrame([(100, 10_000), (10_000, 10_000), (0, 5)], "m bigint, n bigint")
    assert [r[0] for r in rows.select(knn.prefers_exact(F.col("m"), F.col("n"), 50)).collect()] == [True, False, True]


@pytest.mark.parametrize(("m", "sure"), [(1, 1), (4, 1), (6, 3), (30, 2)])
def test_neighbour_selection(m, sure):
    rng = np.random.default_rng(m)
    for _ in range(30):
        v = unit(rng.standard_normal((25, 6)))
        node = unit(rng.standard_normal((1, 6)))[0]
        v = v[np.argsort(-(v @ node), kind="stable")]
        near, among = v @ node, v @ v.T
        kept = select_diverse(near[None], among[None], m, sure)[0]
        for j in range(25):
            crowded = any(kept[i] and among[j, i] > near[j] for i in range(j))
            assert kept[j] == ((j < sure or not crowded) and kept[:j].sum() < m)
        assert np.flatnonzero(select_closest(near[None], m)[0]).tolist() == list(range(min(m, 25)))
    padded = np.array([[0.9, 0.5, -np.inf]])
    assert select_closest(padded, 3)[0].tolist() == [True, True, False] and not select_diverse(padded, np.zeros((1, 3, 3)), 3)[0, 2]


def test_levels_fall_off():
    level = draw_levels(20_000, 16, 3)
    assert level.min() == 0 and 0.05 < (level >= 1).mean() < 0.075


@pytest.mark.parametrize("diverse", [True, False])
def test_graph_recall(diverse):
    x = np.random.default_rng(21).standard_normal((700, 20)).astype(np.float32)
    q = np.random.default_rng(22).standard_normal((60, 20)).astype(np.float32)
    g = HNSW(m=10, ef_construction=50, diverse=diverse, seed=5).build(x)
    ids, sims = g.search(q, 60)
    hits = sum(len(set(exact(x, v, 6)) & set(i[:6].tolist())) for v, i in zip(q, ids, strict=True))
    assert hits / 360 > 0.9 and (np.diff(sims, axis=1) <= 0).all()
    true = unit(q) @ unit(x).T
    assert np.allclose(np.take_along_axis(true, ids, 1), sims, atol=1e-5)
    allowed = np.arange(700) % 9 == 4
    ids, sims = g.search(q, 60, allowed)
    assert all(allowed[i[i < 700]].all() for i in ids)
    want = [set(np.argsort(-np.where(allowed, t, -9))[:6].tolist()) for t in true]
    assert sum(len(w & set(i[:6].tolist())) for w, i in zip(want, ids, strict=True)) / 360 > 0.9
    assert 0 < links_per_node(g) <= 20 and megabytes(g) > 0


def test_graph_of_none_one_and_copies():
    q = np.ones((2, 4), np.float32)
    assert (HNSW().build(np.zeros((0, 4))).search(q, 3)[0] == 0).all()
    ids, sims = HNSW().build(np.ones((1, 4))).search(q, 3)
    assert ids[0].tolist() == [0, 1, 1] and np.isclose(sims[0, 0], 1) and np.isinf(sims[0, 1])
    ids, _ = HNSW(m=4).build(np.vstack([np.ones((50, 4)), np.zeros((2, 4))])).search(q, 8)
    assert len(set(ids[0].tolist())) == 8


def test_approximate_searches(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((8, 16))
    x = (centre[np.arange(400) % 8] + 0.2 * rng.standard_normal((400, 16))).astype(np.float32)
    df, q = frame(spark, x), [float(v) for v in x[5]]
    want = set(exact(x, x[5], 10))
    ivf = IVF(df, "id", "vec", 8)
    assert len({r[0] for r in ivf.search(q, 10, 8).collect()} & want) == 10
    assert len({r[0] for r in ivf.search(q, 10, 2).collect()} & want) >= 8
    assert len({r[0] for r in lsh_search(df, q, 10, "id", "vec").collect()} & want) >= 8
    graphs = build_graphs(df.withColumn("shard", routing.by_id("id", 4)), "id", "vec", "shard")
    assert len({r[0] for r in search_graphs(graphs, q, 10, 50).collect()} & want) >= 9
    even = graphs.withColumn("even", F.filter("ids", lambda i: i % 2 == 0))
    one = spark.createDataFrame([(7, q)], "query_id bigint, q array<double>")
    assert {r["row_id"] % 2 for r in search_graphs_batch(even, one, 10, "query_id", "q", 50, "even").collect()} == {0}


def test_registered_approximate_searches_ask_all_queries(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((8, 16))
    x = (centre[np.arange(900) % 8] + 0.5 * rng.standard_normal((900, 16))).astype(np.float32)
    rows = [(i, i % 5, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(r["query_id"], r["vec_id"]) for r in search.knn_batch(spark, str(tmp_path)).collect()}
    assert len(want) == 90
    for f in (search.hnsw_search, search.ivf_search, search.random_projection_search):
        got = {(r["query_id"], r["vec_id"]) for r in f(spark, str(tmp_path)).collect()}
        assert len(got & want) >= 81, f.__name__


def test_a_store_walks_graphs_or_measures_by_selectivity(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(31)
    x = rng.standard_normal((1300, 10)).astype(np.float32)
    body = [json.dumps({"half": ["left", "right"][i % 2], "rare": i % 60, "word": f"w{i}"}) for i in range(1300)]
    df = spark.createDataFrame([(i, [float(v) for v in r], b) for i, (r, b) in enumerate(zip(x, body, strict=True))], "n int, vec array<double>, payload string")
    store = VectorStore(spark, str(tmp_path / "s"), shards=2, graph_rows=500)
    assert store.index() == 0
    store.add(df.where("n < 700"), "vec", "payload", order="n")
    assert store.index() == 500
    built = store.state["graphs"]
    store.add(df.where("n >= 700"), "vec", "payload", order="n")
    assert store.index() == 1000 and store.state["graphs"][:1] == built and store.index() == 1000
    again = VectorStore(spark, str(tmp_path / "s"))
    assert again.state["graph_rows"] == 500 and again.graphs().select(F.sum(F.size("ids"))).first()[0] == 1000
    queries = df.where("n % 130 = 0").select(F.col("n").cast("long").alias("query_id"), "vec")
    walked = []
    real = store_module.search_graphs_batch
    monkeypatch.setattr(store_module, "search_graphs_batch", lambda graphs, *a: walked.append(graphs.count()) or real(graphs, *a))
    for factor, segments in ((100, 0), (1, 2)):  # few matches in small segments are measured; at a lower price of a walk it is taken
        monkeypatch.setattr(store_module, "prefers_exact", lambda m, n, ef, f=factor: knn.prefers_exact(m, n, ef, f))
        for where, fits in (({"half": "left"}, lambda i: i % 2 == 0), ({"rare": [3, 4], "half": "right"}, lambda i: i % 60 == 3)):
            got = again.search_batch(queries, 8, where).collect()
            expected = segments if where == {"half": "left"} else 0
            assert walked.pop() == expected and all(fits(r["row_id"]) for r in got) and len(got) == 80
            ids = [i for i in range(1300) if fits(i)]
            hits = sum(r["row_id"] in {ids[j] for j in exact(x[ids], x[r["query_id"]], 8)} for r in got)
            assert hits >= (72 if expected else 80)
    free = again.search_batch(queries, 8).collect()
    assert walked.pop() == 4 and sum(r["row_id"] in set(exact(x, x[r["query_id"]], 8)) for r in free) >= 72
    one = again.search([float(v) for v in x[1299]], 3, {"half": "right"}).collect()
    assert one[0]["id"] == 1299 and json.loads(one[0]["payload"])["word"] == "w1299" and len(one) == 3
    again.export(str(tmp_path / "copy"))
    again.install(str(tmp_path / "copy"), 9)
    assert again.state["indexed"] == 0 and again.search([float(v) for v in x[5]], 1).first()["id"] == 5
