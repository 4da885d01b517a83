import numpy as np
import pytest

from lodequery.llm.knn_graph import _Base, _copies, _hash, fit_centroids, make_route, nearest_neighbors

SCHEMA = "shard int, seq bigint, global_ids array<bigint>, dim int, vec_values array<float>, part int, role int, id int, v int, pos int, h int"


def log_of(spark, rows):
    return spark.createDataFrame([(s, q, g, d, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, 5, 6) for s, q, g, d, v in rows], SCHEMA)


def deliveries(x, ids, per=4):
    return [(i % 3, i, ids[i : i + per], x.shape[1], x[i : i + per].ravel()) for i in range(0, len(ids), per)]


def brute(ids, x, k):
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    u = x / np.where(n == 0, 1, n)[:, None]
    s = np.round(u @ u.T, 9)
    out = {}
    for i, g in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and (n[j] > 0 or n[i] == 0)), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[g] = [(ids[j], s[i, j]) for j in order]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbor"], r["similarity"]))
    return got


def clusters(rng, n, dim, topics):
    return (rng.standard_normal((topics, dim))[rng.integers(0, topics, n)] + 0.5 * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("options", [{}, {"cell": 60, "shard": 25, "queries": 40}])
def test_recall_in_one_and_in_many_shards(spark, options):
    rng = np.random.default_rng(1)
    x = clusters(rng, 600, 16, 12)
    x[50:60] = x[40:50] + 0.01 * rng.standard_normal((10, 16))
    ids = list(range(1000, 1600))
    got, want = found(nearest_neighbors(log_of(spark, deliveries(x, ids)), **options)), brute(ids, x, 5)
    hits = sum(len({j for j, _ in got[g]} & {j for j, _ in want[g]}) for g in ids)
    assert hits / (5 * len(ids)) >= 0.9
    assert all(abs(s - dict(want[g]).get(j, s)) < 1e-9 for g in ids for j, s in got[g]) and all(len(v) == 5 for v in got.values())
    near = {(g, j) for g in ids for j, s in want[g] if s >= 0.95}
    high = {(g, j) for g, v in found(nearest_neighbors(log_of(spark, deliveries(x, ids)), min_similarity=0.95, **options)).items() for j, _ in v}
    assert near and len(high & near) / len(near) > 0.95


def test_copies_ties_zeros_and_dirt(spark):
    e = np.eye(4, dtype=np.float32)
    base = [(g, e[0]) for g in range(20, 0, -1)] + [(30, 3 * e[0]), (31, e[1]), (32, 2 * e[1]), (40, 0 * e[0]), (41, 0 * e[0]), (50, -e[0])]
    ids, x = [g for g, _ in base], np.array([v for _, v in base])
    rows = deliveries(x, ids, 3)
    rows += rows[:4]  # delivered again
    rows += [(0, 90, [70, 71], 4, [1, 0, 0]), (0, 91, None, 4, [1.0]), (0, 92, [72], 4, None), (0, 93, [73], 4, [1, None, 0, 0]), (0, 94, [74], 4, [float("nan"), 0, 0, 0]),
             (0, 95, [None], 4, [1, 0, 0, 0]), (0, 96, [80, 81], 2, [1, 0, 1, 1]), (None, None, [], 4, []), (0, 97, [75], None, [1.0])]
    got, want = found(nearest_neighbors(log_of(spark, rows))), brute(ids, x, 5)
    for g in (1, 2, 20, 30, 31, 32, 40, 41):
        assert [j for j, _ in got[g]] == [j for j, _ in want[g]], g
    assert not {70, 71, 72, 73, 74, 75} & set(got) and got[80] == [(81, round(2**-0.5, 9))]
    pairs = found(nearest_neighbors(log_of(spark, rows), min_similarity=0.9))
    assert 40 not in pairs and [j for j, _ in pairs[31]] == [32]


def test_the_latest_vector_of_an_id_counts(spark):
    rows = [(0, 5, [1], 2, [1, 0]), (0, 2, [1], 2, [0, 1]), (0, 1, [2], 2, [0, 1]), (0, 3, [3], 2, [1, 0.01])]
    got = found(nearest_neighbors(log_of(spark, rows), k=1))
    assert [j for j, _ in got[1]] == [3]


def test_empty_and_single(spark):
    assert nearest_neighbors(log_of(spark, [])).count() == 0
    assert nearest_neighbors(log_of(spark, [(0, 1, [1], 2, [1, 0])])).count() == 0
    assert nearest_neighbors(log_of(spark, [(0, 1, [1], 2, [0, 0])])).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbors(log_of(spark, []), k=0)


def test_routes():
    rng = np.random.default_rng(3)
    x = clusters(rng, 2000, 8, 5)
    route = make_route(x, 200_000, 0.2, cell=3000, shard=1000, queries=5000)
    assert route.parts.max() > 1 and route.copies.max() > 1 and route.shards == int((route.parts * route.copies).sum())
    assert make_route(np.zeros((5, 8), np.float32), 5, 0.2).shards == 1
    c = fit_centroids(np.repeat(np.eye(8, dtype=np.float32), 9, axis=0), 8)
    assert np.allclose(np.sort(c.max(1)), 1)
    first, group = _copies(np.vstack([x[:3], x[:3]]))
    assert first.size == 3 and (group[:3] == group[3:]).all() and np.unique(_hash(x)).size == np.unique(x, axis=0).shape[0]


def test_a_group_of_copies_that_holds_most_rows(spark):
    rng = np.random.default_rng(4)
    x = clusters(rng, 300, 8, 5)
    ids = list(range(300)) + list(range(1000, 7000))
    every = np.vstack([x, np.repeat(x[:1], 6000, axis=0)])
    got = nearest_neighbors(log_of(spark, deliveries(every, ids, 50)), queries=1500).cache()
    assert got.count() == 5 * len(ids)
    hot = [0, 1000, 1001, 1002, 1003, 1004]
    for g in (0, 1000, 1004, 1005, 3500, 6999):
        own = [r["neighbor"] for r in got.where(f"id = {g}").orderBy("rank").collect()]
        assert own == [h for h in hot if h != g][:5]


def test_members_are_folded():
    base = _Base(2)
    a, b = np.array([[1, 0]], np.float32), np.array([[0, 1]], np.float32)
    for i in range(50):
        base.add(np.vstack([a, b]), np.array([True, False]), np.array([i, 7, i + 100]), np.array([2, 1]))
        if i % 20 == 0:
            base.fold()
    base.fold()
    first = int(np.flatnonzero((base.x == a).all(axis=1))[0])
    assert base.x.shape[0] == 2 and base.asked[first] and not base.asked[1 - first]
    assert base.values[base.at[first] : base.at[first + 1]].tolist() == list(range(50))
    assert base.values[base.at[1 - first] : base.at[2 - first]].tolist() == list(range(100, 150))
