"""The most similar vectors for every vector: an HNSW graph per shard, and the shards' results merged.

Shards are cells around centroids, so a vector's neighbours lie in a few of them. Centroids are fitted on a bounded
sample, above FLAT of them in two levels; every vector is indexed in the cell of its nearest centroid and searched for
there and in the next cells, as long as their centroids are not ``slack`` further away. The more cells there are, the
more of them a neighbourhood lies in: ``cells_for`` and ``probes_for`` say how the numbers of cells and of probes follow
the collection, and a larger shard gets a wider beam. A shard with too many queries is built several times, and each
copy answers a part of them. Vectors of one direction are one node; of its ids the smallest k + 1 are enough for any
result.

Within a task the rows come sorted: first the shard's vectors, of which the graph is built - flat neighbour arrays, see
``functions.hnsw`` - then the queries, batch by batch, so a task holds one shard and one batch. What the graph finds is
measured again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.hnsw import HNSW, unit
from lodequery.session import materialize, spread

#: Vectors that the centroids are fitted on: at least, at most, and for each centroid.
LEAST_SAMPLE, SAMPLE, SAMPLE_A_CELL = 12_288, 131_072, 12
#: Centroids that are fitted in one level, at most.
FLAT = 512
#: Vectors that the cells of a search should hold together, as the sample foretells them.
ENOUGH = 200
#: Ids of one vector that travel in a row, beyond the first ones.
ID_ROWS = 4_096
#: Vectors of a cell on average: in small collections, and in those that would have more than MANY_CELLS of them.
CELL, LARGE_CELL, MANY_CELLS = 3_000, 32_768, 250
#: Vectors of a shard and queries of a shard at most (as the sample foretells them).
SHARD, QUERIES = 131_072, 65_536
MOST_PARTITIONS = 20_000


@dataclass
class Route:
    """centroids [cells, dim]; of each cell the vectors that the sample foretells, its shards (parts, each built copies
    times) and the number of the first."""

    centroids: np.ndarray
    size: np.ndarray
    parts: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    probes: int
    slack: float

    @property
    def shards(self) -> int:
        return int(self.first[-1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[n, probes] nearest cells, nearest first, and which of them to search."""
        sims = x @ self.centroids.T
        probes = min(self.probes, sims.shape[1])
        if probes < sims.shape[1]:
            best = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
        else:
            best = np.broadcast_to(np.arange(probes), sims.shape)
        near = np.take_along_axis(sims, best, 1)
        order = np.lexsort((best, -near), axis=1)
        best, near = np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)
        go = near >= near[:, :1] - np.float32(self.slack)
        if self.size.size:  # from a cell of few vectors, search on until there are enough to choose from
            before = np.cumsum(self.size[best], axis=1) - self.size[best]
            go |= before < ENOUGH
        return best, go


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means. It begins with vectors drawn one after another, each the likelier the further it lies from those
    before, so that no topic has many centroids and another none. An emptied cell takes over the vector that lies worst."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    cells = max(1, min(cells, x.shape[0]))
    chosen = [int(rng.integers(x.shape[0]))]
    far = np.full(x.shape[0], np.inf)
    while len(chosen) < cells:
        far = np.minimum(far, np.maximum(1 - x @ x[chosen[-1]].astype(np.float64), 1e-9))
        far[chosen[-1]] = 0.0  # distinct vectors: there is always another one
        chosen.append(int(rng.choice(x.shape[0], p=far**2 / (far**2).sum())))
    c = x[chosen]
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        order = np.argsort(own, kind="stable")
        ids, at = np.unique(own[order], return_index=True)
        sums = np.zeros_like(c)
        sums[ids] = np.add.reduceat(x[order], at, axis=0)
        empty = np.setdiff1d(np.arange(cells), ids)
        if empty.size:
            sums[empty] = x[np.argsort(sims.max(axis=1))[: empty.size]]
        c = unit(sums)
    return c


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids in two levels if there are many: coarse ones, then for the sample of each its share of the cells."""
    if cells <= FLAT:
        return fit_centroids(sample, cells)
    coarse = fit_centroids(sample, round(cells**0.5))
    own = np.concatenate([(sample[lo : lo + 8192] @ coarse.T).argmax(axis=1) for lo in range(0, sample.shape[0], 8192)])
    groups = [sample[own == g] for g in np.unique(own)]
    return np.vstack([fit_centroids(x, max(1, round(cells * x.shape[0] / sample.shape[0]))) for x in groups])


def cells_for(total: int, cell: int | None = None) -> int:
    """Cells of ``cell`` vectors, if that is given. Otherwise of CELL, up to MANY_CELLS; then cells grow up to LARGE_CELL
    before there are more of them: a walk in a large graph costs little more than in a small one, a probe costs a walk."""
    if cell:
        return max(1, -(-total // cell))
    few = -(-total // CELL)
    return max(1, few if few <= MANY_CELLS else max(MANY_CELLS, -(-total // LARGE_CELL)))


def probes_for(cells: int) -> int:
    """Cells that a vector is searched for in, at most: 6 of up to 50, 16 of 250, 63 of 2,500."""
    return max(6, int(np.ceil(6 * (cells / 50) ** 0.6)))


def make_route(
    sample: np.ndarray, total: int, slack: float, cell: int | None = None, probes: int | None = None, shard: int = SHARD, queries: int = QUERIES
) -> Route:
    """Cells and shards for ``total`` vectors, foretold from a sample of them."""
    every = unit(sample)
    every = every[(every != 0).any(axis=1)]
    if not every.shape[0]:
        every = np.eye(1, max(1, sample.shape[1]), dtype=np.float32)
    x, often = np.unique(every, axis=0, return_counts=True)
    centroids = fit_cells(x, min(cells_for(total, cell), max(1, x.shape[0] // SAMPLE_A_CELL)))
    n = centroids.shape[0]
    route = Route(centroids, *[np.empty(0)] * 4, probes or probes_for(n), slack)
    share = total / every.shape[0]
    blocks = [x[lo : lo + 4096] for lo in range(0, x.shape[0], 4096)]
    route.size = sum(np.bincount(route.cells(b)[0][:, 0], minlength=n) for b in blocks) * share
    route.parts = np.maximum(1, np.ceil(route.size / shard)).astype(np.int64)
    asked = np.zeros(n)
    for b, times in zip(blocks, np.split(often, np.arange(4096, x.shape[0], 4096)), strict=True):
        best, go = route.cells(b)
        asked += np.bincount(best[go], np.repeat(times, go.sum(axis=1)), minlength=n)  # copies ask, too
    route.copies = np.maximum(1, np.ceil(asked * share / queries)).astype(np.int64)
    route.first = np.cumsum([0, *(route.parts * route.copies)])
    return route


def _hash(x: np.ndarray) -> np.ndarray:
    """A number for each row's bytes, equal for equal rows."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    h = np.full(x.shape[0], 0xCBF29CE484222325, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each group of equal rows, and each row's group."""
    _, first, group = np.unique(_hash(x), return_index=True, return_inverse=True)
    if (x == x[first[group]]).all():
        return first, group
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    return first, group.ravel()


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of equal direction, whatever their length: unit vectors that differ by no more than rounding."""
    u = unit(x)
    first, group = _copies(np.round(u * 8192))
    apart = np.abs(u - u[first[group]]).max(axis=1, initial=0.0) > 1e-6
    group = group.copy()
    group[apart] = first.size + np.arange(apart.sum())
    return np.concatenate([first, np.flatnonzero(apart)]), group


def _lists(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group in ascending order, as (values, offsets)."""
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    values, group = values[new], group[new]
    return values, np.searchsorted(group, np.arange(groups + 1))


def _expand(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``of``: (position in ``of``, index) of all entries between at[x] and at[x + 1]."""
    count = at[of + 1] - at[of]
    row = np.repeat(np.arange(of.size), count)
    return row, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[of], count)


def _valid(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the deliveries with as many floats as ids times dim; vectors with a null or non-finite float
    and null ids are left out, -0.0 counts as 0.0."""
    ids, values = batch.column(0), batch.column(1)
    whole = pc.equal(pc.list_value_length(values), pc.multiply(pc.list_value_length(ids), dim))
    batch = batch.filter(pc.fill_null(whole, False))
    ids, values = batch.column(0).flatten(), batch.column(1).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
    good = np.isfinite(x).all(axis=1) & ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[good], x[good]


_ROUTED = "part int, shard int, role int, ids array<bigint>, vec binary"


def _route_rows(ids: np.ndarray, x: np.ndarray, route: Route, parts: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch for the shards: a vector with its first k + 1 ids as a member of its own shard, and as a query of
    the others; further ids of the same vector come as queries of their own, ID_ROWS at a time."""
    first, group = _copies(x)
    x = x[first]
    values, at = _lists(ids, group, first.size)
    u, h = unit(x), _hash(x)
    best, go = route.cells(u)
    more = np.maximum(0, -(-(np.diff(at) - k - 1) // ID_ROWS))
    unit_of = np.repeat(np.arange(first.size), 1 + more)  # a unit: ids that travel in one row
    nth = np.arange(unit_of.size) - np.repeat(np.cumsum(1 + more) - 1 - more, 1 + more)
    begin = at[unit_of] + np.where(nth > 0, k + 1 + (nth - 1) * ID_ROWS, 0)
    hash_of = h[unit_of] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shard, row, role = [], [], []
    own_cell = best[unit_of, 0]
    base_part = (h[unit_of] % route.parts[own_cell].astype(np.uint64)).astype(np.int64)
    for rank in range(best.shape[1]):
        some = np.flatnonzero(go[unit_of, rank])
        cell = best[unit_of[some], rank]
        for p in range(int(route.parts[cell].max(initial=0))):
            r, c = some[route.parts[cell] > p], cell[route.parts[cell] > p]
            mine = (base_part[r] == p) & (rank == 0) & (nth[r] == 0)
            chosen = ((hash_of[r] >> np.uint64(20)) % route.copies[c].astype(np.uint64)).astype(np.int64)
            for copy in range(int(route.copies[c].max(initial=0))):
                use = (route.copies[c] > copy) & (mine | (chosen == copy))
                shard.append((route.first[c] + p * route.copies[c] + copy)[use])
                row.append(r[use])
                role.append(np.where(mine[use], np.where(chosen[use] == copy, 0, 1), 2))
    if not shard:
        return
    shard, row, role = np.concatenate(shard), np.concatenate(row), np.concatenate(role)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), x.shape[0], [None, pa.py_buffer(np.ascontiguousarray(x))])
    blob = flat.cast(pa.binary())
    own = pa.ListArray.from_arrays(pa.array(np.append(begin, values.size).astype(np.int32)), pa.array(values))
    for lo in range(0, row.size, 10_000):
        cut = slice(lo, lo + 10_000)
        columns = [
            pa.array((shard[cut] % parts).astype(np.int32)), pa.array(shard[cut].astype(np.int32)), pa.array(role[cut].astype(np.int32)),
            own.take(pa.array(row[cut])), blob.take(pa.array(unit_of[row[cut]])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "role", "ids", "vec"])


class _Base:
    """The members of a shard as they come: distinct vectors, their ids, and whether this copy of the shard answers them.

    A vector comes once for each batch of the log that holds it; they are folded together now and then."""

    def __init__(self, dim: int):
        self.x, self.asked = np.zeros((0, dim), np.float32), np.zeros(0, bool)
        self.values, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.new: list[tuple] = []
        self.rows = 0

    def add(self, x: np.ndarray, asked: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        self.new.append((x, asked, values, sizes))
        self.rows += asked.size
        if self.rows > 4 * SHARD + 2 * self.asked.size:
            self.fold()

    def fold(self) -> None:
        parts = [(self.x, self.asked, self.values, np.diff(self.at)), *self.new]
        x, asked, values, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
        first, group = _copies(x)
        self.values, self.at = _lists(values, np.repeat(group, sizes), first.size)
        flags = np.zeros(first.size, bool)
        flags[group[asked]] = True
        self.x, self.asked, self.new, self.rows = x[first], flags, [], 0


@dataclass
class _Shard:
    x: np.ndarray
    norm: np.ndarray
    node: np.ndarray  # of each vector; those of one direction share a node
    members: np.ndarray  # the k + 1 smallest ids of each node
    member_x: np.ndarray  # the vector of each of them
    member_at: np.ndarray
    graph: HNSW
    ef: int


def _pairs(shard: _Shard, q: np.ndarray, ids: np.ndarray, at: np.ndarray, entry: np.ndarray | None, k: int, least: float) -> pa.RecordBatch:
    """(id, neighbour, similarity) of each query's ids, k or k + 1 each."""
    near, rough = shard.graph.search(q, shard.ef, entry=entry)
    row, col = np.nonzero(rough >= max(least - 1e-4, -2))
    pos, i = _expand(shard.member_at, near[row, col])
    row, other, node = row[pos], shard.members[i], shard.member_x[i]
    norm = np.sqrt(np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64)))
    sim = np.empty(row.size)
    for lo in range(0, row.size, 50_000):
        r, c = row[lo : lo + 50_000], node[lo : lo + 50_000]
        sim[lo : lo + 50_000] = np.einsum("ij,ij->i", q[r].astype(np.float64), shard.x[c].astype(np.float64)) / (norm[r] * shard.norm[c])
    sim = np.round(np.clip(sim, -1, 1), 9)
    keep = sim >= least
    row, other, sim = row[keep], other[keep], sim[keep]
    order = np.lexsort((other, -sim, row))
    row, sim, other = row[order], sim[order], other[order]
    rank = np.arange(row.size) - np.searchsorted(row, row)
    row, sim, other = row[rank <= k], sim[rank <= k], other[rank <= k]
    pos, i = _expand(at, row)
    own, other, sim = ids[i], other[pos], sim[pos]
    keep = own != other
    return pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(other[keep]), pa.array(sim[keep])], names=["id", "neighbor", "similarity"])


def _search_shards(dim: int, k: int, ef: int, m: int, ef_construction: int, sure: int, least: float):
    def matrix(column: pa.Array) -> np.ndarray:
        """Without nulls, all values of dim floats: their bytes lie one after another."""
        _, offsets, data = column.buffers()
        first = np.frombuffer(offsets, np.int32)[column.offset]
        return np.frombuffer(data, np.uint8)[first : first + len(column) * 4 * dim].view(np.float32).reshape(-1, dim)

    def build(base: _Base, seed: int) -> _Shard:
        base.fold()
        first, node = _directions(base.x)
        of = np.repeat(np.arange(base.x.shape[0]), np.diff(base.at))  # vector of each id
        order = np.lexsort((base.values, node[of]))
        owner = node[of][order]
        few = np.arange(order.size) - np.searchsorted(owner, owner) <= k
        order, owner = order[few], owner[few]
        wide = max(1.0, first.size / CELL)
        graph = HNSW(m=m, ef_construction=round(ef_construction * wide**0.3), sure=sure, seed=seed).build(base.x[first])
        x = base.x.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        ends = np.searchsorted(owner, np.arange(first.size + 1))
        return _Shard(base.x, norm, node, base.values[order], of[order], ends, graph, round(ef * wide**0.6))

    def members(shard: _Shard, base: _Base) -> Iterator[pa.RecordBatch]:
        asked = np.flatnonzero(base.asked)
        for lo in range(0, asked.size, 4096):
            n = asked[lo : lo + 4096]
            r, i = _expand(base.at, n)
            yield _pairs(shard, shard.x[n], base.values[i], np.searchsorted(r, np.arange(n.size + 1)), shard.node[n], k, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, base, built = -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + (batch.column("role").to_numpy() == 2)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), key.size]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                shard, query, part = int(key[lo]) // 2, int(key[lo]) % 2, batch.slice(lo, hi - lo)
                if shard != current:
                    if base and not built:
                        yield from members(build(base, current), base)
                    current, base, built = shard, None, None
                lists = part.column("ids")
                sizes, ids = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                if not query:
                    base = base or _Base(dim)
                    base.add(matrix(part.column("vec")), part.column("role").to_numpy() == 0, ids, sizes)
                    continue
                if base and not built:
                    built = build(base, current)
                    yield from members(built, base)
                if built:
                    yield _pairs(built, matrix(part.column("vec")), ids, np.concatenate([[0], np.cumsum(sizes)]), None, k, least)
        if base and not built:
            yield from members(build(base, current), base)

    return run


def _settled(log: DataFrame, ids: str, values: str, seq: str, dim: int) -> DataFrame:
    """Deliveries in which no global id has two different vectors: the record of higher seq has the id, the larger
    hash among equal ones. Most logs have no such ids, which is found out from ids and hashes alone."""
    rows = log.select(F.col(seq).alias("seq"), F.col(values).alias("v"), F.posexplode(ids).alias("pos", "id"))
    rows = rows.where((F.size("v") > F.col("pos") * dim) & F.col("id").isNotNull())
    vec = F.slice("v", F.col("pos") * dim + 1, dim)
    hashed = rows.select("id", "seq", F.xxhash64(vec).alias("h"))
    several = hashed.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id")
    if several.isEmpty():
        return log.select(ids, values)
    best = rows.groupBy("id").agg(F.max_by(F.struct(vec.alias("v")), F.struct(F.coalesce("seq", F.lit(-1)), F.xxhash64(vec))).alias("w"))
    return materialize(best.select(F.array("id").alias(ids), F.col("w.v").alias(values)), "vectors")


def nearest_neighbors(
    log: DataFrame,
    k: int = 5,
    min_similarity: float | None = None,
    ids: str = "global_ids",
    values: str = "vec_values",
    dim: str = "dim",
    seq: str = "seq",
    ef: int = 24,
    m: int = 16,
    ef_construction: int = 24,
    sure: int = 4,
    probes: int | None = None,
    slack: float = 0.2,
    sample: int = SAMPLE,
    cell: int | None = None,
    shard: int = SHARD,
    queries: int = QUERIES,
) -> DataFrame:
    """(id, neighbor, similarity, rank) with up to k neighbours of every global id, by cosine similarity, ties by id.

    Deliveries with a wrong number of floats are ignored, as are vectors with a null or non-finite float. Repeated
    deliveries count once; if an id comes with different vectors, that of the highest seq counts. Vectors of different
    dim are no neighbours. A zero vector has similarity 0 to all: it is no vector's neighbour but its own are the
    smallest other ids. With ``min_similarity`` only neighbours of at least that similarity come out - those of them
    that are among the k nearest. Extra columns are ignored; an empty log gives no rows.

    ``ef`` and ``ef_construction`` are those of a graph of CELL vectors, larger ones get more. ``sample`` bounds the
    vectors that centroids are fitted on and the driver sees; ``cell`` and ``probes`` replace their rules.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = log.sparkSession
    named = log.where((F.col(dim) > 0) & (F.size(ids) > 0))
    clean = named.where(F.size(values) == F.size(ids) * F.col(dim))
    dims = named.groupBy(dim).agg(F.sum(F.size(ids)).alias("n")).collect()  # a collection has one dim, rarely a few; n bounds the vectors
    schema = "id bigint, neighbor bigint, similarity double"
    found = spark.createDataFrame([], schema)
    least = -2.0 if min_similarity is None else min_similarity
    for d, n in sorted(map(tuple, dims)):
        one = _settled(clean.where(F.col(dim) == d), ids, values, seq, d)
        most = min(sample, max(LEAST_SAMPLE, SAMPLE_A_CELL * cells_for(n, cell)))
        chosen = one if n <= most else one.sample(0.95 * most / n, seed=11)
        vectors = [np.zeros((0, d), np.float32)]
        for batch in chosen.toArrow().to_batches():
            vectors.append(_valid(batch, d)[1])
        route = make_route(np.vstack(vectors)[:most], n, slack, cell, probes, shard, queries)
        shared = spark.sparkContext.broadcast(route)
        parts = min(MOST_PARTITIONS, max(route.shards, 1))

        def assign(batches: Iterator[pa.RecordBatch], d: int = d, shared=shared, parts: int = parts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    own, x = _valid(batch.slice(lo, 4096), d)
                    some = (x != 0).any(axis=1)
                    if some.any():
                        yield from _route_rows(own[some], x[some], shared.value, parts, k)

        routed = spread(one).mapInArrow(assign, _ROUTED)
        placed = routed.repartitionById(parts, F.col("part")).sortWithinPartitions("shard", "role").select("shard", "role", "ids", "vec")
        found = found.unionByName(placed.mapInArrow(_search_shards(d, k, ef, m, ef_construction, sure, least), schema))
        if least <= 0:
            found = found.unionByName(_zero_vectors(one, ids, values, d, k))
    own = found.repartition("id").dropDuplicates(["id", "neighbor"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k)


def _zero_vectors(log: DataFrame, ids: str, values: str, dim: int, k: int) -> DataFrame:
    rows = log.select(F.col(values).alias("v"), F.posexplode(ids).alias("pos", "id"))
    none = ~F.exists(F.slice("v", F.col("pos") * dim + 1, dim), lambda e: e.isNull() | (e != 0))
    zeros = rows.where(none & F.col("id").isNotNull()).select("id").distinct()
    first = rows.select(F.col("id").alias("neighbor")).where("neighbor is not null").distinct().orderBy("neighbor").limit(k + 1)
    return zeros.crossJoin(F.broadcast(first)).where("id <> neighbor").withColumn("similarity", F.lit(0.0))  # k + 1 rows
