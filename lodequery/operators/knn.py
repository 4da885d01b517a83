"""Exact nearest neighbours by cosine distance, for one query or many. Ties are decided by the smaller id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.vectors import cosine_distance, literal

#: Size of the query matrix that one pass over the vectors takes along; more queries take more passes.
QUERY_BYTES = 64 << 20


def top_k(df: DataFrame, query: list[float], k: int, row_id: str, vec: str, where: Column | None = None) -> DataFrame:
    """(row_id, distance) of the k nearest rows; fewer only if fewer match. Null vectors are no candidates.

    The filter is part of the search. Spark keeps k rows a task and merges them.
    """
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col(vec).isNotNull()).withColumn("distance", cosine_distance(F.col(vec), literal(query)))
    return rows.orderBy("distance", row_id).limit(k)


def _unit64(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _first_k(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries of each row the k of smallest distance, ties by id."""
    order = np.lexsort((ids, dist, row))
    row, ids, dist = row[order], ids[order], dist[order]
    keep = np.arange(row.size) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], dist[keep]


def _nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance) of each row's k smallest distances, ties at the last place included before they are decided."""
    if dist.shape[1] > k:
        row, col = np.nonzero(dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, col = (x.ravel() for x in np.indices(dist.shape))
    return _first_k(row, ids[col], dist[row, col], k)


#: Turns texts into a matrix with a row for each.
Embed = Callable[[list], np.ndarray]


def query_blocks(queries: DataFrame, query_id: str, query_vec: str, embed: Embed | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, in blocks of bounded size; of texts if ``embed`` is given."""
    ids: list[int] = []
    vectors: list = []
    dim, size = None, 0
    value = F.col(query_vec) if embed else F.col(query_vec).cast("array<double>")
    chosen = queries.select(F.col(query_id).cast("long").alias("i"), value.alias("v"))
    matrix = lambda: _unit64(embed(vectors) if embed else np.array(vectors))
    for row in chosen.where("i is not null and v is not null").toLocalIterator(prefetchPartitions=True):
        dim = dim or len(row["v"])
        if not embed and len(row["v"]) != dim:
            continue
        ids.append(row["i"])
        vectors.append(row["v"])
        size += max(4096, len(row["v"])) if embed else dim * 8
        if size >= QUERY_BYTES:
            yield np.array(ids), matrix()
            ids, vectors, size = [], [], 0
    if vectors:
        yield np.array(ids), matrix()


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, embed: Embed | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the rows of this length, at most 4,096 at once."""
    for batch in batches:
        part = batch if embed else batch.filter(pa.array(np.array(batch.column(1).value_lengths()) == dim))
        for lo in range(0, part.num_rows, 4096):
            cut = part.slice(lo, 4096)
            own, values = cut.column(0).to_numpy(zero_copy_only=False), cut.column(1)
            yield own, _unit64(embed(values.to_pylist()) if embed else values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _candidates(df: DataFrame, row_id: str, vec: str, embed: Embed | None) -> tuple[DataFrame, str]:
    value = F.col(vec) if embed else F.col(vec).cast("array<double>")
    rows = df.select(F.col(row_id).alias("row_id"), value.alias("v")).where("v is not null and row_id is not null")
    return rows, f"query_id bigint, row_id {dict(df.dtypes)[row_id]}, distance double"


def top_k_batch(
    df: DataFrame, queries: DataFrame, k: int, row_id: str, vec: str, query_id: str, query_vec: str, max_distance: float | None = None,
    embed: Embed | None = None,
) -> DataFrame:
    """(query_id, row_id, distance, rank) of the k nearest rows of every query.

    The queries travel to the vectors, as a matrix, in blocks of bounded size that are read one after another; each
    task multiplies its batches with it and keeps k rows a query; ranks are given after the merge. Rows and queries
    with a null vector or of another length than the first query's are left out. With ``embed`` both columns are texts,
    which the tasks turn into vectors where they need them.
    """
    spark = df.sparkSession
    rows, schema = _candidates(df, row_id, vec, embed)

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))
        dim = matrix.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = None
            for own, x in _blocks(batches, dim, embed):
                found = [] if best is None else [best]
                for at in range(0, q.shape[0], 512):
                    dist = 1.0 - np.round(q[at : at + 512] @ x.T, 12)
                    row, hit, far = _nearest(dist, own, k)
                    found.append((row + at, hit, far))
                best = _first_k(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            if best is not None:
                columns = [pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[2])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "row_id", "distance"])

        return rows.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for ids, matrix in query_blocks(queries, query_id, query_vec, embed):
        found = found.unionByName(search(ids, matrix))
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return merge_ranked(found, k)


def merge_ranked(found: DataFrame, k: int) -> DataFrame:
    """Of (query_id, row_id, distance) from several searches the k nearest of each query, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
    return found.select("query_id", "row_id", "distance").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def within_batch(
    df: DataFrame, queries: DataFrame, max_distance: float, row_id: str, vec: str, query_id: str, query_vec: str, embed: Embed | None = None
) -> DataFrame:
    """(query_id, row_id, distance) of all rows within the distance of every query, however many.

    The queries travel to the vectors as in ``top_k_batch``; a task gives out what each product finds and keeps nothing.
    """
    spark = df.sparkSession
    rows, schema = _candidates(df, row_id, vec, embed)

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))
        dim = matrix.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            for own, x in _blocks(batches, dim, embed):
                for at in range(0, q.shape[0], 512):
                    dist = 1.0 - np.round(q[at : at + 512] @ x.T, 12)
                    row, col = np.nonzero(dist <= max_distance)
                    if row.size:
                        columns = [pa.array(qids[row + at]), pa.array(own[col]), pa.array(dist[row, col])]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "row_id", "distance"])

        return rows.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for ids, matrix in query_blocks(queries, query_id, query_vec, embed):
        found = found.unionByName(search(ids, matrix))
    return found


def local_top_k(df: DataFrame, query: list[float], k: int, row_id: str, vec: str, shard: str) -> DataFrame:
    """Each shard's own k nearest: (shard, row_id, distance). A full k from each, or the merge would miss some."""
    rows = df.withColumn("distance", cosine_distance(F.col(vec), literal(query)))
    rank = F.row_number().over(Window.partitionBy(shard).orderBy("distance", row_id))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).select(shard, row_id, "distance")


def merge_top_k(lists: DataFrame, k: int, row_id: str) -> DataFrame:
    return lists.orderBy("distance", row_id).limit(k)


def partial_top_k(df: DataFrame, down: DataFrame, query: list[float], k: int, row_id: str, vec: str, shard: str) -> DataFrame:
    """The k nearest rows of the shards that are up, with the sorted list of those that are down as text."""
    hits = top_k(df.join(down, shard, "left_anti"), query, k, row_id, vec)
    missing = down.agg(F.array_join(F.array_sort(F.collect_set(F.col(shard).cast("string"))), ",").alias("missing"))  # a row per shard
    return hits.select(row_id, "distance").join(F.broadcast(missing))  # one row


def post_filter(df: DataFrame, query: list[float], k: int, row_id: str, vec: str, where: Column) -> DataFrame:
    """What a search finds that filters only afterwards; kept to measure what it misses."""
    return top_k(df, query, k, row_id, vec).where(where)


def prefers_exact(matches: Column, size: Column, ef: int, factor: int = 100) -> Column:
    """Whether scanning the matching rows beats a walk of the graph: matches squared up to factor * ef * size."""
    m = matches.cast("double")
    return m * m <= F.lit(float(factor * ef)) * size
