"""Approximate search: inverted files of k-means cells, random projections, and a small-world graph for each shard."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.hnsw import HNSW
from lodequery.functions.vectors import cosine_distance, literal, normalize
from lodequery.operators.knn import merge_ranked, query_blocks, top_k

#: Rows that cells are fitted on, at most.
SAMPLE = 100_000


def nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, distance, rank) of the k nearest of candidate pairs (query_id, q, row_id, vec)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q, x = (np.stack(batch[c].to_numpy()).astype(float) for c in ("q", "v"))
            norms = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", x, x))
            dots = np.einsum("ij,ij->i", q, x)
            cos = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
            far = batch[["query_id", "row_id"]].assign(distance=1.0 - np.round(cos, 12))
            yield far.sort_values(["query_id", "distance", "row_id"]).groupby("query_id").head(k)

    rows = pairs.where(F.size("q") == F.size("vec")).select("query_id", F.col("row_id").cast("long"), "q", F.col("vec").alias("v"))
    far = rows.mapInPandas(measure, "query_id bigint, row_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
    return far.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


class IVF:
    """Vectors in cells around k-means centres; a search reads the ``probes`` nearest cells only."""

    def __init__(self, df: DataFrame, row_id: str, vec: str, cells: int, seed: int = 1):
        unit = df.select(row_id, F.col(vec).alias("vec"), array_to_vector(normalize(vec)).alias("features"))
        rows = unit.count()
        sample = unit if rows <= SAMPLE else unit.sample(SAMPLE / rows, seed=seed)
        self.row_id = row_id
        self.model = KMeans(k=cells, seed=seed, maxIter=20).fit(sample)
        self.centres = np.array(self.model.clusterCenters())
        self.rows = self.model.transform(unit).select(row_id, "vec", F.col("prediction").alias("cell"))

    def write(self, path: str) -> None:
        """A folder for each cell, so that a search prunes to those it probes."""
        self.rows.repartition("cell").write.partitionBy("cell").parquet(path)

    def probed(self, query: list[float], probes: int) -> Column:
        q = np.asarray(query, float)
        near = np.argsort(((self.centres - q / (np.linalg.norm(q) or 1.0)) ** 2).sum(1), kind="stable")[:probes]
        return F.col("cell").isin(*[int(c) for c in near])

    def search_batch(self, queries: DataFrame, k: int, probes: int, query_id: str, query_vec: str) -> DataFrame:
        """(query_id, row_id, distance, rank): every query reads its own ``probes`` nearest cells."""
        dim, centres = self.centres.shape[1], self.centres
        cells = np.arange(len(centres))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = np.stack(batch["q"].to_numpy()).astype(float)
                q /= np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
                far = (centres**2).sum(1) - 2 * q @ centres.T
                probed = np.argsort(far, axis=1, kind="stable")[:, :probes]
                part = batch.loc[batch.index.repeat(probed.shape[1])]
                yield part.assign(cell=cells[probed.ravel()].astype(np.int32))

        asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("q"))
        asked = asked.where((F.size("q") == dim) & F.col("query_id").isNotNull()).mapInPandas(near, "query_id bigint, q array<double>, cell int")
        return nearest_of(asked.join(self.rows.withColumnRenamed(self.row_id, "row_id"), "cell"), k)

    def search(self, query: list[float], k: int, probes: int, rows: DataFrame | None = None) -> DataFrame:
        return top_k(self.rows if rows is None else rows, query, k, self.row_id, "vec", self.probed(query, probes)).select(self.row_id, "distance")


def lsh_search(df: DataFrame, query: list[float], k: int, row_id: str, vec: str, tables: int = 8, bucket: float = 1.0, seed: int = 1) -> DataFrame:
    """Rows that share a bucket of random projections with the query; distances of unit vectors rank as cosines."""
    unit = df.select(row_id, F.col(vec).alias("vec"), array_to_vector(normalize(vec)).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    q = np.asarray(query, float)
    key = unit.sparkSession.createDataFrame([([float(x) for x in q / (np.linalg.norm(q) or 1.0)],)], "v array<double>")
    hashed = model.transform(key.select(array_to_vector("v").alias("features"))).first()["hashes"]
    rows = model.transform(unit).withColumn("hashes", F.transform("hashes", lambda h: F.element_at(vector_to_array(h), 1)))
    hit = [F.element_at("hashes", i + 1) == F.lit(float(h[0])) for i, h in enumerate(hashed)]
    some = hit[0]
    for h in hit[1:]:
        some = some | h
    return rows.where(some).withColumn("distance", cosine_distance("vec", literal(query))).orderBy("distance", row_id).limit(k).select(row_id, "distance")


def lsh_search_batch(
    df: DataFrame, queries: DataFrame, k: int, row_id: str, vec: str, query_id: str, query_vec: str, tables: int = 8, bucket: float = 1.0, seed: int = 1
) -> DataFrame:
    """(query_id, row_id, distance, rank) of rows that share a bucket of random projections with the query."""
    unit = lambda d, i, v: d.select(i, v, array_to_vector(normalize(v)).alias("features")).where(F.col(v).isNotNull())
    rows, asked = unit(df, row_id, vec), unit(queries, query_id, query_vec)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)

    def hashed(d: DataFrame, i: str, name: str) -> DataFrame:
        buckets = F.transform("hashes", lambda h: F.element_at(vector_to_array(h), 1))
        return model.transform(d).select(F.col(i).cast("long").alias(name), F.posexplode(buckets).alias("place", "bucket"))

    shared = hashed(asked, query_id, "query_id").join(hashed(rows, row_id, "row_id"), ["place", "bucket"]).select("query_id", "row_id").distinct()
    vectors = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(vec).alias("vec"))
    return nearest_of(shared.join(asked.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("q")), "query_id").join(vectors, "row_id"), k)


def build_graphs(
    df: DataFrame, row_id: str, vec: str, shard: str | list[str], m: int = 16, ef_construction: int = 100, diverse: bool = True
) -> DataFrame:
    """(the keys of the shards, ids, graph): a graph of each shard in flat arrays. A shard is one task's work and one
    row; choose them of bounded size."""
    keys = [shard] if isinstance(shard, str) else shard
    kinds = {k: t for k, t in df.dtypes if k in keys}
    rows = df.select(*keys, F.col(row_id).cast("long").alias("row_id"), F.col(vec).cast("array<float>").alias("vec"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_id")
        seed = zlib.crc32(repr(key).encode())
        graph = HNSW(m=m, ef_construction=ef_construction, diverse=diverse, seed=seed).build(np.stack(part["vec"].to_numpy()))
        state = {"m": m, "vectors": graph.vectors, "nodes": graph.nodes, "links": graph.links, "entry": graph.entry}
        own = {name: [value] for name, value in zip(keys, key, strict=True)}
        return pd.DataFrame({**own, "ids": [part["row_id"].to_numpy()], "graph": [pickle.dumps(state, 5)]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.where("vec is not null").groupBy(*keys).applyInPandas(build, f"{schema}, ids array<bigint>, graph binary")


def search_graphs(graphs: DataFrame, query: list[float], k: int, ef: int = 50) -> DataFrame:
    """(row_id, distance) of the k nearest to one query."""
    one = graphs.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, q array<double>")
    return search_graphs_batch(graphs, one, k, "query_id", "q", ef).orderBy("distance", "row_id").select("row_id", "distance")


def search_graphs_batch(graphs: DataFrame, queries: DataFrame, k: int, query_id: str, query_vec: str, ef: int = 50, allowed: str | None = None) -> DataFrame:
    """(query_id, row_id, distance, rank) of every query's k nearest: each shard's own best, merged.

    The queries travel to the graphs in blocks, as in ``knn.top_k_batch``; each shard walks with a beam of ``max(ef, k)``
    and gives k rows a query. ``allowed`` names a column of ``graphs`` with the ids that a result may hold.
    """
    spark, schema = graphs.sparkSession, "query_id bigint, row_id bigint, distance double"
    wanted = graphs.select("ids", "graph", F.col(allowed).alias("allowed") if allowed else F.lit(None).cast("array<bigint>").alias("allowed"))

    def search(qids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((qids, matrix.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, blob, chosen = (batch.column(c)[i] for c in ("ids", "graph", "allowed"))
                    state = pickle.loads(blob.as_py())
                    graph = HNSW(m=state["m"], vectors=state["vectors"], nodes=state["nodes"], links=state["links"], entry=state["entry"])
                    ids = np.append(ids.values.to_numpy(zero_copy_only=False), -1)
                    mask = None if not chosen.is_valid else np.isin(ids[:-1], chosen.values.to_numpy(zero_copy_only=False))
                    for at in range(0, len(q), 4096):
                        found, sims = (x[:, :k] for x in graph.search(q[at : at + 4096], max(ef, k), mask))
                        row, place = np.nonzero(found < graph.size)
                        columns = [own[at + row], ids[found[row, place]], 1.0 - sims[row, place].astype(float)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row_id", "distance"])

        return wanted.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for qids, matrix in query_blocks(queries, query_id, query_vec):
        found = found.unionByName(search(qids, matrix))
    return merge_ranked(found, k)


def links_per_node(graph: HNSW) -> float:
    """Links of layer 0 for each vector."""
    return float((graph.links[0][: graph.size] < graph.size).sum() / max(1, graph.size))


def megabytes(graph: HNSW) -> float:
    return (graph.vectors.nbytes + sum(x.nbytes for x in graph.links)) / 1e6
