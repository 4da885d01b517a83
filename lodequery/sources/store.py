"""A collection of vectors with payloads in versioned Parquet folders.

Rows: shard, id, vec (length one), payload (JSON text), namespace, seq. A write is one append with one seq; readers see
it once its manifest is in place. ``compact`` folds the log into a new base, as a snapshot would.

Rows whose ids lie in the same stretch of GRAPH_ROWS numbers and in the same shard are a segment. ``index`` gives every
full stretch that has none yet its graphs, one for each segment, and leaves them as they are from then on, so vectors
that come later cost no rebuilding. A search decides for each segment whether it walks the graph or measures all rows
that match; rows behind the last full stretch are always measured.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.filters import NAMESPACE_FIELD, check_namespace, plan_query
from lodequery.functions.vectors import normalize
from lodequery.operators.ann import build_graphs, search_graphs_batch
from lodequery.operators.knn import merge_ranked, prefers_exact, top_k, top_k_batch
from lodequery.operators.routing import route, with_dense_ids
from lodequery.sources.manifest import ManifestFolder

#: Rows of one file at most, and writes after which the parts are folded together.
FILE_ROWS, COMPACT_EVERY = 1_000_000, 1_000
#: Numbers in the stretch of ids of a segment; a graph holds no more vectors.
GRAPH_ROWS = 65_536
GRAPHS = "shard int, block bigint, ids array<bigint>, graph binary"
SCHEMA = "id bigint, vec array<double>, payload string, namespace string, seq bigint, shard int"


SOURCES = "key string, sha256 string, passages bigint, source string, space string"
SCHEMA_COLUMNS, SOURCE_COLUMNS = ([c.split()[0] for c in x.split(", ")] for x in (SCHEMA, SOURCES))


class OutOfOrderWrite(ValueError):
    """A write whose sequence number isn't the next one."""


class VectorStore:
    """One writer at a time. A store has one dimension, that of its first write."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 4, graph_rows: int = GRAPH_ROWS, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self.manifest = ManifestFolder(spark, f"{self.root}/manifest")
        self.version = self.manifest.version() or 0
        known = self.manifest.read(self.version) if self.version else None
        self.state = json.loads(known) if known else {"shards": shards, "dim": None, "seq": 0, "base_seq": 0, "next_id": 0, "parts": [], "sources": [], "graph_rows": graph_rows, "indexed": 0, "graphs": []}

    @property
    def shards(self) -> int:
        return self.state["shards"]

    def refresh(self) -> None:
        self.version = self.manifest.version() or 0
        if self.version:
            self.state = json.loads(self.manifest.read(self.version))

    def _publish(self, state: dict) -> None:
        """The version after the one that was read: a writer that doesn't know the newest one is refused."""
        self.manifest.publish(self.version + 1, json.dumps(state))
        self.version, self.state = self.version + 1, state

    def rows(self) -> DataFrame:
        """Every row. The folders' shard column prunes partitions."""
        paths = [p["path"] for p in self.state["parts"]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        whole = self.spark.read.schema(f"{SCHEMA}, part string").option("basePath", f"{self.root}/rows")
        return whole.parquet(*paths).select(*SCHEMA_COLUMNS)

    def _part(self, name: str) -> str:
        """A folder for rows: all of them are partitions of one table, so any number of writes is one scan."""
        return f"{self.root}/rows/part={name}-{uuid.uuid4().hex[:8]}"

    def _record(self, sources: DataFrame) -> str:
        path = f"{self.root}/sources/write={uuid.uuid4().hex}"
        sources.select(*SOURCE_COLUMNS).write.parquet(path)
        return path

    def sources(self) -> DataFrame:
        """(key, sha256, passages, source, space) of the files that were taken in."""
        paths = self.state["sources"]
        if not paths:
            return self.spark.createDataFrame([], SOURCES)
        return self.spark.read.schema(f"{SOURCES}, write string").option("basePath", f"{self.root}/sources").parquet(*paths).select(*SOURCE_COLUMNS)

    def add(self, df: DataFrame, vec: str = "vec", payload: str | None = None, namespace: str | None = None, order: str | None = None, seq: int | None = None, sources: DataFrame | None = None) -> int:
        """Append all rows in one step and return the seq. New ids follow the largest; with ``namespace`` all rows go to
        its shard. The rows' vectors must have the store's dimension; a payload may not use the reserved field."""
        if namespace is not None:
            check_namespace(namespace)
        expected = self.state["seq"] + 1
        if seq is not None and seq != expected:
            raise OutOfOrderWrite(f"seq {seq} came where {expected} was due")
        text = F.col(payload) if payload else F.lit(None).cast("string")
        key = order or vec
        rows = df.select(F.col(vec).cast("array<double>").alias("vec"), text.alias("payload"), F.col(key).alias("_k"))
        dims = [r[0] for r in rows.select(F.size("vec").alias("d")).distinct().limit(2).collect()]
        if not dims:
            if sources is not None:
                self._publish(self.state | {"sources": self.state["sources"] + [self._record(sources)]})
            return self.state["seq"]
        if len(dims) > 1 or self.state["dim"] not in (None, dims[0]):
            raise ValueError(f"vectors of {sorted(dims)} numbers in a store of {self.state['dim']}")
        reserved = rows.where(F.try_variant_get(F.try_parse_json("payload"), f"$.{NAMESPACE_FIELD}", "variant").isNotNull())
        if payload and not reserved.isEmpty():
            raise ValueError(f"{NAMESPACE_FIELD} is reserved")
        numbered = with_dense_ids(rows, "id", self.state["next_id"], "_k").withColumn("namespace", F.lit(namespace).cast("string"))
        placed = numbered.select("id", normalize("vec").alias("vec"), "payload", "namespace", F.lit(expected).cast("long").alias("seq"))
        path = self._part(f"{expected:08d}")
        placed.withColumn("shard", route("id", "namespace", self.shards)).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)
        written = self.spark.read.parquet(path).count()
        state = self.state | {"dim": dims[0], "seq": expected, "next_id": self.state["next_id"] + written}
        state["parts"] = self.state["parts"] + [{"path": path, "seq": expected}]
        if sources is not None:
            state["sources"] = self.state["sources"] + [self._record(sources)]
        self._publish(state)
        if len(state["parts"]) >= self.compact_every:
            self.compact()
        return expected

    def index(self) -> int:
        """Graphs for the full stretches of ids that have none; how many ids have graphs then."""
        size, begin = self.state["graph_rows"], self.state["indexed"]
        end = self.state["next_id"] // size * size
        if end > begin:
            rows = self.rows().where((F.col("id") >= begin) & (F.col("id") < end)).withColumn("block", self._block())
            path = f"{self.root}/graphs/built={end:012d}-{uuid.uuid4().hex[:8]}"
            build_graphs(rows, "id", "vec", ["shard", "block"]).write.partitionBy("shard").parquet(path)
            self._publish(self.state | {"indexed": end, "graphs": self.state["graphs"] + [path]})
        return end

    def _block(self) -> Column:
        return F.floor(F.col("id") / F.lit(self.state["graph_rows"])).cast("long")

    def graphs(self) -> DataFrame:
        paths = self.state["graphs"]
        return self.spark.read.schema(f"{GRAPHS}, built string").option("basePath", f"{self.root}/graphs").parquet(*paths).drop("built")

    def lookup(self, where: dict | None = None, namespace: str | None = None) -> DataFrame:
        """(id, payload) of all rows that match, without a query."""
        shard, rest = plan_query(where, namespace, self.shards)
        return self.rows().where(shard).where(rest).select("id", full_payload().alias("payload"))

    def search(self, query: list[float], k: int, where: dict | None = None, namespace: str | None = None, payloads: bool = True, ef: int = 50) -> DataFrame:
        """(id, distance[, payload]) of the k nearest rows that match. A namespace reads its shard's folder only."""
        shard, rest = plan_query(where, namespace, self.shards)
        rows = self.rows().where(shard)
        if not self.state["indexed"]:
            hits = top_k(rows.where(rest), query, k, "id", "vec")
        else:
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, q array<double>")
            found = self.search_batch(one, k, where, namespace, "query_id", "q", ef).select(F.col("row_id").alias("id"), "distance")
            hits = (rows.join(F.broadcast(found), "id") if payloads else found).orderBy("distance", "id")  # k rows
        return hits.select("id", "distance", full_payload().alias("payload")) if payloads else hits.select("id", "distance")

    def search_batch(
        self, queries: DataFrame, k: int, where: dict | None = None, namespace: str | None = None, query_id: str = "query_id", query_vec: str = "vec", ef: int = 50
    ) -> DataFrame:
        """(query_id, row_id, distance, rank) of the k nearest rows that match, for every query.

        A segment's graph is walked unless so few of its rows match that measuring them is cheaper, see
        ``knn.prefers_exact``; a walk passes all nodes and keeps those that match.
        """
        shard, rest = plan_query(where, namespace, self.shards)
        chosen = self.rows().where(shard).where(rest).withColumn("block", self._block())
        bound, keys = self.state["indexed"], ["shard", "block"]
        measured, walked = chosen, None
        if bound:
            graphs = self.graphs().where(shard)
            if not where and namespace is None:
                measured, walked = chosen.where(F.col("id") >= bound), graphs
            else:
                inside = chosen.where(F.col("id") < bound).select("id", *keys)
                sizes = graphs.select(*keys, F.size("ids").alias("size"))
                counts = inside.groupBy(*keys).agg(F.count("*").alias("matches")).join(sizes, keys)  # a row a segment
                plan = counts.select(*keys, prefers_exact(F.col("matches"), F.col("size"), ef).alias("exact"))
                measured = chosen.join(plan.where("not exact"), keys, "left_anti")
                lists = inside.join(plan.where("not exact"), keys, "left_semi").groupBy(*keys).agg(F.collect_list("id").alias("allowed"))  # of a segment
                walked = graphs.join(lists, keys)
        found = top_k_batch(measured, queries, k, "id", "vec", query_id, query_vec)
        if walked is None:
            return found
        column = "allowed" if "allowed" in walked.columns else None
        both = found.drop("rank").unionByName(search_graphs_batch(walked, queries, k, query_id, query_vec, ef, column).drop("rank"))
        return merge_ranked(both, k)

    def records_after(self, seq: int) -> DataFrame | None:
        """The rows of later writes; None if the log was folded into the base beyond ``seq``."""
        return None if seq < self.state["base_seq"] else self.rows().where(F.col("seq") > seq)

    def compact(self) -> None:
        """Fold all parts into one base; ids, shards and seqs stay."""
        if len(self.state["parts"]) < 2:
            return
        path = self._part(f"base-{self.state['seq']:08d}")
        self.rows().repartition("shard", self._block()).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)
        self._publish(self.state | {"parts": [{"path": path, "seq": self.state["seq"]}], "base_seq": self.state["seq"]})

    def export(self, path: str) -> None:
        self.rows().write.partitionBy("shard").parquet(path)

    def install(self, path: str, seq: int) -> None:
        """Replace the whole content by a copy of an exported one."""
        own = self._part(f"base-{seq:08d}")
        self.spark.read.schema(SCHEMA).parquet(path).write.partitionBy("shard").parquet(own)
        rows = self.spark.read.schema(SCHEMA).parquet(own)
        top = rows.agg(F.coalesce(F.max("id") + 1, F.lit(0)), F.max(F.size("vec"))).first()
        self._publish(self.state | {"parts": [{"path": own, "seq": seq}], "seq": seq, "base_seq": seq, "next_id": top[0], "dim": top[1], "indexed": 0, "graphs": []})


def full_payload() -> Column:
    """The payload text with the namespace as a field, as a reader of the collection gets it."""
    name = F.to_json(F.struct(F.col("namespace").alias(NAMESPACE_FIELD)))
    bare = F.coalesce(F.trim("payload"), F.lit("{}"))
    joined = F.when(bare.rlike(r"^\{\s*\}$"), name).otherwise(
        F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(", "), F.substring(name, F.lit(2), F.length(name)))
    )
    return F.when(F.col("namespace").isNull(), F.col("payload")).otherwise(joined)
