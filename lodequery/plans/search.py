"""Queries over vectors, payloads, routing and searches, with their SQL. Every query runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.functions.filters import lookup, matches, plan_query, postings
from lodequery.functions.vectors import cosine_distance, norm, normalize
from lodequery.operators import evals, knn, routing
from lodequery.operators.ann import IVF, build_graphs, lsh_search_batch, search_graphs_batch
from lodequery.session import materialize, shared_dir, table
from lodequery.sources.store import VectorStore

SHARDS, K = 4, 10


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(_vectors(spark, d).where(F.col("vec_id") == vec_id).first()["embedding"])


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with a payload made of their columns."""
    tags = F.array(F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"), F.lit("all"))
    body = F.struct(F.col("label"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("colour"), (F.col("vec_id") % 2 == 0).alias("flag"), tags.alias("tags"))
    return _vectors(spark, d).withColumn("payload", F.to_json(body))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, (F.round("distance", 6) + 0.0).alias("distance"))


def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.round(norm("embedding"), 6).alias("length"))


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    parts = _vectors(spark, d).select("vec_id", F.posexplode(normalize("embedding")).alias("pos", "x"))
    return parts.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


def cosine_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _vectors(spark, d).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return _rounded(a.join(b, "vec_id").withColumn("distance", cosine_distance("embedding", "other")), "vec_id")


def knn_single(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(knn.top_k(_vectors(spark, d), _query(spark, d), K, "vec_id", "embedding"), "vec_id")


def knn_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    hits = knn.top_k(_vectors(spark, d), _query(spark, d), K + 1, "vec_id", "embedding").where("vec_id <> 0").orderBy("distance", "vec_id").limit(K)
    rank = F.row_number().over(Window.orderBy("distance", "vec_id")).cast("long")  # K rows
    return hits.select("vec_id", rank.alias("rank"), F.round(1 - F.col("distance"), 6).alias("similarity"))


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    hits = knn.top_k_batch(_vectors(spark, d), _queries(spark, d), K, "vec_id", "embedding", "qid", "qvec")
    return _rounded(hits.withColumnRenamed("row_id", "vec_id"), "query_id", "vec_id", "rank")


def knn_filtered_label_in(spark: SparkSession, d: str) -> DataFrame:
    where = matches("payload", {"label": [1, 3]})
    return _rounded(knn.top_k(_payloads(spark, d), _query(spark, d), K, "vec_id", "embedding", where), "vec_id")


def knn_filtered_and(spark: SparkSession, d: str) -> DataFrame:
    where = matches("payload", {"colour": ["c0", "c1"], "flag": True, "tags": "even"})
    return _rounded(knn.top_k(_payloads(spark, d), _query(spark, d), K, "vec_id", "embedding", where), "vec_id")


def knn_namespace(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("tenant-"), F.col("label").cast("string"))
    rows = _payloads(spark, d).withColumn("namespace", name).withColumn("shard", routing.by_namespace("namespace", SHARDS))
    shard, rest = plan_query(None, "tenant-1", SHARDS)
    return _rounded(knn.top_k(rows.where(shard), _query(spark, d), K, "vec_id", "embedding", rest), "vec_id", "shard")


def scatter_gather_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("shard", routing.by_id("vec_id", SHARDS))
    lists = knn.local_top_k(rows, _query(spark, d), K, "vec_id", "embedding", "shard")
    return _rounded(knn.merge_top_k(lists, K, "vec_id"), "shard", "vec_id")


def partial_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("shard", routing.by_id("vec_id", SHARDS))
    down = spark.createDataFrame([(2,)], "shard int")
    hits = knn.partial_top_k(rows, down, _query(spark, d), K, "vec_id", "embedding", "shard")
    return _rounded(hits, "vec_id", "missing")


def filter_strategy_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).groupBy("label").agg(F.count("*").alias("matches"))
    size = _vectors(spark, d).count()
    return rows.select("label", "matches", F.when(knn.prefers_exact(F.col("matches"), F.lit(size), 50), "exact").otherwise("graph").alias("strategy"))


def shard_balance(spark: SparkSession, d: str) -> DataFrame:
    return routing.shard_sizes(_vectors(spark, d), routing.by_id("vec_id", SHARDS))


def namespace_routing(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "memory_log").select(F.col("mem_owner").alias("namespace")).where("namespace is not null").distinct()
    return names.select("namespace", routing.by_namespace("namespace", SHARDS).alias("shard"))


def next_id(spark: SparkSession, d: str) -> DataFrame:
    return routing.next_id(_vectors(spark, d), "vec_id")


def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_items").select("item_id")
    return routing.with_dense_ids(rows, "dense_id", 1000, "item_id").select("item_id", F.col("dense_id").cast("long").alias("dense_id"))


def payload_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings(table(spark, d, "events"), "event_id", "props")


def payload_filter_typed(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(matches("props", {"k": [1, 7, 69]}))
    return events.select("event_id", "event_type")


def payload_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = postings(_payloads(spark, d), "vec_id", "payload")
    return lookup(index, {"colour": ["c1", "c2"], "tags": "odd", "flag": False}).withColumnRenamed("row_id", "vec_id")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of a search that lacks one shard, against all of them."""
    rows = _vectors(spark, d).withColumn("shard", routing.by_id("vec_id", SHARDS))
    search = lambda r: knn.top_k_batch(r, _queries(spark, d), K, "vec_id", "embedding", "qid", "qvec")
    return evals.recall_at_k(search(rows.where("shard <> 1")), search(rows))


def post_filter_recall(spark: SparkSession, d: str) -> DataFrame:
    q, where = _query(spark, d), F.col("label") == 1
    one = lambda df: df.select(F.lit(0).alias("query_id"), F.col("vec_id").alias("row_id"))
    found = one(knn.post_filter(_vectors(spark, d), q, K, "vec_id", "embedding", where))
    return evals.recall_at_k(found, one(knn.top_k(_vectors(spark, d), q, K, "vec_id", "embedding", where)))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evals.percentiles(table(spark, d, "events"), "value", "event_type")


def _approximate(hits: DataFrame) -> DataFrame:
    return _rounded(hits.withColumnRenamed("row_id", "vec_id"), "query_id", "vec_id", "rank")


def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    return _approximate(IVF(_vectors(spark, d), "vec_id", "embedding", 16).search_batch(_queries(spark, d), K, 12, "qid", "qvec"))


def random_projection_search(spark: SparkSession, d: str) -> DataFrame:
    return _approximate(lsh_search_batch(_vectors(spark, d), _queries(spark, d), K, "vec_id", "embedding", "qid", "qvec"))


def hnsw_search(spark: SparkSession, d: str) -> DataFrame:
    """Shards of at most some 2,000 vectors, so that a walk finds as much in a large table as in a small one."""
    shards = max(SHARDS, -(-_vectors(spark, d).count() // 2_000))
    rows = _vectors(spark, d).withColumn("shard", routing.by_id("vec_id", shards))
    graphs = materialize(build_graphs(rows, "vec_id", "embedding", "shard"), "graphs")
    return _approximate(search_graphs_batch(graphs, _queries(spark, d), K, "qid", "qvec", 100))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Do the approximate searches find nine tenths of what the exact one finds?"""
    best = materialize(knn_batch(spark, d).select("query_id", "vec_id"), "best")
    rows = None
    for name, f in (("graphs", hnsw_search), ("cells", ivf_search), ("projections", random_projection_search)):
        hit = f(spark, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
        one = best.join(hit, ["query_id", "vec_id"], "left").agg(F.count("*").alias("expected"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
        one = one.select(F.lit(name).alias("index"), "expected", "enough")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def store_search(spark: SparkSession, d: str) -> DataFrame:
    """A store with graphs, in two writes, asked with a filter: segments with few matches are measured, not walked."""
    store = VectorStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", SHARDS, graph_rows=256)
    for part in (0, 1):
        store.add(_payloads(spark, d).where(F.col("vec_id") % 2 == part), "embedding", "payload", order="vec_id")
    store.index()
    hits = store.search_batch(_queries(spark, d), K, {"label": [1, 3], "tags": "all"}, query_id="qid", query_vec="qvec")
    return _rounded(hits, "query_id", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        vector_norm, vector_normalize, cosine_distance_pairs, knn_single, knn_exclude_self, knn_batch, knn_filtered_label_in, knn_filtered_and,
        knn_namespace, scatter_gather_topk, partial_results, filter_strategy_choice, shard_balance, namespace_routing, next_id, dense_ids,
        payload_postings, payload_filter_typed, payload_lookup, recall_at_k, post_filter_recall, latency_percentiles, ivf_search,
        random_projection_search, hnsw_search, ann_recall, store_search,
    )
}

_E = """v as (select vec_id, label, embedding::double[] as x, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
q as (select x as qx, n as qn from v where vec_id = 0),
dist as (select vec_id, label, case when n * qn = 0 then 1.0 else 1 - list_inner_product(x, qx) / (n * qn) end as d from v, q)"""
_TOP = "round(d, 6) + 0.0 as distance"


def crc32_sql(w: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({w}))), "
        f"lambda i: ('0x' || substr(hex(encode({w})), (2 * i + 1)::BIGINT, 2))::BIGINT)), "
        "lambda s, b: list_reduce(list_prepend(xor(s, b), [0,0,0,0,0,0,0,0]::BIGINT[]), "
        "lambda x, z: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"
    )


def _batch(rows: str) -> str:
    return f"""select a.vec_id as query_id, b.vec_id, 1 - list_inner_product(a.x, b.x) / (a.n * b.n) as d,
  row_number() over (partition by a.vec_id order by 1 - list_inner_product(a.x, b.x) / (a.n * b.n), b.vec_id) as rank
from v a, v b where a.vec_id % 100 = 0 and {rows} qualify rank <= 10"""


SQL = {
    "vector_norm": f"with {_E} select vec_id, round(n, 6) as length from v",
    "vector_normalize": f"""with {_E} select vec_id, unnest(range(len(x))) as pos, round(unnest(list_transform(x, lambda e: case when n > 0 then e / n else e end)), 6) + 0.0 as x from v""",
    "cosine_distance_pairs": f"""with {_E} select a.vec_id, round(1 - list_inner_product(a.x, b.x) / (a.n * b.n), 6) + 0.0 as distance from v a join v b on b.vec_id = a.vec_id + 1""",
    "knn_single": f"with {_E} select vec_id, {_TOP} from dist order by d, vec_id limit 10",
    "knn_exclude_self": f"""with {_E}, t as (select vec_id, d from dist order by d, vec_id limit 11)
select vec_id, row_number() over (order by d, vec_id) as rank, round(1 - d, 6) as similarity from t where vec_id <> 0 order by d, vec_id limit 10""",
    "knn_batch": f"with {_E}, b as ({_batch('true')}) select query_id, vec_id, rank, {_TOP} from b",
    "knn_filtered_label_in": f"with {_E} select vec_id, {_TOP} from dist where label in (1, 3) order by d, vec_id limit 10",
    "knn_filtered_and": f"with {_E} select vec_id, {_TOP} from dist where label % 3 in (0, 1) and vec_id % 2 = 0 order by d, vec_id limit 10",
    "knn_namespace": f"with {_E} select vec_id, ({crc32_sql(chr(39) + 'tenant-1' + chr(39))} % 4)::int as shard, {_TOP} from dist where label = 1 order by d, vec_id limit 10",
    "scatter_gather_topk": f"with {_E} select (vec_id % 4)::int as shard, vec_id, {_TOP} from dist order by d, vec_id limit 10",
    "partial_results": f"with {_E} select vec_id, '2' as missing, {_TOP} from dist where vec_id % 4 <> 2 order by d, vec_id limit 10",
    "filter_strategy_choice": """select label, count(*) as matches,
  case when count(*) * count(*) <= 100 * 50 * (select count(*) from embeddings) then 'exact' else 'graph' end as strategy from embeddings group by label""",
    "shard_balance": "select (vec_id % 4)::int as shard, count(*) as vectors from embeddings group by 1",
    "namespace_routing": f"select n as namespace, ({crc32_sql('n')} % 4)::int as shard from (select distinct mem_owner as n from memory_log where mem_owner is not null)",
    "next_id": "select coalesce(max(vec_id) + 1, 0)::bigint as next_id from embeddings",
    "dense_ids": "select item_id, 999 + row_number() over (order by item_id) as dense_id from eval_items",
    "payload_postings": """select distinct event_id as row_id, 'k' as field, 'BIGINT' as kind, props->>'k' as value from events
where json_type(props, '$.k') in ('UBIGINT', 'BIGINT')""",
    "payload_filter_typed": "select event_id, event_type from events where json_type(props, '$.k') in ('UBIGINT', 'BIGINT') and (props->>'k')::bigint in (1, 7, 69)",
    "payload_lookup": "select vec_id from embeddings where label % 3 in (1, 2) and vec_id % 2 = 1",
    "recall_at_k": f"""with {_E}, t as ({_batch('true')}), f as ({_batch('b.vec_id % 4 <> 1')}),
j as (select t.query_id, count(f.vec_id) as h, count(*) as n from t left join f on f.query_id = t.query_id and f.vec_id = t.vec_id group by 1)
select sum(h)::bigint as hits, sum(n)::bigint as expected, round(sum(h) / sum(n), 6) as recall, round(avg(h / n), 6) as mean_recall from j""",
    "post_filter_recall": f"""with {_E}, t as (select vec_id from dist where label = 1 order by d, vec_id limit 10),
f as (select vec_id from (select vec_id, label from dist order by d, vec_id limit 10) where label = 1),
j as (select count(f.vec_id) as h, count(*) as n from t left join f using (vec_id))
select h as hits, n as expected, round(h / n, 6) as recall, round(h / n, 6) as mean_recall from j""",
    "ann_recall": """select i as index, 10 * (select count(*) from embeddings where vec_id % 100 = 0) as expected, true as enough
from (values ('graphs'), ('cells'), ('projections')) t(i)""",
    "store_search": f"with {_E}, b as ({_batch('b.label in (1, 3)')}) select query_id, rank, {_TOP} from b",
    "latency_percentiles": """select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99,
  round(avg(value), 6) as mean, count(value) as n from events group by event_type""",
}
