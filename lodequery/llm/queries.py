"""Queries of the llm problems. Their results aren't expressible in SQL where no SQL is given; see tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.llm.knn_graph import nearest_neighbors
from lodequery.llm.leakage import find_leaks
from lodequery.llm.markup import clean_passages, markup_found
from lodequery.llm.packing import corpus_shares, mixture, pack_documents, room_left
from lodequery.llm.repetition import find_repetitive, measure_repetition
from lodequery.llm.segment import LIMIT, OVERLAP, cut_kinds, split_passages
from lodequery.operators.knn import top_k_batch
from lodequery.session import materialize, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_kinds(split_passages(table(spark, d, "passages"), renumber=False))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_passages(table(spark, d, "passages"))


#: White space as Python knows it, for expressions of Spark and SQL.
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each passage that was split the characters beside white space that its pieces hold together, each once; whether
    all pieces keep the limit and the overlap, are numbered from 0 and have the passage's heading."""
    pieces = materialize(split_passages(table(spark, d, "passages")), "whole")
    own = Window.partitionBy("passage_id").orderBy("piece_no")  # the pieces of one passage
    told = pieces.withColumn("before", F.coalesce(F.lag("stop").over(own), F.lit(0)))
    new = F.substring("text", F.greatest(F.lit(0), F.col("before") - F.col("start")) + 1, F.length("text"))
    told = told.withColumn("letters", F.length(F.regexp_replace(new, _SPACE, "")))
    return told.groupBy("passage_id").agg(
        F.sum("letters").cast("long").alias("letters"),
        F.bool_and(F.length("text") <= LIMIT).alias("short"),
        F.bool_and((F.col("piece_no") == 0) | (F.col("before") - F.col("start") <= OVERLAP)).alias("shared"),
        ((F.count("*") == F.max("n_pieces")) & (F.max("piece_no") == F.count("*") - 1) & (F.max("chunk_index") - F.min("chunk_index") == F.count("*") - 1)).alias("dense"),
        F.max("heading").alias("heading"),
    )


def p4_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose text has no sign that any markup begins with, as they come out."""
    cleaned = clean_passages(table(spark, d, "passages"))
    unsigned = table(spark, d, "passages").where(~F.col("text").rlike(_SIGNS)).select("passage_id")
    return cleaned.join(unsigned, "passage_id", "left_semi").select("passage_id", F.md5("text").alias("digest"))


_SIGNS = r"[<&$\\`*_\[{|~#>=]|''|--|[-+][ \t]|\d\.[ \t]"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup_found(clean_passages(table(spark, d, "passages")))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_passages(table(spark, d, "passages")).select("passage_id", "text", "heading").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_neighbors(table(spark, d, "vector_log"), k=5, min_similarity=0.9)
    return near.select(F.least("id", "neighbor").alias("id_lo"), F.greatest("id", "neighbor").alias("id_hi")).distinct()


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return nearest_neighbors(table(spark, d, "vector_log"), k=5)


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every vector of an id divisible by 100 against all of them: is recall@5 against the exact search at least 0.9?"""
    log = table(spark, d, "vector_log")
    asked = F.col("id") % 100 == 0
    near = nearest_neighbors(log, k=5).where(asked).select("id", F.col("neighbor").alias("row_id"))
    whole = log.where(F.size("vec_values") == F.size("global_ids") * F.col("dim")).select(F.posexplode("global_ids").alias("pos", "id"), "dim", "vec_values")
    rows = materialize(whole.select("id", F.slice("vec_values", F.col("pos") * F.col("dim") + 1, F.col("dim")).alias("vec")).dropDuplicates(["id"]), "vectors")
    exact = top_k_batch(rows, rows.where(asked), 6, "id", "vec", "id", "vec").withColumnRenamed("query_id", "id").where("id <> row_id")
    best = exact.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("n <= 5")
    hits = best.join(near.withColumn("hit", F.lit(1)), ["id", "row_id"], "left").agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
    return hits.select("expected", (F.col("hits") >= 0.9 * F.col("expected")).alias("enough"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    return room_left(p6_containers(spark, d))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far windows of containers are from the corpus's proportions of sources."""
    packed = materialize(p6_containers(spark, d), "packed")
    return mixture(packed, corpus_shares(packed))


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each limit the documents that are packed, containers that are too full, and pieces that are there twice or
    are missing: piece numbers of a document run from 0, and all but the last piece fill a container."""
    packed = materialize(p6_containers(spark, d), "packed")
    keys = ["limit_name", "capacity_tokens"]
    room = packed.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("t"))
    full = room.groupBy(*keys).agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("too_full"))
    each = packed.groupBy(*keys, "doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("piece_no").alias("d"), F.max("piece_no").alias("last"),
        F.count_if(F.col("n_tokens") == F.col("capacity_tokens")).alias("whole"),
    )
    counts = each.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.sum(F.col("n") - F.col("d")).alias("twice"),
        F.count_if((F.col("d") <= F.col("last")) | (F.col("whole") < F.col("last"))).alias("incomplete"),
    )
    return counts.join(full, keys).select(*keys, "documents", "too_full", "twice", "incomplete")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_repetitive(table(spark, d, "documents")).select("doc_id").distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return measure_repetition(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_pieces, p3_whole, p4_found, p4_clean, p4_unchanged, p5_found, p5_neighbors, p5_recall, p6_containers, p6_room, p6_mixture, p6_whole, p7_found, p8_found,
        p8_shares,
    )
}
SQL: dict[str, str] = {
    "p3_found": r"""
select distinct passage_id, case when regexp_matches(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]{1000}[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]') then 'hard' else 'natural' end as cut_kind
from passages where length(text) > 1000 and passage_id is not null""",
    "p5_found": """
with v as (
  select distinct on (id) id, list_slice(vals, pos * dim + 1, pos * dim + dim)::double[] as x
  from (select unnest(global_ids) as id, unnest(range(len(global_ids))) as pos, dim, vec_values as vals
        from vector_log where len(vec_values) = len(global_ids) * dim)),
n as (select id, x, sqrt(list_inner_product(x, x)) as norm from v),
s as (select a.id as a, b.id as b, case when a.norm = 0 or b.norm = 0 then 0 else round(list_inner_product(a.x, b.x) / (a.norm * b.norm), 9) end as sim
      from n a, n b where a.id <> b.id),
t as (select a, b, sim from s qualify row_number() over (partition by a order by sim desc, b) <= 5)
select distinct least(a, b) as id_lo, greatest(a, b) as id_hi from t where sim >= 0.9""",
    "p5_recall": """
select 5 * count(distinct id) as expected, true as enough
from (select unnest(global_ids) as id from vector_log where len(vec_values) = len(global_ids) * dim) where id % 100 = 0""",
    "p6_whole": """
select limit_name, capacity_tokens, (select count(distinct doc_id) from documents) as documents, 0 as too_full, 0 as twice, 0 as incomplete
from pack_limits where capacity_tokens > 0""",
    "p3_whole": f"""
select passage_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) as letters, true as short, true as shared, true as dense, heading
from (select distinct passage_id, text, heading from passages) where length(text) > 1000 and passage_id is not null""",
    "p4_unchanged": f"""
select distinct passage_id, md5(text) as digest from passages where passage_id is not null and not regexp_matches(text, '{_SIGNS.replace("'", "''")}')""",
}
