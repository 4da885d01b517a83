"""Queries over texts, files, memories, server states and evaluations, with their SQL. Every query runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import documents, evals, health, memory
from lodequery.operators.chunking import chunk
from lodequery.operators.incremental import clean_sha256, is_committed, merge_intervals
from lodequery.operators.knn import top_k_batch, within_batch
from lodequery.plans.search import crc32_sql
from lodequery.session import materialize, shared_dir, spread, table, utc_micros
from lodequery.streaming.ingest import read_replayed, replay


def hash_embedding_sparse(spark: SparkSession, d: str) -> DataFrame:
    weights = T.hashed_weights(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")
    return weights.select(F.col("row_id").alias("doc_id"), "bucket", F.round("weight", 6).alias("weight"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("passage_id", "heading", "text").distinct()


def _embeddable(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).withColumn("full", T.embedding_text("heading", "text"))


def hash_embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    """Questions (every hundredth) against all passages."""
    asked = table(spark, d, "eval_items").where("item_id % 100 = 0")
    hits = top_k_batch(_embeddable(spark, d), asked, 5, "passage_id", "full", "item_id", "question", embed=T.hash_matrix)
    return hits.select(F.col("query_id").alias("item_id"), F.col("row_id").alias("passage_id"), "rank", (F.round("distance", 5) + 0.0).alias("distance"))


#: Copies of one text that a task joins with a query at once.
_COPIES = 4_096


def near_duplicates(spark: SparkSession, d: str, within: float = 0.03) -> DataFrame:
    """Passages (every hundredth) and all passages of nearly the same words: similarity 0.97 or more.

    Passages of one text are one class, named by its smallest id: classes are searched, and each pair of them stands
    for all pairs of their members. The members of a large class are joined in blocks.
    """
    texts = _passages(spark, d).where("passage_id is not null")
    texts = texts.withColumn("full", T.embedding_text("heading", "text")).withColumn("digest", F.sha2("full", 256))
    asks = F.col("passage_id") % 100 == 0
    classes = texts.groupBy("digest").agg(
        F.min("passage_id").alias("class"), F.any_value("full").alias("full"), F.max(asks).alias("asked"), F.count("*").alias("size")
    )
    classes = classes.withColumn("blocks", F.ceil(F.col("size") / _COPIES))
    classes = materialize(classes.select("digest", "class", "asked", "blocks", "full"), "classes")
    block = F.pmod(F.xxhash64("passage_id"), "blocks").alias("block")
    members = texts.select("digest", "passage_id").join(classes.select("digest", "class", "blocks"), "digest").select("class", "passage_id", block)
    asked = classes.where("asked").select(F.col("class").alias("qclass"), F.col("full").alias("question"))
    pairs = within_batch(classes, asked, within, "class", "full", "qclass", "question", T.hash_matrix).withColumnsRenamed({"query_id": "qclass", "row_id": "class"})
    queries = members.where(asks).select(F.col("class").alias("qclass"), F.col("passage_id").alias("query_id"))
    hits = pairs.join(queries, "qclass").join(classes.select("class", "blocks"), "class")
    hits = hits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = hits.join(members, ["class", "block"]).where("passage_id <> query_id")
    return found.select("query_id", "passage_id", (F.round("distance", 5) + 0.0).alias("distance"))


def related_passages(spark: SparkSession, d: str) -> DataFrame:
    """The same for passages that share many words only: similarity 0.5 or more."""
    return near_duplicates(spark, d, 0.5)


def retrieval_mrr(spark: SparkSession, d: str) -> DataFrame:
    """All questions against all passages: does the section that a question is about come first?"""
    items = table(spark, d, "eval_items").where("section is not null")
    rows = _embeddable(spark, d)
    hits = top_k_batch(rows, items, 10, "passage_id", "full", "item_id", "question", embed=T.hash_matrix)
    headed = hits.join(rows.select(F.col("passage_id").alias("row_id"), "heading"), "row_id").withColumnRenamed("query_id", "item_id")
    firsts = evals.first_correct(headed, items.select("item_id", "kind", "section"), "item_id", "rank", "heading", "section")
    kinds = items.select("item_id", F.col("kind").alias("k"))
    return evals.rank_measures(firsts.join(kinds, "item_id").drop("kind"), "k").withColumnRenamed("k", "kind")


def answerable(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose section no passage has."""
    items = table(spark, d, "eval_items").where("section is not null")
    return evals.unknown_answers(items, table(spark, d, "passages"), "section", "heading").select("item_id", "section")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", F.size(T.sentences("text")).cast("long").alias("sentences"))
    return texts


def passage_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunk(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")
    return made.select(F.col("row_id").alias("doc_id"), "index", "heading", F.length("text").alias("n_chars"))


def passages_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the distinct words of at most 1,000 characters that its passages hold, whether all passages keep
    the limit, and whether they are numbered from 0 on."""
    made = materialize(chunk(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text"), "passages")
    words = made.select("row_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    kept = words.where(F.length("w") <= 1000).groupBy("row_id").agg(F.countDistinct("w").alias("words"))
    form = made.groupBy("row_id").agg(
        (F.max(F.length("text")) <= 1000).alias("short"), ((F.max("index") == F.count("*") - 1) & (F.countDistinct("index") == F.count("*"))).alias("dense")
    )
    return form.join(kept, "row_id", "left").select(F.col("row_id").alias("doc_id"), F.coalesce("words", F.lit(0)).alias("words"), "short", "dense")


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("passage_id", F.sha2(T.embedding_text("heading", "text"), 256).alias("digest"))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


def describe_age(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", utc_micros("ts").alias("t"))
    now = events.agg(F.max("t")).first()[0] or 0
    return events.select("event_id", T.describe_age((F.lit(now) - F.col("t")) / 1e6).alias("age"))


def claimed_outcome(spark: SparkSession, d: str) -> DataFrame:
    claim = F.when(F.col("outcome").isNull(), "no claim").when(is_committed("outcome"), "**Outcome: Fixed**").otherwise("outcome : needs a person.")
    report = F.concat(F.lit("Report of the run\nOutcome: unclear\n"), claim, F.lit("\n"))
    runs = table(spark, d, "ingest_runs").select("run_id", "shard", T.claimed_outcome(report).alias("claim"))
    return runs.distinct()


def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Listings against what the last committed attempt of their key took in."""
    taken = table(spark, d, "sources").where(is_committed("outcome")).groupBy("source_key").agg(F.max(F.struct("attempt", clean_sha256("sha256").alias("sha256"))).alias("l"))
    listed = table(spark, d, "file_scans").select("source_key", clean_sha256("sha256").alias("sha256")).where("sha256 is not null").distinct()
    return documents.classify(listed, taken.select("source_key", "l.sha256"), "source_key", "sha256")


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "sources").where(is_committed("outcome")).groupBy("source_key").agg(F.max_by(F.struct("space_name", "passages"), "attempt").alias("l"))
    return documents.source_listing(taken.select("source_key", "l.*"), "space_name", "passages")


def _records(spark: SparkSession, d: str, once: bool = False) -> DataFrame:
    return memory.from_payloads(spread(table(spark, d, "memory_log"), "delivery_id"), "mem_owner", "seq", "payloads", once)


def memory_live(spark: SparkSession, d: str) -> DataFrame:
    """Memories that no record names, whatever the order."""
    return memory.live_ids(_records(spark, d))


def memory_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return memory.replaced(_records(spark, d))


def memory_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where("type = 'memory' and tags is not null")
    return rows.select("owner", "memory_id", "seq", F.array_join(memory.clean_tags(F.col("tags")), ",").alias("tags")).distinct()


def memory_recency(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where("type = 'memory' and created is not null").select("owner", "memory_id", "created").distinct()
    now = rows.agg(F.max("created")).first()[0] or 0.0
    return rows.select("owner", "memory_id", F.round(memory.recency(F.lit(now) - F.col("created")), 9).alias("bonus"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """One owner's memories for a question; all owners' rows are read, the owner's searched."""
    owner = table(spark, d, "memory_log").groupBy("mem_owner").count().orderBy(F.desc("count"), "mem_owner").first()[0]
    own = _records(spark, d, True).where(F.col("owner") == owner)
    own = own.withColumn("_first", F.coalesce(F.col("text"), F.concat("seq", F.lit("/"), "place"))).groupBy("owner", "type", "memory_id", "_first")
    rows = own.agg(F.first("text").alias("text"), F.first("tags").alias("tags"), F.max("created").alias("created"), F.flatten(F.collect_list("replaces")).alias("replaces"))
    hits = memory.recall(rows.withColumn("vec", T.hash_embed_udf()("text")), owner, T.hash_embed(_QUESTION), 1.8e9, 5)
    return hits.select("memory_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What the committed runs skip, and what the log itself skips."""
    runs = table(spark, d, "ingest_runs").where(is_committed("outcome"))
    skipped = health.interval_gaps(merge_intervals(runs, "shard", "first_seq", "last_seq"), "shard").withColumn("of", F.lit("runs"))
    return skipped.unionByName(health.sequence_gaps(table(spark, d, "vector_log"), "shard", "seq").withColumn("of", F.lit("log")))


def log_after(spark: SparkSession, d: str) -> DataFrame:
    """Records of each shard after the last seq that a successful run took over."""
    done = table(spark, d, "ingest_runs").where(is_committed("outcome")).groupBy("shard").agg(F.max("last_seq").alias("done"))
    log = table(spark, d, "vector_log").join(done, "shard", "left").where("done is null or seq > done")
    return log.select("shard", "seq").distinct()


def replay_state(spark: SparkSession, d: str) -> DataFrame:
    """Each shard's records, vectors and last seq after replaying its whole deliveries once each."""
    whole = table(spark, d, "vector_log").where("size(vec_values) = size(global_ids) * dim")
    once = whole.groupBy("shard", "seq").agg(F.max(F.size("global_ids")).alias("n"))
    return once.groupBy("shard").agg(F.count("*").alias("records"), F.sum("n").cast("long").alias("vectors"), F.max("seq").alias("last_seq"))


def _servers(spark: SparkSession, d: str) -> DataFrame:
    """Three copies of each shard, whose state is what their runs say."""
    runs = table(spark, d, "ingest_runs").withColumn("replica", (F.col("run_id") % 3).cast("int"))
    return runs.groupBy("shard", "replica").agg(
        (F.count_if(is_committed("outcome")) > 0).alias("up"),
        (F.count_if(F.lower(F.trim("outcome")) == "running") > 0).alias("process"),
        F.count("*").alias("size"),
        F.max("last_seq").alias("last_seq"),
        F.min("first_seq").alias("snapshot_seq"),
    )


def health_problems(spark: SparkSession, d: str) -> DataFrame:
    return health.find_problems(_servers(spark, d)).select("shard", "kind", "problem")


def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    return health.repair_plan(_servers(spark, d))


def server_totals(spark: SparkSession, d: str) -> DataFrame:
    return health.status(_servers(spark, d))


def ops_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    runs = e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("setup"),
        F.col("event_type").alias("scenario"),
        (F.col("value") > 50).alias("success"),
        F.when(F.col("event_id") % 17 == 0, "lost").alias("error"),
        (F.col("event_id") % 9).alias("turns"),
        (F.col("event_id") % 1000).alias("tokens"),
    )
    return evals.run_summary(runs, "setup", "scenario", "success", "error", "turns", "tokens")


def stream_ingest_replay(spark: SparkSession, d: str) -> DataFrame:
    """The vector log as a stream, replayed into a folder of batches; what the batches hold together."""
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    replay(spark, f"{d}/vector_log.parquet", f"{base}/out", f"{base}/checkpoint", files=8).awaitTermination()
    rows = read_replayed(spark, f"{base}/out").where("shard is not null")
    return rows.groupBy("shard").agg(F.count("*").alias("deliveries"), F.countDistinct("delivery_id").alias("distinct_deliveries"))


QUERIES = {
    f.__name__: f
    for f in (
        hash_embedding_sparse, hash_embedding_knn, near_duplicates, related_passages, retrieval_mrr, answerable, sentence_split, passage_chunks, passages_kept, embedding_text,
        snippet, describe_age, claimed_outcome, doc_fingerprint, ingest_dedup, source_listing, memory_live, memory_tombstones, memory_tags,
        memory_recency, memory_recall, sequence_gaps, log_after, replay_state, health_problems, repair_plan, server_totals, ops_summary,
        stream_ingest_replay,
    )
}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_COMMITTED = "lower(trim(outcome)) = 'committed'"
_SHA = "nullif(regexp_extract(lower(sha256), '(?:^|[^0-9a-f])([0-9a-f]{64})\\s*$', 1), '')"
_PASSAGES = "p as (select distinct passage_id, heading, text, case when coalesce(heading, '') <> '' then heading || chr(10) || chr(10) || text else text end as full_text from passages)"


def _weights(name: str, row_id: str, text: str, source: str) -> str:
    return f"""{name}_w as (select {row_id} as id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as w from {source}),
{name}_c as (select id, case when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end as t, count(*) as c
  from {name}_w where w not in ({_STOP}) group by 1, 2),
{name}_h as (select t, {crc32_sql('t')} as h from (select distinct t from {name}_c)),
{name}_b as (select id, (h % 512)::int as bucket, sum(c * case when (h >> 16) & 1 = 1 then 1 else -1 end) as n from {name}_c join {name}_h using (t) group by 1, 2),
{name}_d as (select id, bucket, sign(n) * ln(1 + abs(n)) as x from {name}_b where n <> 0),
{name} as (select id, bucket, x / sqrt(sum(x * x) over (partition by id)) as weight from {name}_d)"""


_SEARCH = f"""dist as (select q.id as query_id, p.id as row_id, 1 - sum(q.weight * p.weight) as d from q join pw p using (bucket) group by 1, 2)"""
_QUESTION = "their furnace and the plain shard"
_RECORDS = """raw as (select mem_owner as owner, seq, unnest(payloads) as body, unnest(range(len(payloads))) as place from memory_log),
good as (select owner, seq, place, any_value(body::json) as j from raw where json_valid(body) group by 1, 2, 3),
gone as (select distinct owner, memory_id from (
  select owner, unnest(case when json_type(j, '$.replaces') = 'ARRAY' then (j->>'$.replaces[*]')
                            when json_type(j, '$.replaces') = 'VARCHAR' then [j->>'replaces'] else [] end) as memory_id from good) where memory_id is not null)"""
_SERVERS = """s as (select shard, (run_id % 3)::int as replica, count(*) filter (lower(trim(outcome)) = 'committed') > 0 as up,
  count(*) filter (lower(trim(outcome)) = 'running') > 0 as process, count(*) as size, max(last_seq) as last_seq, min(first_seq) as snapshot_seq
  from ingest_runs group by 1, 2)"""

SQL = {
    "hash_embedding_sparse": f"with {_weights('p', 'doc_id', 'text', 'documents')} select id as doc_id, bucket, round(weight, 6) as weight from p",
    "hash_embedding_knn": f"""with {_PASSAGES}, {_weights('pw', 'passage_id', 'full_text', 'p')},
{_weights('q', 'item_id', 'question', '(select * from eval_items where item_id % 100 = 0)')}, {_SEARCH}
select query_id as item_id, row_id as passage_id, row_number() over (partition by query_id order by round(d, 12), row_id) as rank, round(d, 5) + 0.0 as distance
from dist qualify rank <= 5""",
    "near_duplicates": f"""with {_PASSAGES}, {_weights('pw', 'passage_id', 'full_text', 'p')}, q as (select * from pw where id % 100 = 0), {_SEARCH}
select query_id, row_id as passage_id, round(d, 5) + 0.0 as distance from dist where d <= 0.03 and query_id <> row_id""",
    "retrieval_mrr": f"""with {_PASSAGES}, {_weights('pw', 'passage_id', 'full_text', 'p')},
{_weights('q', 'item_id', 'question', '(select * from eval_items where section is not null)')}, {_SEARCH},
r as (select query_id, row_id, row_number() over (partition by query_id order by round(d, 12), row_id) as rank from dist qualify rank <= 10),
f as (select item_id, kind, (select min(rank) from r join p on p.passage_id = r.row_id where r.query_id = item_id and p.heading = e.section) as first
      from eval_items e where section is not null)
select coalesce(kind, 'all') as kind, count(*) as questions, round(avg(case when first <= 1 then 1.0 else 0.0 end), 6) as hit_at_1,
  round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as hit_at_5, round(avg(coalesce(1.0 / first, 0)), 6) as mrr
from f group by grouping sets ((kind), ())""",
    "answerable": "select item_id, section from eval_items where section is not null and section not in (select heading from passages where heading is not null)",
    "sentence_split": """select doc_id, len(string_split(regexp_replace(text, '([.!?])[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+([A-Z0-9"''(\\[`*_])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as sentences from documents""",
    "passages_kept": """select doc_id, (select count(distinct w) from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w) where length(w) <= 1000)
  as words, true as short, true as dense from documents where regexp_matches(text, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]')""",
    "embedding_text": f"with {_PASSAGES} select passage_id, sha256(full_text) as digest from p",
    "snippet": """with o as (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x{0B}\\f\\r]+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) <= 240 then t else regexp_replace(substring(t, 1, 240), '\\s\\S*$', '') || ' ...' end as snippet from o""",
    "describe_age": """with a as (select event_id, ((select max(epoch_us(ts)) from events) - epoch_us(ts)) / 1e6 as s from events),
u as (select event_id, case when s >= 86400 then 'day' when s >= 3600 then 'hour' when s >= 60 then 'minute' end as unit,
  floor(case when s >= 86400 then s / 86400 when s >= 3600 then s / 3600 else s / 60 end)::bigint as n from a)
select event_id, case when unit is null then 'just now' else n || ' ' || unit || case when n > 1 then 's' else '' end || ' ago' end as age from u""",
    "claimed_outcome": f"""select distinct run_id, shard, case when outcome is null then null when {_COMMITTED} then 'fixed' else 'needs a person' end as claim from ingest_runs""",
    "doc_fingerprint": "select doc_id, sha256(text) as sha256 from documents",
    "ingest_dedup": f"""with t as (select source_key, arg_max({_SHA}, attempt) as had from sources where {_COMMITTED} group by 1)
select distinct f.source_key, {_SHA.replace('sha256', 'f.sha256')} as sha256,
  case when had is null then 'new' when had = {_SHA.replace('sha256', 'f.sha256')} then 'unchanged' else 'changed' end as state
from file_scans f left join t using (source_key) where {_SHA.replace('sha256', 'f.sha256')} is not null""",
    "source_listing": f"""with t as (select source_key, arg_max(struct_pack(s := space_name, p := passages), attempt) as l from sources where {_COMMITTED} group by 1),
n as (select distinct l.s as s from t where l.s is not null order by 1 limit 50)
select count(*) as files, coalesce(sum(l.p), 0)::bigint as passages, (select string_agg(s, ',' order by s) from n) as namespaces from t""",
    "memory_live": f"""with {_RECORDS}, m as (select distinct owner, j->>'memory_id' as memory_id from good where j->>'type' = 'memory')
select owner, memory_id from m anti join gone using (owner, memory_id)""",
    "memory_tombstones": f"with {_RECORDS} select owner, memory_id from gone",
    "memory_tags": f"""with {_RECORDS} select distinct owner, j->>'memory_id' as memory_id, seq, array_to_string(list_sort(list_distinct(j->>'$.tags[*]')), ',') as tags
from good where j->>'type' = 'memory' and json_type(j, '$.tags') = 'ARRAY'""",
    "memory_recency": f"""with {_RECORDS}, m as (select distinct owner, j->>'memory_id' as memory_id, (j->>'created')::double as created from good where j->>'type' = 'memory' and j->>'created' is not null)
select owner, memory_id, round(0.03::double * pow(0.5::double, greatest((select max(created) from m) - created, 0) / 86400 / 30), 9) as bonus from m""",
    "memory_recall": f"""with {_RECORDS},
o as (select mem_owner as owner from memory_log group by 1 order by count(*) desc, 1 limit 1),
m as (select row_number() over (order by memory_id, text) as id, * from (
  select j->>'memory_id' as memory_id, j->>'text' as text, max((j->>'created')::double) as created
  from good join o using (owner) where j->>'type' = 'memory' and j->>'text' is not null group by 1, 2)),
{_weights('pw', 'id', 'text', 'm')}, {_weights('q', 'id', 'question', "(select 0 as id, '" + _QUESTION + "' as question)")}, {_SEARCH},
n as (select m.memory_id, m.created, coalesce(1 - d, 0.0) as s from m left join dist on row_id = m.id order by round(s, 12) desc, memory_id limit 20),
r as (select *, s + 0.03::double * pow(0.5::double, greatest(1.8e9::double - created, 0) / 86400 / 30) as score from n
  where memory_id not in (select memory_id from gone join o using (owner)))
select memory_id, round(s, 6) as similarity, round(score, 6) as score from r order by r.score desc, s desc, memory_id limit 5""",
    "sequence_gaps": f"""with o as (
  select distinct 'log' as of, shard, seq from vector_log
  union
  select 'runs', shard, unnest(range(first_seq, last_seq + 1)) from ingest_runs where {_COMMITTED}),
g as (select of, shard, coalesce(lag(seq) over (partition by of, shard order by seq), 0)::bigint as after_seq, seq as next_seq from o)
select of, shard, after_seq, next_seq from g where next_seq <> after_seq + 1""",
    "log_after": f"""with m as (select shard, max(last_seq) as done from ingest_runs where {_COMMITTED} group by 1)
select distinct v.shard, v.seq from vector_log v left join m using (shard) where done is null or seq > done""",
    "replay_state": """with o as (select shard, seq, max(len(global_ids)) as n from vector_log where len(vec_values) = len(global_ids) * dim group by 1, 2)
select shard, count(*) as records, sum(n)::bigint as vectors, max(seq) as last_seq from o group by 1""",
    "health_problems": f"""with {_SERVERS}
select shard, 0 as kind, 'shard ' || shard || ' replica ' || replica || case when process then ' does not answer, although its process is running' else ' is down' end as problem
from s where not up
union all
select shard, 1, case when not bool_or(up) then 'shard ' || shard || ' has no live replica: searches that need it fail' else 'replicas of shard ' || shard ||
  ' are out of sync (' || string_agg('replica ' || replica || ' at seq ' || last_seq, ', ' order by replica) filter (up) || ')' end
from s group by shard having not bool_or(up) or count(distinct last_seq) filter (up) > 1""",
    "repair_plan": f"""with {_SERVERS}, n as (select shard, arg_max(struct_pack(r := replica, l := last_seq, f := snapshot_seq), (last_seq, -replica)) as b from s where up group by 1)
select s.shard, s.replica, b.r as source, case when s.last_seq < b.f then 'snapshot' else 'log' end as method, b.l - s.last_seq as records
from s join n using (shard) where s.up and s.last_seq < b.l""",
    "server_totals": f"""with {_SERVERS}, b as (select arg_max(size, (last_seq, replica)) as size from s where up group by shard)
select count(*) as servers, count(*) filter (up) as up, count(distinct shard) as shards, (select coalesce(sum(size), 0)::bigint from b) as vectors from s""",
    "ops_summary": """with r as (select 's' || (user_id % 3) as setup, event_type as scenario, value > 50 as success, event_id % 17 = 0 as lost, event_id % 9 as turns, event_id % 1000 as tokens from events),
g as (select setup, coalesce(scenario, 'all') as scenario, count(*) filter (not lost) as runs, count(*) filter (not lost and success) as successes,
  median(turns) filter (not lost) as median_turns, round(avg(tokens) filter (not lost), 6) as mean_tokens, count(*) filter (lost) as errors
  from r group by grouping sets ((setup, scenario), (setup))),
w as (select *, successes::double / runs as p, 1.959963984540054::double as z, runs::double as n from g)
select setup, scenario, runs, successes, round(p, 6) as rate,
  round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as high,
  median_turns, mean_tokens, errors from w""",
    "stream_ingest_replay": "select shard, count(*) as deliveries, count(distinct delivery_id) as distinct_deliveries from vector_log where shard is not null group by 1",
}
SQL["related_passages"] = SQL["near_duplicates"].replace("d <= 0.03", "d <= 0.5")
