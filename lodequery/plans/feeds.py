"""Queries of the general problems: new or changed records (p1) and the change feed (p2), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.operators.changefeed import ChangeFeed, memory_changes
from lodequery.operators.incremental import as_intervals, changed_files, is_committed, merge_intervals, subtract_intervals
from lodequery.session import shared_dir, spread, table


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return subtract_intervals(table(spark, d, "vector_log"), p1_processed(spark, d), "shard", "seq", "first_seq", "last_seq")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = changed_files(
        table(spark, d, "file_scans"), table(spark, d, "sources"), "source_key", "sha256", "seen_at", "attempt", "outcome"
    )
    one = files.select(F.lit("files").alias("feed"), F.col("key").alias("item_key"), F.col("version").alias("item_version"))
    two = _pending(spark, d).select(
        F.lit("log").alias("feed"), F.col("shard").cast("string").alias("item_key"), F.col("seq").cast("string").alias("item_version")
    )
    return one.unionByName(two)


def p1_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The pending stretches of each shard's log, as disjoint intervals."""
    return as_intervals(_pending(spark, d), "shard", "seq").withColumnsRenamed({"first": "first_seq", "last": "last_seq"})


def p1_processed(spark: SparkSession, d: str) -> DataFrame:
    """What the successful runs took over, as disjoint intervals."""
    runs = table(spark, d, "ingest_runs").where(is_committed("outcome"))
    return merge_intervals(runs, "shard", "first_seq", "last_seq").withColumnsRenamed({"first": "first_seq", "last": "last_seq"})


def _feed(spark: SparkSession) -> ChangeFeed:
    return ChangeFeed(spark, f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}")


def _current(state: DataFrame) -> DataFrame:
    return state.where("alive").select(F.col("owner").alias("mem_owner"), "memory_id", "seq")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The state that a feed of the whole log has published."""
    return _current(_feed(spark).publish(memory_changes(spread(table(spark, d, "memory_log"), "delivery_id"))))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same out of two publications: deliveries of odd numbers first, the others on top of them."""
    feed, log = _feed(spark), spread(table(spark, d, "memory_log"), "delivery_id")
    feed.publish(memory_changes(log.where("delivery_id % 2 = 1")))
    return _current(feed.publish(memory_changes(log.where("delivery_id % 2 = 0"))))


QUERIES = {f.__name__: f for f in (p1_found, p1_gaps, p1_processed, p2_found, p2_batches)}

_COMMITTED = "lower(trim(outcome)) = 'committed'"
_SHA = "nullif(regexp_extract(lower(sha256), '(?:^|[^0-9a-f])([0-9a-f]{64})\\s*$', 1), '')"
_PENDING = f"""select distinct v.shard, v.seq from vector_log v
  where not exists (select 1 from ingest_runs r where {_COMMITTED} and r.shard = v.shard
                    and v.seq between r.first_seq and r.last_seq)"""

SQL = {
    "p1_found": f"""
with listed as (select source_key, arg_max({_SHA}, seen_at) as version from file_scans where {_SHA} is not null group by 1),
taken as (select source_key, arg_max({_SHA}, attempt) as had from sources where {_COMMITTED} group by 1)
select 'files' as feed, l.source_key as item_key, l.version as item_version
from listed l left join taken t using (source_key) where t.had is null or t.had <> l.version
union all
select 'log', shard::varchar, seq::varchar from ({_PENDING})""",
    "p1_gaps": f"""
with n as (select shard, seq, seq - row_number() over (partition by shard order by seq) as island from ({_PENDING}))
select shard, min(seq) as first_seq, max(seq) as last_seq from n group by shard, island""",
    "p1_processed": f"""
with n as (select distinct shard, unnest(range(first_seq, last_seq + 1)) as seq from ingest_runs where {_COMMITTED}),
i as (select shard, seq, seq - row_number() over (partition by shard order by seq) as island from n)
select shard, min(seq) as first_seq, max(seq) as last_seq from i group by shard, island""",
    "p2_found": """
with raw as (select mem_owner, shard, seq, unnest(payloads) as body, unnest(range(len(payloads))) as place from memory_log),
good as (select distinct mem_owner, shard, seq, place, body::json as j from raw where json_valid(body)),
effects as (
  select mem_owner, j->>'memory_id' as memory_id, seq, place, true as alive from good where j->>'type' = 'memory'
  union all
  select mem_owner, unnest(case when json_type(j, '$.replaces') = 'ARRAY' then (j->>'$.replaces[*]')
                                when json_type(j, '$.replaces') = 'VARCHAR' then [j->>'replaces'] else [] end), seq, place, false
  from good),
last as (select mem_owner, memory_id, max((seq, place, alive)) as top from effects where memory_id is not null group by 1, 2)
select mem_owner, memory_id, top[1]::bigint as seq from last where top[3]""",
}
SQL["p2_batches"] = SQL["p2_found"]
