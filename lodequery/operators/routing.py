"""Where rows go: shards by id or namespace, and dense ids."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.session import materialize


def by_id(row_id: Column | str, shards: int) -> Column:
    """Round robin over dense ids: shard sizes differ by at most one."""
    return F.pmod(F.col(row_id) if isinstance(row_id, str) else row_id, F.lit(shards)).cast("int")


def by_namespace(namespace: Column | str, shards: int) -> Column:
    """All rows of a namespace in one shard: crc32 of its UTF-8 bytes, modulo the shards."""
    c = F.col(namespace) if isinstance(namespace, str) else namespace
    return (F.crc32(F.encode(c, "UTF-8")) % F.lit(shards)).cast("int")


def namespace_shard_of(name: str, shards: int) -> int:
    return zlib.crc32(name.encode("utf-8")) % shards


def route(row_id: str, namespace: str, shards: int) -> Column:
    return F.when(F.col(namespace).isNull(), by_id(row_id, shards)).otherwise(by_namespace(namespace, shards))


def next_id(df: DataFrame, row_id: str) -> DataFrame:
    """One row: one more than the largest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(row_id) + 1, F.lit(0)).cast("long").alias("next_id"))


def shard_sizes(df: DataFrame, shard: Column) -> DataFrame:
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("vectors"))


#: How two results of an aggregate make one; nulls don't count.
_COMBINED = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": F.greatest,
    "min": F.least,
}


def running(df: DataFrame, kind: str, value: Column, name: str, group: list[str], order: list[str], behind: bool = False) -> DataFrame:
    """The sum, max or min of ``value`` over the rows of the same group that come before, as column ``name``; null if
    there are none. With ``behind`` over the rows that come after.

    ``order`` must tell the rows of a group apart. Rows are range-partitioned by group and order, so a large group lies
    in many partitions; the aggregate runs within each, and what a group has in the other partitions is added. The
    ranged rows are written once: bounds drawn anew for a second reading could differ.
    """
    total, both = getattr(F, kind), _COMBINED[kind]
    ranged = df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn("_p", F.spark_partition_id()).withColumn("_v", value)
    parts = materialize(ranged, "ranged")
    way = F.desc if behind else F.asc  # backwards for what comes after: a frame that ends at the last row would take quadratic time
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumn("_w", total("_v").over(before("_p", *group).orderBy(*map(way, order))))
    totals = parts.groupBy("_p", *group).agg(total("_v").alias("_t"))  # rows: partitions plus groups
    others = total("_t").over(before(*group).orderBy(way("_p")))
    beside = totals.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], others.alias("_b"))
    same = [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]]
    joined = within.join(beside, same).withColumn(name, both(F.col("_b"), F.col("_w")))
    return joined.drop("_p", "_v", "_w", "_q", "_b", *[f"_g{i}" for i in range(len(group))])


def running_sum(df: DataFrame, value: Column, name: str, group: list[str], order: list[str]) -> DataFrame:
    """The sum of ``value`` over the rows of the same group that come before, as column ``name``; 0 for the first."""
    told = running(df, "sum", value, name, group, order)
    return told.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def with_dense_ids(df: DataFrame, name: str, start: int, *order: str) -> DataFrame:
    """Consecutive ids from ``start`` in the given order, without a single sorting task; ties in arbitrary but fixed order."""
    tie = "_tie"
    told = running_sum(df.withColumn(tie, F.monotonically_increasing_id()), F.lit(1), name, [], [*order, tie])
    return told.withColumn(name, F.col(name) + start).drop(tie)
