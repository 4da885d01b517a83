"""The state of shard copies as a table: (shard, replica, up, process, size, last_seq, snapshot_seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.operators.incremental import as_intervals
from lodequery.operators.routing import running


# The sentences of ``find_problems`` are fixed values.


def find_problems(servers: DataFrame) -> DataFrame:
    """(shard, kind, replica, problem) in words; empty if every copy answers and live copies of a shard agree."""
    each = servers.where("not up").select(
        "shard",
        F.lit(0).alias("kind"),
        "replica",
        F.format_string(
            "shard %s replica %s %s",
            "shard",
            "replica",
            F.when(F.col("process"), "does not answer, although its process is running").otherwise("is down"),
        ).alias("problem"),
    )
    place = F.when(F.col("up"), F.struct("replica", F.format_string("replica %s at seq %s", "replica", "last_seq").alias("t")))
    shards = servers.groupBy("shard").agg(
        F.bool_or("up").alias("live"),
        F.countDistinct(F.when(F.col("up"), F.col("last_seq"))).alias("seqs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), ", ").alias("at"),  # the copies of a shard are few
    )
    none = F.format_string("shard %s has no live replica: searches that need it fail", "shard")
    apart = F.format_string("replicas of shard %s are out of sync (%s)", "shard", "at")
    whole = shards.where("not live or seqs > 1").select(
        "shard", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("replica"), F.when(~F.col("live"), none).otherwise(apart).alias("problem")
    )
    return each.withColumn("replica", F.col("replica").cast("int")).unionByName(whole)


def describe_health(servers: DataFrame) -> DataFrame:
    """(shard, line): a shard's copies in words."""
    one = F.when(F.col("up"), F.format_string("replica %s up (%s vectors, seq %s)", "replica", "size", "last_seq")).otherwise(F.format_string("replica %s DOWN", "replica"))
    copies = F.array_sort(F.collect_list(F.struct("replica", one.alias("t"))))  # the copies of a shard are few
    joined = F.array_join(F.transform(copies, lambda x: x["t"]), ", ")
    return servers.groupBy("shard").agg(joined.alias("t")).select("shard", F.format_string("shard %s: %s", "shard", "t").alias("line"))


def repair_plan(servers: DataFrame) -> DataFrame:
    """(shard, replica, source, method, records): how each live copy that lags catches up with the newest live one.

    Of equally new copies the one of smaller number is the source. By snapshot if the source's log no longer reaches
    back to the copy's seq, else by log.
    """
    newest = Window.partitionBy("shard").orderBy(F.desc("last_seq"), "replica")
    ranked = servers.where("up").select(
        "shard", "replica", "last_seq",
        F.first("replica").over(newest).alias("source"),
        F.first("last_seq").over(newest).alias("goal"),
        F.first("snapshot_seq").over(newest).alias("from_seq"),
    )
    return ranked.where("last_seq < goal").select(
        "shard", "replica", "source",
        F.when(F.col("last_seq") < F.col("from_seq"), "snapshot").otherwise("log").alias("method"),
        (F.col("goal") - F.col("last_seq")).alias("records"),
    )


def status(servers: DataFrame) -> DataFrame:
    """One row: copies, copies that are up, shards, and the rows of the live copies (of each shard the newest)."""
    best = servers.where("up").groupBy("shard").agg(F.max_by("size", F.struct("last_seq", "replica")).alias("size"))
    counts = servers.agg(F.count("*").alias("servers"), F.count_if("up").alias("up"), F.countDistinct("shard").alias("shards"))
    return counts.join(F.broadcast(best.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("vectors"))))  # one row each


def restarts(journal: DataFrame) -> DataFrame:
    """Restarts of each server in a journal (kind, tool, shard, replica, error)."""
    done = journal.where("kind = 'tool' and tool = 'restart_server' and not error")
    return done.groupBy("shard", "replica").agg(F.count("*").alias("restarts"))


def interval_gaps(intervals: DataFrame, shard: str, first: str = "first", last: str = "last") -> DataFrame:
    """(shard, after_seq, next_seq) between disjoint intervals, and before the first, as a log begins at 1."""
    own = intervals.select(F.col(shard).alias("shard"), F.col(first).alias("first"), F.col(last).alias("last"))
    before = running(own, "max", F.col("last"), "before", ["shard"], ["first"])
    gaps = before.select("shard", F.coalesce("before", F.lit(0).cast("long")).alias("after_seq"), F.col("first").alias("next_seq"))
    return gaps.where("next_seq <> after_seq + 1")


def sequence_gaps(log: DataFrame, shard: str, seq: str) -> DataFrame:
    """(shard, after_seq, next_seq) wherever a log skips numbers; a log begins at 1. Repeated records are one."""
    points = log.select(F.col(shard).alias("shard"), F.col(seq).cast("long").alias("seq")).where("shard is not null and seq is not null")
    return interval_gaps(as_intervals(points, "shard", "seq"), "shard")
