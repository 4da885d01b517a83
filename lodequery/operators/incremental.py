"""Processing only new or changed records.

A log is a set of records (stream, seq). What has been processed is kept as disjoint intervals of seq for each stream.
A run subtracts them from what the log holds, processes the gaps - also those that fill up late, below intervals that
are already processed - and publishes its output and the merged intervals in one step.

Streams may be few and one may hold most records, so no window runs over a whole stream: rows are range-partitioned by
(stream, number), each partition is swept by itself, and what the others before it cover is carried over, see
``routing.running``. Intervals are never spelled out as numbers, so a wild bound costs no more than any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.operators.routing import running
from lodequery.sources.manifest import ManifestFolder


def is_committed(outcome: str) -> F.Column:
    """True where an outcome reads "committed" without regard to letter case and outer blanks; null counts as false."""
    return F.coalesce(F.lower(F.trim(F.col(outcome))) == "committed", F.lit(False))


def clean_sha256(column: str) -> F.Column:
    """64 lower-case hex digits out of an unevenly written SHA-256 (letter case, blanks, a prefix); null if it has none."""
    found = F.regexp_extract(F.lower(F.col(column)), r"(?:^|[^0-9a-f])([0-9a-f]{64})\s*$", 1)
    return F.when(found != "", found)


def _sane(intervals: DataFrame, stream: str, first: str, last: str) -> DataFrame:
    """(stream, first, last) without rows that cover nothing; of those that begin at one number the longest, which is
    found out before the shuffle, so repeated runs cost no more than one."""
    named = intervals.select(F.col(stream).alias("stream"), F.col(first).cast("long").alias("first"), F.col(last).cast("long").alias("last"))
    return named.where("stream is not null and first <= last").groupBy("stream", "first").agg(F.max("last").alias("last"))


def merge_intervals(intervals: DataFrame, stream: str, first: str, last: str) -> DataFrame:
    """Disjoint intervals (stream, first, last) that cover the same numbers as the given ones, as few as possible.

    Rows with a null or with first > last cover nothing. Repeated and overlapping rows are no problem; an empty table
    gives an empty one. An interval that begins beyond all before it starts a new one; a started one ends where those
    before the next start end.
    """
    swept = running(_sane(intervals, stream, first, last), "max", F.col("last"), "before", ["stream"], ["first"])
    apart = F.col("before").isNull() | F.coalesce(F.col("first") > F.try_add("before", F.lit(1)), F.lit(False))
    starts = swept.where(apart).select("stream", "first", "before")
    ended = running(starts, "min", F.struct("first", "before"), "next", ["stream"], ["first"], behind=True)
    ends = _sane(intervals, stream, first, last).groupBy("stream").agg(F.max("last").alias("end"))
    whole = ended.join(ends, "stream").select("stream", "first", F.coalesce("next.before", "end").alias("last"))
    return whole.withColumnRenamed("stream", stream)


def _swept(log: DataFrame, done: DataFrame, stream: str, seq: str, first: str, last: str) -> DataFrame:
    """The distinct (stream, seq) of ``log``, and whether an interval of ``done`` covers them.

    One sweep over points and intervals in order of their numbers: a point is covered if an interval that began before
    it, or with it, ends at or after it.
    """
    points = log.select(F.col(stream).alias("stream"), F.col(seq).cast("long").alias("at"))
    points = points.where("stream is not null and at is not null").distinct()
    spans = _sane(done, stream, first, last)
    events = points.select("stream", "at", F.lit(None).cast("long").alias("till"), F.lit(1).alias("kind")).unionByName(
        spans.select("stream", F.col("first").alias("at"), F.col("last").alias("till"), F.lit(0).alias("kind"))
    )
    swept = running(events, "max", F.col("till"), "reach", ["stream"], ["at", "kind"]).where("kind = 1")
    return swept.select(F.col("stream").alias(stream), F.col("at").alias(seq), F.coalesce(F.col("reach") >= F.col("at"), F.lit(False)).alias("covered"))


def subtract_intervals(log: DataFrame, done: DataFrame, stream: str, seq: str, first: str, last: str) -> DataFrame:
    """The distinct (stream, seq) of ``log`` that no interval of ``done`` covers.

    Records with a null stream or seq have no place in the log and are left out. Intervals with a null or with
    first > last cover nothing. Repeated records come out once. Other columns, whatever their names, are ignored.
    """
    return _swept(log, done, stream, seq, first, last).where("not covered").drop("covered")


def within_intervals(log: DataFrame, chosen: DataFrame, stream: str, seq: str, first: str, last: str) -> DataFrame:
    """The rows of ``log``, whole and as often as they come, whose (stream, seq) an interval of ``chosen`` covers."""
    inside = _swept(log, chosen, stream, seq, first, last).where("covered").drop("covered")
    return log.join(inside, [stream, seq], "left_semi")


def as_intervals(points: DataFrame, stream: str, seq: str) -> DataFrame:
    """Disjoint intervals (stream, first, last) of the given (stream, seq)."""
    own = points.select(F.col(stream).alias("stream"), F.col(seq).alias("first"), F.col(seq).alias("last"))
    return merge_intervals(own, "stream", "first", "last").withColumnRenamed("stream", stream)


def changed_files(
    listings: DataFrame, taken: DataFrame, key: str, sha: str, seen: str, attempt: str, outcome: str
) -> DataFrame:
    """(key, version): files whose newest readable listing has other contents than the last committed attempt.

    Newest by ``seen`` among listings with a valid hash; a null ``seen`` is older than all others, equal times are
    decided by the larger hash. The committed attempt of highest number counts; of several rows of it, any committed
    one makes it so, and equal numbers with different hashes are decided by the larger hash. A file without committed
    attempt is new. A null key is no file. Modification times are not looked at.
    """
    newest = (
        listings.select(F.col(key).alias("key"), F.col(seen).alias("seen"), clean_sha256(sha).alias("version"))
        .where("key is not null and version is not null")
        .groupBy("key")
        .agg(F.max(F.struct("seen", "version")).alias("newest"))
        .select("key", F.col("newest.version").alias("version"))
    )
    committed = (
        taken.where(is_committed(outcome))
        .select(F.col(key).alias("key"), F.col(attempt).alias("attempt"), clean_sha256(sha).alias("had"))
        .where("key is not null and attempt is not null")
        .groupBy("key")
        .agg(F.max(F.struct("attempt", "had")).alias("last"))
        .select("key", F.col("last.had").alias("had"))
    )
    both = newest.join(committed, "key", "left")
    return both.where("had is null or had <> version").select("key", "version")


class IncrementalRun:
    """Processed intervals and output of one log in a folder, published together.

    ``run`` first writes the pending records' intervals, so that a log that grows meanwhile can't make output and
    intervals differ. Until the manifest of the new version is in place, readers and a repeated run see the old one:
    a failed run leaves files that nothing refers to, and the next run takes the same records again.
    """

    def __init__(self, spark: SparkSession, root: str, stream: str = "shard", seq: str = "seq"):
        self.spark, self.root, self.stream, self.seq = spark, root.rstrip("/"), stream, seq
        self.manifest = ManifestFolder(spark, f"{self.root}/manifest")

    def processed(self) -> DataFrame | None:
        """The disjoint intervals (stream, first, last) that are done; None before the first run."""
        known = self.manifest.latest()
        return self.spark.read.parquet(json.loads(known)["intervals"]) if known else None

    def output(self) -> DataFrame | None:
        """What all published runs have written; None before the first run."""
        known = self.manifest.latest()
        paths = json.loads(known)["outputs"] if known else []
        return self.spark.read.parquet(*paths) if paths else None

    def pending(self, log: DataFrame) -> DataFrame:
        done = self.processed()
        if done is None:
            own = log.select(self.stream, F.col(self.seq).cast("long").alias(self.seq))
            return own.where(F.col(self.stream).isNotNull() & F.col(self.seq).isNotNull()).distinct()
        return subtract_intervals(log, done, self.stream, self.seq, "first", "last")

    def run(self, log: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Give the pending records' rows to ``process``, write its result and publish; False if nothing was pending."""
        version = (self.manifest.version() or 0) + 1
        folder = f"{self.root}/run-{version:08d}-{uuid.uuid4().hex[:8]}"
        as_intervals(self.pending(log), self.stream, self.seq).write.parquet(f"{folder}/pending")
        gaps = self.spark.read.parquet(f"{folder}/pending")
        if gaps.isEmpty():
            return False
        process(within_intervals(log, gaps, self.stream, self.seq, "first", "last")).write.parquet(f"{folder}/output")
        done = self.processed()
        every = gaps if done is None else gaps.unionByName(done)
        merge_intervals(every, self.stream, "first", "last").write.parquet(f"{folder}/intervals")
        known = self.manifest.latest()
        outputs = (json.loads(known)["outputs"] if known else []) + [f"{folder}/output"]
        self.manifest.publish(version, json.dumps({"intervals": f"{folder}/intervals", "outputs": outputs}))
        return True
