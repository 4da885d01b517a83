"""Streams: a log that is taken in batch by batch exactly once, incremental postings, and a watch over server states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodequery.functions.filters import postings
from lodequery.operators.health import find_problems


def replay(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 1, available: bool = True) -> StreamingQuery:
    """Append a folder of Parquet files, or one file, to ``target``, a version folder for each micro-batch.

    The batch number is the write's seq. A batch that is run again after a failure overwrites its own folder, so nothing
    is lost or doubled; ``read_replayed`` reads them in order.
    """

    def write(batch: DataFrame, seq: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/seq={seq}")

    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files)
    if any(p.endswith(source) for p in spark.read.parquet(source).inputFiles()):  # streams read folders only
        folder, _, name = source.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="10 seconds")).start()


def read_replayed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(target)


def catch_up_postings(batch: DataFrame, seq: int, target: str, row_id: str, payload: str) -> None:
    """For foreachBatch: the postings of one batch, in a folder of its own that a repetition overwrites."""
    postings(batch, row_id, payload).write.mode("overwrite").parquet(f"{target}/seq={seq}")


def drop_repeated(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen before, within the watermark; the state of older keys is dropped."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and key, final when the watermark has passed."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("events"))


class Watch:
    """Called with a table of server states again and again: acts on problems, but not twice on the same ones in a row."""

    def __init__(self, act: Callable[[list[str]], None]):
        self.act, self.last = act, None

    def look(self, servers: DataFrame) -> list[str]:
        rows = find_problems(servers).orderBy("shard", "kind", "replica").select("problem").collect()  # a row a fault
        found = [r[0] for r in rows]
        if found and found != self.last:
            self.act(found)
        self.last = found
        return found
