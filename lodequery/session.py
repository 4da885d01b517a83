"""Session set-up, table access and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent.parent

#: What every session of this library expects; a setting that the session already has stays.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests, the command line and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodequery")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of executors that don't share the driver's path."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in paths:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="lodequery-")) / "lodequery.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "lodequery").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named Parquet table of a folder. Timestamps without zone are read as they are stored."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a folder of this machine only in local mode."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodequery-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and the files survive lost executors.

    They stay until ``release``, as results that were not yet computed may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what ``materialize`` has written for this application, when its results have been taken; how many tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan's rows by key only if it has fewer partitions than the cluster has cores.

    For scans and what is computed of them row by row: asking a shuffle for its partitions would run it. A large table arrives in many partitions and isn't shuffled; a small single file would otherwise keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def utc_micros(column: str | F.Column) -> F.Column:
    """Microseconds since 1970 of a timestamp with or without zone (session time zone UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast(T.TimestampType()))
