"""An append-only memory: records that write, replace and forget, and recall by likeness and age.

Records: type ('memory' or 'forget'), memory_id, text, tags, created (seconds), replaces, owner, vec. Nothing is ever
changed; a memory that a record of its owner names in ``replaces`` is gone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.text import hash_embed
from lodequery.functions.vectors import cosine_similarity, literal
from lodequery.sources.manifest import ManifestFolder

RECORD = (
    "type string, memory_id string, text string, tags array<string>, created double, replaces array<string>, owner string, vec array<double>"
)
SAME = 0.97
RECENT_WEIGHT, HALF_LIFE_DAYS = 0.03, 30
CANDIDATES = 4

_FIELDS = {"type": "string", "memory_id": "string", "text": "string", "tags": "array<string>", "created": "double"}


def from_payloads(log: DataFrame, owner: str, seq: str, payloads: str, once: bool = True) -> DataFrame:
    """Records out of JSON payloads; broken JSON gives none. ``replaces`` may be a list, one text, null or missing.

    With ``once`` each (owner, seq, place) comes once; of different bodies that of the larger hash. Columns that aren't
    asked for are neither read nor shuffled.
    """
    each = log.select(F.col(owner).alias("owner"), F.col(seq).alias("seq"), F.posexplode(payloads).alias("place", "body"))
    parsed = each.withColumn("v", F.try_parse_json("body")).where(F.col("v").isNotNull())
    fields = [F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in _FIELDS.items()]
    named = F.try_variant_get("v", "$.replaces", "variant")
    many = F.try_variant_get("v", "$.replaces", "array<string>")
    one = F.when(F.schema_of_variant(named) == "STRING", F.array(F.try_variant_get("v", "$.replaces", "string")))
    names = F.coalesce(many, one, F.array().cast("array<string>")).alias("replaces")
    rows = parsed.select("owner", "seq", "place", *fields, names, F.xxhash64("body").alias("_h"))
    if not once:
        return rows.drop("_h")
    columns = [*_FIELDS, "replaces"]
    return rows.groupBy("owner", "seq", "place").agg(*[F.max_by(c, "_h").alias(c) for c in columns])


def live_ids(records: DataFrame) -> DataFrame:
    """(owner, memory_id) of the memories that no record names, in one pass; repeated records don't matter."""
    written = F.when((F.col("type") == "memory") & F.col("memory_id").isNotNull(), F.array(F.struct(F.col("memory_id").alias("id"), F.lit(True).alias("written"))))
    none = F.array().cast("array<struct<id:string,written:boolean>>")
    named = F.transform(F.filter("replaces", lambda x: x.isNotNull()), lambda x: F.struct(x.alias("id"), F.lit(False).alias("written")))
    effects = records.select("owner", F.explode(F.concat(F.coalesce(written, none), named)).alias("e")).select("owner", F.col("e.id").alias("memory_id"), "e.written")
    return effects.groupBy("owner", "memory_id").agg(F.min("written").alias("alive")).where("alive").select("owner", "memory_id")


def replaced(records: DataFrame) -> DataFrame:
    """(owner, memory_id) that any record names."""
    return records.select("owner", F.explode("replaces").alias("memory_id")).where("memory_id is not null").distinct()


def live(records: DataFrame) -> DataFrame:
    """The memories that no record has replaced or forgotten."""
    return records.where("type = 'memory'").join(replaced(records), ["owner", "memory_id"], "left_anti")


def dedupe_ids(ids: Column) -> Column:
    """Without repetitions, in the given order."""
    return F.array_distinct(ids)


def clean_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


def recency(age_seconds: Column) -> Column:
    days = F.greatest(age_seconds, F.lit(0.0)) / 86400
    return F.lit(RECENT_WEIGHT) * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def recall(records: DataFrame, owner: str, query: list[float], now: float, k: int = 5, tags: list[str] | None = None) -> DataFrame:
    """Up to k current memories by similarity plus a bonus for recent ones; fewer if the candidates are gone.

    Candidates are the 4 k most similar memories of the owner with any of the tags; replaced ones drop out afterwards.
    """
    own = records.where(F.col("owner") == owner)
    some = own.where("type = 'memory'")
    if tags:
        some = some.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    near = some.withColumn("similarity", cosine_similarity("vec", literal(query))).orderBy(F.desc("similarity"), "memory_id").limit(CANDIDATES * k)
    left = near.join(replaced(own).select("memory_id"), "memory_id", "left_anti")
    scored = left.withColumn("score", F.col("similarity") + recency(F.lit(float(now)) - F.col("created")))
    return scored.select("memory_id", "text", "tags", "created", "similarity", "score").orderBy(F.desc("score"), F.desc("similarity"), "memory_id").limit(k)


class MemoryError_(ValueError):
    """A request that the memory refuses."""


class MemoryStore:
    """One owner's memories in a folder of Parquet versions; one writer at a time."""

    def __init__(
        self, spark: SparkSession, root: str, owner: str, embed: Callable[[str], list[float]] = hash_embed, clock: Callable[[], float] = time.time
    ):
        if not isinstance(owner, str) or not owner.strip() or len(owner) > 128:
            raise MemoryError_("an owner is text of 1 to 128 characters")
        self.spark, self.root, self.owner, self.embed, self.clock = spark, root.rstrip("/"), owner, embed, clock
        self.manifest = ManifestFolder(spark, f"{self.root}/manifest")

    def records(self) -> DataFrame:
        known = self.manifest.latest()
        paths = json.loads(known)["parts"] if known else []
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def _append(self, *row: object) -> None:
        version = (self.manifest.version() or 0) + 1
        path = f"{self.root}/part-{version:08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([row], RECORD).coalesce(1).write.parquet(path)
        known = self.manifest.latest()
        parts = (json.loads(known)["parts"] if known else []) + [path]
        self.manifest.publish(version, json.dumps({"parts": parts}))

    def _own(self) -> DataFrame:
        return self.records().where(F.col("owner") == self.owner)

    def remember(self, text: str, tags: list[str] | None = None, replaces: list[str] | None = None) -> tuple[str, bool]:
        """(id, whether it was stored). Without ``replaces`` a text whose nearest memory is current and nearly the same
        is that memory."""
        text = (text or "").strip()
        if not text:
            raise MemoryError_("nothing to remember")
        named = list(dict.fromkeys(replaces or []))
        vector = self.embed(text)
        own = self._own()
        if named:
            known = {r[0] for r in live(own).where(F.col("memory_id").isin(named)).select("memory_id").collect()}
            if gone := [x for x in named if x not in known]:
                raise MemoryError_(f"not among the current memories: {', '.join(gone)}")
        else:
            near = own.where("type = 'memory'").withColumn("s", cosine_similarity("vec", literal(vector))).orderBy(F.desc("s"), "memory_id").limit(1)
            first = near.join(replaced(own), ["owner", "memory_id"], "left").select("memory_id", "s").collect()
            current = live(own).where(F.col("memory_id") == first[0][0]).limit(1).count() if first else 0
            if current and first[0][1] >= SAME:
                return first[0][0], False
        new = "m" + uuid.uuid4().hex[:10]
        self._append("memory", new, text, sorted(set(tags or [])), float(self.clock()), named, self.owner, vector)
        return new, True

    def recall(self, query: str, k: int = 5, tags: list[str] | None = None) -> list[dict]:
        return [r.asDict() for r in recall(self.records(), self.owner, self.embed(query), self.clock(), k, tags).collect()]

    def forget(self, memory_id: str) -> None:
        if not live(self._own()).where(F.col("memory_id") == memory_id).limit(1).count():
            raise MemoryError_(f"not among the current memories: {memory_id}")
        tomb = "f" + uuid.uuid4().hex[:10]
        self._append("forget", tomb, None, [], float(self.clock()), [memory_id], self.owner, [1.0] * len(self.embed("x")))
