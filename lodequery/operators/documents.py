"""Ingesting files as passages, once per content, and finding passages for a question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.text import embedding_text, get_embedder, hash_embed, snippet
from lodequery.operators.chunking import chunk
from lodequery.session import materialize
from lodequery.sources.files import decode_text, find_documents
from lodequery.sources.store import VectorStore


@dataclass
class IngestReport:
    """files: (key, path, sha256, state) of every listed file; how many are in each state; and the passages of the new ones."""

    files: DataFrame
    new: int
    unchanged: int
    changed: int
    passages: int


def classify(listing: DataFrame, taken: DataFrame, key: str, sha: str) -> DataFrame:
    """The listing with state 'new', 'unchanged' or 'changed' against what was taken in (key, sha)."""
    had = taken.select(F.col(key), F.col(sha).alias("_had"))
    state = F.when(F.col("_had").isNull(), "new").when(F.col("_had") == F.col(sha), "unchanged").otherwise("changed")
    return listing.join(had, key, "left").withColumn("state", state).drop("_had")


def read_passages(files: DataFrame, max_chars: int = 1000, overlap: int = 150) -> DataFrame:
    """(path, index, heading, text) of each file's passages. Headings are read in Markdown files only."""
    texts = files.select("path", decode_text().alias("text"))
    markdown = F.lower("path").rlike(r"\.(md|markdown)$")
    one = chunk(texts.where(markdown), "path", "text", max_chars, overlap, True)
    two = chunk(texts.where(~markdown), "path", "text", max_chars, overlap, False)
    return one.unionByName(two).withColumnRenamed("row_id", "path")


def ingest_files(spark: SparkSession, store: VectorStore, paths: list[str], namespace: str | None = None, embedder: str = "hash", max_chars: int = 1000, overlap: int = 150) -> IngestReport:
    """Take in the files that the store doesn't know by (namespace, path); a changed file is reported and left as it is.

    Passages and the record of their files are published in one step. Blank files are recorded with no passages. Listing,
    known files and passages are tables throughout; the driver sees counts.
    """
    prefix = f"{namespace}::" if namespace else ""
    files = find_documents(spark, paths).withColumn("key", F.concat(F.lit(prefix), "path"))
    marked = materialize(classify(files.select("key", "path", "sha256"), store.sources().select("key", "sha256"), "key", "sha256"), "listing")
    counts = dict(marked.groupBy("state").count().collect())  # three rows
    new = marked.where("state = 'new'")
    report = IngestReport(marked, *(counts.get(s, 0) for s in ("new", "unchanged", "changed")), 0)
    if not report.new:
        return report
    passages = materialize(read_passages(files.join(new.select("key"), "key", "left_semi"), max_chars, overlap), "passages")
    report.passages = passages.count()
    rows = passages.select(
        get_embedder(embedder)(embedding_text("heading", "text")).alias("vec"),
        F.to_json(F.struct("text", F.col("path").alias("source"), "heading", F.col("index").alias("chunk"))).alias("payload"),
        F.concat_ws("\x00", "path", F.lpad("index", 9, "0")).alias("place"),
    )
    made = passages.groupBy("path").agg(F.count("*").alias("passages"))
    record = new.join(made, "path", "left").select("key", "sha256", F.coalesce("passages", F.lit(0)).alias("passages"), F.col("path").alias("source"), F.lit(namespace).cast("string").alias("space"))
    store.add(rows, "vec", "payload", namespace, "place", sources=record)
    return report


def find_passages(store: VectorStore, question: str, k: int = 5, namespace: str | None = None, source: str | None = None) -> DataFrame:
    """(rank order) id, distance, source, heading, chunk and a snippet of the passages nearest to a question."""
    hits = store.search(hash_embed(question), k, {"source": source} if source else None, namespace)
    p = F.from_json("payload", "text string, source string, heading string, chunk int")
    return hits.withColumn("p", p).select("id", "distance", "p.source", "p.heading", "p.chunk", snippet("p.text").alias("snippet"))


def source_listing(sources: DataFrame, space: str, passages: str, most: int = 50) -> DataFrame:
    """One row: files, passages, and the namespaces in order, at most ``most`` of them."""
    totals = sources.agg(F.count("*").alias("files"), F.coalesce(F.sum(passages), F.lit(0)).alias("passages"))
    names = sources.where(F.col(space).isNotNull()).select(space).distinct().orderBy(space).limit(most)
    return totals.join(F.broadcast(names.agg(F.array_join(F.array_sort(F.collect_list(space)), ",").alias("namespaces"))))  # one row each
