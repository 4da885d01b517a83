"""Evaluation texts leaking into training text, by Wu-Manber search for many patterns at once.

The patterns are all runs of ``span`` words of the evaluation items; the text is the words of a document. A block is
two adjacent words. The shift table gives, for the block that ends a window of the text, how far the window can move
without passing an occurrence: nothing of the window that no pattern holds is looked at. Where the shift is zero, the
bucket of the patterns' last blocks gives the candidates, of which first the leading block and then all words are
compared. The windows of all documents of a batch move at the same time, as arrays; long documents are cut into
stretches that overlap by ``span - 1`` words, so that none of them holds up the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.mailtext import message_words, words
from lodequery.session import materialize, spread

SPAN = 12
#: Patterns that one matcher holds; with more, the words of the documents are searched once for each block of patterns.
PATTERNS_A_PASS = 400_000
_STRETCH = 192


@dataclass
class Matcher:
    """Tables of one block of patterns. vocabulary: word -> number from 1; 0 stands for words of no pattern."""

    vocabulary: dict[str, int]
    patterns: np.ndarray  # [number, span], by suffix key
    owners: np.ndarray  # item of each entry of owner_at
    owner_at: np.ndarray  # [number + 1]
    shift: np.ndarray  # by block key
    bucket_at: np.ndarray  # [keys + 1], into patterns
    mask: int

    @property
    def span(self) -> int:
        return self.patterns.shape[1]

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)).astype(
            np.int64
        ) & self.mask

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's last position, pattern) of every occurrence; starts and ends bound the stretches of ``text``."""
        at, till = starts + self.span - 1, ends
        going = at < till
        at, till = at[going], till[going]
        stops: list[np.ndarray] = []
        while at.size:
            step = self.shift[self.key(text[at - 1], text[at])].astype(np.int64)
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < till
            at, till = at[going], till[going]
        stop = np.concatenate(stops) if stops else np.empty(0, np.int64)
        keys = self.key(text[stop - 1], text[stop])
        first, count = self.bucket_at[keys], self.bucket_at[keys + 1] - self.bucket_at[keys]
        stop = np.repeat(stop, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pattern = np.repeat(first, count) + offset
        lead = stop - self.span + 1
        same = (text[lead] == self.patterns[pattern, 0]) & (text[lead + 1] == self.patterns[pattern, 1])
        stop, pattern, lead = stop[same], pattern[same], lead[same]
        whole = (text[lead[:, None] + np.arange(self.span)] == self.patterns[pattern]).all(axis=1)
        return stop[whole], pattern[whole]


def build_matcher(items: list[tuple[int, list[str]]], span: int = SPAN) -> Matcher | None:
    """Tables for (item, words) pairs; None if no item has ``span`` words."""
    owners: dict[tuple[str, ...], dict[int, None]] = {}
    for item, ws in items:
        for i in range(len(ws) - span + 1):
            owners.setdefault(tuple(ws[i : i + span]), {})[item] = None
    if not owners:
        return None
    vocabulary: dict[str, int] = {}
    for pattern in owners:
        for w in pattern:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    rows = np.array([[vocabulary[w] for w in p] for p in owners], np.int32)
    size = 1 << max(12, int(rows.shape[0] * 8).bit_length())
    m = Matcher(vocabulary, rows, np.empty(0), np.empty(0), np.full(size, span - 1, np.int16), np.empty(0), size - 1)
    for j in range(span - 1):
        np.minimum.at(m.shift, m.key(rows[:, j], rows[:, j + 1]), np.int16(span - 2 - j))
    suffix = m.key(rows[:, -2], rows[:, -1])
    order = np.argsort(suffix, kind="stable")
    m.patterns = rows[order]
    m.bucket_at = np.searchsorted(suffix[order], np.arange(size + 1))
    lists = list(owners.values())
    m.owner_at = np.cumsum([0, *(len(lists[i]) for i in order)])
    m.owners = np.array([x for i in order for x in lists[i]], np.int64)
    return m


def leaked_items(matcher: Matcher, documents: list[list[str]]) -> list[tuple[int, int]]:
    """Distinct (position in ``documents``, item) pairs."""
    get = matcher.vocabulary.get
    lengths = np.array([len(d) for d in documents], np.int64)
    text = np.fromiter((get(w, 0) for d in documents for w in d), np.int32, int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    pieces = np.maximum(1, -(-(lengths - matcher.span + 1) // _STRETCH))
    owner = np.repeat(np.arange(len(documents)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = begin[owner] + nth * _STRETCH
    ends = np.minimum(starts + _STRETCH + matcher.span - 1, begin[owner] + lengths[owner])
    stop, pattern = matcher.search(text, starts, ends)
    doc = np.searchsorted(begin + lengths, stop, side="right")
    found: set[tuple[int, int]] = set()
    for d, p in set(zip(doc.tolist(), pattern.tolist(), strict=True)):
        found.update((d, x) for x in matcher.owners[matcher.owner_at[p] : matcher.owner_at[p + 1]].tolist())
    return sorted(found)


def _blocks(items: DataFrame, item_id: str, question: str, span: int, most: int) -> Iterator[Matcher]:
    """Matchers over all items, each of ``most`` patterns at most; the items pass the driver one after another, and a
    long one is divided between matchers."""
    own: list[tuple[int, list[str]]] = []
    room = most
    chosen = items.select(F.col(item_id).alias("i"), F.col(question).alias("q")).where("i is not null and q is not null")
    for row in chosen.toLocalIterator(prefetchPartitions=True):
        ws = words(row["q"])
        at, last = 0, len(ws) - span + 1  # patterns begin at [at, last)
        while at < last:
            n = min(room, last - at)
            own.append((row["i"], ws[at : at + n + span - 1]))
            at, room = at + n, room - n
            if not room:
                yield build_matcher(own, span)
                own, room = [], most
    if own:
        yield build_matcher(own, span)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    question: str = "question",
    span: int = SPAN,
    most: int = PATTERNS_A_PASS,
) -> DataFrame:
    """Distinct (doc_id, item_id): the message's readable text has ``span`` words in a row that stand so in the item.

    Null ids, texts and questions match nothing, nor do questions of fewer words; equal questions of several items
    match all of them; extra columns are ignored; without documents or items the result is empty. The matcher that is
    broadcast holds ``most`` patterns at most. More of them are searched in blocks: then the messages are decoded once
    into a written table of words, which each block reads.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint"
    texts = spread(documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null"), "d")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([" ".join(message_words(x.as_py())) for x in part.column(1)], pa.string())], names=["d", "t"])

    def scan(matcher: Matcher, read: Callable[[str], list[str]], texts: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hits: list[tuple[int, int]] = []
                for at in range(0, len(ids), 1000):
                    part = [read(x.as_py()) for x in batch.column(1).slice(at, 1000)]
                    hits += [(ids[at + d], item) for d, item in leaked_items(shared.value, part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["doc_id", "item_id"]
                )

        return texts.mapInArrow(run, schema)

    blocks = _blocks(items, item_id, question, span, most)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return scan(first, message_words, texts).distinct()
    decoded = materialize(texts.mapInArrow(decode, "d bigint, t string"), "words")
    found = [materialize(scan(m, str.split, decoded), "leaks") for m in chain([first, second], blocks)]
    return reduce(DataFrame.unionByName, found).distinct()
