"""Repetition inside a single document.

``measure_repetition`` gives each document's share of words that lie in a run of ``span`` words which stood earlier in
the same text. ``find_repetitive`` needs only the documents above a threshold and gets there by a cascade: each rule is
a condition that such a document can't fail, so a document leaves at the first rule that it fails, and only the rest is
measured. How long the rules take and how many documents they reject is estimated in the task, on documents drawn at
random from each Arrow batch, and they are put in order of documents rejected per second. So the order follows the
documents and the machine at hand; it changes the time only, never the result, and no document visits the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.mailtext import message_words
from lodequery.session import spread

SPAN = 8
THRESHOLD = 0.3
#: Documents of a batch on which cost and selectivity of the rules are estimated.
SAMPLE = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(ws: list[str]) -> np.ndarray:
    """Words as numbers, by first occurrence."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in ws], np.int64)


def _runs(n: np.ndarray, span: int) -> np.ndarray:
    """A number for each run of ``span`` words, equal for equal runs only."""
    if n.size < span:
        return np.empty(0, np.int64)
    ids, width = n, 1
    while width < span:  # runs of twice the length, named anew each time, so that names stay small and exact
        more = min(width, span - width)
        a, b = ids[: ids.size - more], ids[more:]
        _, ids = np.unique(a * (int(ids.max()) + 1) + b, return_inverse=True)
        width += more
    return ids


def repeated_words(n: np.ndarray, span: int) -> int:
    """Words that lie in a run of ``span`` words that stood earlier already; the two runs may overlap."""
    runs = _runs(n, span)
    if not runs.size:
        return 0
    _, first = np.unique(runs, return_index=True)
    again = np.ones(runs.size, bool)
    again[first] = False
    edge = np.zeros(n.size + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + span, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _least(n: int, threshold: float) -> int:
    """Words that must be repeated for the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


# Rules: True if a document of these words may reach the threshold. Repeated words stood earlier, so each is no first
# occurrence; of a repeated stretch of c words, c - 1 pairs are no first occurrence, and stretches have span words.


def long_enough(n: np.ndarray, span: int, threshold: float) -> bool:
    return n.size > span


def few_words(n: np.ndarray, span: int, threshold: float) -> bool:
    return n.size - (int(n.max()) + 1 if n.size else 0) >= _least(n.size, threshold)


def few_pairs(n: np.ndarray, span: int, threshold: float) -> bool:
    if n.size < 2:
        return False
    pairs = n[:-1] * (int(n.max()) + 1) + n[1:]
    return pairs.size - np.unique(pairs).size >= _least(n.size, threshold) * (span - 1) / span - 1e-9


def dense_repeats(n: np.ndarray, span: int, threshold: float) -> bool:
    """By hashes at every position: windows seen before, times span, must cover what the threshold asks for."""
    if n.size <= span:
        return False
    h = n.astype(np.uint64) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(n.size - span + 1, np.uint64)
    for j in range(span):
        total = total * np.uint64(0x100000001B3) + h[j : n.size - span + 1 + j]
    seen = total.size - np.unique(total).size
    return seen * span >= _least(n.size, threshold)


Rule = Callable[[np.ndarray, int, float], bool]
RULES: dict[str, Rule] = {f.__name__: f for f in (dense_repeats, few_pairs, few_words, long_enough)}


def rule_order(sample: list[np.ndarray], span: int, threshold: float) -> list[str]:
    """Rules by documents rejected per second, estimated on documents that the rules before haven't rejected."""
    left, names, order = sample, list(RULES), []
    while names and left:
        gain = {}
        for name in names:
            began = time.perf_counter()
            kept = [RULES[name](n, span, threshold) for n in left]
            gain[name] = (kept.count(False) / max(time.perf_counter() - began, 1e-9), kept)
        best = max(names, key=lambda x: gain[x][0])
        if not gain[best][0]:
            break
        order.append(best)
        left = [n for n, k in zip(left, gain[best][1], strict=True) if k]
        names.remove(best)
    return order + names


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return spread(documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null"), "d")


def measure_repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, repeated, share) of every document with an id.

    Null, empty and unreadable texts and texts of ``span`` words or fewer have share 0. Rows with equal ids give a row
    each. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns = [numbered(message_words(t.as_py())) for t in batch.column(1)]
            again = [repeated_words(n, span) for n in ns]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n.size for n in ns], pa.int64()),
                    pa.array(again, pa.int64()),
                    pa.array([a / n.size if n.size else 0.0 for a, n in zip(again, ns, strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_words", "repeated", "share"],
            )

    return _texts(documents, doc_id, text).mapInArrow(run, "doc_id bigint, n_words bigint, repeated bigint, share double")


def find_repetitive(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """Distinct (doc_id, share) of the documents whose share of repeated words is at least ``threshold``.

    The result is that of ``measure_repetition`` with a filter. ``sample`` documents of each batch put the rules in
    order; without any, the rules stay in their own order.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(11)
        for batch in batches:
            ids, shares = [], []
            texts = batch.column(1)
            chosen = set(draw.choice(batch.num_rows, min(sample, batch.num_rows), replace=False).tolist())
            known = {i: numbered(message_words(texts[i].as_py())) for i in chosen}
            rules = [RULES[name] for name in rule_order(list(known.values()), span, threshold)]
            for i, d in enumerate(batch.column(0).to_pylist()):
                n = known.pop(i) if i in known else numbered(message_words(texts[i].as_py()))
                if all(rule(n, span, threshold) for rule in rules):
                    again = repeated_words(n, span)
                    if again >= _least(n.size, threshold):
                        ids.append(d)
                        shares.append(again / n.size)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "share"])

    return _texts(documents, doc_id, text).mapInArrow(run, "doc_id bigint, share double").distinct()
