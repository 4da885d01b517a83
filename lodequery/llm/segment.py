"""Splitting oversized items at natural boundaries, by lexical cohesion.

A text is cut only where it has a boundary: between paragraphs, lines, sentences or words, in this order of rank. Along
the text a block of words before each boundary is compared with the block after it; where the similarity forms a
valley, the topic changes. Of the boundaries of the best rank within the window that a piece may end in, the deepest
valley is taken. The next piece begins up to ``overlap`` characters earlier, at a sentence or word of its own. Only a
stretch without any white space that is longer than the limit is cut through a word.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.operators.routing import running_sum
from lodequery.session import materialize

LIMIT, OVERLAP = 1000, 150
#: Words of a block on either side of a boundary.
BLOCK = 40
#: A piece should fill at least this part of the limit if a boundary of any rank allows it.
LEAST_FILL = 0.5
PARAGRAPH, LINE, SENTENCE, WORD, HARD = range(5)

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """(positions, ranks) of all places where a piece may end: the positions where white space begins."""
    places, ranks = [], []
    for m in _SPACE.finditer(text):
        if not 0 < m.start() or m.end() == len(text):
            continue
        breaks = len(re.findall(r"\r\n|[\n\r\v\f\x85  ]", m[0]))
        if breaks > 1:
            rank = PARAGRAPH
        elif breaks:
            rank = LINE
        else:
            rank = SENTENCE if _SENTENCE_END.search(text, max(0, m.start() - 4), m.start()) else WORD
        places.append(m.start())
        ranks.append(rank)
    return places, ranks


def valley_depths(text: str, places: list[int], block: int = BLOCK) -> list[float]:
    """How far the similarity of the blocks around each place lies below the peaks on either side of it.

    Words count less the more of the stretches between the places they stand in, so what every sentence holds doesn't
    hide a change of topic. The similarities are smoothed over three places before valleys are looked for.
    """
    tokens = [(m.start(), m[0].lower()) for m in _TOKEN.finditer(text)]
    starts, ws = [t[0] for t in tokens], [t[1] for t in tokens]
    edges = [0, *(bisect_left(starts, p) for p in places), len(ws)]
    spread = Counter(w for lo, hi in zip(edges, edges[1:], strict=False) for w in set(ws[lo:hi]))
    weight = {w: log(1 + (len(edges) - 1) / n) ** 2 for w, n in spread.items()}
    sims: list[float] = []
    left: Counter[str] = Counter()
    right: Counter[str] = Counter()
    at_left, at_mid, at_right = 0, 0, 0  # tokens [at_left, at_mid) and [at_mid, at_right) are in the blocks
    dot = sq_left = sq_right = 0.0

    def change(side: Counter[str], other: Counter[str], w: str, by: int) -> tuple[float, float]:
        had = side[w]
        side[w] = had + by
        return by * other[w] * weight[w], ((had + by) ** 2 - had**2) * weight[w]

    for place in places:
        mid = bisect_left(starts, place)
        lo, hi = max(0, mid - block), min(len(ws), mid + block)
        while at_right < hi:
            d, s = change(right, left, ws[at_right], 1)
            dot, sq_right, at_right = dot + d, sq_right + s, at_right + 1
        while at_mid < mid:
            d, s = change(right, left, ws[at_mid], -1)
            dot, sq_right = dot + d, sq_right + s
            d, s = change(left, right, ws[at_mid], 1)
            dot, sq_left, at_mid = dot + d, sq_left + s, at_mid + 1
        while at_left < lo:
            d, s = change(left, right, ws[at_left], -1)
            dot, sq_left, at_left = dot + d, sq_left + s, at_left + 1
        sims.append(dot / sqrt(sq_left * sq_right) if sq_left > 1e-9 and sq_right > 1e-9 else 0.0)
    n = len(sims)
    sims = [sum(sims[max(0, i - 1) : i + 2]) / len(sims[max(0, i - 1) : i + 2]) for i in range(n)]
    peak_left, peak_right = sims[:], sims[:]
    for i in range(1, n):  # hill climbing: as long as the similarity doesn't fall
        peak_left[i] = max(sims[i], peak_left[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 2, -1, -1):
        peak_right[i] = max(sims[i], peak_right[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
    return [peak_left[i] + peak_right[i] - 2 * sims[i] for i in range(n)]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, end, rank of the cut at its end) of each piece; the last piece ends with the text, at rank PARAGRAPH.

    Every piece has at most ``limit`` characters, and every character that isn't white space is in a piece. Text up to
    the limit is one piece; null, empty or blank text has none. Neighbours share at most ``overlap`` characters.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if not text or text.isspace():
        return []
    if len(text) <= limit:
        return [(0, len(text), PARAGRAPH)]
    places, ranks = boundaries(text)
    of_rank = [[p for p, r in zip(places, ranks, strict=True) if r <= top] for top in range(HARD)]
    # valleys between sentences, lines and paragraphs; between words only the last place is taken, if nothing else is left
    depth = dict(zip(of_rank[SENTENCE], valley_depths(text, of_rank[SENTENCE], block), strict=True))
    rank_at = dict(zip(places, ranks, strict=True))
    after = {m.start(): m.end() for m in _SPACE.finditer(text)}
    full = len(text.rstrip())
    pieces: list[tuple[int, int, int]] = []
    cut = start = len(text) - len(text.lstrip())
    while full - start > limit:
        end = _end_of_piece(of_rank, depth, cut, start, limit)
        if end is None and start < cut:  # what is shared leaves no room for the next word
            start = cut
            continue
        if end is None:
            pieces.append((start, start + limit, HARD))
            cut = start = start + limit
            if cut in after:
                cut = start = after[cut]
            continue
        pieces.append((start, end, rank_at[end]))
        cut = after[end]
        start = _shared_from(text, of_rank, after, end, cut, start, overlap)
    if full > start:
        pieces.append((start, full, PARAGRAPH))
    return pieces


def _end_of_piece(of_rank: list[list[int]], depth: dict[int, float], cut: int, start: int, limit: int) -> int | None:
    """Where the piece that begins at ``start`` and has new text from ``cut`` on ends; None if no boundary is in reach."""
    for least in (max(cut, start + int(limit * LEAST_FILL)), cut):
        for top in (PARAGRAPH, LINE, SENTENCE, WORD):
            found = of_rank[top][bisect_right(of_rank[top], least) : bisect_right(of_rank[top], start + limit)]
            if found:
                return max(found, key=lambda p: (depth.get(p, 0.0), p)) if top < WORD else found[-1]
    return None


def _shared_from(text: str, of_rank: list[list[int]], after: dict[int, int], end: int, cut: int, start: int, overlap: int) -> int:
    """Where the next piece begins: the earliest sentence, else word, within ``overlap`` characters before the cut."""
    for top in (SENTENCE, WORD):
        lo = bisect_left(of_rank[top], max(start + 1, end - overlap))
        for p in of_rank[top][lo:]:
            if p >= end:
                break
            if after[p] > start and cut - after[p] <= overlap:
                return after[p]
    return cut


_PIECES = (
    "passage_id bigint, source_key string, heading string, chunk_index int, piece_no int, n_pieces int, start int, stop int, "
    "cut_rank int, oversize boolean, text string"
)


def split_passages(
    passages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, keep_short: bool = False, renumber: bool = True
) -> DataFrame:
    """Pieces of the passages of more than ``limit`` characters, with their heading.

    passage_id, source_key, heading, piece_no (from 0), n_pieces, start and stop in the passage's text, cut_rank (of
    the cut at the end; HARD is through a word), text, and chunk_index counted anew: the pieces of a source in the
    order of the old index, ties by passage_id, passages that aren't split counting one (or none, if blank). With
    ``keep_short`` those come out too; without ``renumber`` chunk_index stays the passage's, which saves the count over
    each source. An oversized text of white space only is one empty piece. Passages that are repeated come out once,
    whichever of different rows of one id is the larger; rows without id are left out, a null source_key is a source of
    its own, a null index comes first. Extra columns are ignored; an empty table gives an empty one.
    """
    cols = ["passage_id", "source_key", "heading", "chunk_index", "text"]
    once = passages.select(F.col("passage_id").cast("long"), *cols[1:3], F.col("chunk_index").cast("int"), "text")
    once = once.where("passage_id is not null").groupBy("passage_id").agg(F.max(F.struct(*cols[1:])).alias("p")).select("passage_id", "p.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for pid, source, heading, index, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                large = len(text or "") > limit
                pieces = split_text(text, limit, overlap, block) or [(0, 0, PARAGRAPH)] * large
                rows += [
                    (pid, source, heading, index, i, len(pieces), a, b, rank, large, text[a:b]) for i, (a, b, rank) in enumerate(pieces)
                ]
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.string()]
            cut = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            names = [x.split()[0] for x in _PIECES.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cut, kinds, strict=True)], names=names)

    if not keep_short and not renumber:
        once = once.where(F.length("text") > limit)
    pieces = once.mapInArrow(run, _PIECES)
    if renumber:
        pieces = materialize(pieces, "pieces")  # the split would else run once for the count and once for the result
        skip = _first_index(pieces)
        pieces = pieces.drop("chunk_index").join(skip, "passage_id").withColumn("chunk_index", F.col("first_index") + F.col("piece_no"))
    wanted = pieces if keep_short else pieces.where("oversize")
    return wanted.select("passage_id", "source_key", "heading", "piece_no", "n_pieces", "start", "stop", "cut_rank", "oversize", "text", "chunk_index")


def _first_index(pieces: DataFrame) -> DataFrame:
    """(passage_id, first_index): pieces of the source before the passage; one large source is no single task."""
    counts = pieces.where("piece_no = 0").select("passage_id", "source_key", F.coalesce("chunk_index", F.lit(-1)).alias("old"), "n_pieces")
    told = running_sum(counts, F.col("n_pieces"), "first_index", ["source_key"], ["old", "passage_id"])
    return told.select("passage_id", F.col("first_index").cast("int").alias("first_index"))


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """(passage_id, cut_kind) of the passages that were split: 'hard' if a word had to be cut, else 'natural'."""
    hard = F.max((F.col("cut_rank") == HARD).cast("int")) == 1
    return pieces.where("oversize").groupBy("passage_id").agg(F.when(hard, "hard").otherwise("natural").alias("cut_kind"))
