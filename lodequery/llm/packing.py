"""Filling fixed-capacity containers with items, under a mixture of sources.

Sizes are tokens of a public tokenizer. Only a text that is larger than a container is split: into full containers and
a rest. Items lie in queues, one for each source. In every round one container is filled: each source's deficit grows
by its target share of the capacity, and the source of largest deficit puts in its largest item that still fits, as
long as anything fits; in the last part of a container the item that fits best wins, of any source that isn't far ahead
of its target. Deficits are never reset, so windows of containers keep to the target proportions and what one lacks the
next makes good.

Items are dealt to partitions by hash, each with the mixture of the whole. What a partition will serve of each source
is known beforehand - all that it has - so the deficits that it inherits from the partitions before it are running sums,
and partitions fill their containers independently.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.session import materialize, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are divided before merging (fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a partition on average: one task's memory, and one container in so many that may stay partly empty.
ITEMS = 60_000
#: Containers of a window in which the mixture is reported.
WINDOW = 64
#: The last part of a container, in which the best fit is taken, and how far a source may be served beyond its target
#: then, in containers.
LAST_PART, AHEAD = 0.5, 0.25
#: Tasks that pack; beyond that a task packs several partitions, one after another.
MOST_TASKS = 20_000
_NEVER = np.iinfo(np.int64).max
_LONG = 100_000
_MOST_LIMITS = 1_000


@lru_cache(maxsize=2)
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    """A very long text in parts, cut where the pattern begins a new piece anyway: before a blank between letters."""
    at = 0
    while len(text) - at > _LONG:
        cut = at + _LONG
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(documents: DataFrame, doc_id: str, text: str, source: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every row with an id; a null text has no tokens, a null source is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(folder, vocabulary)
        for batch in batches:
            sizes = [sum(len(encoding.encode_ordinary(s)) for s in _stretches(t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return spread(rows.where("doc_id is not null"), "doc_id").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


class _Stock:
    """Items that are left: of each source its sizes in ascending order, and of each size how many each source has.

    The sizes that are left are the bits of one number, so the largest that fits is found without trying sources.
    """

    def __init__(self, sizes: list[np.ndarray]):
        order = [np.lexsort((-np.arange(len(s)), s)) for s in sizes]
        self.item = [o.tolist() for o in order]
        self.queue = [np.asarray(s)[o].tolist() for s, o in zip(sizes, order, strict=True)]
        self.least = np.array([q[0] if q else _NEVER for q in self.queue], np.int64)
        self.left = sum(map(len, self.queue))
        self.of_size: dict[int, Counter[int]] = {}
        for s, q in enumerate(self.queue):
            for size in q:
                self.of_size.setdefault(size, Counter())[s] += 1
        self.bits = sum(1 << size for size in self.of_size)

    def largest(self, source: int, room: int) -> int:
        return self.queue[source][bisect_right(self.queue[source], room) - 1]

    def best(self, room: int, chosen: np.ndarray, owed: np.ndarray) -> tuple[int, int]:
        """(source, size) of the largest item up to ``room`` among the chosen sources, one of which must have such an
        item; of equal ones that of the source that is owed most."""
        bits = self.bits & ((2 << room) - 1)
        while True:
            size = bits.bit_length() - 1
            have = [s for s in self.of_size[size] if chosen[s]]
            if have:
                return max(have, key=lambda s: (owed[s], -s)), size
            bits ^= 1 << size

    def take(self, source: int, size: int) -> int:
        at = bisect_right(self.queue[source], size) - 1
        self.queue[source].pop(at)
        self.left -= 1
        self.least[source] = self.queue[source][0] if self.queue[source] else _NEVER
        have = self.of_size[size]
        have[source] -= 1
        if not have[source]:
            del have[source]
            if not have:
                self.bits ^= 1 << size
                del self.of_size[size]
        return self.item[source].pop(at)


def fill_containers(sizes: list[np.ndarray], share: np.ndarray, deficit: np.ndarray, capacity: int) -> list[list[tuple[int, int]]]:
    """Containers as lists of (source, index in the source's sizes). Every item must be at most the capacity.

    ``share`` is each source's target part of the tokens, ``deficit`` what it is owed from before. Up to LAST_PART the
    source of largest deficit puts in its largest item that fits. Then the item that fits best wins, of any source that
    hasn't been served more than AHEAD of a container beyond its target - so what is served of a source never runs
    away from its target -, and only if none of those has an item that fits, of any source at all. The targets of
    sources that are used up fall to the others in proportion.
    """
    stock = _Stock(sizes)
    owed = np.array(deficit, np.float64)
    share = np.asarray(share, np.float64)
    containers: list[list[tuple[int, int]]] = []
    while stock.left:
        there = np.where(stock.least < _NEVER, share, 0.0)
        total = there.sum()
        if total > 0:
            owed += there * (capacity / total)
        room, content = capacity, []
        while True:
            fits = stock.least <= room
            if not fits.any():
                break
            if room > capacity * (1 - LAST_PART):
                s = int(np.where(fits, owed, -np.inf).argmax())
                size = stock.largest(s, room)
            else:
                due = fits & (owed > -AHEAD * capacity)
                s, size = stock.best(room, due if due.any() else fits, owed)
            content.append((s, stock.take(s, size)))
            room -= size
            owed[s] -= size
        containers.append(content)
    return containers


_PACKED = (
    "limit_name string, capacity_tokens bigint, container_id bigint, window_no bigint, place int, doc_id bigint, source string, "
    "piece_no bigint, first_token bigint, n_tokens bigint"
)


def _pack_part(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The containers of one partition of one limit, of its items (kind 1) and of what its sources are owed (kind 0)."""
    name, capacity, part = (rows.column(c)[0].as_py() for c in ("limit_name", "capacity", "part"))
    kind = rows.column("kind").to_numpy()
    items, carried = rows.filter(pa.array(kind == 1)), rows.filter(pa.array(kind == 0))
    if not items.num_rows:
        return
    items = items.sort_by([("source", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("size", "ascending")])
    owed = {x["source"]: (x["share"], x["deficit"]) for x in carried.select(["source", "share", "deficit"]).to_pylist()}
    code = pc.dictionary_encode(items.column("source").combine_chunks(), null_encoding="encode")
    sources, at = code.dictionary.to_pylist(), code.indices.to_numpy()
    ends = np.searchsorted(at, np.arange(len(sources) + 1))  # nulls come last, and so does their code
    size = items.column("size").to_numpy()
    known = np.array([owed.get(s, (0.0, 0.0)) for s in sources])
    filled = fill_containers([size[a:b] for a, b in zip(ends, ends[1:], strict=False)], known[:, 0], known[:, 1], capacity)
    count = np.array([len(c) for c in filled])
    no = np.repeat(np.arange(count.size), count)
    chosen = np.array([ends[s] + i for c in filled for s, i in c])
    place = np.arange(chosen.size) - np.repeat(np.cumsum(count) - count, count)
    took, n = items.take(pa.array(chosen)), chosen.size
    piece = took.column("piece").combine_chunks()
    columns = [
        pa.array([name] * n, pa.string()), pa.array(np.full(n, capacity)), pa.array((part << 32) + no), pa.array((part << 32) + no // WINDOW),
        pa.array(place.astype(np.int32)), took.column("doc_id"), took.column("source"), piece, pc.multiply(piece, capacity), took.column("size"),
    ]
    yield from pa.table(columns, names=[x.split()[0] for x in _PACKED.split(",")]).to_batches(20_000)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their partition's number ``at``: one partition at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        at = batch.column("at").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), at.size]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            if held and at[lo] != current:
                yield from _pack_part(pa.Table.from_batches(held))
                held = []
            current = at[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from _pack_part(pa.Table.from_batches(held))


def pack(
    sizes: DataFrame, limits: DataFrame, targets: DataFrame | None = None, limit_name: str = "limit_name", capacity: str = "capacity_tokens",
    items: int = ITEMS,
) -> DataFrame:
    """Assign every piece of every document to a container of each limit; ``sizes`` as from ``token_counts``.

    ``targets`` (source, share) sets the proportions, by default those of the corpus; a source without target is owed
    nothing and fills what room is left. A document of no tokens lies in a container without taking room. Repeated rows
    are items of their own. Limits without a positive capacity hold nothing and are left out.
    """
    spark = sizes.sparkSession
    known = limits.select(F.col(limit_name).alias("n"), F.col(capacity).cast("long").alias("c")).where("c > 0").distinct().limit(_MOST_LIMITS + 1).collect()
    if len(known) > _MOST_LIMITS:
        raise ValueError(f"more than {_MOST_LIMITS} limits")
    schema = spark.createDataFrame([], _PACKED)
    if not known:
        return schema
    known = sorted(map(tuple, known), key=lambda x: (x[1], x[0] or ""))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(c)))
    sums = [F.coalesce(F.sum(pieces(c)), F.lit(0)).alias(f"c{i}") for i, (_, c) in enumerate(known)]
    *count, tokens = sizes.agg(*sums, F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    parts = [max(1, round(n / items)) for n in count]
    first = np.cumsum([0, *parts])
    every = F.array(*[
        F.struct(F.lit(n).cast("string").alias("limit_name"), F.lit(c).cast("long").alias("capacity"), F.lit(int(p)).alias("parts"), F.lit(int(f)).alias("first"))
        for (n, c), p, f in zip(known, parts, first, strict=False)
    ])
    rows = sizes.select("doc_id", "source", "n_tokens", F.explode(every).alias("l"))
    rows = rows.select("doc_id", "source", "n_tokens", "l.*").withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))) - 1))
    )
    size = F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity"))
    rows = rows.withColumn("size", size).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("long"))
    served = rows.groupBy("limit_name", "capacity", "first", "part", "source").agg(F.sum("size").alias("served"))
    served = materialize(served, "served")  # partitions times sources, used twice
    if targets is None:
        shares = sizes.groupBy(F.col("source").alias("s")).agg((F.sum("n_tokens") / F.lit(float(max(1, tokens)))).alias("share"))
    else:
        shares = targets.select(F.col("source").cast("string").alias("s"), F.col("share").cast("double").alias("share"))
    parts_total = served.groupBy("limit_name", "capacity", "first", "part").agg(F.sum("served").alias("tokens"))
    by_part = Window.partitionBy("limit_name", "capacity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts_total.select("limit_name", "capacity", "part", F.coalesce(F.sum("tokens").over(by_part), F.lit(0)).alias("all_before"))
    by_source = Window.partitionBy("limit_name", "capacity", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = served.withColumn("own_before", F.coalesce(F.sum("served").over(by_source), F.lit(0)))
    same = [F.col("a.limit_name").eqNullSafe(F.col("b.limit_name")), F.col("a.capacity") == F.col("b.capacity"), F.col("a.part") == F.col("b.part")]
    carry = own.alias("a").join(before.alias("b"), same).join(shares, F.col("a.source").eqNullSafe(F.col("s")), "left")
    share = F.coalesce(F.col("share"), F.lit(0.0))
    carried = carry.select(
        F.lit(0).alias("kind"), "a.limit_name", "a.capacity", "a.first", "a.part", "a.source", F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("piece"), F.lit(None).cast("long").alias("size"), share.alias("share"),
        (share * F.col("all_before") - F.col("own_before")).alias("deficit"),
    )
    none = F.lit(None).cast("double")
    packed = rows.select(F.lit(1).alias("kind"), "limit_name", "capacity", "first", "part", "source", "doc_id", "piece", "size", none.alias("share"), none.alias("deficit"))
    numbered = carried.unionByName(packed).withColumn("at", F.col("first") + F.col("part"))
    tasks = min(int(first[-1]), MOST_TASKS)
    placed = numbered.repartitionById(tasks, F.pmod("at", F.lit(tasks)).cast("int")).sortWithinPartitions("at")
    return placed.drop("first").mapInArrow(_pack, _PACKED)


def pack_documents(
    documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: DataFrame | None = None,
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``pack`` over the documents' texts. The texts are read and measured once; their sizes are written to the shared folder."""
    return pack(materialize(token_counts(documents, doc_id, text, source, folder, vocabulary), "sizes"), limits, targets)


def room_left(packed: DataFrame) -> DataFrame:
    """Of each limit: containers, tokens, and the share of all containers' room that stays empty."""
    own = packed.groupBy("limit_name", "capacity_tokens").agg(
        F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents")
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return own.withColumn("empty_share", F.round(1 - F.col("tokens") / room, 6))


def mixture(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """How far the windows of each limit are from the targets (source, share): windows, and over them the mean and the
    95th percentile of the largest difference between a source's part of a window and its share."""
    keys = ["limit_name", "window_no"]
    own = packed.groupBy(*keys, "source").agg(F.sum("n_tokens").alias("t"))
    total = own.groupBy(*keys).agg(F.sum("t").alias("all")).where(F.col("all") > 0)
    part = own.join(total, keys).join(targets.select(F.col("source").alias("s"), "share"), F.col("source").eqNullSafe(F.col("s")), "left")
    # a source that the window lacks is off by its share; the largest of those is at most the largest share
    off = part.groupBy(*keys).agg(F.max(F.abs(F.col("t") / F.col("all") - F.coalesce("share", F.lit(0.0)))).alias("off"))
    return off.groupBy("limit_name").agg(
        F.count("*").alias("windows"), F.round(F.avg("off"), 6).alias("mean_off"), F.round(F.percentile("off", F.lit(0.95)), 6).alias("p95_off")
    )


def corpus_shares(packed: DataFrame) -> DataFrame:
    """(source, share) of the packed tokens, which are the default targets. Any one limit holds all tokens."""
    one = packed.where(F.col("capacity_tokens") == packed.agg(F.min("capacity_tokens")).first()[0])
    sums = one.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    total = one.agg(F.sum("n_tokens").alias("all"))
    return sums.join(F.broadcast(total)).select("source", (F.col("t") / F.greatest("all", F.lit(1))).alias("share"))  # one row
