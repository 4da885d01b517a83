"""Text expressions: hashed bag-of-words vectors, sentences, snippets and readable summaries."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 512
# Fixed value: words too common to tell texts apart.
STOPWORDS = (
    "a an and are as at be been but by can do does for from had has have how if in into is it its no not of on or so such than that the "
    "their then there these they this to was we were what when where which who why will with you your"
).split()
_STOP = frozenset(STOPWORDS)
_WORD = re.compile("[a-z0-9]+")


def terms(text: Column | str) -> Column:
    """Runs of a-z and 0-9 in lower case, without stopwords; a plural s is dropped from words of more than three letters."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def hashed_weights(df: DataFrame, row_id: str, text: str, dim: int = DIM) -> DataFrame:
    """(row_id, bucket, weight): signed counts of hashed terms, damped by log1p, rows of length one.

    A text without terms has no rows: its vector is zero. Term counts are aggregated before the shuffle.
    """
    term = df.select(F.col(row_id).alias("row_id"), F.explode(terms(text)).alias("term"))
    crc = F.crc32(F.encode("term", "UTF-8"))
    sign = F.when(F.shiftright(crc, 16).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)
    counts = term.groupBy("row_id", (crc % dim).cast("int").alias("bucket")).agg(F.sum(sign).alias("n"))
    damped = counts.where("n <> 0").withColumn("w", F.signum("n") * F.log1p(F.abs("n").cast("double")))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))  # a row has ``dim`` buckets at most
    return damped.select("row_id", "bucket", (F.col("w") / length).alias("weight"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: named within a lambda it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_vector(text: Column | str, dim: int = DIM) -> Column:
    """The same vector as a dense array<double>, within the row: no shuffle."""
    entries = F.transform(
        terms(text),
        lambda t: F.struct(
            (F.crc32(F.encode(t, "UTF-8")) % dim).cast("int").alias("b"),
            F.when(F.shiftright(F.crc32(F.encode(t, "UTF-8")), 16).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1).alias("s"),
        ),
    )
    # terms by bucket, then one sum per run of equal buckets
    ordered = F.array_sort(entries)
    runs = F.aggregate(
        ordered,
        F.array().cast("array<struct<b:int,s:int>>"),
        lambda acc, e: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == e["b"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(e["b"].alias("b"), (F.element_at(acc, -1)["s"] + e["s"]).alias("s")))),
        ).otherwise(F.concat(acc, F.array(F.struct(e["b"].alias("b"), e["s"].alias("s"))))),
    )
    by_bucket = F.map_from_entries(F.transform(runs, lambda e: F.struct(e["b"].alias("k"), (F.signum(e["s"]) * F.log1p(F.abs(e["s"]).cast("double"))).alias("v"))))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    dense = _bound(by_bucket, lambda m: F.transform(places, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    long = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return _bound(dense, lambda d: _bound(long(d), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(x))))


@lru_cache(maxsize=200_000)
def _bucket(word: str, dim: int) -> tuple[int, int] | None:
    """Bucket and sign of a word; None for a stopword."""
    if word in _STOP:
        return None
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    crc = zlib.crc32(word.encode())
    return crc % dim, 1 if crc >> 16 & 1 else -1


def hash_matrix(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The same vectors as the rows of a matrix; a text without terms has a zero row."""
    counts = np.zeros((len(texts), dim))
    at: list[int] = []
    signs: list[int] = []
    for i, text in enumerate(texts):
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            if (found := _bucket(w, dim)) is not None:
                at.append(i * dim + found[0])
                signs.append(n * found[1])
    np.add.at(counts.ravel(), at, signs)
    v = np.copysign(np.log1p(np.abs(counts)), counts)
    length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def hash_embed(text: str | None, dim: int = DIM) -> list[float]:
    """The same vector on the driver, for a question."""
    return hash_matrix([text], dim)[0].tolist()


def hash_embed_udf(dim: int = DIM):
    """``hash_embed`` over Arrow batches, for long texts and many rows."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_matrix(texts.tolist(), dim)))

    return embed


class EmbedderUnavailable(RuntimeError):
    """An embedder needs a model or a package that isn't here."""


def onnx_embedder(model_path: str, tokenizer_path: str, max_tokens: int = 512):
    """A sentence model by ONNX, mean-pooled and normalized; the model is loaded once a worker.

    Models aren't part of this library: without the files EmbedderUnavailable is raised.
    """
    for p in (model_path, tokenizer_path):
        if not os.path.exists(p):
            raise EmbedderUnavailable(f"{p} isn't there")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime as ort
        from tokenizers import Tokenizer

        session = ort.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_tokens)
        tokenizer.enable_padding()
        names = {i.name for i in session.get_inputs()}
        for texts in batches:
            out = []
            for lo in range(0, len(texts), 32):
                enc = tokenizer.encode_batch(texts.iloc[lo : lo + 32].fillna("").tolist())
                feed = {"input_ids": np.array([e.ids for e in enc]), "attention_mask": np.array([e.attention_mask for e in enc])}
                feed["token_type_ids"] = np.zeros_like(feed["input_ids"])
                hidden = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
                mask = feed["attention_mask"][:, :, None]
                mean = (hidden * mask).sum(1) / np.maximum(mask.sum(1), 1)
                out += (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype("float32").tolist()
            yield pd.Series(out)

    return embed


EMBEDDERS = {"hash": hash_embed_udf, "onnx": onnx_embedder}


def get_embedder(name: str, **options):
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](**options)


def sentences(text: Column | str) -> Column:
    """Split after . ! ? and white space before a capital, a digit or an opening mark."""
    return F.split(F.col(text) if isinstance(text, str) else text, r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"'(\[`*_])""")


def embedding_text(heading: Column | str, text: Column | str) -> Column:
    h, t = (F.col(c) if isinstance(c, str) else c for c in (heading, text))
    return F.when(F.coalesce(h, F.lit("")) != "", F.concat(h, F.lit("\n\n"), t)).otherwise(t)


def snippet(text: Column | str, width: int = 240) -> Column:
    """One line; if longer than ``width``, cut after a word, with " ..."."""
    one = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    short = F.regexp_replace(F.substring(one, 1, width), r"\s\S*$", "")
    return F.when(F.length(one) <= width, one).otherwise(F.concat(short, F.lit(" ...")))


def describe_age(seconds: Column | str) -> Column:
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    text = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86400)):
        n = F.floor(s / size).cast("string")
        text = F.when(s >= size, F.concat(n, F.lit(f" {unit}"), F.when(s >= 2 * size, "s").otherwise(""), F.lit(" ago"))).otherwise(text)
    return text


def claimed_outcome(report: Column | str) -> Column:
    """The last line "Outcome: ..." of a report, in lower case; null if there is none."""
    claims = F.regexp_extract_all(
        F.lower(F.col(report) if isinstance(report, str) else report),
        F.lit(r"(?m)^\W*outcome\W*:\W*(fixed|needs a person|nothing wrong)\W*$"),
        F.lit(1),
    )
    return F.when(F.size(claims) > 0, F.element_at(claims, -1))


def display_path(path: Column | str, base: str) -> Column:
    """Relative to ``base`` if it lies below it."""
    p = F.col(path) if isinstance(path, str) else path
    root = base.rstrip("/") + "/"
    return F.when(p.startswith(root), F.substring(p, F.lit(len(root) + 1), F.length(p))).otherwise(p)


def parse_addresses(text: str) -> list[tuple[str, int, str]]:
    """Addresses in a list with commas; blank ones are none."""
    return [parse_address(part) for part in text.split(",") if part.strip()]


def parse_address(text: str) -> tuple[str, int, str]:
    """HOST:PORT[=PEER] as (host, port, peer address); the peer is the address itself if not given."""
    m = re.fullmatch(r"([^\s:=,]+):(\d{1,5})(?:=([^\s:=,]+:\d{1,5}))?", text.strip())
    if not m or not 0 < int(m[2]) < 65536:
        raise ValueError(f"{text!r} is not HOST:PORT[=PEER]")
    return m[1], int(m[2]), m[3] or f"{m[1]}:{m[2]}"
