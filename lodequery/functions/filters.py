"""Equality filters on JSON payloads, strict about types.

A filter is {field: value or [values]}: fields are joined by AND, values of a field by OR, and a list in the payload
matches if one of its items does. Values are text of at most 128 characters, integers or booleans; True is not 1 and
"1" is not 1. Only scalars and lists of scalars at the top level of a payload can match.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT = 128
NAMESPACE_FIELD = "_namespace"
#: Type of a JSON value in a variant, by the Python type of a filter value.
_KINDS = {str: "STRING", bool: "BOOLEAN", int: "BIGINT"}


def _fits(value: Any) -> bool:
    if type(value) is str:
        return len(value) <= MAX_TEXT
    return type(value) is bool or (type(value) is int and -(2**63) <= value < 2**63)


def normalize_filter(where: dict | None) -> dict[str, list] | None:
    """{field: [values]}; None for no filter. ValueError for what can't be looked up."""
    if where is None:
        return None
    if not isinstance(where, dict):
        raise ValueError("a filter is a dict of fields and values")
    wanted = {}
    for field, given in where.items():
        if not isinstance(field, str):
            raise ValueError(f"field names are text, not {field!r}")
        values = list(given) if isinstance(given, (list, tuple, set, frozenset)) else [given]
        if not values:
            raise ValueError(f"no value given for {field!r}")
        for v in values:
            if not _fits(v):
                raise ValueError(f"{field!r} can't be filtered by {v!r}: text up to {MAX_TEXT} characters, integers and booleans can")
        wanted[field] = values
    return wanted or None


def encode_filter(where: dict | None) -> str:
    wanted = normalize_filter(where)
    return "" if wanted is None else json.dumps(wanted, ensure_ascii=False)


def decode_filter(text: str) -> dict[str, list] | None:
    return normalize_filter(json.loads(text)) if text else None


def parse_where(conditions: list[str]) -> dict[str, list]:
    """FIELD=VALUE texts as a filter: JSON integers, booleans and quoted text are taken as such, the rest as text."""
    wanted: dict[str, list] = {}
    for text in conditions:
        field, sign, value = text.partition("=")
        if not field or not sign:
            raise ValueError(f"{text!r} is not FIELD=VALUE")
        try:
            read = json.loads(value)
        except ValueError:
            read = value
        wanted.setdefault(field, []).append(read if type(read) in _KINDS else value)
    return wanted


def _path(field: str) -> str:
    if '"' not in field:
        return f'$["{field}"]'
    if "'" not in field:
        return f"$['{field}']"
    raise ValueError(f"field {field!r} holds both kinds of quotes")


def _is_one_of(item: Column, values: list) -> Column:
    tests = []
    for kind, name in _KINDS.items():
        own = [v for v in values if type(v) is kind]
        if own:
            same = F.schema_of_variant(item) == name
            tests.append(same & F.try_variant_get(item, "$", {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "bigint"}[name]).isin(own))
    return reduce(lambda a, b: a | b, tests)


def _test(values: list):
    return lambda item: _is_one_of(item, values)


def matches(payload: Column | str, where: dict | None) -> Column:
    """Predicate on a JSON text column; null or broken payloads and missing fields match nothing."""
    wanted = normalize_filter(where)
    if wanted is None:
        return F.lit(True)
    v = F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)
    tests = []
    for field, values in wanted.items():
        item = F.try_variant_get(v, _path(field), "variant")
        items = F.try_variant_get(v, _path(field), "array<variant>")
        tests.append(_is_one_of(item, values) | F.exists(items, _test(values)))
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def postings(df: DataFrame, row_id: str, payload: str) -> DataFrame:
    """Inverted index (row_id, field, kind, value) of the payloads' filterable values, each once.

    Null and broken payloads, and those that aren't objects, have none. kind is STRING, BIGINT or BOOLEAN, value the text
    of the value.
    """
    v = F.try_parse_json(F.col(payload))
    fields = (
        df.select(F.col(row_id).alias("row_id"), v.alias("v"))
        .where(F.schema_of_variant("v").startswith("OBJECT"))
        .select("row_id", F.explode(F.col("v").cast("map<string,variant>")).alias("field", "item"))
    )
    listed = F.when(F.schema_of_variant("item").startswith("ARRAY"), F.try_variant_get("item", "$", "array<variant>")).otherwise(F.array("item"))
    items = fields.select("row_id", "field", F.explode(listed).alias("item"))
    typed = items.select("row_id", "field", F.schema_of_variant("item").alias("kind"), F.try_variant_get("item", "$", "string").alias("value"))
    return typed.where(F.col("kind").isin(*_KINDS.values()) & (F.length("value") <= MAX_TEXT)).distinct()


def lookup(index: DataFrame, where: dict | None) -> DataFrame:
    """row_id of the rows that match, out of ``postings``: one pass over the wanted entries, counting fields."""
    wanted = normalize_filter(where)
    if wanted is None:
        return index.select("row_id").distinct()
    text = lambda v: str(v).lower() if type(v) is bool else str(v)
    entries = [(f, _KINDS[type(v)], text(v)) for f, vs in wanted.items() for v in vs]
    tests = [(F.col("field") == f) & (F.col("kind") == k) & (F.col("value") == v) for f, k, v in entries]
    hits = index.where(reduce(lambda a, b: a | b, tests))
    return hits.groupBy("row_id").agg(F.countDistinct("field").alias("n")).where(F.col("n") == len(wanted)).select("row_id")


def check_namespace(name: str) -> str:
    if not isinstance(name, str) or not name or len(name) > MAX_TEXT:
        raise ValueError(f"a namespace is text of 1 to {MAX_TEXT} characters")
    return name


def check_payload(payload: dict | None) -> None:
    if payload and NAMESPACE_FIELD in payload:
        raise ValueError(f"{NAMESPACE_FIELD} is reserved")


def plan_query(where: dict | None, namespace: str | None, shards: int) -> tuple[Column, Column]:
    """(predicate on the partition column ``shard``, predicate on ``namespace`` and ``payload``)."""
    from lodequery.operators.routing import namespace_shard_of

    if where and NAMESPACE_FIELD in where:
        raise ValueError(f"{NAMESPACE_FIELD} is reserved")
    if namespace is None:
        return F.lit(True), matches("payload", where)
    name = check_namespace(namespace)
    return F.col("shard") == namespace_shard_of(name, shards), (F.col("namespace") == name) & matches("payload", where)
