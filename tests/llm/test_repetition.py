import random

import numpy as np
import pytest

from lodequery.llm.repetition import RULES, find_repetitive, measure_repetition, numbered, repeated_words, rule_order

SCHEMA = "doc_id bigint, text string, d int, t int, share int"


def brute(ws, span):
    seen, hit = set(), [False] * len(ws)
    for i in range(len(ws) - span + 1):
        run = tuple(ws[i : i + span])
        if run in seen:
            hit[i : i + span] = [True] * span
        seen.add(run)
    return sum(hit)


def texts(rng, n):
    for _ in range(n):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 5, 50]))]
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 30, 200]))]
        if rng.random() < 0.4 and ws:
            ws += ws[: rng.randrange(len(ws) + 1)] * rng.randrange(3)
        yield ws


@pytest.mark.parametrize("span", [2, 3, 8])
def test_equals_brute_force_and_no_rule_loses_a_document(span):
    rng = random.Random(span)
    for ws in texts(rng, 400):
        n = numbered(ws)
        again = repeated_words(n, span)
        assert again == brute(ws, span)
        for threshold in (0.05, 0.3, 0.9, 1.0):
            if ws and again / len(ws) >= threshold:
                assert all(rule(n, span, threshold) for rule in RULES.values()), (ws, threshold)


def test_overlapping_runs_count():
    assert repeated_words(numbered(["a"] * 20), 8) == 19 and repeated_words(numbered(["a"] * 8), 8) == 0
    assert repeated_words(np.empty(0, np.int64), 8) == 0


def test_order_has_every_rule():
    sample = [numbered(w) for w in texts(random.Random(1), 60)]
    assert sorted(rule_order(sample, 8, 0.3)) == sorted(RULES) == sorted(rule_order([], 8, 0.3))


def test_table(spark):
    again = "one two three four five six seven eight nine ten "
    rows = [(1, "S: x\n\n" + again * 3), (1, "S: x\n\n" + again * 3), (2, "S: x\n\n" + again), (3, None), (4, ""), (5, "S: x\n\n" + "spam " * 200_000), (None, again * 9)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    shares = {(r["doc_id"], round(r["share"], 4), r["n_words"]) for r in measure_repetition(df).collect()}
    assert shares == {(1, 0.6667, 30), (2, 0.0, 10), (3, 0.0, 0), (4, 0.0, 0), (5, 1.0, 200_000)}
    for sample in (0, 3, 400):
        got = sorted(tuple(r) for r in find_repetitive(df, sample=sample).select("doc_id").collect())
        assert got == [(1,), (5,)]
    assert find_repetitive(df.limit(0)).count() == 0 and measure_repetition(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_repetitive(df, threshold=0)
