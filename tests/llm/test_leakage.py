import random

import numpy as np
import pytest

from lodequery.llm.leakage import build_matcher, find_leaks, leaked_items
from lodequery.llm.mailtext import words

DOCS = "doc_id bigint, text string, d int, t int, item_id int"
ITEMS = "item_id bigint, question string, i int, q int, doc_id int"


def brute(items, docs, span):
    found = set()
    for i, q in items:
        runs = {tuple(q[k : k + span]) for k in range(len(q) - span + 1)}
        for d, w in enumerate(docs):
            if any(tuple(w[k : k + span]) in runs for k in range(len(w) - span + 1)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("span", [2, 3, 5, 12])
def test_equals_brute_force(span):
    rng = random.Random(span)
    letters = [f"w{i}" for i in range(4 if span < 12 else 2)]
    items = [(i, [rng.choice(letters) for _ in range(rng.randrange(0, 30))]) for i in range(25)]
    items += [(100, items[3][1]), (101, items[4][1][:-1])]
    docs = [[rng.choice([*letters, "other"]) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 900]))] for _ in range(60)]
    docs.append(["pad"] * 185 + items[5][1] + ["pad"] * 30)  # over the end of a stretch
    m = build_matcher(items, span)
    assert set(leaked_items(m, docs)) == brute(items, docs, span)


def test_every_position_of_a_long_document():
    q = [f"q{i}" for i in range(12)]
    m = build_matcher([(7, q)])
    for at in range(0, 600, 7):
        assert leaked_items(m, [["x"] * at + q + ["x"] * (600 - at)]) == [(0, 7)]
        assert leaked_items(m, [["x"] * at + q[:-1] + ["x"]]) == []
    assert leaked_items(m, []) == [] and leaked_items(m, [[]]) == []


def test_shifts_never_pass_an_occurrence():
    m = build_matcher([(1, list("abcdefghijkl"))])
    assert m.shift.max() == 11 and np.count_nonzero(m.shift == 0) >= 1
    assert build_matcher([(1, ["a"] * 11)]) is None and build_matcher([]) is None


def test_table(spark):
    question = "Which of these twelve words in a row will be found in the archive again?"
    rows = [
        (1, f"Subject: {question}\n\nnothing"), (2, f"Subject: x\n\nsee:\n> Which of these twelve\n> WORDS in a row, will be found in the — archive!"), (3, None), (4, ""),
        (5, "Subject: x\n\n" + "pad " * 50_000 + question), (5, "Subject: x\n\n" + question), (None, "a\n\n" + question), (6, "x: y\n\nof these twelve words in a row will be found in"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)
    items = [(10, question), (11, question), (12, "too short to be found"), (13, None), (None, question), (14, "the same start of these twelve words in a row will be found in the sea")]
    its = spark.createDataFrame([(*r, 1, 2, 3) for r in items], ITEMS)
    want = {(d, i) for d, t in rows if d and t for i, q in items if i and q and brute([(i, words(q))], [words(t.partition("\n\n")[2])], 12)}
    for most in (1, 5, 400_000):  # in blocks, too
        got = find_leaks(docs, its, most=most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert find_leaks(docs.limit(0), its).count() == 0 and find_leaks(docs, its.limit(0)).count() == 0
