import random
import re

import pytest

from lodequery.llm.segment import HARD, LINE, PARAGRAPH, SENTENCE, boundaries, cut_kinds, split_passages, split_text, valley_depths

SCHEMA = "passage_id bigint, source_key string, heading string, chunk_index int, text string, p string, stop string, n_pieces string"


def sample(rng):
    parts = []
    while sum(map(len, parts)) < rng.choice([900, 3000, 9000]):
        kind = rng.random()
        if kind < 0.1:
            parts.append("x" * rng.randrange(1, 2600))
        elif kind < 0.3:
            parts.append(rng.choice(["\n\n", "\n", "\r\n\r\n", "  ", "\u00a0", "\u2028"]))
        else:
            parts.append(" ".join(rng.choice(["alpha", "beta", "gamma", "été", "日本"]) for _ in range(rng.randrange(1, 20))) + rng.choice([". ", "! ", " ", "\n"]))
    return "".join(parts)


@pytest.mark.parametrize(("limit", "overlap"), [(1000, 150), (1000, 0), (100, 99), (50, 10)])
def test_invariants(limit, overlap):
    rng = random.Random(limit + overlap)
    for _ in range(60):
        text = sample(rng)
        pieces = split_text(text, limit, overlap)
        assert all(0 <= b - a <= limit for a, b, _ in pieces)
        seen = [False] * len(text)
        for a, b, _ in pieces:
            seen[a:b] = [True] * (b - a)
        assert all(s or c.isspace() for s, c in zip(seen, text, strict=True))
        assert all(x[0] < y[0] and x[1] < y[1] and x[1] - y[0] <= overlap for x, y in zip(pieces, pieces[1:], strict=False))
        hard = any(rank == HARD for *_, rank in pieces)
        assert hard == bool(re.search(rf"\S{{{limit + 1}}}", text))


def test_small_and_odd_texts():
    assert split_text(None) == split_text("") == split_text(" \n") == []
    assert split_text("x" * 1000) == [(0, 1000, PARAGRAPH)]
    assert split_text("x" * 1001) == [(0, 1000, HARD), (1000, 1001, PARAGRAPH)]
    assert split_text("a" * 1000 + " " + "b" * 1000) == [(0, 1000, 3), (1001, 2001, PARAGRAPH)]
    assert max(b - a for a, b, _ in split_text("w " * 500_000)) <= 1000
    for bad in ((10, 10), (10, -1)):
        with pytest.raises(ValueError):
            split_text("x", *bad)


def test_ranks_of_boundaries():
    text = "One two. Three\nfour\n\nfive"
    assert boundaries(text) == ([3, 8, 14, 19], [3, SENTENCE, LINE, PARAGRAPH])


def test_deepest_valley_is_taken():
    about = lambda words, n: " ".join(f"The {random.Random(i).choice(words)} meets the {random.Random(i + 99).choice(words)} near noon." for i in range(n))
    ships, bread = about(["ship", "harbor", "sail", "anchor"], 16), about(["flour", "oven", "yeast", "dough"], 16)
    text = ships + " " + bread + " " + ships
    places = [p for p, rank in zip(*boundaries(text), strict=True) if rank <= SENTENCE]
    edge = len(ships)
    depths = dict(zip(places, valley_depths(text, places), strict=True))
    assert depths[edge] == max(v for p, v in depths.items() if 100 < p < len(ships + bread) - 100)
    first = split_text(text, 1000, 0)[0]
    assert abs(first[1] - edge) < 80


def test_passages(spark):
    long = "Short sentence here. " * 120
    rows = [
        (1, "s", "A > B", 0, "short"), (2, "s", "A", 1, long), (2, "s", "A", 1, long), (3, "s", None, 1, long), (4, "s", "", 2, " " * 1001),
        (5, None, "x", None, "y" * 2500), (6, "s", "z", 5000, long), (7, "s", "n", 9, None), (None, "s", "n", 9, long), (8, "t", "n", 0, ""),
    ]
    df = spark.createDataFrame([(*r, "p", "q", "r") for r in rows], SCHEMA)
    got = split_passages(df).orderBy("passage_id", "piece_no").collect()
    assert {r["passage_id"] for r in got} == {2, 3, 4, 5, 6}
    by = {}
    for r in got:
        by.setdefault(r["passage_id"], []).append(r)
    assert [r["piece_no"] for r in by[2]] == list(range(len(by[2]))) and len(by[2]) == by[2][0]["n_pieces"]
    assert by[2][0]["heading"] == "A" and by[3][0]["heading"] is None
    n = len(by[2])
    assert [r["chunk_index"] for r in by[2]] == list(range(1, 1 + n)) and by[3][0]["chunk_index"] == 1 + n
    assert by[4][0]["chunk_index"] == 1 + 2 * n and by[6][0]["chunk_index"] == 2 + 2 * n and by[5][0]["chunk_index"] == 0
    assert by[4][0]["text"] == "" and all(r["text"] == long[r["start"] : r["stop"]] for r in by[2])
    kinds = {r["passage_id"]: r["cut_kind"] for r in cut_kinds(split_passages(df, renumber=False)).collect()}
    assert kinds == {2: "natural", 3: "natural", 4: "natural", 5: "hard", 6: "natural"}
    assert {r["passage_id"] for r in split_passages(df, keep_short=True).collect()} == {1, 2, 3, 4, 5, 6}
    assert split_passages(df.limit(0)).count() == 0
