import json
import random

import pytest

from lodequery.operators import changefeed
from lodequery.operators.changefeed import ChangeFeed, memory_changes

LOG = "mem_owner string, seq bigint, payloads array<string>, owner string, memory_id int, alive int"


def payload(kind="memory", own="m1", replaces=None, **more):
    return json.dumps({"type": kind, "memory_id": own, "replaces": replaces, **more})


def log_of(spark, rows):
    return spark.createDataFrame([(o, s, p, "x", 1, 2) for o, s, p in rows], LOG)


def payload_effects(body):
    """(memory_id, written) pairs of one payload, in plain Python."""
    def refuse(text):
        raise ValueError(text)

    try:
        fields = json.loads(body or "", parse_constant=refuse)
    except (ValueError, RecursionError):
        return []
    if not isinstance(fields, dict):
        return []
    named = fields.get("replaces")
    named = [named] if isinstance(named, str) else named if isinstance(named, list) else []
    effects = {x: False for x in named if isinstance(x, str)}
    if fields.get("type") == "memory" and isinstance(fields.get("memory_id"), str):
        effects[fields["memory_id"]] = True
    return list(effects.items())


def brute(rows):
    best = {}
    for owner, seq, bodies in rows:
        if owner is None or seq is None:
            continue
        for place, body in enumerate(bodies or []):
            for mid, written in payload_effects(body):
                key, at = (owner, mid), (seq, place, written)
                best[key] = max(best.get(key, at), at)
    return {(*k, v[0]) for k, v in best.items() if v[2]}


BODIES = [
    payload(), payload(replaces=["a", "b", 3, None, ["c"], {"d": 1}]), payload("forget", "f1", "a"), payload("note", "n1", ["a"]), payload(replaces=["m1"]),
    payload(own="\u00fc \u2028 \\ \" '"), payload(replaces={"a": 1}), payload(replaces=True), payload(own=""), payload(replaces=["a", "a"]),
    None, "", " ", "{", "[1]", "3", '"memory"', '{"type": "memory", "memory_id": NaN}', '{"type":"memory","memory_id":7}', '{"type":["memory"],"memory_id":"x"}',
    "[" * 100_000, payload() + "x", payload(text="y" * 300_000),
]


def test_effects_of_payloads(spark):
    rows = memory_changes(log_of(spark, [(f"o{i}", i, [b]) for i, b in enumerate(BODIES)]), with_body=True).collect()
    got = {(r["owner"], r["memory_id"], r["alive"]) for r in rows}
    assert got == {(f"o{i}", m, w) for i, b in enumerate(BODIES) for m, w in payload_effects(b)} and len(rows) == len(got)
    assert all(r["place"] == 0 and r["seq"] == int(r["owner"][1:]) and r["body"] == (BODIES[r["seq"]] if r["alive"] else None) for r in rows)


def test_order_repetition_and_damage_do_not_matter(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for seq in range(1, 400):
        owner = rng.choice(["big", "big", "a", "b"])
        body = payload(rng.choice(["memory", "memory", "forget"]), f"m{rng.randrange(40)}", [f"m{rng.randrange(40)}" for _ in range(rng.randrange(3))])
        rows.append((owner, seq, [body] * rng.choice([1, 1, 2])))
    rows += [(o, s, [b[0][:20]]) for o, s, b in rng.sample(rows, 60)]  # damaged deliveries of whole ones
    rows += rng.sample(rows, 100) + [(None, 3, [payload()]), ("a", None, [payload()]), ("a", 5, None), ("a", 6, [None, ""])]
    want = brute(rows)
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = log_of(spark, rows).repartition(5)
        got = ChangeFeed(spark, str(tmp_path / str(seed)), buckets=3).publish(memory_changes(df)).where("alive").select("owner", "memory_id", "seq").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_log(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"))
    assert feed.publish(memory_changes(log_of(spark, []))).count() == 0
    assert feed.publish(memory_changes(log_of(spark, [("o", 1, [payload()])]))).count() == 1
    assert feed.publish(memory_changes(log_of(spark, []))).count() == 1


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), buckets=16)
    feed.publish(memory_changes(log_of(spark, [("o", i, [payload(own=f"m{i}")]) for i in range(200)])))
    first = json.loads(feed.manifest.latest())["folders"]
    feed.publish(memory_changes(log_of(spark, [("o", 900, [payload(own="m7")])])))
    second = json.loads(feed.manifest.latest())["folders"]
    (old, kept), (new, own) = sorted(second.items())
    assert len(own) == 1 and sorted(kept + own) == first[old] and feed.state().count() == 200
    assert feed.state().where("seq = 900").select("memory_id").first()[0] == "m7" and len(list((tmp_path / "feed").glob(f"{new.rsplit('/', 1)[1]}/bucket=*"))) == 1


def test_buckets_grow_with_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changefeed, "KEYS_A_BUCKET", 10)
    feed = ChangeFeed(spark, str(tmp_path / "feed"))
    counts = []
    for lo in (0, 30, 60, 200):
        feed.publish(memory_changes(log_of(spark, [("o", i, [payload(own=f"m{i}")]) for i in range(lo, lo + 50)])))
        counts.append(json.loads(feed.manifest.latest())["buckets"])
    assert counts == [8, 16, 16, 16] and feed.state().count() == 160
    assert feed.state().groupBy("owner", "memory_id").count().where("count > 1").count() == 0


def test_later_batches_and_tombstones(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), buckets=2)
    assert feed.state() is None
    feed.publish(memory_changes(log_of(spark, [("o", 1, [payload(own="a", text="one")]), ("o", 5, [payload("forget", "f", ["a", "z"])])]), with_body=True))
    assert feed.state().where("alive").count() == 0
    feed.publish(memory_changes(log_of(spark, [("o", 3, [payload(own="a", text="late")]), ("o", 2, [payload(own="b", text="two")])]), with_body=True))
    rows = {r["memory_id"]: r for r in feed.state().collect()}
    assert not rows["a"]["alive"] and rows["a"]["seq"] == 5  # the tombstone holds against the late write
    assert rows["b"]["alive"] and json.loads(rows["b"]["body"])["text"] == "two" and not rows["z"]["alive"]
    before = feed.state().count()
    feed.publish(memory_changes(log_of(spark, [("o", 9, [payload(own="z", text="new")])]), with_body=True))
    assert feed.state().count() == before and feed.state().where("memory_id = 'z' and alive and seq = 9").count() == 1


def test_failed_publication_leaves_the_state(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), buckets=2)
    feed.publish(memory_changes(log_of(spark, [("o", 1, [payload(own="a")])])))
    broken = memory_changes(log_of(spark, [("o", 2, [payload(own="b")])])).selectExpr("owner", "memory_id", "raise_error('lost') as seq", "place", "alive", "body")
    with pytest.raises(Exception, match="lost"):
        feed.publish(broken.selectExpr("owner", "memory_id", "cast(seq as bigint) seq", "place", "alive", "body"))
    assert [r["memory_id"] for r in feed.state().collect()] == ["a"]
