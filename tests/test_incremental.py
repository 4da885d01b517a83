import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodequery.operators.incremental import IncrementalRun, as_intervals, changed_files, clean_sha256, merge_intervals, subtract_intervals, within_intervals
from lodequery.operators.routing import running
from lodequery.sources.manifest import ConflictError, ManifestFolder

LOG = "shard int, seq bigint, stream string, block int, at int, till int, first int, last int"
RUNS = "shard int, first_seq bigint, last_seq bigint, stream string"


def log_of(spark, pairs):
    return spark.createDataFrame([(a, b, "x", 1, 2, 3, 4, 5) for a, b in pairs], LOG)


def covered(intervals):
    return {(s, n) for s, a, b in intervals for n in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_subtract_and_merge_equal_sets(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randrange(3), rng.randrange(-5, 60)) for _ in range(150)] + [(None, 4), (1, None)]
    runs = [(rng.randrange(4), a := rng.randrange(-9, 60), a + rng.randrange(-2, 9)) for _ in range(20)] + [(1, None, 5), (1, 5, None), (None, 1, 9)]
    done = spark.createDataFrame([(*r, "y") for r in runs], RUNS)
    sane = [r for r in runs if None not in r and r[1] <= r[2]]
    left = subtract_intervals(log_of(spark, points), done, "shard", "seq", "first_seq", "last_seq").collect()
    want = {p for p in points if None not in p} - covered(sane)
    assert len(left) == len({tuple(r) for r in left})
    assert {tuple(r) for r in left} == want
    merged = [tuple(r) for r in merge_intervals(done, "shard", "first_seq", "last_seq").collect()]
    assert covered(merged) == covered(sane)
    assert sum(b - a + 1 for _, a, b in merged) == len(covered(sane))  # disjoint
    ends = sorted(merged)
    assert all(not (x[0] == y[0] and x[2] + 1 >= y[1]) for x, y in zip(ends, ends[1:], strict=False))  # as few as possible


def test_empty_tables(spark):
    nothing, none = log_of(spark, []), spark.createDataFrame([], RUNS)
    assert subtract_intervals(nothing, none, "shard", "seq", "first_seq", "last_seq").count() == 0
    assert subtract_intervals(log_of(spark, [(1, 1)]), none, "shard", "seq", "first_seq", "last_seq").count() == 1
    assert merge_intervals(none, "shard", "first_seq", "last_seq").count() == 0
    assert as_intervals(nothing, "shard", "seq").count() == 0


def test_changed_files_ties_nulls_and_dirt(spark):
    a, b = "a" * 64, "b" * 64
    scans = spark.createDataFrame(
        [
            ("same", "SHA256:" + a.upper(), 2, 0), ("same", b, 1, 0), ("changed", f" {b} ", 5, 0), ("new", a, None, 0), ("unreadable", None, 1, 0),
            ("broken", "xyz", 1, 0), (None, a, 1, 0), ("tie", a, 3, 0), ("tie", b, 3, 0), ("late", a, 9, 0), ("late", None, 10, 0), ("failed", a, 1, 0),
        ],
        "k string, sha string, seen int, had int",
    )
    taken = spark.createDataFrame(
        [
            ("same", a, 1, "COMMITTED "), ("changed", b, 1, "committed"), ("changed", a, 2, " Committed"), ("changed", b, 3, "failed"),
            ("changed", b, None, "committed"), ("tie", a, 1, "committed"), ("late", a, 1, "committed"), ("failed", a, 1, None), (None, a, 1, "committed"),
        ],
        "k string, sha string, attempt int, outcome string",
    )
    got = changed_files(scans, taken, "k", "sha", "seen", "attempt", "outcome").collect()
    assert {tuple(r) for r in got} == {("changed", b), ("new", a), ("tie", b), ("failed", a)}
    assert changed_files(scans.limit(0), taken, "k", "sha", "seen", "attempt", "outcome").count() == 0
    assert changed_files(scans, taken.limit(0), "k", "sha", "seen", "attempt", "outcome").count() == 6


def test_clean_sha256(spark):
    good = "0" * 63 + "f"
    rows = [(good,), (f"  {good.upper()} ",), (f"sha-256={good}",), ("0" * 65,), ("",), (None,), ("f" * 63,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(clean_sha256("s")).collect()]
    assert got == [good, good, good, None, None, None, None]


def test_runs_survive_failures_and_take_late_records_once(spark, tmp_path):
    run = IncrementalRun(spark, str(tmp_path / "r"))
    take = lambda df: df.select("shard", "seq").distinct()
    first = log_of(spark, [(0, 1), (0, 2), (0, 5), (1, 1), (1, 1)])

    def fail(df):
        raise RuntimeError("worker lost")

    with pytest.raises(RuntimeError):
        run.run(first, fail)
    assert run.processed() is None and run.output() is None
    assert run.run(first, take)
    assert not run.run(first, take)
    late = log_of(spark, [(0, 1), (0, 2), (0, 3), (0, 5), (1, 1), (1, 2)])
    with pytest.raises(RuntimeError):
        run.run(late, fail)
    assert run.run(late, take)
    out = sorted(tuple(r) for r in run.output().collect())
    assert out == [(0, 1), (0, 2), (0, 3), (0, 5), (1, 1), (1, 2)]
    assert sorted(tuple(r) for r in run.processed().collect()) == [(0, 1, 3), (0, 5, 5), (1, 1, 2)]


@pytest.mark.parametrize("local", [True, False])
def test_two_writers_conflict(spark, tmp_path, local):
    m = ManifestFolder(spark, str(tmp_path / "m"))
    m._local = local  # otherwise as on a shared file system
    assert m.version() is None and m.latest() is None
    m.publish(1, "eins")
    with pytest.raises(ConflictError):
        m.publish(1, "zwei")
    assert m.latest() == "eins" and m.version() == 1
    assert not [f for f in (tmp_path / "m").iterdir() if "draft" in f.name and not f.name.endswith(".crc")]


def test_many_writers_of_one_version(spark, tmp_path):
    def write(i):
        try:
            ManifestFolder(spark, str(tmp_path / "m")).publish(1, f"writer {i}")
        except ConflictError:
            return None
        return f"writer {i}"

    with ThreadPoolExecutor(8) as pool:
        won = [w for w in pool.map(write, range(24)) if w]
    assert won == [ManifestFolder(spark, str(tmp_path / "m")).latest()]


def test_concurrent_runs_neither_skip_nor_repeat(spark, tmp_path):
    log, both = log_of(spark, [(s, q) for s in range(3) for q in range(1, 40)]), threading.Barrier(2)

    def work(name):
        run = IncrementalRun(spark, str(tmp_path / "r"))

        def process(df):
            try:
                both.wait(20)  # both have seen the same pending records
            except threading.BrokenBarrierError:
                pass
            return df.select("shard", "seq", F.lit(name).alias("by"))

        for _ in range(3):
            try:
                return run.run(log, process)
            except ConflictError:
                both.abort()
        return None

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(work, "ab")) == [False, True]
    out = IncrementalRun(spark, str(tmp_path / "r")).output().collect()
    assert len(out) == 3 * 39 and len({(r["shard"], r["seq"]) for r in out}) == 3 * 39 and len({r["by"] for r in out}) == 1


def test_wild_bounds_cost_nothing(spark):
    top, low = 2**63 - 1, -(2**63)
    runs = spark.createDataFrame([(0, 5, 2**60, "x"), (0, 3, 4, "x"), (1, low, top, "x"), (1, 7, 9, "x"), (2, 2, 2, "x"), (2, 2**60, top, "x")], RUNS)
    merged = sorted(tuple(r) for r in merge_intervals(runs, "shard", "first_seq", "last_seq").collect())
    assert merged == [(0, 3, 2**60), (1, low, top), (2, 2, 2), (2, 2**60, top)]
    log = log_of(spark, [(0, 2), (0, 4), (0, 2**61), (1, top), (1, low), (2, 3), (2, 2**60), (3, 1)])
    left = subtract_intervals(log, runs, "shard", "seq", "first_seq", "last_seq").collect()
    assert sorted(tuple(r) for r in left) == [(0, 2), (0, 2**61), (2, 3), (3, 1)]


def test_rows_within_intervals_come_whole_and_as_often(spark):
    log = log_of(spark, [(0, 1), (0, 1), (0, 2), (1, 1), (None, 1)])
    got = within_intervals(log, spark.createDataFrame([(0, 1, 1, "x")], RUNS), "shard", "seq", "first_seq", "last_seq")
    assert got.columns == log.columns and [tuple(r)[:2] for r in got.collect()] == [(0, 1), (0, 1)]


def test_one_stream_with_all_rows_is_swept_in_ranges(spark):
    points = spark.range(1, 20_001).selectExpr("0 as shard", "id * 3 as seq")
    assert as_intervals(points, "shard", "seq").count() == 20_000
    runs = spark.range(0, 5_000).selectExpr("0 as shard", "id * 12 as first_seq", "id * 12 + 5 as last_seq", "'x' as stream")
    assert subtract_intervals(points, runs, "shard", "seq", "first_seq", "last_seq").count() == 10_001
    swept = running(points, "max", F.col("seq"), "before", ["shard"], ["seq"])
    assert swept.where("before is null").count() == 1 and swept.where("before = seq - 3").count() == 19_999
    back = running(points, "min", F.col("seq"), "next", ["shard"], ["seq"], behind=True)
    assert back.where("next is null").count() == 1 and back.where("next = seq + 3").count() == 19_999
