from pyspark.sql import functions as F

from lodequery.operators import evals
from lodequery.streaming.ingest import catch_up_postings, drop_repeated, windowed_counts


def test_grades(spark):
    runs = spark.createDataFrame(
        [
            (1, True, False, 0, 1, True, "Outcome: fixed", None), (2, True, False, 0, 1, True, "Outcome: nothing wrong", None), (3, False, False, None, None, False, "outcome: needs a person", None),
            (4, False, False, None, None, False, "Outcome: needs a person", None), (5, True, True, None, None, True, "Outcome: nothing wrong", None), (6, True, False, 0, 0, True, "Outcome: fixed", "lost"),
            (7, True, False, 0, 0, True, "no claim", None),
        ],
        "run int, fixable boolean, stale boolean, shard int, replica int, healthy boolean, report string, error string",
    )
    journal = spark.createDataFrame(
        [(1, "tool", "read_server_log", 0, 1, False), (1, "model", "x", None, None, False), *[(4, "tool", "restart_server", 0, 0, True)] * 3, (2, "tool", "read_server_log", 0, 0, False)],
        "run int, kind string, tool string, shard int, replica int, error boolean",
    )
    got = {r["run"]: r for r in evals.grade(runs, journal).collect()}
    assert [got[i]["success"] for i in range(1, 8)] == [True, False, True, False, True, False, False]
    assert got[1]["diagnosed"] and not got[2]["diagnosed"] and got[3]["diagnosed"] is None and got[4]["failed_calls"] == 3 and got[5]["tool_calls"] == 0


def test_windows_and_repeats(spark, tmp_path):
    rows = [(1, 0), (1, 30), (2, 60), (1, 700), (1, 5), (2, 4000), (3, 100)]  # seconds; 5 is late but within bounds
    src = str(tmp_path / "in")
    for i, (k, s) in enumerate(rows):
        spark.createDataFrame([(k, s)], "k int, s int").selectExpr("k", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append" if i else "overwrite").parquet(src)
    stream = lambda: spark.readStream.schema("k int, ts timestamp").parquet(src)

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    counts = {(r["window"]["start"].timestamp(), r["k"]): r["events"] for r in collect(windowed_counts(stream(), "ts", "k"), "w", "complete")}
    assert counts[(0.0, 1)] == 3 and counts[(600.0, 1)] == 1 and counts[(3600.0, 2)] == 1
    assert sorted(r["k"] for r in collect(drop_repeated(stream(), ["k"], "ts"), "d", "append")) == [1, 2, 3]


def test_postings_by_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": [1, "x"]}')], "id bigint, p string").repartition(2).write.parquet(src)
    stream = spark.readStream.schema("id bigint, p string").option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(lambda b, n: catch_up_postings(b, n, out, "id", "p")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3 and got.where((F.col("kind") == "BIGINT") & (F.col("value") == "1")).count() == 2
