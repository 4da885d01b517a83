import os

import pytest

from lodequery.session import materialize, release, shared_dir, spread


def test_written_tables_stay_until_released(spark):
    df = materialize(spark.range(5), "t")
    assert sorted(r[0] for r in df.collect()) == list(range(5))
    kept = [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("t-")]
    assert kept and release(spark) >= 1
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("t-")] and release(spark) == 0


def test_small_scans_are_spread_and_wide_ones_left_alone(spark):
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10, 1, 9)
    assert spread(wide, "id") is wide


def test_a_cluster_must_name_the_folder(spark, monkeypatch):
    class Far:
        sparkContext = type("C", (), {"master": "spark://far", "getCheckpointDir": lambda self: None})()
        conf = type("K", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        shared_dir(Far())
