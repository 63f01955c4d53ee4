"""What has to meet in one task: the rows of a scan's block and the frames of a log's file, also where the planner drops a shuffle for a broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import scan
from loomline.streaming import framed


@pytest.fixture
def turning(spark):
    """Joins are planned as merges and turn into broadcasts once their sides are known."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_a_log_keeps_all_frames_of_a_file(turning, tmp_path):
    rows = turning.range(0, 4000, 1, 8).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("file"), F.col("id").alias("seq"), F.lit("x").alias("body"))
    framed.write_log(rows, str(tmp_path / "log"))
    assert framed.read_log(turning, str(tmp_path / "log"), stream=False).count() == 4000


def test_frames_of_equal_seq_have_one_order(turning, tmp_path):
    rows = turning.range(0, 4000, 1, 8).select(F.lit("f").alias("file"), F.lit(1).alias("seq"), F.col("id").cast("string").alias("body"))
    framed.write_log(rows.orderBy(F.desc("seq"), F.rand(1)), str(tmp_path / "a"))
    framed.write_log(rows.orderBy(F.desc("seq"), F.rand(2)), str(tmp_path / "b"))
    assert (tmp_path / "a" / "f").read_bytes() == (tmp_path / "b" / "f").read_bytes()


def test_a_machine_over_blocks_in_many_tasks(turning, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 500)
    rng, steps, want, s = random.Random(3), [], {}, 0
    for i in range(1, 4001):
        step = rng.choice(([1, 1, 2], [0, 2, 1], [2, 0, 0]))
        steps.append((i, *step))
        want[i], s = s, step[s]
    rng.shuffle(steps)
    df = turning.createDataFrame(steps, "i long, a int, b int, c int").repartition(8)
    got = scan.machine(df, "i", [F.col("a"), F.col("b"), F.col("c")], 0, "state")
    assert {r.i: r.state for r in got.collect()} == want
