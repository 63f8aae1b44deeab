"""Restatements as a stream: equal to the whole table after late and repeated files, replays and merged levels."""

import random
from pathlib import Path

import pytest

from tallyframe.streaming import restatements as R

SCHEMA = "k string, v double, seq int"
ARGS = (["k"], "v", ["seq"])


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def known(spark, target, batch=None):
    return {(r.k, r.v) for r in R.current(spark, str(target), SCHEMA, *ARGS, batch).collect()}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    files = [[("a", 1.0, 1), ("b", 2.0, 1)], [("a", None, 2), ("b", 3.0, 2), ("c", None, 2)], [("a", 5.0, 3)], [("b", 9.0, 0)], [("a", 5.0, 3), ("a", 4.0, 3)]]
    files += [[(rng.choice("abcdefgh"), rng.choice([None, float(i)]), rng.randrange(20)) for _ in range(5)] for i in range(6)]
    for i, rows in enumerate(files):
        arrive(spark, tmp_path / "in", rows)
        R.latest_facts(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "check"), *ARGS, fan=3).awaitTermination()
        if i in (2, 4, len(files) - 1):
            assert known(spark, tmp_path / "out") == {(r.k, r.v) for r in R.as_batch(spark.read.parquet(str(tmp_path / "in")), *ARGS).collect()}
    log = R.Log(spark, str(tmp_path / "out"))
    levels = [r["level"] for r in log.runs()]
    # eleven batches of threes: two runs of one batch, none of three and one of nine
    assert sorted(levels) == [0, 0, 2] and log.manifests() == [9, 10]


def test_replayed_batches(spark, tmp_path):
    batches = [[(f"k{i}", float(i), i), ("all", float(i), i)] for i in range(7)]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for i, f in enumerate(frames):
        for _ in range(2):  # every batch runs twice
            R.merge(f, i, str(tmp_path / "t"), *ARGS, fan=2)
    assert known(spark, tmp_path / "t") == {*((f"k{i}", float(i)) for i in range(7)), ("all", 6.0)}
    assert known(spark, tmp_path / "t", 5) == {*((f"k{i}", float(i)) for i in range(6)), ("all", 5.0)}
    # a batch that failed before its manifest leaves runs that count for nothing
    log = R.Log(spark, str(tmp_path / "t"))
    log.write(spark.createDataFrame([("all", -1.0, 99)], SCHEMA), 0, 7)
    assert ("all", 6.0) in known(spark, tmp_path / "t")
    R.merge(spark.createDataFrame([("new", 1.0, 1)], SCHEMA), 7, str(tmp_path / "t"), *ARGS, fan=2)
    assert {("all", 6.0), ("new", 1.0)} <= known(spark, tmp_path / "t")


def test_a_small_batch_writes_little(spark, tmp_path):
    big = spark.range(200_000).selectExpr("concat('k', id) k", "cast(id as double) v", "1 seq")
    R.merge(big, 0, str(tmp_path / "t"), *ARGS)
    before = {p for p in (tmp_path / "t/runs").rglob("*.parquet")}
    R.merge(spark.createDataFrame([("k5", 0.5, 2)], SCHEMA), 1, str(tmp_path / "t"), *ARGS)
    new = sum(p.stat().st_size for p in (tmp_path / "t/runs").rglob("*.parquet") if p not in before)
    assert new * 100 < sum(Path(p).stat().st_size for p in before) and R.current(spark, str(tmp_path / "t"), SCHEMA, *ARGS).filter("k = 'k5'").first().v == 0.5


@pytest.mark.parametrize("rows", [[], [("a", None, 1)]])
def test_nothing_known(spark, tmp_path, rows):
    assert known(spark, tmp_path / "none") == set()
    R.merge(spark.createDataFrame(rows, SCHEMA), 0, str(tmp_path / "t"), *ARGS)
    assert known(spark, tmp_path / "t") == set()
