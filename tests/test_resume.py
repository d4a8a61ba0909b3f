"""Streams that are taken up again, thin and missing cases, the shared folder."""

import datetime as dt

import pytest

from matchloom.operators import reports
from matchloom.sources import shared
from matchloom.streaming import twins

SCHEMA = "event_type string, ts timestamp_ntz"


def land(spark, folder, name, n):
    rows = [("view", dt.datetime(2024, 1, 1, i % 24)) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_runs_on_one_checkpoint(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land(spark, folder, "a", 5)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        path = twins.run_available(twins.outcome_counts(stream), "complete", out, state)
        return [(r.event_type, r.n) for r in spark.read.parquet(path).collect()]

    assert run() == [("view", 5)]
    assert run() == [("view", 5)]  # nothing new
    land(spark, folder, "b", 3)
    assert run() == [("view", 8)]


def test_first_run_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    path = twins.run_available(twins.outcome_counts(stream), "complete", str(tmp_path / "out"), str(tmp_path / "state"))
    back = spark.read.parquet(path)
    assert back.count() == 0 and back.columns == ["event_type", "n", "latest"]


def test_zero_filled(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    rows = spark.createDataFrame([(1,), (1,), (3,), (9,)], "entity_id long")
    assert sorted((r.entity_id, r.n) for r in reports.zero_filled(entities, rows, "entity_id").collect()) == [(1, 2), (2, 0), (3, 1)]


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_path(Session(), "x")
