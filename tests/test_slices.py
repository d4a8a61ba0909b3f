"""Aggregation in slices: growing input, killed runs, merges, late matches."""

import datetime as dt
import random

import pytest

from matchloom.operators import aggregate
from matchloom.streaming import slices, twins

P_SCHEMA, M_SCHEMA = "match_id long, entity_id long, team_id long", "match_id long, mode string, version string, occurred_at timestamp_ntz"
RESULTS = ["victory", "defeat", "draw", "unknown"]


def tables(spark, n=60):
    matches = [(i, [None, "solo", "duo"][i % 3], "OF"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(n)]
    teams = [(i * 2 + s, i, RESULTS[(i + s) % 4]) for i in range(n) for s in (0, 1)]
    return (spark.createDataFrame(matches, M_SCHEMA), spark.createDataFrame(teams, "team_id long, match_id long, result string"),
            spark.createDataFrame([(e, e != 3) for e in range(7)], "entity_id long, is_active boolean"))


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, P_SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def participations(seed, n=80):
    rng = random.Random(seed)
    return [(m, rng.randrange(7), rng.choice([None, 2 * m, 2 * m + 1])) for m in (rng.randrange(60) for _ in range(n))]


def stream(spark, folder, files=1):
    return spark.readStream.schema(P_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def expected(spark, rows, matches, teams, entities):
    facts = aggregate.participation_facts(spark.createDataFrame(rows, P_SCHEMA), matches, teams)
    return rows_of(aggregate.mode_aggregate(facts, entities))


@pytest.mark.parametrize("merge_every", [1, 2, 50])
def test_growing_input_and_a_killed_run(spark, tmp_path, merge_every, monkeypatch):
    matches, teams, entities = tables(spark)
    folder, seen = str(tmp_path / "in"), []

    def fresh():
        return slices.ModeStatistics(spark, str(tmp_path / "state"), lambda: matches, lambda: teams, merge_every)

    for step in range(3):
        new = [participations(10 * step + i) for i in range(2)]
        for i, rows in enumerate(new):
            land(spark, folder, f"f{step}-{i}", rows)
            seen += rows
        if step == 1:  # dies behind its state and before its cursor
            broken, add = fresh(), slices.StateFolder.add

            def killed(self, partials, number):
                add(self, partials, number)
                raise RuntimeError("killed")

            with monkeypatch.context() as patch:
                patch.setattr(slices.StateFolder, "add", killed)
                with pytest.raises(Exception, match="killed"):
                    broken.run(stream(spark, folder))
        done = fresh().run(stream(spark, folder))
        assert (done.slices, done.rows) == (2, 160)  # what is new, and nothing else
        assert rows_of(fresh().read(entities)) == expected(spark, seen, matches, teams, entities)
    assert fresh().run(stream(spark, folder)) == slices.Run(0, 0)


def test_a_broken_write_is_not_read(spark, tmp_path):
    shape = slices.Mergeable(("k",), {"n": "sum", "top": "max"})
    schema = spark.createDataFrame([], "k string, n long, top long").schema
    state = slices.StateFolder(spark, str(tmp_path), shape, schema)
    assert state.read().collect() == []
    state.add(spark.createDataFrame([("a", 1, 5)], schema), 0)
    state.add(spark.createDataFrame([("a", 2, 3), ("b", 1, None)], schema), 1)
    state.add(spark.createDataFrame([("a", 9, 9)], schema), 2)
    (tmp_path / "delta" / "batch=2" / "_SUCCESS").unlink()
    assert rows_of(state.read()) == [("a", 3, 5), ("b", 1, None)]
    state.merge(1)
    assert rows_of(state.read()) == [("a", 3, 5), ("b", 1, None)]
    state.add(spark.createDataFrame([("a", 2, 3), ("b", 1, None)], schema), 1)  # a repeat of what the base holds
    assert rows_of(state.read()) == [("a", 3, 5), ("b", 1, None)]


def test_matches_that_land_later(spark, tmp_path):
    matches, teams, entities = tables(spark)
    known = {"matches": matches.where("match_id < 30")}
    folder, first, second = str(tmp_path / "in"), participations(1), participations(2)
    kept = slices.ModeStatistics(spark, str(tmp_path / "state"), lambda: known["matches"], lambda: teams)
    land(spark, folder, "a", first)
    kept.run(stream(spark, folder))
    assert kept.waiting(0).count() == sum(m >= 30 for m, _, _ in first)
    known["matches"] = matches
    land(spark, folder, "b", second)
    kept.run(stream(spark, folder))
    assert rows_of(kept.read(entities)) == expected(spark, first + second, matches, teams, entities)


def test_closed_hours_come_once_and_an_empty_run_is_an_empty_table(spark, tmp_path):
    schema = "event_type string, ts timestamp_ntz"
    (tmp_path / "in").mkdir()

    def run():
        found = twins.hourly_counts(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "1 hour")
        out = twins.run_available(found, "append", str(tmp_path / "out"), str(tmp_path / "cursor"))
        return sorted((r.hour.hour, r.n) for r in twins.results(spark, found.schema, out).collect())

    def put(name, *hours):
        rows = [("view", dt.datetime(2024, 1, 1, h, m)) for h, m in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    assert run() == []
    put("a", (1, 5), (1, 50), (2, 10), (4, 0))
    assert run() == [(1, 2), (2, 1)]
    put("b", (4, 30), (9, 0))
    assert run() == [(1, 2), (2, 1), (4, 2)]
