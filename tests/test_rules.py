"""Rules that plain queries over the tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchloom.operators import aggregate, catalog, ingest, monitor, ranking, reports, retention, sampling, sync
from matchloom.streaming import twins


def test_small_aggregate(spark):
    """A wins two of three matches against B."""
    matches = spark.createDataFrame([(i, "m", None, dt.datetime(2026, 1, i)) for i in (1, 2, 3)],
                                    "match_id int, mode string, version string, occurred_at timestamp_ntz")
    teams = spark.createDataFrame([(i * 2 + s, i, r) for i, a, b in ((1, "victory", "defeat"), (2, "victory", "defeat"), (3, "defeat", "victory"))
                                   for s, r in ((0, a), (1, b))], "team_id int, match_id int, result string")
    parts = spark.createDataFrame([(i, i * 2 + s, e) for i in (1, 2, 3) for s, e in ((0, "A"), (1, "B"))], "match_id int, team_id int, entity_id string")
    entities = spark.createDataFrame([("A", True), ("B", True)], "entity_id string, is_active boolean")
    facts = aggregate.participation_facts(parts, matches, teams.select("team_id", "result"))
    got = {r.entity_id: (r.matches, r.wins, r.losses, round(r.win_rate, 4)) for r in aggregate.overall_aggregate(facts, entities).collect()}
    assert got == {"A": (3, 2, 1, 0.6667), "B": (3, 1, 2, 0.3333)}
    pairs = {(r.entity_id, r.opponent_id): round(r.win_rate, 4) for r in aggregate.matchup_aggregate(parts, matches, teams, entities).collect()}
    assert pairs == {("A", "B"): 0.6667, ("B", "A"): 0.3333}


def test_cap_keeps_latest(spark):
    rows = spark.createDataFrame([(1, "heavy", "e", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i)) for i in range(50)] + [(2, "light", "e", dt.datetime(2025, 1, 1))],
                                 "id int, player string, entity string, at timestamp_ntz")
    kept = ranking.cap_per_player(rows, ["entity", "player"], "at", ["id"]).collect()
    assert len(kept) == 21 and min(r.at for r in kept if r.player == "heavy") == dt.datetime(2026, 1, 2, 6)


@pytest.mark.parametrize("scores,tiers", [
    ([10.0], ["S"]), ([5.0, 5.0, 5.0], ["S"] * 3), ([float(i) for i in range(1, 101)], ["D"] * 9 + ["C"] * 20 + ["B"] * 40 + ["A"] * 20 + ["S"] * 11), ([], []),
])
def test_tiers(spark, scores, tiers):
    rows = spark.createDataFrame([(s,) for s in scores], "score double")
    assert [r.tier for r in ranking.percentile_tiers(rows, "score").orderBy("score").collect()] == tiers


def test_publication_gate(spark):
    schema = "entity_id int, tier string, score double"
    old = spark.createDataFrame([(i, "A", 50.0) for i in range(8)], schema)

    def outcome(rows, current=old):
        return ranking.publication_gate(spark.createDataFrame(rows, schema), current).first().outcome

    same = [(i, "A", 50.0) for i in range(8)]
    assert outcome(same) == "no_change"
    assert outcome([(0, "A", 51.5), *same[1:]]) == "publish"
    assert outcome([(i, "B" if i < 2 else "A", 50.0) for i in range(8)]) == "publish"  # a quarter is not over the guard
    assert outcome([(i, "B" if i < 3 else "A", 50.0) for i in range(8)]) == "held"
    assert outcome([(i, "B", 50.0) for i in range(8)], old.where("false")) == "publish"  # the first run


def test_result_policies(spark):
    item = '{"battleTime":"20260715T120000.000Z","event":{"mode":"m"},"battle":{"result":"victory","teams":[[{"tag":"#A","brawler":{"id":1}}],[{"tag":"#B","brawler":{"id":2}}]]}}'
    rows = spark.createDataFrame([(item,)], "item string")
    assert ingest.match_items(rows).first().results == ["victory", "victory"]
    assert ingest.match_items(rows, result_policy="inverted").first().results == ["victory", "defeat"]


def test_unknown_entity_quarantines(spark):
    item = '{"battleTime":"20260715T120000.000Z","event":{"mode":"m"},"battle":{"players":[{"tag":"#A","brawler":{"id":1}},{"tag":"#B","brawler":{"id":9}}]}}'
    rows = ingest.with_match_key(ingest.match_items(spark.createDataFrame([(item,)], "item string")))
    good, held = ingest.split_known(rows, spark.createDataFrame([(1,)], "entity_id int"))
    assert good.count() == 0 and held.count() == 1


def test_volume_anomaly(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id int")
    assert catalog.volume_anomaly(ids(), ids(1)).first().incident is None
    assert catalog.volume_anomaly(ids(1, 2), ids()).first().incident == "missing_source_data"
    assert catalog.volume_anomaly(ids(1, 2, 3), ids(1)).first().incident == "unexpected_mass_change"
    assert catalog.volume_anomaly(ids(1, 2), ids(1)).first().blocks is False


def test_fair_batch(spark):
    rows = spark.createDataFrame([(f"big{i}", "us", i) for i in range(50)] + [("tiny", "au", 0), ("none", None, 0)], "id string, region string, due int")
    got = sampling.fair_batch(rows, [F.coalesce("region", F.lit("~"))], [F.col("due"), F.col("id")], 5).collect()
    assert len(got) == 5 and {"tiny", "none"} <= {r.id for r in got}
    assert sampling.fair_batch(rows, [F.col("region")], [F.col("id")], 0).count() == 0


def test_growth_and_status(spark):
    now = dt.datetime(2026, 7, 31)
    history = spark.createDataFrame([(now - dt.timedelta(days=d), float(b)) for d, b in ((1, 90), (6, 60), (8, 40), (29, 10), (0, 100))], "at timestamp, bytes double")
    r = monitor.growth_rates(history, F.lit(now), F.lit(100.0)).first()
    assert (r.g1, r.g7) == (10.0, pytest.approx(40 / 6)) and r.g30 == pytest.approx(90 / 29) and r.conservative == pytest.approx(40 / 6)
    rows = spark.createDataFrame([(None, None), (10.0, 90.0), (40.0, None), (None, 25.0), (90.0, 50.0)], "d double, f double")
    assert [x[0] for x in rows.select(monitor.status(F.col("d"), F.col("f"))).collect()] == ["unknown", "critical", "warning", "warning", "healthy"]


def test_thin_history_gives_no_forecast(spark):
    state = spark.createDataFrame([(10.0, 100.0, 1.0, 2, 9)], "total double, cap double, conservative double, snapshots int, span_days int")
    assert {(r.status, r.projected_total) for r in monitor.forecast(state).collect()} == {("insufficient_data", None)}


def test_grace_has_a_floor():
    with pytest.raises(ValueError):
        retention.payload_removal(None, None, grace_days=6)


def test_merge_of_immutable_rows_reports_divergence(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "n")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None)], "id int, v string")
    plan = {r.id: r.action for r in sync.merge_plan(a, b, "id", ["id", "v"], immutable=True).collect()}
    assert plan == {1: "diverged", 2: "matched", 3: "inserted"}
    assert sync.apply_merge(a.where("id = 1"), b, "id").count() == 2


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, v double")
    r = reports.nearest_rank(rows, "v", "g").first()
    assert (r.p50, r.p95, r.p99) == (5.0, 10.0, 10.0)


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    folder, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    schema = "user_id int, event_type string, ts timestamp_ntz"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(folder))
    write([(1, "a", dt.datetime(2026, 1, 1)), (1, "a", dt.datetime(2026, 1, 2))])
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(folder))
        twins.run_available(twins.dedup(stream, ["user_id", "event_type"]), "append", out, state)
        write([(1, "a", dt.datetime(2026, 1, 3)), (2, "b", dt.datetime(2026, 1, 3))])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b")]


def test_late_duplicate_passes_a_watermark_only(spark, tmp_path):
    schema = "user_id int, ts timestamp_ntz"
    out, state, folder = f"file://{tmp_path}/out", f"file://{tmp_path}/state", str(tmp_path / "in")
    for day in (1, 20, 21):
        spark.createDataFrame([(1 if day != 20 else 9, dt.datetime(2026, 1, day))], schema).write.mode("append").parquet(folder)
        stream = twins.dedup_within(spark.readStream.schema(schema).parquet(folder), ["user_id"], "1 day")
        twins.run_available(stream, "append", out, state)
    assert sorted(r.user_id for r in spark.read.parquet(out).collect()) == [1, 1, 9]


def test_exact_allowlist():
    assert retention.exact_allowlist(["b", "a", "b"]) == ["a", "b"]
    for bad in ([], ["*"], ["all"], ["a", ""], ["x%"]):
        with pytest.raises(ValueError):
            retention.exact_allowlist(bad)
