"""Participations with matches and teams: rows without a team."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.operators import aggregate
from matchloom.plans import registry


@pytest.fixture
def shuffled(spark):
    """Joins that are never broadcast and keep all their partitions."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_without_a_team_are_dealt_over_tasks(spark, shuffled):
    n = F.col("id")
    rows = spark.range(4000).select((n % 400).alias("match_id"), n.alias("entity_id"), F.when(n % 10 == 0, n % 400 * 2).alias("team_id"))
    matches = spark.range(400).select(n.alias("match_id"), F.lit("m").alias("mode"))
    teams = spark.range(800).select(n.alias("team_id"), F.lit("victory").alias("result"))  # a team for the number of each match, too
    facts = aggregate.participation_facts(rows, matches, teams)
    assert set(facts.columns) == {"team_id", "match_id", "entity_id", "mode", "result"}
    got = facts.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 4000 and all((r.result is None) == (r.team_id is None) for r in got)
    without = [r.task for r in got if r.team_id is None]
    most = max(without.count(t) for t in set(without))
    assert len(without) == 3600 and most < 3600 / 2


@pytest.fixture
def meetings(spark):
    """6,000 participations in 500 matches, one in seven without a team, every second match without a version."""
    n, match = F.col("id"), F.col("id") % 500
    rows = spark.range(6000).select(match.alias("match_id"), F.when(n % 7 != 0, match * 2 + F.floor(n / 500) % 2).alias("team_id"), (n * 31 % 97).alias("entity_id"))
    matches = spark.range(500).select(n.alias("match_id"), F.when(n % 5 != 0, F.concat(F.lit("m"), n % 3)).alias("mode"), F.when(n % 2 != 0, "v").alias("version"))
    results = F.element_at(F.array(*map(F.lit, ("victory", "defeat", "draw", "unknown"))), (n % 4 + 1).cast("int"))
    entities = spark.range(97).select(n.alias("entity_id"), (n % 10 != 0).alias("is_active"))
    return rows, matches, spark.range(1000).select(n.alias("team_id"), results.alias("result")), entities


def pairs_made(meetings):
    """Matches, wins and losses by entity and opponent, one participation after the other."""
    rows, matches, teams, entities = ([r.asDict() for r in t.collect()] for t in meetings)
    mode, result = {m["match_id"]: m["mode"] for m in matches}, {t["team_id"]: t["result"] for t in teams}
    active, met, found = {e["entity_id"] for e in entities if e["is_active"]}, {}, {}
    for r in rows:
        if r["team_id"] is not None:
            met.setdefault(r["match_id"], []).append((r["entity_id"], r["team_id"]))
    for match, sides in met.items():
        for entity, team in sides:
            for opponent, other in sides:
                if mode[match] and entity in active and team != other and entity != opponent:
                    stats = found.setdefault((entity, opponent), [0, 0, 0])
                    for i, counts in enumerate((True, result[team] == "victory", result[team] == "defeat")):
                        stats[i] += counts
    return {k: tuple(v) for k, v in found.items()}


def test_tasks_of_pairs_do_not_grow_with_the_rows(spark, meetings):
    held = "spark.sql.shuffle.partitions"
    before = spark.conf.get(held)
    try:
        spark.conf.set(held, "4")
        for wanted in (20, 60):
            pairs = aggregate.matchup_pairs(*meetings, rows_per_task=6000 // wanted)
            per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per_task) == sum(v[0] for v in pairs_made(meetings).values())
            assert len(per_task) > wanted / 2 and max(per_task) < 6 * sum(per_task) / wanted
    finally:
        spark.conf.set(held, before)


def test_all_joins_of_pairs_are_dealt_by_rows(spark, meetings, shuffled):
    plan = aggregate.matchup_pairs(*meetings, rows_per_task=100)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((match_id|team_id)#\d+L?, (\d+)\), (\w+)", plan)
    # a participation moves to its team's result, then once to its match
    assert sorted(dealt) == [("match_id", "60", "REPARTITION_BY_NUM")] * 3 + [("team_id", "4", "REPARTITION_BY_NUM")] * 2


@pytest.mark.parametrize("rows_per_task", [100, 500_000])
def test_pairs_whatever_their_tasks(spark, meetings, rows_per_task):
    got = aggregate.matchup_pairs(*meetings, rows_per_task=rows_per_task).groupBy("entity_id", "opponent_id").agg(*aggregate.outcomes()[:3])
    assert {(r.entity_id, r.opponent_id): (r.matches, r.wins, r.losses) for r in got.collect()} == pairs_made(meetings)


def test_pooled_at_once_equals_stored_and_pooled(spark, meetings):
    at_once = aggregate.pooled_aggregate(*meetings)
    stored = aggregate.pooled_matchups(aggregate.matchup_aggregate(*meetings))
    assert at_once.columns == stored.columns
    rows = sorted(at_once.collect(), key=lambda r: (r.entity_id, r.opponent_id))
    assert rows == sorted(stored.collect(), key=lambda r: (r.entity_id, r.opponent_id))
    assert {(r.entity_id, r.opponent_id): (r.matches, r.wins, r.losses) for r in rows} == pairs_made(meetings)


@pytest.mark.parametrize("name", ["g13_matchup_coverage", "g15_nested_matchups", "s20_published_read"])
def test_pairs_are_summed_once(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[entity_id#\w+, opponent_id#", plan)) == 1


@pytest.mark.parametrize("name", ["g15_nested_matchups", "s20_published_read"])
def test_rows_move_to_their_match_once(spark, sf_dir, shuffled, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(match_id#\w+, \d+\)", plan)) == 3  # rows, modes, opponents
