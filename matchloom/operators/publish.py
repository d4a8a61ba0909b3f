"""Publication of candidates and the read model over published sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_mode_tiers(modes: DataFrame) -> DataFrame:
    """One JSON array per entity, ordered by mode; bounded by the number of modes."""
    rows = F.sort_array(F.collect_list(F.struct("mode", "tier")))
    return modes.groupBy("entity_id").agg(F.to_json(rows).alias("mode_tiers"))


def nested_matchups(matchups: DataFrame) -> DataFrame:
    """Counters and strong matchups per entity, as sorted strings of opponents."""
    def names(*kinds: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("relationship").isin(*kinds), F.col("opponent_id")))), ",")
    return matchups.groupBy("entity_id").agg(
        names("hard_counter", "counter").alias("countered_by"), names("strong", "hard_advantage").alias("strong_against"))


def publish(ranking: DataFrame, modes: DataFrame, matchups: DataFrame) -> DataFrame:
    """Published items: each ranked entity with its nested sets."""
    return ranking.join(nested_mode_tiers(modes), "entity_id", "left").join(nested_matchups(matchups), "entity_id", "left")


def read_published(items: DataFrame, entities: DataFrame) -> DataFrame:
    """Published items with names, best first."""
    return items.join(entities.select("entity_id", "name"), "entity_id").orderBy(F.desc("score"), "entity_id")


def supersede(snapshots: DataFrame, new_id: Column) -> DataFrame:
    """The pointer table after a publication: one current row at most."""
    old = snapshots.withColumn("is_current", F.lit(False))
    return old.unionByName(snapshots.sparkSession.range(1).select(new_id.alias("snapshot_id"), F.lit(True).alias("is_current")))


def approval_checks(run: DataFrame) -> DataFrame:
    """(run_id, check, passed) of a held run, in the order in which they apply."""
    checks = [
        ("is_held", F.col("status") == "held"), ("not_published", ~F.col("published")),
        ("hold_reason", F.col("hold_reason") == "mass_movement_guard"), ("inputs_succeeded", F.col("inputs_succeeded")),
        ("complete", F.col("rows") > 0),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"))
                     for i, (n, c) in enumerate(checks)])
    return run.select("run_id", F.explode(rows).alias("c")).select("run_id", "c.step", "c.check", "c.passed")
