"""Win, loss and draw statistics of entities, and of pairs of entities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def participation_facts(participations: DataFrame, matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Each participation with its match and, if it has one, its team's result.

    Rows without a team would all meet in one task; they are dealt by their
    match instead, and the second condition keeps them from any team.
    """
    rows, results = participations.join(matches, "match_id"), teams.select(F.col("team_id").alias("_team"), "result")
    met = (F.coalesce("team_id", "match_id") == F.col("_team")) & F.col("team_id").isNotNull()
    return rows.join(results, met, "left").drop("_team")


def _of_active(facts: DataFrame, entities: DataFrame) -> DataFrame:
    return facts.join(entities.where("is_active").select("entity_id"), "entity_id", "left_semi")


def outcomes() -> list:
    """Matches, wins, losses and draws of a group; sums of parts are those of the whole."""
    return [
        F.count("*").alias("matches"),
        F.count_if(F.col("result") == "victory").alias("wins"),
        F.count_if(F.col("result") == "defeat").alias("losses"),
        F.count_if(F.col("result") == "draw").alias("draws"),
    ]


def mode_aggregate(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """By entity, mode and version; matches without a mode are left out."""
    stats = _of_active(facts.where("mode IS NOT NULL"), entities).groupBy("entity_id", "mode", "version").agg(
        *outcomes(), F.max("occurred_at").alias("latest")
    )
    return stats.withColumn("win_rate", scalars.win_rate(F.col("wins"), F.col("losses")))


def overall_aggregate(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """By entity and version, matches without a mode included."""
    stats = _of_active(facts, entities).groupBy("entity_id", "version").agg(
        *outcomes(), F.count_distinct("mode").alias("mode_coverage"), F.max("occurred_at").alias("latest")
    )
    return stats.withColumn("win_rate", scalars.win_rate(F.col("wins"), F.col("losses")))


def matchup_pairs(
    participations: DataFrame, matches: DataFrame, teams: DataFrame, entities: DataFrame, rows_per_task: int = 500_000
) -> DataFrame:
    """Participations of active entities, each with every one of another entity on another team of its match.

    Team results and match attributes are joined before the pairs are made, on
    the smaller side, and pairs meet on the match, so the self-join moves narrow
    rows once.  Results come first: modes and opponents then meet the rows where
    they are.  Opponents may be inactive.

    Pairs outnumber the rows that they are made from, and rows the bytes that
    they are shuffled in, so tasks that are cut by the bytes they read would
    hold millions.  Rows are counted, and where they are many a task pairs some
    ``rows_per_task`` of them, whatever their number.  Teams meet their rows in
    as many tasks, up to the number of shuffle partitions: beyond, the tasks
    that the teams come from would hold them in memory to sort them by task.
    """
    session = participations.sparkSession
    tasks = math.ceil(participations.count() / rows_per_task)
    many = tasks > session.sparkContext.defaultParallelism  # up to there Spark makes as many

    def dealt(n: int, key: str, *sides: DataFrame) -> list[DataFrame]:
        return [side.repartition(n, key) if many else side for side in sides]

    sided = participations.where("team_id IS NOT NULL").select("match_id", "team_id", "entity_id")
    by_team = min(tasks, int(session.conf.get("spark.sql.shuffle.partitions")))
    ours, results = dealt(by_team, "team_id", _of_active(sided, entities), teams.select("team_id", "result"))
    theirs = sided.select("match_id", F.col("team_id").alias("other_team"), F.col("entity_id").alias("opponent_id"))
    modes = matches.where("mode IS NOT NULL").select("match_id", "mode", "version")
    ours, modes, theirs = dealt(tasks, "match_id", ours.join(results, "team_id"), modes, theirs)
    return ours.join(modes, "match_id").join(theirs, "match_id").where("team_id <> other_team AND entity_id <> opponent_id")


def _matchups(pairs: DataFrame, *keys: str) -> DataFrame:
    stats = pairs.groupBy("entity_id", "opponent_id", *keys).agg(*outcomes()[:3])
    return stats.withColumn("win_rate", scalars.win_rate(F.col("wins"), F.col("losses")))


def matchup_aggregate(participations: DataFrame, matches: DataFrame, teams: DataFrame, entities: DataFrame) -> DataFrame:
    """By entity, opponent on another team, mode and version."""
    return _matchups(matchup_pairs(participations, matches, teams, entities), "mode", "version")


def pooled_aggregate(participations: DataFrame, matches: DataFrame, teams: DataFrame, entities: DataFrame) -> DataFrame:
    """Matchups over all modes and versions, counted from the pairs, without a row for each mode and version."""
    return _matchups(matchup_pairs(participations, matches, teams, entities))


def pooled_matchups(matchups: DataFrame) -> DataFrame:
    """Stored matchups over all modes and versions."""
    stats = matchups.groupBy("entity_id", "opponent_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matches", "wins", "losses")]
    )
    return stats.withColumn("win_rate", scalars.win_rate(F.col("wins"), F.col("losses")))


def run_counts(**outputs: DataFrame) -> DataFrame:
    """Rows of each output of a run, and how many fail to reconcile."""
    counted = None
    for scope, rows in outputs.items():
        draws = F.col("draws") if "draws" in rows.columns else F.lit(0)
        bad = ~scalars.reconciles(F.col("matches"), F.col("wins"), F.col("losses"), draws)
        one = rows.agg(F.lit(scope).alias("scope"), F.count("*").alias("rows"), F.count_if(bad).alias("unreconciled"))
        counted = one if counted is None else counted.union(one)
    return counted


def run(participations: DataFrame, matches: DataFrame, teams: DataFrame, entities: DataFrame, path: str) -> DataFrame:
    """A whole aggregation run: three outputs below ``path``, then their counts as read back."""
    facts = participation_facts(participations, matches, teams)
    outputs = {
        "per_mode": mode_aggregate(facts, entities), "overall": overall_aggregate(facts, entities),
        "matchup": matchup_aggregate(participations, matches, teams, entities),
    }
    for scope, rows in outputs.items():
        rows.write.mode("overwrite").parquet(f"{path}/{scope}")
    return run_counts(**{scope: participations.sparkSession.read.parquet(f"{path}/{scope}") for scope in outputs})
