"""What may be archived or removed, and why not.

Planners only return rows; nothing is deleted in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCEEDED = ("succeeded", "succeeded_with_warnings")
ACTIVE = ("queued", "running", "held", "retrying")


def workflow_triples(runs: DataFrame, scopes: tuple = (0, 1, 2)) -> DataFrame:
    """Per workflow: latest start, whether all runs succeeded, whether all scopes exist."""
    return runs.groupBy("workflow_id").agg(
        F.max("started_at").alias("latest"), F.bool_and(F.col("status").isin(*SUCCEEDED)).alias("succeeded"),
        (F.size(F.array_intersect(F.collect_set("scope"), F.array(*map(F.lit, scopes)))) == len(scopes)).alias("complete"),
    )


def hot_workflows(runs: DataFrame, keep: int = 3) -> DataFrame:
    """The newest complete and successful workflows."""
    return workflow_triples(runs).where("succeeded AND complete").orderBy(F.desc("latest"), "workflow_id").limit(keep).select("workflow_id")


def latest_triple(runs: DataFrame) -> DataFrame:
    """The newest successful workflow, null unless its triple is complete: no older one takes its place."""
    newest = workflow_triples(runs).where("succeeded").orderBy(F.desc("latest"), "workflow_id").limit(1)
    return newest.select(F.when(F.col("complete"), F.col("workflow_id")).alias("workflow_id"), "complete")


def first_reason(*conditions: tuple[str, Column]) -> Column:
    """The first reason that applies, or null."""
    return F.coalesce(*[F.when(c, reason) for reason, c in conditions])


def all_reasons(*conditions: tuple[str, Column]) -> Column:
    """All reasons that apply, in order."""
    return F.array_compact(F.array(*[F.when(c, reason) for reason, c in conditions]))


def _flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    marked = keys.select(F.col(keys.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def run_eligibility(runs: DataFrame, referenced: DataFrame, published: DataFrame, active_workflows: DataFrame, holds: DataFrame, keep: int = 3) -> DataFrame:
    """Each aggregation run with every reason that keeps it."""
    df = _flag(runs, hot_workflows(runs, keep), "workflow_id", "_hot")
    for keys, key, name in ((referenced, "run_id", "_ref"), (published, "run_id", "_pub"), (active_workflows, "workflow_id", "_act"), (holds, "run_id", "_hold")):
        df = _flag(df, keys, key, name)
    reasons = all_reasons(
        ("not_succeeded", ~F.col("status").isin(*SUCCEEDED)), ("hot_recent_triple", F.col("_hot")),
        ("referenced_by_ranking_run", F.col("_ref")), ("referenced_by_published_snapshot", F.col("_pub")),
        ("workflow_non_terminal", F.col("_act")), ("retention_hold", F.col("_hold")),
    )
    return df.select("run_id", "workflow_id", "status", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def ranking_eligibility(runs: DataFrame, published: DataFrame, holds: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Each ranking run with every reason that keeps it; the newest success always stays."""
    newest = runs.where("status = 'succeeded'").agg(F.max("started_at").alias("_newest"))
    df = _flag(_flag(runs.crossJoin(F.broadcast(newest)), published, "run_id", "_pub"), holds, "run_id", "_hold")
    reasons = all_reasons(
        ("not_succeeded", F.col("status") != "succeeded"),
        ("current_held_or_published", (F.col("status") == "held") | F.col("_pub")
         | ((F.col("status") == "succeeded") & (F.col("started_at") == F.col("_newest")))),
        ("within_90_day_window", F.col("started_at") >= as_of - F.make_interval(days=F.lit(days))),
        ("retention_hold", F.col("_hold")),
    )
    return df.select("run_id", "status", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def payload_removal(rows: DataFrame, as_of: Column, grace_days: int = 7) -> DataFrame:
    """Each payload with the first reason that it stays (null: may go)."""
    if grace_days < 7:
        raise ValueError("the grace period is seven days at least")
    reason = first_reason(
        ("payload_already_removed", F.col("removed_at").isNotNull()), ("no_archive", F.col("archive_id").isNull()),
        ("archive_not_verified", ~F.col("archive_status").eqNullSafe("verified")),
        ("archive_incomplete", F.col("verified_at").isNull() | F.col("object_checksum").isNull()),
        ("within_grace_period", F.col("verified_at") > as_of - F.make_interval(days=F.lit(grace_days))),
    )
    return rows.withColumn("reason", reason)


def existence_flags(rows: DataFrame, key: str, users: list[tuple[str, DataFrame]]) -> DataFrame:
    """A boolean per table that uses the key, and the first that does."""
    for name, keys in users:
        rows = _flag(rows, keys, key, name)
    return rows.withColumn("blocked_by", first_reason(*[(n, F.col(n)) for n, _ in users]))


def unreferenced(rows: DataFrame, key: str, users: list[DataFrame]) -> DataFrame:
    """Rows that no table uses: a chain of anti-joins."""
    for keys in users:
        rows = rows.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")
    return rows


def archive_key(received_at: Column, category: Column, run: Column, ident: Column, checksum: Column) -> Column:
    return F.concat_ws(
        "/", F.lit("raw/v1"), F.date_format(received_at, "yyyy/MM/dd"), category, run,
        F.concat(ident, F.lit("-"), F.substring(checksum, 1, 16), F.lit(".json.gz")))


def archive_manifest(rows: DataFrame, group: Column, ident: str, at: str) -> DataFrame:
    """Count, bounds and an order-free checksum of each archived set.

    Row digests are summed, so a set of any size folds in parallel.
    """
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns])), 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy(group.alias("family")).agg(
        F.count("*").alias("rows"), F.min(ident).alias("min_id"), F.max(ident).alias("max_id"), F.min(at).alias("first_at"),
        F.max(at).alias("last_at"), F.sum(digest).alias("digest"))


def trend_rollup(rows: DataFrame, keys: list[str], run: str) -> DataFrame:
    """One row per natural key: that of the latest run."""
    w = Window.partitionBy(*keys).orderBy(F.desc(run))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scoped_deletion(children: DataFrame, key: str, allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, counts per allowed key before and after); keys not listed are never touched."""
    ids = allowlist.select(key).distinct()
    kept = children.join(ids, key, "left_anti")
    before = children.join(ids, key, "left_semi").groupBy(key).agg(F.count("*").alias("before"))
    after = kept.join(ids, key, "left_semi").groupBy(key).agg(F.count("*").alias("after"))
    return kept, ids.join(before, key, "left").join(after, key, "left").select(
        key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def exact_allowlist(ids: list[str]) -> list[str]:
    """Only ids, each once; patterns and words like ``all`` are refused."""
    bad = [i for i in ids if not i or "*" in i or "%" in i or i.lower() == "all"]
    if bad or not ids:
        raise ValueError(f"an allowlist holds plain ids only: {bad}")
    return sorted(set(ids))


def player_safeguard(players: DataFrame, participations: DataFrame) -> DataFrame:
    """Why a player stays; routine retention never removes one."""
    df = _flag(players, participations, "player_id", "_used")
    reasons = all_reasons(
        ("active_or_reachable", F.col("is_reachable")), ("participant_referenced", F.col("_used")),
        ("no_approved_merge_evidence", F.lit(True)))
    return df.select("player_id", F.lit(False).alias("deletable"), reasons.alias("reasons"))


def removed_payloads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after a sweep, manifest): payloads without a reason to stay become null."""
    goes = F.col("reason").isNull()
    swept = rows.withColumn("payload", F.when(~goes, F.col("payload")))
    manifest = rows.agg(F.count_if(goes).alias("removed"), F.count_if(~goes).alias("kept"),
                        F.coalesce(F.sum(F.when(goes, F.octet_length("payload"))), F.lit(0)).alias("bytes"))
    return swept, manifest


def lock_actions(locks: DataFrame, watermark: Column, ttl_s: Column, ttls: Column) -> DataFrame:
    """What becomes of locks whose ``locked_at`` is missing: repaired from the
    expiry where the time to live is certain, skipped where it is not, and an
    error where the lock is still live."""
    missing = F.col("locked_at").isNull()
    action = (
        F.when(~missing, "copy").when(F.col("expires_at") > watermark, "error").when(ttls == 1, "repair").otherwise("skip"))
    fixed = F.when(action == "repair", F.col("expires_at") - F.make_interval(secs=ttl_s)).otherwise(F.col("locked_at"))
    return locks.withColumn("action", action).withColumn("locked_at", fixed)
