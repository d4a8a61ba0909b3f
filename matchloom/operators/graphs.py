"""Graphs of rows that leave the hot store: who may go and why not, what goes along, and proof of the copy.

A family has anchors and rows of other tables that hang on them, over several
levels.  ``plan`` gives every anchor that is old enough one outcome: that it may
go, or the first reason that keeps it.  ``closure`` follows the anchors down to
all rows that go with them.  ``store`` writes both and a manifest made from the
source rows on their way; ``prove`` reads the copy back, twice, and compares.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import digests
from .archive import FAMILIES
from .reports import union_all
from .retention import first_reason

#: The order in which references to a fetch are named.
FETCH_REFERENCES = (
    "raw_snapshot", "battle_observation", "normalized_battle", "canonical_brawler", "normalized_player", "normalized_club",
    "data_incident", "retry_chain",
)
#: States of a run that has not ended.
ACTIVE = ("running", "queued", "retrying")
PROMOTED_DAYS = 30


def _before(at: Column, as_of: Column, days: int) -> Column:
    return at < as_of - F.make_interval(days=F.lit(days))


def _flagged(rows: DataFrame, key: str, references: dict[str, DataFrame]) -> DataFrame:
    """A boolean ``_ref_<name>`` for each reference: whether the key is among its ids."""
    for name, ids in references.items():
        marked = ids.select(F.col(ids.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct().withColumn(f"_ref_{name}", F.lit(True))
        rows = rows.join(marked, rows[key] == F.col("_id"), "left").drop("_id")
        rows = rows.withColumn(f"_ref_{name}", F.coalesce(f"_ref_{name}", F.lit(False)))
    return rows


def _reasons(family: str, as_of: Column, references: dict[str, DataFrame]) -> list[tuple[str, Column]]:
    """Why an anchor that is old enough stays, the first that holds."""
    ref = lambda name: F.col(f"_ref_{name}")
    if family == "workflow_audit":
        spec = FAMILIES[family]
        return [
            ("active_or_retryable", F.col("status").isin(*ACTIVE)), ("referenced_by_fetch", ref("fetch")),
            ("referenced_by_active_lock", ref("active_lock")),
            ("within_extended_retention", F.col("status").isin(*spec.extended) & ~_before(F.col(spec.at), as_of, spec.extended_days)),
        ]
    if family == "fetch_audit":
        return [(f"referenced_by_{name}", ref(name)) for name in FETCH_REFERENCES if name in references]
    if family == "observed_players":
        promoted = F.coalesce(F.col("promoted"), F.lit(False))
        hot = lambda at, days: ~F.coalesce(_before(at, as_of, days), F.lit(False))
        return [
            ("active_crawl_dependency", ref("active_crawl")), ("promoted_without_proof", promoted & F.col("promoted_at").isNull()),
            ("within_promoted_hot", promoted & hot(F.col("promoted_at"), PROMOTED_DAYS)),
            ("within_unpromoted_hot", ~promoted & hot(F.col("first_observed_at"), FAMILIES[family].days)),
        ]
    if family == "detected_changes":
        return [("open_incident_dependency", ref("open_incident"))]
    return []


def plan(
    rows: DataFrame, family: str, as_of: Column, key: str = "id", references: dict[str, DataFrame] | None = None,
    hot_parents: tuple[DataFrame, str, str] | None = None,
) -> DataFrame:
    """(key, outcome, reason) for each anchor that the family looks at.

    outcome is archive_and_delete, archive or skip; reason is null but for skip.
    ``references`` are ids that point at anchors, by name; for detected_changes
    and observed_players they are keyed by the columns ``fetch_id`` and ``tag``.
    ``hot_parents`` (rows, key, time) is a second cutoff, for observations: only
    those of matches that are still hot leave by themselves, as the graph of a
    match takes its own along.  A null time is never old, but for a player that
    was never observed, who stays for that reason.
    """
    spec, references = FAMILIES[family], references or {}
    if family != "observed_players":  # its own cutoffs are reasons
        rows = rows.where(_before(F.col(spec.at), as_of, spec.days))
    if spec.only is not None:
        rows = rows.where(F.expr(spec.only))
    if hot_parents is not None:
        parents, parent_key, at = hot_parents
        hot = parents.where(~_before(F.col(at), as_of, FAMILIES["match_graph"].days)).select(F.col(parent_key).alias("_parent"))
        rows = rows.join(hot, rows[parent_key] == F.col("_parent"), "left_semi")
    by = {"detected_changes": "fetch_id", "observed_players": "tag"}.get(family, key)
    flagged = _flagged(rows, by, references)
    conditions = _reasons(family, as_of, references)
    reason = first_reason(*conditions) if conditions else F.lit(None).cast("string")
    goes = "archive" if spec.archive_only else "archive_and_delete"
    return flagged.withColumn("reason", reason).select(
        key, F.when(F.col("reason").isNull(), goes).otherwise("skip").alias("outcome"), "reason")


@dataclass(frozen=True)
class Child:
    """Rows of a table that hang on rows of another one: ``fk`` here is ``parent_key`` there."""

    table: str
    rows: DataFrame
    fk: str
    parent: str
    parent_key: str


def closure(anchor_table: str, anchors: DataFrame, children: list[Child]) -> dict[str, DataFrame]:
    """The rows of every table that go with the anchors, level by level; parents before children."""
    out = {anchor_table: anchors}
    for child in children:
        keys = out[child.parent].select(F.col(child.parent_key).alias("_up")).where("_up IS NOT NULL").distinct()
        more = child.rows.join(keys, child.rows[child.fk] == F.col("_up"), "left_semi")
        # a table can hang on two others: each row goes once
        out[child.table] = out[child.table].union(more).distinct() if child.table in out else more
    return out


def deletion_order(anchor_table: str, children: list[Child]) -> list[str]:
    """Tables from the deepest level up, so that no row loses its parent before it goes."""
    order = [anchor_table]
    for child in children:
        if child.table in order:
            order.remove(child.table)
        order.append(child.table)
    return order[::-1]


def store(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table below ``path``, and a manifest (table, rows, digest_1, digest_2) of the rows on their way there.

    The sums are taken of the source rows before the writer has them, in the
    same pass, so that no table is made twice.
    """
    spark, sums = next(iter(tables.values())).sparkSession, []
    for name, rows in tables.items():
        seen = Observation()
        rows.observe(seen, *digests.content_sums(rows.columns)).write.mode("overwrite").parquet(f"{path}/{name}")
        found = seen.get
        sums.append((name, found["rows"], found["digest_1"], found["digest_2"]))
    manifest = spark.createDataFrame(sums, "table string, rows long, digest_1 decimal(20,0), digest_2 decimal(20,0)")  # a row a table
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest.parquet")
    return spark.read.parquet(f"{path}/_manifest.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


#: What a proof says of each table of a copy.
PROOF = "copy string, pass int, table string, expected_rows long, rows long, reason string"


def prove(
    spark: SparkSession, expected: DataFrame, where: Callable[[str], str], anchor_table: str, anchor_keys: DataFrame, key: str,
    children: list[Child], passes: int = 2,
) -> DataFrame:
    """(pass, table, expected_rows, rows, reason) for each table of the manifest; null reasons prove it.

    Every pass reads all files again.  In order: the files are there, as many
    rows as the source had, the anchors are those planned, each child row's
    parent is in the archive, and the contents are alike by both digests, which
    tell a lost, a doubled and a changed row whatever the order of rows.
    """
    return prove_copies(spark, expected, {"": where}, anchor_table, anchor_keys, key, children, passes).drop("copy")


def prove_copies(
    spark: SparkSession, expected: DataFrame, copies: dict[str, Callable[[str], str]], anchor_table: str, anchor_keys: DataFrame, key: str,
    children: list[Child], passes: int = 2,
) -> DataFrame:
    """``prove`` for several copies by name, as rows of ``PROOF``.

    Each pass has jobs of its own: within one job Spark reads a file once for all
    plans that are equal, so a second pass there would see what the first one
    read.  In each pass copies that share the files of a table, and of the table
    it hangs on, share their check.
    """
    wanted = {r["table"]: r for r in expected.collect()}  # one row a table
    found = []
    for number in range(1, passes + 1):
        places = {copy: {n: where(n) for n in wanted} for copy, where in copies.items()}
        opened = {p: spark.read.parquet(p) for p in {p for at in places.values() for p in at.values()} if _exists(spark, p)}
        shared = {}  # what a check looks at, and the copies it is made for
        for copy, at in places.items():
            stored = {n: opened[p] for n, p in at.items() if p in opened}
            found += [(copy, number, n, want["rows"], None, "missing_child_table") for n, want in wanted.items() if n not in stored]
            for n in stored:
                files = (n, at[n], *[at[c.parent] for c in children if c.table == n and c.parent in stored])
                shared.setdefault(files, (stored, []))[1].append(copy)
        for table in wanted:  # by table, as the driver holds whole plans
            checks = [
                _checked(stored, n, wanted[n], anchor_table, anchor_keys, key, children).select(
                    F.explode(F.array(*map(F.lit, alike))).alias("copy"), F.lit(number).alias("pass"), F.lit(n).alias("table"), "expected_rows", "rows", "reason")
                for (n, *_), (stored, alike) in shared.items() if n == table]
            if checks:
                found += [tuple(r) for r in union_all(checks).collect()]  # one row a table and copy
    return spark.createDataFrame(found, PROOF)


def _checked(
    stored: dict[str, DataFrame], name: str, want: Row, anchor_table: str, anchor_keys: DataFrame, key: str, children: list[Child],
) -> DataFrame:
    """(expected_rows, rows, reason) of one table of a stored copy: one row."""
    rows = stored[name]
    checks = rows.agg(*digests.content_sums(rows.columns))
    wrong = F.lit("fk_closure_violation")
    if name == anchor_table:
        wrong = F.lit("anchor_set_mismatch")
        found, planned = (df.select(key).distinct() for df in (rows, anchor_keys))
        lost = found.withColumn("_f", F.lit(1)).join(planned.withColumn("_p", F.lit(1)), key, "full_outer").where("_f IS NULL OR _p IS NULL")
        checks = checks.crossJoin(F.broadcast(lost.agg(F.count("*").alias("_astray"))))  # one row
    else:
        for child in (c for c in children if c.table == name and c.parent in stored):
            parents = stored[child.parent].select(F.col(child.parent_key).alias("_up"))
            # rows of one parent mostly lie in one file, so few of them move
            named = rows.where(F.col(child.fk).isNotNull()).select(F.col(child.fk).alias("_fk")).distinct()
            orphans = named.join(parents, F.col("_fk") == F.col("_up"), "left_anti")
            checks = checks.crossJoin(F.broadcast(orphans.agg(F.count("*").alias("_astray"))))
            break
    if "_astray" not in checks.columns:
        checks = checks.withColumn("_astray", F.lit(0))
    same = (F.col("digest_1") == F.lit(want["digest_1"])) & (F.col("digest_2") == F.lit(want["digest_2"]))
    reason = first_reason(("row_count_mismatch", F.col("rows") != want["rows"]), ("astray", F.col("_astray") > 0), ("content_checksum_mismatch", ~same))
    return checks.select(
        F.lit(want["rows"]).cast("long").alias("expected_rows"), "rows", F.when(reason == "astray", wrong).otherwise(reason).alias("reason"))
