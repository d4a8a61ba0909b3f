"""Fair selection of work, crawl outcomes and rate budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import budgets

#: A scope's window in seconds, its ceiling, and what of it is kept for priority work.
BUDGETS = (
    ("global", 86400, 5000, 200), ("catalog", 86400, 50, 0), ("rankings", 86400, 300, 0),
    ("profile", 3600, 500, 0), ("log", 3600, 1000, 0), ("club", 86400, 200, 0),
)


def due(schedule: DataFrame, as_of: Column) -> DataFrame:
    """Active, due, not backing off and not leased."""
    return schedule.where(
        F.col("is_active") & (F.col("next_due") <= as_of)
        & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= as_of))
        & (F.col("leased_until").isNull() | (F.col("leased_until") < as_of))
    )


def fetch_limit(batch: Column, factor: int = 8, least: int = 200, most: int = 2000) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), batch * factor))


def fair_batch(candidates: DataFrame, stratum: list[Column], order: list[Column], size: int, strata_order: list[Column] | None = None) -> DataFrame:
    """Round-robin over strata: round k takes the k-th of each stratum.

    Numbering is within strata; the final order is a top-k, so no step sorts
    all candidates in one task.
    """
    keyed = candidates.withColumns({f"_s{i}": c for i, c in enumerate(stratum)})
    keys = [f"_s{i}" for i in range(len(stratum))]
    numbered = keyed.withColumn("round", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    taken = numbered.where(F.col("round") <= max(size, 0))
    chosen = taken.orderBy("round", *(strata_order or keys)).limit(max(size, 0))
    return chosen.drop(*keys)


def crawl_outcome(rows: DataFrame) -> DataFrame:
    """Next state of crawled players, before jitter.

    Columns: outcome (success, empty, failure, dead), failures, priority.
    """
    failed, fine = F.col("outcome") == "failure", F.col("outcome").isin("success", "empty")
    failures = F.when(fine, F.lit(0)).otherwise(F.col("failures") + 1)
    delay = (
        F.when(F.col("outcome") == "success", F.lit(120.0)).when(F.col("outcome") == "empty", F.lit(720.0))
        .when(failed, scalars.failure_delay_minutes(failures))
    )
    return rows.select(
        "*", failures.alias("next_failures"), delay.alias("delay_minutes"),
        scalars.priority_after(F.col("priority"), fine).alias("next_priority"), (F.col("outcome") != "dead").alias("stays_active"),
    )


def sticky_merge(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first value seen of each column stays."""
    ordered = F.struct(*order)
    return rows.groupBy(key).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(c) for c in columns
    ])


def refresh_merge(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The last known value of each column wins."""
    ordered = F.struct(*order)
    return rows.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(c) for c in columns
    ])


def unpromoted(observed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` players seen that are not promoted yet, oldest first, with their place in that order.

    Observed: id, promoted, first_observed_at, source, detail (JSON).  A club is
    named for members of clubs whose detail can be read; the choice is a top-k,
    so the place is numbered over ``limit`` rows only.
    """
    first = observed.where(~F.col("promoted")).orderBy("first_observed_at", "id").limit(limit)
    club = F.when(F.col("source") == "club_member", F.get_json_object("detail", "$.clubTag"))
    place = F.row_number().over(Window.orderBy("first_observed_at", "id"))
    return first.withColumn("place", place.cast("long")).withColumn("club_tag", club)


def rate_budget(requests: DataFrame, window_s: int, ceiling: int, reserve: int, order: list[str]) -> DataFrame:
    """Grant requests (scope, at, priority) within fixed windows of time, numbered by ``slot``.

    ``budgets.in_windows`` has windows that begin at a scope's first request.
    """
    slot = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / window_s)
    return budgets.grant(requests.withColumn("slot", slot), ["scope", "slot"], order, ceiling, reserve)


def budget_use(seeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Each budget with the requests of its scope and the most of them within one of its windows."""
    limits = F.broadcast(seeds.select("scope", "window_s"))  # a row a scope
    slot = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (F.col("window_s").cast("long") * 1_000_000))
    used = requests.join(limits, "scope").groupBy("scope", slot.alias("slot")).agg(F.count("*").alias("n"))
    sums = used.groupBy("scope").agg(F.max("n").alias("busiest"), F.sum("n").alias("requests"))
    return seeds.join(sums, "scope", "left").fillna(0, ["busiest", "requests"])


def seed_schedule(current: DataFrame, seeds: DataFrame) -> DataFrame:
    """The schedule after a seed refresh: a known region stays, the bracket follows the seed.

    Both: player, region, bracket.
    """
    new = seeds.select("player", F.col("region").alias("_region"), F.col("bracket").alias("_bracket"))
    return current.join(new, "player", "full_outer").select(
        "player", F.coalesce("region", "_region").alias("region"), F.coalesce("_bracket", "bracket").alias("bracket"))
