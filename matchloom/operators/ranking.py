"""Scores, tiers and publication decisions from capped participations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.shared import shared_path
from .ordered import shares_at_or_below


@dataclass(frozen=True)
class RuleSet:
    """All parameters of a ranking run, with the production defaults."""

    cap: int = 20
    overall_floor: int = 100
    mode_floor: int = 30
    high_floor: int = 30
    recent_days: float = 30
    active_version: str = "O"
    guard: float = 0.25
    significance: float = 1.0


def cap_per_player(rows: DataFrame, keys: list[str], latest: str, ties: list[str], cap: int = 20) -> DataFrame:
    """The latest ``cap`` rows of each group; ``ties`` make the order total."""
    w = Window.partitionBy(*keys).orderBy(F.desc(latest), *ties)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= cap).drop("_place")


def _weight(as_of: Column) -> Column:
    return scalars.recency_weight(scalars.days_between(F.col("occurred_at"), as_of))


def weighted_outcomes(capped: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Recency-weighted wins and losses beside plain match counts."""
    w = _weight(as_of)
    return capped.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        F.sum(F.when(F.col("result") == "victory", w).otherwise(0.0)).alias("weighted_wins"),
        F.sum(F.when(F.col("result") == "defeat", w).otherwise(0.0)).alias("weighted_losses"),
    )


def _rate(wins: Column, losses: Column) -> Column:
    return F.try_divide(wins, F.nullif(wins + losses, F.lit(0.0)))


def blended_rates(capped: DataFrame, keys: list[str], as_of: Column, rules: RuleSet) -> DataFrame:
    """Win rates over all versions and the active one, blended by its sample."""
    w, current = _weight(as_of), F.col("version") == rules.active_version
    won, lost = F.col("result") == "victory", F.col("result") == "defeat"
    sums = capped.groupBy(*keys).agg(
        F.count("*").alias("matches"), F.count_if(current).alias("current_rows"),
        *[F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in
          (("all_w", won), ("all_l", lost), ("cur_w", won & current), ("cur_l", lost & current))],
    )
    blended = scalars.blend(
        _rate(F.col("cur_w"), F.col("cur_l")), _rate(F.col("all_w"), F.col("all_l")),
        scalars.version_blend_weight(F.col("current_rows")),
    )
    return sums.select(*keys, "matches", "current_rows", blended.alias("win_rate"))


def high_rank_rates(capped: DataFrame, as_of: Column, floor: int = 30) -> DataFrame:
    """The rate within the highest bracket that has the floor's sample.

    The choice of bracket comes first: if its rate is null, so is the result.
    """
    names = [name for _, name in scalars.BRACKETS]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("bracket"))
    by = weighted_outcomes(capped.where(order > 0), ["entity_id", "bracket"], as_of).where(F.col("matches") >= floor)
    best = by.groupBy("entity_id").agg(
        F.max_by(F.struct("bracket", "weighted_wins", "weighted_losses"), order).alias("top")
    )
    return best.select(
        "entity_id", F.col("top.bracket").alias("high_bracket"),
        _rate(F.col("top.weighted_wins"), F.col("top.weighted_losses")).alias("high_rate"),
    )


def strata_coverage(capped: DataFrame, as_of: Column, recent_days: float = 30) -> DataFrame:
    ranked = F.when(F.col("bracket") != scalars.UNRANKED, F.col("bracket"))
    recent = scalars.days_between(F.col("occurred_at"), as_of) <= recent_days
    return capped.groupBy("entity_id").agg(
        F.count_distinct("region").alias("regions"), F.count_distinct(ranked).alias("brackets"),
        F.bool_or(recent).alias("recent"),
    )


def pick_rates(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Share of its scope's matches, over all rows of the scope."""
    totals = rows.groupBy(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)]).agg(F.sum("matches").alias("_total"))
    on = F.lit(True)
    for i, c in enumerate(scope):
        on &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    # one row without a scope
    both = rows.join(totals, on) if scope else rows.crossJoin(F.broadcast(totals))
    share = F.try_divide(F.col("matches").cast("double"), F.nullif(F.col("_total"), F.lit(0)))
    return both.select(*rows.columns, share.alias("pick_rate"))


def percentile_tiers(rows: DataFrame, score: str, scope: list[str] | None = None) -> DataFrame:
    """Tiers by the share of scores at or below; equal scores share a tier."""
    # the quotient first, then times 100, as the cutoffs are compared in this form
    percentile = F.col("_share") * 100
    shared = shares_at_or_below(rows, score, scope or [], "_share")
    return shared.withColumn("percentile", percentile).withColumn("tier", scalars.tier(F.col("percentile"))).drop("_share")


def matchup_candidates(pooled: DataFrame) -> DataFrame:
    matches = F.col("matches")
    return pooled.select(
        "entity_id", "opponent_id", "matches", F.round("win_rate", 5).alias("win_rate"),
        scalars.matchup_class(F.col("win_rate"), matches).alias("relationship"),
        scalars.matchup_confidence(matches, F.lit(False)).alias("confidence"),
    )


def matchup_coverage(candidates: DataFrame) -> DataFrame:
    """Share of an entity's pairs that can be classed."""
    return candidates.groupBy("entity_id").agg(F.avg(F.col("relationship").isNotNull().cast("int")).alias("coverage"))


def qualifying_matchups(candidates: DataFrame) -> DataFrame:
    return candidates.where(
        F.col("relationship").isNotNull() & F.col("win_rate").isNotNull()
        & F.col("confidence").isin("probable_counter", "high_confidence_counter")
    )


def _kept(rows: DataFrame) -> DataFrame:
    """Few rows made from many, written to the shared folder as they are read more than once."""
    path = shared_path(rows.sparkSession, "ranking")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _stored_score(raw: Column) -> Column:
    """Two decimals as a decimal column would keep them: ties go up, binary noise below 1e-10 aside."""
    return F.round(raw.cast("decimal(18,10)"), 2).cast("double")


def _rates(w: Column) -> tuple[list[Column], Column]:
    """Sums of one pass over capped rows, and the blended rate that they give."""
    won, lost = F.col("result") == "victory", F.col("result") == "defeat"
    current = F.col("_current")
    sums = [F.count("*").alias("matches"), F.count_if(current).alias("current_rows"), *[
        F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in
        (("_all_w", won), ("_all_l", lost), ("_cur_w", won & current), ("_cur_l", lost & current))]]
    blended = scalars.blend(
        _rate(F.col("_cur_w"), F.col("_cur_l")), _rate(F.col("_all_w"), F.col("_all_l")), scalars.version_blend_weight(F.col("current_rows")))
    return sums, blended


def _strata(as_of: Column, recent_days: float) -> list[Column]:
    """Mergeable states of strata: the few regions as a set, brackets as bits, whether any row is recent."""
    recent = scalars.days_between(F.col("occurred_at"), as_of) <= recent_days
    return [
        F.collect_set("region").alias("_regions"), F.bit_or(F.when(F.col("_order") > 0, F.expr("shiftleft(1, _order - 1)"))).alias("_brackets"),
        F.bool_or(recent).alias("recent"),
    ]


def _prepared(capped: DataFrame, rules: RuleSet) -> DataFrame:
    names = F.array(*[F.lit(name) for _, name in scalars.BRACKETS])
    return capped.withColumns({
        "_current": F.col("version") == rules.active_version, "_order": F.array_position(names, F.col("bracket")).cast("int")})


def entity_inputs(capped: DataFrame, as_of: Column, rules: RuleSet = RuleSet()) -> DataFrame:
    """All that an entity's ranking takes from capped rows, in one pass and one exchange.

    (entity_id, matches, current_rows, win_rate, high_bracket, high_rate, regions, brackets, recent)
    """
    w = _weight(as_of)
    sums, blended = _rates(w)
    names = [name for _, name in scalars.BRACKETS]
    by_bracket = []
    for i in range(1, len(names) + 1):
        here = F.col("_order") == i
        by_bracket += [
            F.count_if(here).alias(f"_n{i}"), F.sum(F.when(here & (F.col("result") == "victory"), w).otherwise(0.0)).alias(f"_w{i}"),
            F.sum(F.when(here & (F.col("result") == "defeat"), w).otherwise(0.0)).alias(f"_l{i}")]
    one = _prepared(capped, rules).groupBy("entity_id").agg(*sums, *by_bracket, *_strata(as_of, rules.recent_days))
    high = F.when(F.lit(False), F.struct(F.lit("").alias("bracket"), F.lit(0.0).alias("rate")))
    for i in range(len(names), 0, -1):  # the highest with the floor's sample, even if its rate is null
        high = high.when(F.col(f"_n{i}") >= rules.high_floor, F.struct(F.lit(names[i - 1]).alias("bracket"), _rate(F.col(f"_w{i}"), F.col(f"_l{i}")).alias("rate")))
    return one.withColumn("_high", high).select(
        "entity_id", "matches", "current_rows", blended.alias("win_rate"), F.col("_high.bracket").alias("high_bracket"), F.col("_high.rate").alias("high_rate"),
        F.size("_regions").cast("long").alias("regions"), F.bit_count(F.coalesce("_brackets", F.lit(0))).cast("long").alias("brackets"), "recent")


def mode_inputs(capped: DataFrame, as_of: Column, rules: RuleSet = RuleSet()) -> DataFrame:
    """(entity_id, mode, matches, current_rows, win_rate, regions, brackets, recent) in one pass.

    Rates are those of the mode, strata those of the entity over all its modes:
    the states of its few modes are merged.
    """
    sums, blended = _rates(_weight(as_of))
    one = _prepared(capped, rules).groupBy("entity_id", "mode").agg(*sums, *_strata(as_of, rules.recent_days))
    whole = Window.partitionBy("entity_id")  # a row for each mode
    merged = one.select(
        "entity_id", "mode", "matches", "current_rows", blended.alias("win_rate"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_regions").over(whole)))).cast("long").alias("regions"),
        F.bit_count(F.coalesce(F.bit_or("_brackets").over(whole), F.lit(0))).cast("long").alias("brackets"), F.bool_or("recent").over(whole).alias("recent"))
    return merged.where("mode IS NOT NULL")


def rank_entities(capped: DataFrame, candidates: DataFrame, as_of: Column, rules: RuleSet = RuleSet()) -> DataFrame:
    """The overall ranking: rates rounded as they are stored, tiers unrounded."""
    rows = entity_inputs(capped, as_of, rules).join(matchup_coverage(candidates), "entity_id", "left")
    rows = _kept(rows)  # totals and tiers read it again
    rows = pick_rates(rows, []).select(
        "*", F.round("win_rate", 5).alias("rate"), F.round("high_rate", 5).alias("high"),
        F.round("pick_rate", 5).alias("pick"), F.coalesce("coverage", F.lit(0.0)).alias("covered"),
    )
    eligible = rows.where((F.col("matches") >= rules.overall_floor) & F.col("rate").isNotNull())
    scored = eligible.withColumn(
        "raw_score", scalars.overall_score(F.col("rate"), F.col("pick"), F.col("high"), F.round("covered", 5))
    )
    gate = scalars.high_gate(F.coalesce("recent", F.lit(False)), F.col("regions"), F.col("brackets"))
    return percentile_tiers(scored, "raw_score").select(
        "entity_id", "matches", F.col("rate").alias("win_rate"), F.col("pick").alias("pick_rate"),
        F.col("high").alias("high_rate"), _stored_score(F.col("raw_score")).alias("score"), F.round("percentile", 4).alias("percentile"),
        "tier", scalars.confidence(F.col("matches"), gate).alias("confidence"),
    )


def rank_modes(capped: DataFrame, as_of: Column, rules: RuleSet = RuleSet()) -> DataFrame:
    """The ranking within each mode; confidence takes the entity's own gates."""
    rows = _kept(mode_inputs(capped, as_of, rules))
    rows = pick_rates(rows, ["mode"]).select(
        "*", F.round("win_rate", 5).alias("rate"), F.round("pick_rate", 5).alias("pick")
    )
    scored = rows.where((F.col("matches") >= rules.mode_floor) & F.col("rate").isNotNull()).withColumn(
        "raw_score", scalars.mode_score(F.col("rate"), F.col("pick"))
    )
    gate = scalars.high_gate(F.coalesce("recent", F.lit(False)), F.col("regions"), F.col("brackets"))
    return percentile_tiers(scored, "raw_score", ["mode"]).select(
        "entity_id", "mode", "matches", F.col("rate").alias("win_rate"), F.col("pick").alias("pick_rate"),
        _stored_score(F.col("raw_score")).alias("score"), "tier",
        scalars.confidence(F.col("matches"), gate, (30, 60, 150)).alias("confidence"),
    )


def rule_reach(facts: DataFrame, rules: RuleSet) -> DataFrame:
    """(name, value, groups): how many groups each floor lets pass, and how many the cap cuts."""
    def one(name: str, rows: DataFrame, keys: list[str], over: bool) -> DataFrame:
        value = getattr(rules, name)
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        reached = F.col("n") > value if over else F.col("n") >= value
        return sizes.agg(F.lit(name).alias("name"), F.lit(float(value)).alias("value"), F.count_if(reached).alias("groups"))

    return one("cap", facts, ["entity_id", "player_id"], True).unionByName(one("overall_floor", facts, ["entity_id"], False)).unionByName(
        one("mode_floor", facts.where("mode IS NOT NULL"), ["entity_id", "mode"], False))


def compare_tiers(new: DataFrame, current: DataFrame) -> DataFrame:
    """Each new row beside the published one of the same entity."""
    old = current.select("entity_id", F.col("tier").alias("old_tier"), F.col("score").alias("old_score"))
    return new.join(old, "entity_id", "left")


def publication_gate(new: DataFrame, current: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """One row: hold on mass movement, publish on a real change, else neither."""
    pair = compare_tiers(new, current)
    moved = F.col("old_tier").isNotNull() & (F.col("old_tier") != F.col("tier"))
    # the first run of all has nothing to move away from
    first = ~F.exists(F.collect_set(F.col("old_tier").isNotNull()), lambda x: x)
    change = F.col("old_tier").isNull() | moved | (F.abs(F.col("score") - F.col("old_score")) > rules.significance)
    sums = pair.agg(
        F.count("*").alias("entities"), F.count_if(moved).alias("moved"), first.alias("first_run"),
        F.coalesce(F.bool_or(change), F.lit(False)).alias("changed"),
    )
    ratio = F.coalesce(F.try_divide(F.col("moved").cast("double"), F.nullif("entities", F.lit(0))), F.lit(0.0))
    return sums.select(
        "entities", "moved", F.round(ratio, 5).alias("move_ratio"), "changed",
        F.when(~F.col("first_run") & (ratio > rules.guard), "held").when(F.col("changed"), "publish")
        .otherwise("no_change").alias("outcome"),
    )
