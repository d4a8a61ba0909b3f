"""Plans: aggregates, windows over participations, scores and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate, ranking
from ..sources.views import AS_OF, Views
from .base import query

RATE = "CASE WHEN {w} + {l} > 0 THEN round({w} / ({w} + {l}), 5) END"
DAYS = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(occurred_at)) / 86400.0"
WEIGHT = (
    f"CASE WHEN {DAYS} <= 30 THEN 1.0 WHEN {DAYS} <= 90 THEN 1.0 - ({DAYS} - 30) / 60.0 * 0.5 "
    f"WHEN {DAYS} <= 180 THEN 0.5 - ({DAYS} - 90) / 90.0 * 0.5 ELSE 0.0 END"
)


def rate(w: str = "wins", l: str = "losses") -> str:
    return RATE.format(w=w, l=l)


def facts(v: Views) -> DataFrame:
    return aggregate.participation_facts(v.participations, v.matches, v.teams)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def capped(v: Views) -> DataFrame:
    active = facts(v).join(v.entities.where("is_active").select("entity_id"), "entity_id", "left_semi")
    return ranking.cap_per_player(
        active, ["entity_id", "player_id"], "occurred_at", ["match_id", "line", "item", "price", "shipped_at"]
    ).join(v.players.select("player_id", "region", "bracket"), "player_id", "left")


def matchups(v: Views) -> DataFrame:
    return aggregate.matchup_aggregate(v.participations, v.matches, v.teams, v.entities)


def pooled(v: Views) -> DataFrame:
    return aggregate.pooled_aggregate(v.participations, v.matches, v.teams, v.entities)


def rounded(df: DataFrame, *columns: str, places: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("j1_participation_facts", "SELECT match_id, entity_id, line, item, team_id, player_id, occurred_at, mode, version, result FROM facts")
def j1(v):
    return facts(v).select("match_id", "entity_id", "line", "item", "team_id", "player_id", "occurred_at", "mode", "version", "result")


@query("g1_mode_aggregate", f"""
SELECT entity_id, mode, version, matches, wins, losses, draws, latest, {rate()} AS win_rate FROM mode_stats""")
def g1(v):
    return rounded(aggregate.mode_aggregate(facts(v), v.entities), "win_rate")


@query("g2_overall_aggregate", f"""
SELECT entity_id, version, matches, wins, losses, draws, mode_coverage, latest, {rate()} AS win_rate FROM (
  SELECT f.entity_id, f.version, count(*) AS matches, count(*) FILTER (WHERE result = 'victory') AS wins,
    count(*) FILTER (WHERE result = 'defeat') AS losses, count(*) FILTER (WHERE result = 'draw') AS draws,
    count(DISTINCT mode) AS mode_coverage, max(occurred_at) AS latest
  FROM facts f JOIN entities e ON f.entity_id = e.entity_id WHERE e.is_active GROUP BY f.entity_id, f.version)""")
def g2(v):
    return rounded(aggregate.overall_aggregate(facts(v), v.entities), "win_rate")


@query("g3_matchup_aggregate", f"SELECT *, {rate()} AS win_rate FROM pair_stats")
def g3(v):
    return rounded(matchups(v), "win_rate")


@query("j2_matchup_pairs", """
SELECT a.match_id, count(*) AS pairs FROM participations a JOIN participations b
ON a.match_id = b.match_id AND a.team_id <> b.team_id AND a.entity_id <> b.entity_id GROUP BY 1""")
def j2(v):
    a = v.participations.where("team_id IS NOT NULL").select("match_id", "team_id", "entity_id")
    b = a.select("match_id", F.col("team_id").alias("other_team"), F.col("entity_id").alias("other"))
    return a.join(b, "match_id").where("team_id <> other_team AND entity_id <> other").groupBy("match_id").agg(
        F.count("*").alias("pairs"))


@query("g4_rows_per_run", """
SELECT 'per_mode' AS scope, count(*) AS rows, 0 AS unreconciled FROM mode_stats
UNION ALL SELECT 'matchup', count(*), 0 FROM pair_stats""")
def g4(v):
    return aggregate.run_counts(per_mode=aggregate.mode_aggregate(facts(v), v.entities), matchup=matchups(v)).select(
        "scope", "rows", F.col("unreconciled").cast("int").alias("unreconciled"))


@query("g5_reconciliation_warnings", """
SELECT count(*) FILTER (WHERE wins < 0 OR losses < 0 OR draws < 0 OR wins + losses + draws > matches) AS warnings,
  count(*) AS rows FROM (SELECT p_partkey % 7 - 1 AS wins, p_size % 5 AS losses, p_partkey % 3 AS draws, p_size % 11 AS matches FROM part)""")
def g5(v):
    rows = v.table("part").selectExpr("p_partkey % 7 - 1 AS wins", "p_size % 5 AS losses", "p_partkey % 3 AS draws", "p_size % 11 AS matches")
    ok = scalars.reconciles(*map(F.col, ("matches", "wins", "losses", "draws")))
    return rows.agg(F.count_if(~ok).alias("warnings"), F.count("*").alias("rows"))


@query("p22_reconcile_violations", """
SELECT p_partkey AS id, wins, losses, draws, matches FROM (
  SELECT p_partkey, p_partkey % 7 - 1 AS wins, p_size % 5 AS losses, p_partkey % 3 AS draws, p_size % 11 AS matches FROM part)
WHERE wins < 0 OR losses < 0 OR draws < 0 OR wins + losses + draws > matches""")
def p22(v):
    rows = v.table("part").selectExpr(
        "p_partkey AS id", "p_partkey % 7 - 1 AS wins", "p_size % 5 AS losses", "p_partkey % 3 AS draws", "p_size % 11 AS matches")
    return rows.where(~scalars.reconciles(*map(F.col, ("matches", "wins", "losses", "draws"))))


@query("g6_pooled_matchups", f"""
SELECT *, {rate()} AS win_rate FROM (
  SELECT entity_id, opponent_id, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(wins) AS BIGINT) AS wins,
    CAST(sum(losses) AS BIGINT) AS losses FROM pair_stats GROUP BY 1, 2)""")
def g6(v):
    return rounded(pooled(v), "win_rate")


@query("g7_participation_slots", "SELECT count(*) AS slots FROM facts")
def g7(v):
    return facts(v).agg(F.count("*").alias("slots"))


@query("w1_player_cap", """
SELECT row_id, player_id, entity FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, player_id ORDER BY occurred_at DESC, row_id) AS place FROM cap_rows)
WHERE place <= 20""")
def w1(v):
    return ranking.cap_per_player(v.cap_rows, ["entity", "player_id"], "occurred_at", ["row_id"]).select("row_id", "player_id", "entity")


@query("g8_weighted_outcomes", f"""
SELECT entity_id, count(*) AS matches, round(sum(CASE WHEN result = 'victory' THEN {WEIGHT} ELSE 0.0 END), 4) AS weighted_wins,
  round(sum(CASE WHEN result = 'defeat' THEN {WEIGHT} ELSE 0.0 END), 4) AS weighted_losses FROM ranked GROUP BY 1""")
def g8(v):
    return rounded(ranking.weighted_outcomes(capped(v), ["entity_id"], as_of()), "weighted_wins", "weighted_losses", places=4)


BLENDED = f"""
SELECT {{keys}}, matches, current_rows,
  coalesce(cur * least(1.0, current_rows / 100.0) + al * (1.0 - least(1.0, current_rows / 100.0)), cur, al) AS rate_raw FROM (
  SELECT {{keys}}, count(*) AS matches, count(*) FILTER (WHERE version = 'O') AS current_rows,
    sum(CASE WHEN result = 'victory' THEN {WEIGHT} ELSE 0.0 END)
      / nullif(sum(CASE WHEN result IN ('victory', 'defeat') THEN {WEIGHT} ELSE 0.0 END), 0) AS al,
    sum(CASE WHEN result = 'victory' AND version = 'O' THEN {WEIGHT} ELSE 0.0 END)
      / nullif(sum(CASE WHEN result IN ('victory', 'defeat') AND version = 'O' THEN {WEIGHT} ELSE 0.0 END), 0) AS cur
  FROM ranked {{where}} GROUP BY {{keys}})"""


@query("g9_blended_win_rate", f"SELECT entity_id, matches, current_rows, round(rate_raw, 5) AS win_rate FROM ({BLENDED.format(keys='entity_id', where='')})")
def g9(v):
    return rounded(ranking.blended_rates(capped(v), ["entity_id"], as_of(), ranking.RuleSet()), "win_rate")


HIGH = f"""
SELECT entity_id, bracket AS high_bracket, w / nullif(w + l, 0) AS high_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ord DESC) AS place FROM (
    SELECT entity_id, bracket, count(*) AS n,
      CASE bracket WHEN '0-5k' THEN 1 WHEN '5k-15k' THEN 2 WHEN '15k-30k' THEN 3 WHEN '30k-50k' THEN 4 WHEN '50k-75k' THEN 5
        WHEN '75k+' THEN 6 ELSE 0 END AS ord,
      sum(CASE WHEN result = 'victory' THEN {WEIGHT} ELSE 0.0 END) AS w, sum(CASE WHEN result = 'defeat' THEN {WEIGHT} ELSE 0.0 END) AS l
    FROM ranked GROUP BY 1, 2) WHERE ord > 0 AND n >= 30) WHERE place = 1"""


@query("g10_high_rank_win_rate", f"SELECT entity_id, high_bracket, round(high_raw, 5) AS high_rate FROM ({HIGH})")
def g10(v):
    return rounded(ranking.high_rank_rates(capped(v), as_of()), "high_rate")


STRATA = f"""
SELECT entity_id, count(DISTINCT region) AS regions, count(DISTINCT CASE WHEN bracket <> 'unranked' THEN bracket END) AS brackets,
  bool_or({DAYS} <= 30) AS recent FROM ranked GROUP BY 1"""


@query("g11_strata_coverage", STRATA)
def g11(v):
    return ranking.strata_coverage(capped(v), as_of())


@query("g12_pick_denominators", "SELECT mode, CAST(sum(matches) AS BIGINT) AS total FROM mode_stats GROUP BY 1")
def g12(v):
    return aggregate.mode_aggregate(facts(v), v.entities).groupBy("mode").agg(F.sum("matches").alias("total"))


@query("w3_pick_rate", """
SELECT entity_id, mode, version, matches, round(matches / sum(matches) OVER (PARTITION BY mode), 5) AS pick_rate FROM mode_stats""")
def w3(v):
    rows = ranking.pick_rates(aggregate.mode_aggregate(facts(v), v.entities), ["mode"])
    return rounded(rows.select("entity_id", "mode", "version", "matches", "pick_rate"), "pick_rate")


@query("w2_percentile_tiers", """
SELECT entity_id, p AS percentile, CASE WHEN p >= 90 THEN 'S' WHEN p >= 70 THEN 'A' WHEN p >= 30 THEN 'B' WHEN p >= 10 THEN 'C' ELSE 'D' END AS tier
FROM (SELECT entity_id, cume_dist() OVER (ORDER BY balance) * 100 AS p FROM entities)""")
def w2(v):
    return ranking.percentile_tiers(v.entities, "balance").select("entity_id", "percentile", "tier")


CANDIDATES = f"""
SELECT entity_id, opponent_id, matches, {rate()} AS win_rate,
  CASE WHEN matches < 20 OR r IS NULL THEN NULL WHEN r <= 0.35 THEN 'hard_counter' WHEN r < 0.45 THEN 'counter'
    WHEN r <= 0.55 THEN 'neutral' WHEN r < 0.65 THEN 'strong' ELSE 'hard_advantage' END AS relationship,
  CASE WHEN matches < 20 THEN 'insufficient' WHEN matches < 40 THEN 'weak_signal' ELSE 'probable_counter' END AS confidence
FROM (SELECT *, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END AS r FROM (
  SELECT entity_id, opponent_id, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(wins) AS BIGINT) AS wins,
    CAST(sum(losses) AS BIGINT) AS losses FROM pair_stats GROUP BY 1, 2))"""


def candidates(v: Views) -> DataFrame:
    return ranking.matchup_candidates(pooled(v))


@query("r4_matchup_candidates", CANDIDATES)
def r4(v):
    return candidates(v)


@query("g13_matchup_coverage", f"""
SELECT entity_id, round(avg(CASE WHEN relationship IS NULL THEN 0 ELSE 1 END), 5) AS coverage FROM ({CANDIDATES}) GROUP BY 1""")
def g13(v):
    return rounded(ranking.matchup_coverage(candidates(v)), "coverage")


NATION_PAIRS = """SELECT entity_id, opponent_id, count(*) AS matches, count(*) FILTER (WHERE result = 'victory') AS wins, count(*) FILTER (WHERE result = 'defeat') AS losses FROM (
  SELECT x.nation AS entity_id, y.nation AS opponent_id, t.result FROM participations a JOIN participations b ON a.match_id = b.match_id AND a.team_id <> b.team_id
    JOIN matches m ON a.match_id = m.match_id JOIN teams t ON a.team_id = t.team_id JOIN catalog x ON a.entity_id = x.entity_id JOIN catalog y ON b.entity_id = y.entity_id
  WHERE m.mode IS NOT NULL AND x.nation <> y.nation) GROUP BY 1, 2"""


@query("p24_qualifying_matchups", f"""SELECT entity_id, opponent_id, matches, {rate()} AS win_rate,
  CASE WHEN r <= 0.35 THEN 'hard_counter' WHEN r < 0.45 THEN 'counter' WHEN r <= 0.55 THEN 'neutral' WHEN r < 0.65 THEN 'strong' ELSE 'hard_advantage' END AS relationship
FROM (SELECT *, wins / nullif(wins + losses, 0) AS r FROM ({NATION_PAIRS})) WHERE matches >= 40 AND r IS NOT NULL""")
def p24(v):
    """Pairs of nations, which meet often enough at every scale."""
    nations = v.catalog.select("entity_id", F.col("nation").cast("long").alias("nation"))
    rows = v.participations.join(nations, "entity_id").drop("entity_id").withColumnRenamed("nation", "entity_id")
    entities = nations.select(F.col("nation").alias("entity_id"), F.lit(True).alias("is_active")).distinct()
    stats = aggregate.pooled_aggregate(rows, v.matches, v.teams, entities)
    return ranking.qualifying_matchups(ranking.matchup_candidates(stats)).select("entity_id", "opponent_id", "matches", "win_rate", "relationship")


RANKED = f"""
SELECT *, cume_dist() OVER (ORDER BY raw_score) * 100 AS p FROM (
  SELECT b.entity_id, b.matches, b.regions, b.brackets, b.recent, b.rate, b.pick, b.high,
    (0.5 * rate + 0.2 * pick + 0.2 * coalesce(high, rate) + 0.1 * round(coalesce(c.coverage, 0.0), 5)) * 100 AS raw_score
  FROM (SELECT b.entity_id, b.matches, s.regions, s.brackets, s.recent, round(b.rate_raw, 5) AS rate, round(h.high_raw, 5) AS high,
      round(b.matches / sum(b.matches) OVER (), 5) AS pick
    FROM ({BLENDED.format(keys='entity_id', where='')}) b LEFT JOIN ({HIGH}) h ON b.entity_id = h.entity_id
    LEFT JOIN ({STRATA}) s ON b.entity_id = s.entity_id) b
  LEFT JOIN (SELECT entity_id, avg(CASE WHEN relationship IS NULL THEN 0 ELSE 1 END) AS coverage FROM ({CANDIDATES}) GROUP BY 1) c
    ON b.entity_id = c.entity_id
  WHERE b.matches >= 100 AND rate IS NOT NULL)"""
TIER = "CASE WHEN p >= 90 THEN 'S' WHEN p >= 70 THEN 'A' WHEN p >= 30 THEN 'B' WHEN p >= 10 THEN 'C' ELSE 'D' END"
GATE = "recent AND regions >= 2 AND brackets >= 2"


def overall_ranking(v: Views) -> DataFrame:
    return ranking.rank_entities(capped(v), candidates(v), as_of())


@query("r5_final_ranking", f"""
SELECT entity_id, matches, rate AS win_rate, pick AS pick_rate, high AS high_rate, CAST(round(CAST(raw_score AS DECIMAL(18, 10)), 2) AS DOUBLE) AS score, round(p, 4) AS percentile,
  {TIER} AS tier, CASE WHEN matches < 100 THEN 'insufficient' WHEN matches < 200 THEN 'low' WHEN matches >= 500 AND {GATE} THEN 'high'
    ELSE 'medium' END AS confidence FROM ({RANKED})""")
def r5(v):
    return overall_ranking(v)


@query("r3_mode_candidates", f"""
SELECT x.entity_id, mode, matches, rate AS win_rate, pick AS pick_rate, CAST(round(CAST(raw_score AS DECIMAL(18, 10)), 2) AS DOUBLE) AS score, {TIER} AS tier,
  CASE WHEN matches < 30 THEN 'insufficient' WHEN matches < 60 THEN 'low' WHEN matches >= 150 AND {GATE} THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT *, cume_dist() OVER (PARTITION BY mode ORDER BY raw_score) * 100 AS p FROM (
  SELECT *, (rate * 0.7 + pick * 0.3) * 100 AS raw_score FROM (
    SELECT entity_id, mode, matches, round(rate_raw, 5) AS rate, round(matches / sum(matches) OVER (PARTITION BY mode), 5) AS pick
    FROM ({BLENDED.format(keys='entity_id, mode', where='WHERE mode IS NOT NULL')}))
  WHERE matches >= 30 AND rate IS NOT NULL)) x LEFT JOIN ({STRATA}) s ON x.entity_id = s.entity_id""")
def r3(v):
    return ranking.rank_modes(capped(v), as_of())


PUBLISHED = """SELECT entity_id, CASE WHEN entity_id % 9 = 0 THEN 'D' ELSE 'B' END AS tier, 40.0 + entity_id % 5 AS score
FROM entities WHERE entity_id % 6 <> 0"""
NEW = """SELECT entity_id, CASE WHEN balance >= 6000 THEN 'A' ELSE 'B' END AS tier, round(40.0 + balance / 10000, 2) AS score FROM entities"""


def published(v: Views) -> DataFrame:
    return v.entities.where("entity_id % 6 <> 0").selectExpr(
        "entity_id", "CASE WHEN entity_id % 9 = 0 THEN 'D' ELSE 'B' END AS tier", "40.0D + entity_id % 5 AS score")


def new_ranking(v: Views) -> DataFrame:
    return v.entities.selectExpr(
        "entity_id", "CASE WHEN balance >= 6000 THEN 'A' ELSE 'B' END AS tier", "round(40.0D + balance / 10000, 2) AS score")


@query("j19_tier_comparison", f"""
SELECT n.entity_id, n.tier, n.score, o.tier AS old_tier, CAST(o.score AS DOUBLE) AS old_score
FROM ({NEW}) n LEFT JOIN ({PUBLISHED}) o ON n.entity_id = o.entity_id""")
def j19(v):
    return ranking.compare_tiers(new_ranking(v), published(v))


MOVES = f"""SELECT count(*) AS entities, count(*) FILTER (WHERE o.tier IS NOT NULL AND o.tier <> n.tier) AS moved,
  bool_or(o.tier IS NULL OR o.tier <> n.tier OR abs(n.score - o.score) > 1.0) AS changed
FROM ({NEW}) n LEFT JOIN ({PUBLISHED}) o ON n.entity_id = o.entity_id"""


@query("g14_tier_move_ratio", f"SELECT round(moved / entities, 5) AS move_ratio FROM ({MOVES})")
def g14(v):
    return ranking.publication_gate(new_ranking(v), published(v)).select("move_ratio")


@query("c6_publication_gate", f"""
SELECT entities, moved, round(moved / entities, 5) AS move_ratio, changed,
  CASE WHEN moved / entities > 0.25 THEN 'held' WHEN changed THEN 'publish' ELSE 'no_change' END AS outcome FROM ({MOVES})""")
def c6(v):
    return ranking.publication_gate(new_ranking(v), published(v))
