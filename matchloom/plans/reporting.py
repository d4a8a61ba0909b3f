"""Plans: joins, coverage and integrity reports, publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import publish, ranking, reports
from ..sources.views import AS_OF, EVENTS_AS_OF
from . import statistics as st
from .base import query


@query("j3_strata_lookup", """SELECT p.match_id, p.entity_id, p.line, p.item, p.price, t.result, pl.region, pl.bracket FROM participations p JOIN matches m ON p.match_id = m.match_id
LEFT JOIN teams t ON p.team_id = t.team_id LEFT JOIN players pl ON m.player_id = pl.player_id WHERE m.version = 'O'""")
def j3(v):
    rows = st.facts(v).where("version = 'O'").join(v.players.select("player_id", "region", "bracket"), "player_id", "left")
    return rows.select("match_id", "entity_id", "line", "item", "price", "result", "region", "bracket")


@query("j4_region_coverage", "SELECT region, count(DISTINCT match_id) AS n FROM matches m JOIN players p ON m.player_id = p.player_id GROUP BY 1")
def j4(v):
    return reports.counts_by(v.matches.join(v.players, "player_id"), F.col("region"), "region", "match_id")


@query("g18_matches_by_bracket", "SELECT bracket, count(DISTINCT match_id) AS n FROM matches m JOIN players p ON m.player_id = p.player_id GROUP BY 1")
def g18(v):
    return reports.counts_by(v.matches.join(v.players, "player_id"), F.col("bracket"), "bracket", "match_id")


@query("j5_mode_labels", "SELECT coalesce(mode, 'no mode') AS mode, count(*) AS n FROM matches GROUP BY 1")
def j5(v):
    labels = v.matches.where("mode IS NOT NULL").select(F.col("mode").alias("key"), F.col("mode").alias("label")).distinct()
    rows = v.matches.join(labels, F.col("mode") == F.col("key"), "left")
    return reports.counts_by(rows, F.coalesce("label", F.lit("no mode")), "mode")


@query("j9_published_labels", f"SELECT p.entity_id, e.name, p.tier, CAST(p.score AS DOUBLE) AS score FROM ({st.PUBLISHED}) p JOIN entities e ON p.entity_id = e.entity_id")
def j9(v):
    return publish.read_published(st.published(v), v.entities).select("entity_id", "name", "tier", "score")


@query("t1_published_order", f"SELECT entity_id, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, entity_id) AS place FROM ({st.PUBLISHED})")
def t1(v):
    # one row per published entity: the size of a catalog
    w = Window.orderBy(F.desc("score"), "entity_id")
    return st.published(v).select("entity_id", "score", F.row_number().over(w).alias("place"))


@query("g16_mode_tiers_json", """SELECT entity_id, '[' || string_agg('{"mode":"' || mode || '","tier":"' || tier || '"}', ',' ORDER BY mode) || ']' AS mode_tiers FROM (
  SELECT DISTINCT entity_id, mode, CASE WHEN entity_id % 2 = 0 THEN 'A' ELSE 'B' END AS tier FROM mode_stats) GROUP BY 1""")
def g16(v):
    modes = st.facts(v).join(v.entities.where("is_active").select("entity_id"), "entity_id").where("mode IS NOT NULL").select("entity_id", "mode").distinct()
    return publish.nested_mode_tiers(modes.withColumn("tier", F.when(F.col("entity_id") % 2 == 0, "A").otherwise("B")))


@query("g15_nested_matchups", f"""SELECT entity_id, coalesce(string_agg(CAST(opponent_id AS VARCHAR), ',' ORDER BY opponent_id) FILTER (WHERE relationship IN ('hard_counter', 'counter')), '') AS countered_by,
  coalesce(string_agg(CAST(opponent_id AS VARCHAR), ',' ORDER BY opponent_id) FILTER (WHERE relationship IN ('strong', 'hard_advantage')), '') AS strong_against FROM ({st.CANDIDATES}) GROUP BY 1""")
def g15(v):
    return publish.nested_matchups(st.candidates(v))


@query("s20_published_read", f"""SELECT p.entity_id, e.name, p.tier, CAST(p.score AS DOUBLE) AS score, count(c.opponent_id) AS matchups FROM ({st.PUBLISHED}) p JOIN entities e ON p.entity_id = e.entity_id
LEFT JOIN (SELECT * FROM ({st.CANDIDATES}) WHERE relationship IS NOT NULL AND confidence = 'probable_counter') c ON p.entity_id = c.entity_id GROUP BY 1, 2, 3, 4""")
def s20(v):
    counts = ranking.qualifying_matchups(st.candidates(v)).groupBy("entity_id").agg(F.count("*").alias("matchups"))
    items = st.published(v).join(counts, "entity_id", "left").withColumn("matchups", F.coalesce("matchups", F.lit(0)))
    return publish.read_published(items, v.entities).select("entity_id", "name", "tier", "score", "matchups")


@query("c7_supersede", "SELECT DISTINCT o_custkey AS snapshot_id, false AS is_current FROM orders UNION ALL SELECT -1, true")
def c7(v):
    old = v.table("orders").select(F.col("o_custkey").alias("snapshot_id")).distinct()
    return publish.supersede(old, F.lit(-1).cast("long"))


@query("c8_approval_checks", """SELECT run_id, step, ['is_held', 'not_published', 'hold_reason', 'inputs_succeeded', 'complete'][step + 1] AS check,
  CASE step WHEN 0 THEN run_id % 2 = 0 WHEN 1 THEN run_id % 3 <> 0 WHEN 2 THEN run_id % 5 = 0 WHEN 3 THEN run_id % 7 <> 0 ELSE run_id % 11 > 0 END AS passed
FROM (SELECT o_orderkey AS run_id, unnest([0, 1, 2, 3, 4]) AS step FROM orders)""")
def c8(v):
    runs = v.table("orders").selectExpr(
        "o_orderkey AS run_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'held' ELSE 'succeeded' END AS status", "o_orderkey % 3 = 0 AS published",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'mass_movement_guard' END AS hold_reason", "o_orderkey % 7 <> 0 AS inputs_succeeded", "o_orderkey % 11 AS rows")
    return publish.approval_checks(runs)


@query("j24_zero_filled_counts", "SELECT e.entity_id, count(p.match_id) AS n FROM entities e LEFT JOIN participations p ON e.entity_id = p.entity_id GROUP BY 1")
def j24(v):
    return reports.zero_filled(v.entities, v.participations, "entity_id")


@query("g17_dataset_coverage", """SELECT 'mode' AS metric, coalesce(mode, 'unknown') AS key, count(*) AS n FROM matches GROUP BY 2
UNION ALL SELECT 'region', coalesce(region, 'unknown'), count(*) FROM players GROUP BY 2 UNION ALL SELECT 'bracket', bracket, count(*) FROM players GROUP BY 2
UNION ALL SELECT 'region_bracket', coalesce(region, 'unknown') || '/' || bracket, count(*) FROM players GROUP BY 2""")
def g17(v):
    unknown = F.coalesce("region", F.lit("unknown"))
    parts = [
        ("mode", v.matches, F.coalesce("mode", F.lit("unknown"))), ("region", v.players, unknown), ("bracket", v.players, F.col("bracket")),
        ("region_bracket", v.players, F.concat(unknown, F.lit("/"), "bracket")),
    ]
    return reports.union_all([reports.counts_by(rows, key, "key").select(F.lit(name).alias("metric"), "key", "n") for name, rows, key in parts])


@query("t2_top_items", "SELECT item, count(*) AS n FROM participations GROUP BY 1 ORDER BY n DESC, item LIMIT 50")
def t2(v):
    return reports.counts_by(v.participations, F.col("item"), "item").orderBy(F.desc("n"), "item").limit(50)


@query("t3_latest_failed_runs", "SELECT run_id, started_at FROM runs WHERE status = 'failed' ORDER BY started_at DESC, run_id LIMIT 10")
def t3(v):
    return v.runs.where("status = 'failed'").orderBy(F.desc("started_at"), "run_id").limit(10).select("run_id", "started_at")


@query("t5_oldest_backlog", "SELECT run_id, started_at FROM runs WHERE status <> 'succeeded' ORDER BY started_at, run_id LIMIT 25")
def t5(v):
    return v.runs.where("status <> 'succeeded'").orderBy("started_at", "run_id").limit(25).select("run_id", "started_at")


@query("t6_keyset_page", "SELECT run_id FROM runs WHERE run_id > 100 ORDER BY run_id LIMIT 40")
def t6(v):
    return v.runs.where("run_id > 100").orderBy("run_id").limit(40).select("run_id")


@query("t7_bounded_delete_set", f"SELECT run_id FROM runs WHERE started_at < TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAY ORDER BY started_at, run_id LIMIT 30")
def t7(v):
    old = F.col("started_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 2000 DAYS")
    return v.runs.where(old).orderBy("started_at", "run_id").limit(30).select("run_id")


@query("g19_daily_counts", "SELECT CAST(occurred_at AS DATE) AS day, count(*) AS n FROM matches WHERE occurred_at >= TIMESTAMP '2001-07-02' GROUP BY 1")
def g19(v):
    return reports.counts_by(v.matches.where("occurred_at >= TIMESTAMP_NTZ '2001-07-02'"), F.to_date("occurred_at"), "day")


@query("g28_collection_curve", "SELECT CAST(observed_at AS DATE) AS day, count(*) AS n FROM observations WHERE observed_at >= TIMESTAMP '2024-01-17' GROUP BY 1")
def g28(v):
    return reports.counts_by(v.observations.where("observed_at >= TIMESTAMP_NTZ '2024-01-17'"), F.to_date("observed_at"), "day")


@query("g20_thin_entities", """SELECT count(*) FILTER (WHERE n = 0) AS none, count(*) FILTER (WHERE n < 30) AS thin, count(*) AS entities FROM (
  SELECT e.entity_id, count(p.match_id) AS n FROM entities e LEFT JOIN participations p ON e.entity_id = p.entity_id GROUP BY 1)""")
def g20(v):
    rows = reports.zero_filled(v.entities, v.participations, "entity_id")
    return rows.agg(F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") < 30).alias("thin"), F.count("*").alias("entities"))


@query("g21_fetch_rates", """SELECT round(avg(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END), 5) AS success, round(count(*) FILTER (WHERE kind = 'view') / count(*) FILTER (WHERE kind <> 'error'), 5) AS empty
FROM observations WHERE observed_at >= TIMESTAMP '2024-01-24'""")
def g21(v):
    fine, empty = F.count_if(F.col("kind") != "error"), F.count_if(F.col("kind") == "view")
    return v.observations.where("observed_at >= TIMESTAMP_NTZ '2024-01-24'").agg(
        F.round(F.try_divide(fine.cast("double"), F.count("*")), 5).alias("success"), F.round(F.try_divide(empty.cast("double"), fine), 5).alias("empty"))


@query("g22_dedup_rate", "SELECT round((count(*) - count(DISTINCT match_id)) / count(*), 5) AS dedup_rate FROM observations")
def g22(v):
    n, m = F.count("*"), F.count_distinct("match_id")
    return v.observations.agg(F.round(F.try_divide((n - m).cast("double"), n), 5).alias("dedup_rate"))


METRICS = "SELECT (SELECT count(*) FROM matches) AS matches, (SELECT count(DISTINCT region) FROM players) AS regions, (SELECT count(DISTINCT bracket) FROM players WHERE bracket <> 'unranked') AS brackets, (SELECT count(*) FROM players) AS players"


@query("g23_readiness_gates", f"""SELECT kind, gate, CAST(value AS DOUBLE) AS value, CAST(required AS DOUBLE) AS required, value >= required AS passed FROM (
  SELECT 'hard' AS kind, 'matches' AS gate, matches AS value, 5000 AS required FROM ({METRICS}) UNION ALL SELECT 'hard', 'regions', regions, 2 FROM ({METRICS})
  UNION ALL SELECT 'hard', 'brackets', brackets, 2 FROM ({METRICS}) UNION ALL SELECT 'hard', 'players', players, 500 FROM ({METRICS})
  UNION ALL SELECT 'preferred', 'matches', matches, 20000 FROM ({METRICS}) UNION ALL SELECT 'preferred', 'regions', regions, 5 FROM ({METRICS})
  UNION ALL SELECT 'preferred', 'brackets', brackets, 3 FROM ({METRICS}))""")
def g23(v):
    ranked = F.when(F.col("bracket") != "unranked", F.col("bracket"))
    metrics = v.matches.agg(F.count("*").alias("matches")).crossJoin(v.players.agg(
        F.count_distinct("region").alias("regions"), F.count_distinct(ranked).alias("brackets"), F.count("*").alias("players")))
    return reports.gates(metrics, {"matches": 5000, "regions": 2, "brackets": 2, "players": 500}, {"matches": 20000, "regions": 5, "brackets": 3})


@query("g24_ingestion_health", """SELECT workflow_id, arg_max(run_id, (started_at, run_id)) AS latest_run, arg_max(status, (started_at, run_id)) AS latest_status,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS runs FROM runs GROUP BY 1""")
def g24(v):
    latest = F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id"))
    rows = v.runs.groupBy("workflow_id").agg(latest.alias("l"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("runs"))
    return rows.select("workflow_id", F.col("l.run_id").alias("latest_run"), F.col("l.status").alias("latest_status"), "failed", "runs")


@query("g25_health_counts", f"""SELECT count(*) FILTER (WHERE observed_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 36 HOUR) AS recent, count(*) FILTER (WHERE kind = 'error') AS errors,
  count(DISTINCT fetch_id) AS sources, max(observed_at) AS newest FROM observations""")
def g25(v):
    since = F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 36 HOURS")
    return v.observations.agg(F.count_if(F.col("observed_at") >= since).alias("recent"), F.count_if(F.col("kind") == "error").alias("errors"),
                              F.count_distinct("fetch_id").alias("sources"), F.max("observed_at").alias("newest"))


@query("g27_growth_windows", f"""SELECT count(*) FILTER (WHERE ts >= t - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts >= t - INTERVAL 24 HOUR) AS last_day,
  count(*) FILTER (WHERE ts >= t - INTERVAL 7 DAY) AS last_week FROM (SELECT ts, TIMESTAMP '{EVENTS_AS_OF}' AS t FROM events)""")
def g27(v):
    return reports.growth_windows(v.table("events"), "ts", F.lit(EVENTS_AS_OF).cast("timestamp_ntz"))


@query("g29_freshness_bounds", "SELECT kind, min(observed_at) AS oldest, max(observed_at) AS newest FROM observations GROUP BY 1")
def g29(v):
    return v.observations.groupBy("kind").agg(F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))


@query("g30_dedup_proof", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM participations GROUP BY match_id, line)")
def g30(v):
    return reports.dedup_proof(v.participations, ["match_id", "line"])


@query("g31_child_ratios", """SELECT round((SELECT count(*) FROM participations) / (SELECT count(*) FROM matches), 5) AS participations, round((SELECT count(*) FROM teams) / (SELECT count(*) FROM matches), 5) AS teams""")
def g31(v):
    n = v.matches.agg(F.count("*").cast("double").alias("n"))
    sums = v.participations.agg(F.count("*").alias("p")).crossJoin(v.teams.agg(F.count("*").alias("t"))).crossJoin(n)
    return sums.select(F.round(F.col("p") / F.col("n"), 5).alias("participations"), F.round(F.col("t") / F.col("n"), 5).alias("teams"))


@query("g35_counts_by_severity", "SELECT count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'signup') AS signups FROM observations")
def g35(v):
    return v.observations.agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "signup").alias("signups"))


@query("g36_ordered_distinct_concat", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def g36(v):
    return v.table("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("g37_latency_percentiles", """SELECT event_type, min(value) FILTER (WHERE k >= ceil(n * 0.5)) AS p50, min(value) FILTER (WHERE k >= ceil(n * 0.95)) AS p95, min(value) FILTER (WHERE k >= ceil(n * 0.99)) AS p99
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def g37(v):
    return reports.nearest_rank(v.table("events"), "value", "event_type")


@query("g38_active_by_stratum", "SELECT coalesce(region, 'unknown') AS region, bracket, count(*) AS n FROM players WHERE trophies >= 0 GROUP BY 1, 2")
def g38(v):
    return v.players.where("trophies >= 0").groupBy(F.coalesce("region", F.lit("unknown")).alias("region"), "bracket").agg(F.count("*").alias("n"))


@query("s13_size_report", """SELECT p_brand AS name, CAST(sum(p_size) AS BIGINT) AS bytes, round(sum(p_size) / (SELECT sum(p_size) FROM part) * 100, 4) AS percent, round(sum(p_size) / count(*), 4) AS bytes_per_row FROM part GROUP BY 1""")
def s13(v):
    p = v.table("part")
    rows = p.groupBy(F.col("p_brand").alias("name")).agg(F.sum("p_size").alias("bytes"), F.count("*").alias("n"))
    total = p.agg(F.sum("p_size").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(
        "name", "bytes", F.round(F.col("bytes") / F.col("total") * 100, 4).alias("percent"), F.round(F.col("bytes") / F.col("n"), 4).alias("bytes_per_row"))


@query("t4_tables_by_size", "SELECT p_brand AS name, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1 ORDER BY bytes DESC, name LIMIT 10")
def t4(v):
    rows = v.table("part").groupBy(F.col("p_brand").alias("name")).agg(F.sum("p_size").alias("bytes"))
    return rows.orderBy(F.desc("bytes"), "name").limit(10)


@query("j13_orphans", """SELECT 'match' AS relation, count(*) AS orphans FROM (SELECT match_id FROM participations WHERE match_id NOT IN (SELECT match_id FROM matches WHERE match_id % 10 <> 3))
UNION ALL SELECT 'entity', count(*) FROM (SELECT entity_id FROM participations WHERE entity_id NOT IN (SELECT entity_id FROM entities WHERE is_active))
UNION ALL SELECT 'team', count(*) FROM (SELECT team_id FROM participations WHERE team_id IS NOT NULL AND team_id NOT IN (SELECT team_id FROM teams WHERE result <> 'unknown'))""")
def j13(v):
    return reports.orphans(v.participations, [
        ("match", "match_id", v.matches.where("match_id % 10 <> 3"), "match_id"), ("entity", "entity_id", v.entities.where("is_active"), "entity_id"),
        ("team", "team_id", v.teams.where("result <> 'unknown'"), "team_id")])


#: Tables without which nothing else makes sense, and two that are never there.
CRITICAL = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier", "matches_of_old", "ghost")


@query("j17_expected_tables", """SELECT name, name IN (SELECT table_name FROM information_schema.tables) AS present
FROM (VALUES ('customer'), ('events'), ('lineitem'), ('nation'), ('orders'), ('part'), ('region'), ('supplier'), ('matches_of_old'), ('ghost')) t(name)""")
def j17(v):
    return reports.expected_tables(v.spark, v.sf_dir, CRITICAL)


@query("c31_invariant_checks", """SELECT 'unique_runs' AS check, CAST(count(*) - count(DISTINCT run_id) AS DOUBLE) AS observed, 0.0::DOUBLE AS expected, count(*) = count(DISTINCT run_id) AS passed FROM runs
UNION ALL SELECT 'matches_without_player', CAST(count(*) AS DOUBLE), 0.0, count(*) = 0 FROM matches WHERE player_id NOT IN (SELECT player_id FROM players)
UNION ALL SELECT 'inactive_entities', CAST(count(*) AS DOUBLE), 0.0, count(*) = 0 FROM entities WHERE NOT is_active""")
def c31(v):
    return reports.checks([
        ("unique_runs", v.runs.agg(F.count("*") - F.count_distinct("run_id")), 0),
        ("matches_without_player", v.matches.join(v.players.select("player_id"), "player_id", "left_anti").agg(F.count("*")), 0),
        ("inactive_entities", v.entities.where("NOT is_active").agg(F.count("*")), 0)])


@query("u2_inline_union", "SELECT kind, weight, count(*) AS n FROM observations o JOIN (VALUES ('click', 1), ('view', 2), ('error', 3)) w(k, weight) ON o.kind = w.k GROUP BY 1, 2")
def u2(v):
    weights = v.spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "kind string, weight int")
    return v.observations.join(F.broadcast(weights), "kind").groupBy("kind", "weight").agg(F.count("*").alias("n"))


@query("x7_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x7(v):
    return v.table("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
