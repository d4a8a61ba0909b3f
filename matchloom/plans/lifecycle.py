"""Plans: sources and sinks, archives, state after upserts, composite runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate, archive, catalog, ingest, monitor, ranking, reports, retention, sampling, sync
from ..sources import pages
from ..sources.shared import shared_path
from ..sources.views import AS_OF, Views
from . import ingestion as ing
from . import operations as ops
from . import statistics as st
from .base import query


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- sources and sinks --------------------------------------------------

OBJECTS = """CASE c_custkey % 4 WHEN 0 THEN '{"ok":true,"payload":{"tag":"#P' || c_custkey || '"}}' WHEN 1 THEN '{"ok":false,"payload":{"tag":"x"}}'
  WHEN 2 THEN '{"ok":true,"payload":[1]}' ELSE 'no json' END"""


@query("s4_object_envelope", """SELECT c_custkey AS fetch_id, c_custkey % 4 = 0 AS accepted, CASE WHEN c_custkey % 4 = 0 THEN '{"tag":"#P' || c_custkey || '"}' END AS object FROM customer""")
def s4(v):
    return ingest.envelope_objects(v.table("customer").selectExpr("c_custkey AS fetch_id", f"{OBJECTS} AS body")).select("fetch_id", "accepted", "object")


@query("s5_raw_snapshots", """SELECT event_type AS category, count(*) AS n, count(DISTINCT sha256(props)) AS checksums, CAST(sum(strlen(props)) AS BIGINT) AS bytes
FROM events GROUP BY 1""")
def s5(v):
    path = shared_path(v.spark, "snapshots")
    archive.write_snapshots(v.table("events").select(F.col("event_type").alias("category"), F.col("props").alias("payload")), path)
    return v.spark.read.parquet(path).groupBy("category").agg(
        F.count("*").alias("n"), F.count_distinct("checksum").alias("checksums"), F.sum("bytes").alias("bytes"))


@query("s6_scan_by_id", "SELECT entity_id, name FROM entities WHERE is_active AND entity_id > 12 ORDER BY entity_id LIMIT 8")
def s6(v):
    path = shared_path(v.spark, "pages")
    pages.write_sorted(v.entities.where("is_active"), ["entity_id"], path, 8)
    return pages.read_page(v.spark, path, ["entity_id"], 8, F.struct(F.lit(12).cast("long"))).rows.select("entity_id", "name")


@query("s10_table_columns", "SELECT * FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) t(position, name, type)")
def s10(v):
    return sync.columns_of(v.table("nation"))


@query("s11_schema_problems", "SELECT * FROM (VALUES ('p_brand: missing'), ('p_size: string')) t(problem)")
def s11(v):
    p = v.table("part")
    found = sync.schema_problems(p, p.drop("p_brand").withColumn("p_size", F.col("p_size").cast("string")))
    return v.spark.createDataFrame([(x,) for x in found], "problem string")


@query("s12_capacity_scan", "SELECT 'orders' AS name, count(*) AS rows, true AS stored FROM orders UNION ALL SELECT 'lineitem', count(*), true FROM lineitem UNION ALL SELECT 'events', count(*), true FROM events")
def s12(v):
    sizes = monitor.table_sizes(v.spark, {n: f"{v.sf_dir}/{n}.parquet" for n in ("orders", "lineitem", "events")})
    return sizes.select("name", "rows", (F.col("bytes") > 0).alias("stored"))


@query("s14_document_store", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def s14(v):
    rows, path = v.table("orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderstatus"), shared_path(v.spark, "documents")
    archive.write_documents(rows, path)
    return archive.read_documents(v.spark, path, rows.schema)


HOT_CUT = f"TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"


@query("s21_published_response", f"SELECT count(*) > 0 AS available, count(*) AS items, max(score) AS best FROM (SELECT CAST(score AS DOUBLE) AS score FROM ({st.PUBLISHED}))")
def s21(v):
    return st.published(v).agg((F.count("*") > 0).alias("available"), F.count("*").alias("items"), F.max("score").alias("best"))


# ---- validators and predicates ------------------------------------------

@query("p5_club_ranking_items", "SELECT s_suppkey AS fetch_id, s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS valid FROM supplier")
def p5(v):
    key = F.col("s_suppkey")
    item = F.concat(F.lit('{"tag":"'), F.when(key % 3 == 0, " ").otherwise("#C"), F.lit('","name":"club"'),
                    F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(',"rank":'), key)), F.lit(',"trophies":7}'))
    return ingest.ranking_items(v.table("supplier").select(key.alias("fetch_id"), item.alias("item"))).select("fetch_id", "valid")


@query("p10_sub_items", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '1:a,2:b' WHEN s_suppkey % 3 = 0 THEN '' ELSE '2:b' END AS subs, CASE WHEN s_suppkey % 2 = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS dropped FROM supplier")
def p10(v):
    key = F.col("s_suppkey")
    item = F.when(key % 2 == 0, '{"starPowers":[{"id":2,"name":"b"},{"id":"1","name":" a "}]}').when(key % 3 == 0, '{"id":1}').otherwise(
        '{"starPowers":[{"id":2,"name":"b"},{"id":3,"name":" "}]}')
    rows = catalog.sub_items(v.table("supplier").select(key.alias("id"), item.alias("item")))
    return rows.select("id", F.array_join(F.transform("sub_items", lambda s: F.concat_ws(":", s["id"], s["name"])), ",").alias("subs"), "dropped")


UNWRAPPED = "CASE n % 4 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 END"


@query("p18_unwrapped_failure", f"""SELECT id, up AS upstream, CASE WHEN up = 404 THEN 'not_found' WHEN up = 429 THEN 'rate_limited' ELSE 'server_error' END AS code FROM (SELECT id, {UNWRAPPED} AS up FROM ({ing.NUMBERS}))""")
def p18(v):
    body = F.when(F.col("up").isNotNull(), F.concat(F.lit('{"ok":false,"error":"upstream_api_error","upstreamStatus":'), "up", F.lit("}"))).otherwise(
        '{"ok":false,"error":"bad_gateway","upstreamStatus":404}')
    rows = ing.numbers(v).selectExpr("id", f"{UNWRAPPED} AS up").select("id", body.alias("body"))
    inner = scalars.upstream_status(F.col("body"))
    return rows.select("id", inner.alias("upstream"), scalars.failure_code(F.coalesce(inner, F.lit(502)), F.lit(None).cast("string")).alias("code"))


@query("p23_row_reconciles", """SELECT p_partkey AS id, wins >= 0 AND wins + losses + draws <= matches AS ok FROM (
  SELECT p_partkey, p_partkey % 7 - 1 AS wins, p_size % 5 AS losses, p_partkey % 3 AS draws, p_size % 11 AS matches FROM part)""")
def p23(v):
    rows = v.table("part").selectExpr("p_partkey AS id", "p_partkey % 7 - 1 AS wins", "p_size % 5 AS losses", "p_partkey % 3 AS draws", "p_size % 11 AS matches")
    return rows.select("id", scalars.reconciles(*map(F.col, ("matches", "wins", "losses", "draws"))).alias("ok"))


@query("p29_replay_validation", """SELECT 'catalog' AS category, count(*) FILTER (WHERE s_suppkey % 5 > 2) AS valid, count(*) FILTER (WHERE s_suppkey % 5 <= 2) AS rejected, bool_or(s_suppkey % 5 > 2) AS passed FROM supplier
UNION ALL SELECT 'match_log', count(*) FILTER (WHERE o_orderkey % 5 < 2), count(*) FILTER (WHERE o_orderkey % 5 >= 2), bool_or(o_orderkey % 5 < 2) FROM orders""")
def p29(v):
    items = ing.p9(v).select(F.lit("catalog").alias("category"), F.col("reason").isNull().alias("valid"))
    log = ingest.match_items(ing.match_log(v)).select(F.lit("match_log").alias("category"), F.col("reason").isNull().alias("valid"))
    return archive.replay_summary(items.unionByName(log))


@query("p30_timestamps", """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z')
  WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.129Z') END AS at FROM events""")
def p30(v):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", " yyyy-MM-dd")).when(
        k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".129999+02:00"))).when(
        F.col("event_id") % 8 == 3, "0000-00-00 00:00:00").otherwise("2024-02-30")
    return v.table("events").select(F.col("event_id").alias("id"), ingest.timestamps(raw).alias("at"))


LOCKS = {
    "id": "o_orderkey", "locked_at": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END", "expires_at": "o_orderdate", "ttls": "1 + o_orderkey % 2",
}


@query("p31_stale_locks", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'copy' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'error' WHEN o_orderkey % 2 = 0 THEN 'repair' ELSE 'skip' END AS action,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate WHEN o_orderdate <= TIMESTAMP '2001-01-01' AND o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 900 SECOND END AS locked_at FROM orders""")
def p31(v):
    locks = v.table("orders").selectExpr(*[f"{e} AS {n}" for n, e in LOCKS.items()])
    return retention.lock_actions(locks, ntz("2001-01-01"), F.lit(900), F.col("ttls")).select("id", "action", "locked_at")


@query("j11_payload_states", """SELECT coalesce(m.version, 'none') AS state, count(*) AS n, count(*) FILTER (WHERE m.match_id IS NULL) AS unarchived FROM runs r
LEFT JOIN (SELECT * FROM matches WHERE mode IS NOT NULL) m ON r.run_id = m.match_id GROUP BY 1""")
def j11(v):
    states = v.matches.where("mode IS NOT NULL").select(F.col("match_id").alias("run_id"), "version", F.lit(True).alias("archived"))
    return v.runs.join(states, "run_id", "left").groupBy(F.coalesce("version", F.lit("none")).alias("state")).agg(
        F.count("*").alias("n"), F.count_if(F.col("archived").isNull()).alias("unarchived"))


# ---- scalars ------------------------------------------------------------

@query("f8_high_gate", f"SELECT id, n % 2 = 0 AND m % 4 >= 2 AND m % 5 >= 2 AS gate FROM ({ing.NUMBERS})")
def f8(v):
    return ing.numbers(v).select("id", scalars.high_gate(F.col("n") % 2 == 0, F.col("m") % 4, F.col("m") % 5).alias("gate"))


@query("f13_movement_guard", f"SELECT id, id % 5 <> 0 AND m / 100 > 0.25 AS held FROM ({ing.NUMBERS})")
def f13(v):
    return ing.numbers(v).select("id", scalars.exceeds_guard(F.col("m") / 100, F.col("id") % 5 == 0).alias("held"))


@query("f14_significant_change", f"""SELECT n.entity_id, o.tier IS NULL OR o.tier <> n.tier OR abs(n.score - o.score) > 1.0 AS significant FROM ({st.NEW}) n LEFT JOIN ({st.PUBLISHED}) o ON n.entity_id = o.entity_id""")
def f14(v):
    pair = ranking.compare_tiers(st.new_ranking(v), st.published(v))
    return pair.select("entity_id", scalars.significant(*map(F.col, ("old_tier", "tier", "old_score", "score"))).alias("significant"))


@query("f15_canonical_json", """SELECT event_id AS id, CASE WHEN event_id % 5 > 0 THEN '{"a":{"k":' || json_extract_string(props, '$.k') || '},"z":[1,{"a":null,"b":"é"}]}' END AS document FROM events""")
def f15(v):
    raw = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit('{ "z": [1, {"b": "é", "a": null}],\n "a": '), "props", F.lit("}"))).otherwise("{no json")
    return v.table("events").select(F.col("event_id").alias("id"), archive.canonical_json(raw).alias("document"))


@query("f16_sha256", "SELECT c_custkey AS id, sha256(c_name) AS digest FROM customer")
def f16(v):
    return v.table("customer").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("digest"))


@query("f20_success_delay", f"SELECT id, CASE WHEN m % 3 = 0 THEN 720.0::DOUBLE ELSE 120.0 END AS minutes FROM ({ing.NUMBERS})")
def f20(v):
    return ing.numbers(v).select("id", scalars.success_delay_minutes(F.col("m") % 3 == 0).cast("double").alias("minutes"))


@query("f29_days_to_limit", f"SELECT id, CASE WHEN n > 30 AND id % 7 > 0 THEN round((5000 - m) / (n - 30), 6) END AS days FROM ({ing.NUMBERS})")
def f29(v):
    growth = F.when(F.col("id") % 7 > 0, (F.col("n") - 30).cast("double"))
    return ing.numbers(v).select("id", F.round(monitor.days_to_limit(F.col("m").cast("double"), F.lit(5000.0), growth), 6).alias("days"))


@query("f30_free_space", f"SELECT id, 300 - n AS free, round((300 - n) / 300 * 100, 4) AS percent FROM ({ing.NUMBERS})")
def f30(v):
    free = F.lit(300) - F.col("n")
    return ing.numbers(v).select("id", free.alias("free"), F.round(free / 300 * 100, 4).alias("percent"))


@query("f33_history_span", "SELECT fetch_id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(observed_at))) / 86400000000.0, 5) AS days FROM observations GROUP BY 1")
def f33(v):
    oldest = v.observations.groupBy("fetch_id").agg(F.min("observed_at").alias("at"))
    return oldest.select("fetch_id", F.round(scalars.days_between(F.col("at"), F.lit("2024-01-31").cast("timestamp")), 5).alias("days"))


@query("f35_row_checksum", "SELECT id, sha256(id || '|' || name) AS checksum FROM source_rows")
def f35(v):
    return v.source_rows.select("id", sync.row_checksum(v.source_rows, ["id", "name"]).alias("checksum"))


@query("f36_evidence_hash", """SELECT run_id, sha256('{"run_id":' || run_id || ',"status":"' || status || '","workflow_id":' || workflow_id || '}') AS evidence FROM runs""")
def f36(v):
    return v.runs.select("run_id", archive.evidence_hash("run_id", "status", "workflow_id").alias("evidence"))


# ---- archives and retention ---------------------------------------------

ARCHIVES = {
    "id": "o_orderkey", "created_at": "o_orderdate", "attempts": "CAST(o_custkey % 6 AS BIGINT)", "original_bytes": "o_custkey * 10", "object_bytes": "o_custkey * 3",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'verified' ELSE 'pending' END",
}


@query("g26_archive_metrics", f"""SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'O') AS verified, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
  max(o_custkey % 6) AS max_attempts, CAST(sum(o_custkey * 10) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS original_bytes, CAST(sum(o_custkey * 3) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS object_bytes,
  CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(min(o_orderdate) FILTER (WHERE o_orderstatus = 'P')) AS BIGINT) AS oldest_pending_s, round(10 / 3, 5) AS ratio FROM orders""")
def g26(v):
    return archive.metrics(v.table("orders").selectExpr(*[f"{e} AS {n}" for n, e in ARCHIVES.items()]), F.lit(AS_OF))


def objects(v: Views) -> tuple[DataFrame, DataFrame]:
    """A manifest over events, and objects of which some are lost or changed."""
    e = v.table("events").select(F.col("event_id").alias("key"), F.concat("props", F.col("event_id").cast("string")).alias("payload"))
    made = e.select("key", "payload", archive.compressed(F.col("payload")).alias("data"))
    k = F.col("key")
    manifest = made.select(
        "key", F.sha2("data", 256).alias("object_checksum"),
        F.when(k % 11 == 0, F.sha2(F.lit("another"), 256)).otherwise(F.sha2("payload", 256)).alias("original_checksum"),
        F.when(k % 13 == 0, "changed since").otherwise(F.col("payload")).alias("live_payload"))
    stored = made.where(k % 5 != 0).select("key", F.when(k % 7 == 0, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")).alias("data"))
    return manifest, stored


REVERIFIED = """CASE WHEN event_id % 5 = 0 THEN 'object_missing' WHEN event_id % 7 = 0 THEN 'object_checksum_mismatch' WHEN event_id % 11 = 0 THEN 'decompressed_mismatch'
  WHEN event_id % 13 = 0 THEN 'live_payload_mismatch' END"""


@query("m21_reverification", f"SELECT event_id AS key, {REVERIFIED} AS reason FROM events")
def m21(v):
    return archive.verify_objects(*objects(v)).select("key", "reason")


@query("c19_archive_verification", f"SELECT coalesce({REVERIFIED}, 'intact') AS outcome, count(*) AS n FROM events GROUP BY 1")
def c19(v):
    return archive.verify_objects(*objects(v)).groupBy(F.coalesce("reason", F.lit("intact")).alias("outcome")).agg(F.count("*").alias("n"))


@query("c20_restore_proof", "SELECT count(*) AS rows, 0 AS differing FROM orders")
def c20(v):
    rows, path = v.table("orders"), shared_path(v.spark, "restore")
    rows.write.parquet(path)
    back = v.spark.read.parquet(path)
    return back.agg(F.count("*").alias("rows")).crossJoin(
        sync.same_rows(rows, back, "o_orderkey", rows.columns).agg(F.count("*").cast("int").alias("differing")))


@query("c17_family_plans", f"""SELECT 'match_graph' AS family, 'archive_and_delete' AS action, count(*) AS n FROM matches WHERE occurred_at < {HOT_CUT}
UNION ALL SELECT 'match_observations', 'archive_and_delete', count(*) FROM observations WHERE observed_at < TIMESTAMP '2024-07-15' - INTERVAL 180 DAY
UNION ALL SELECT 'workflow_audit', 'archive_and_delete', count(*) FROM runs WHERE started_at < CASE WHEN status = 'failed' THEN TIMESTAMP '{AS_OF}' - INTERVAL 730 DAY ELSE {HOT_CUT} END
UNION ALL SELECT 'fetch_audit', 'archive_and_delete', count(*) FROM runs WHERE started_at < {HOT_CUT}
UNION ALL SELECT 'data_incidents', 'archive_and_delete', count(*) FROM matches WHERE mode IS NOT NULL AND occurred_at < {HOT_CUT}
UNION ALL SELECT 'normalized_snapshots', 'archive_and_delete', count(*) FROM matches WHERE match_id % 4 <> 0 AND occurred_at < {HOT_CUT}
UNION ALL SELECT 'player_name_history', 'archive', count(*) FROM matches WHERE occurred_at < {HOT_CUT}""")
def c17(v):
    m, now = v.matches, ntz(AS_OF)
    tables = [
        ("match_graph", m, now), ("match_observations", v.observations, ntz("2024-07-15")), ("workflow_audit", v.runs, now), ("fetch_audit", v.runs, now),
        ("data_incidents", m.withColumn("resolved_at", F.when(F.col("mode").isNotNull(), F.col("occurred_at"))), now),
        ("normalized_snapshots", m.selectExpr("occurred_at AS created_at", "match_id % 4 = 0 AS is_accepted"), now),
        ("player_name_history", m.withColumnRenamed("occurred_at", "recorded_at"), now)]
    return reports.union_all([
        archive.plan_family(rows, name, at).groupBy(F.lit(name).alias("family"), "action").agg(F.count("*").alias("n")) for name, rows, at in tables])


@query("c22_scoped_deletion", "SELECT run_id AS match_id, (SELECT count(*) FROM participations p WHERE p.match_id = run_id) AS before, 0 AS after FROM runs WHERE run_id % 40 = 0")
def c22(v):
    listed = v.runs.where("run_id % 40 = 0").select(F.col("run_id").alias("match_id"))
    _, counts = retention.scoped_deletion(v.participations, "match_id", listed)
    return counts.withColumn("after", F.col("after").cast("int"))


@query("m20_payload_sweep", f"""SELECT count(*) FILTER (WHERE reason IS NULL) AS removed, count(*) FILTER (WHERE reason IS NOT NULL) AS kept,
  CAST(coalesce(sum(length(payload)) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS bytes FROM (SELECT {ops.PAYLOAD_REASON} AS reason, 'p' || id AS payload FROM ({ops.PAYLOAD_SQL}))""")
def m20(v):
    return retention.removed_payloads(ops._payloads(v).withColumn("payload", F.concat(F.lit("p"), F.col("id"))))[1]


@query("m22_player_safeguard", """SELECT player_id, false AS deletable, CASE WHEN trophies >= 0 THEN 'active_or_reachable,' ELSE '' END
  || CASE WHEN player_id IN (SELECT player_id FROM matches WHERE match_id % 3 = 0) THEN 'participant_referenced,' ELSE '' END || 'no_approved_merge_evidence' AS reasons FROM players""")
def m22(v):
    players = v.players.select("player_id", (F.col("trophies") >= 0).alias("is_reachable"))
    out = retention.player_safeguard(players, v.matches.where("match_id % 3 = 0").select("player_id"))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("m23_lock_cleanup", "SELECT run_id FROM runs r LEFT JOIN (SELECT * FROM matches WHERE mode IS NOT NULL) m ON r.run_id = m.match_id WHERE r.started_at < TIMESTAMP '1998-01-01' AND (m.version IS NULL OR m.version <> 'O')")
def m23(v):
    live = v.matches.where("mode IS NOT NULL AND version = 'O'").select(F.col("match_id").alias("run_id"))
    return v.runs.where("started_at < TIMESTAMP_NTZ '1998-01-01'").join(live, "run_id", "left_anti").select("run_id")


@query("m15_active_holds", "SELECT run_id FROM runs WHERE run_id % 25 = 0 AND status <> 'failed'")
def m15(v):
    holds = v.runs.where("run_id % 25 = 0").select("run_id", F.when(F.col("status") == "failed", F.col("started_at")).alias("released_at"))
    return holds.where("released_at IS NULL").select("run_id")


@query("m16_eligibility_inputs", "SELECT 'runs' AS input, count(*) AS n FROM runs UNION ALL SELECT 'referenced', count(*) FROM runs WHERE run_id % 9 = 0 UNION ALL SELECT 'holds', count(*) FROM runs WHERE run_id % 25 = 0")
def m16(v):
    r = v.runs
    return reports.union_all([df.agg(F.lit(n).alias("input"), F.count("*").alias("n")) for n, df in (
        ("runs", r), ("referenced", r.where("run_id % 9 = 0")), ("holds", r.where("run_id % 25 = 0")))])


@query("m18_verification_passes", "SELECT user_id AS archive_id, count(DISTINCT event_type) AS passes FROM events WHERE value >= 20 GROUP BY 1")
def m18(v):
    return v.table("events").where("value >= 20").groupBy(F.col("user_id").alias("archive_id")).agg(F.count_distinct("event_type").alias("passes"))


# ---- state after upserts ------------------------------------------------

@query("c12_player_upsert", """SELECT id AS player_id, CASE WHEN k2 AND id % 4 = 0 THEN c_name || ' II' ELSE c_name END AS name, CASE WHEN k2 AND id % 10 = 0 THEN c_nationkey END AS club_id,
  CASE WHEN k2 AND id % 10 <> 0 THEN '#W' WHEN NOT k2 THEN '#OLD' END AS pending_club, k2 AS is_reachable, CASE WHEN k2 AND k3 AND id % 4 = 0 THEN c_name END AS previous_name,
  CASE WHEN NOT k3 THEN 'new' WHEN NOT k2 THEN 'kept' WHEN id % 4 = 0 THEN 'renamed' ELSE 'same' END AS action
FROM (SELECT *, c_custkey AS id, c_custkey % 2 = 0 AS k2, c_custkey % 3 = 0 OR c_custkey % 2 = 1 AS k3 FROM customer)""")
def c12(v):
    return _players_after(v)


def _players_after(v: Views) -> DataFrame:
    c = v.table("customer")
    current = c.where("c_custkey % 3 = 0 OR c_custkey % 2 = 1").selectExpr("c_custkey AS player_id", "c_name AS name", "CAST(NULL AS INT) AS club_id", "'#OLD' AS pending_club", "false AS is_reachable")
    incoming = c.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey AS player_id", "CASE WHEN c_custkey % 4 = 0 THEN c_name || ' II' ELSE c_name END AS name", "CASE WHEN c_custkey % 10 = 0 THEN c_nationkey END AS club_id", "'#W' AS pending_club")
    return ingest.upsert_players(current, incoming)


@query("r10_profile_sync", """SELECT CASE WHEN NOT k3 THEN 'new' WHEN NOT k2 THEN 'kept' WHEN id % 4 = 0 THEN 'renamed' ELSE 'same' END AS action, count(*) AS n
FROM (SELECT c_custkey AS id, c_custkey % 2 = 0 AS k2, c_custkey % 3 = 0 OR c_custkey % 2 = 1 AS k3 FROM customer) GROUP BY 1""")
def r10(v):
    return _players_after(v).groupBy("action").agg(F.count("*").alias("n"))


@query("m3_unreachable_players", "SELECT player_id, player_id % 8 <> 0 AS is_reachable, CASE WHEN player_id % 8 = 0 THEN 'not_found' END AS unreachable_reason FROM players")
def m3(v):
    failed = v.players.where("player_id % 8 = 0").select("player_id", F.lit("not_found").alias("reason"))
    return ingest.mark_unreachable(v.players.select("player_id", F.lit(True).alias("is_reachable")), failed)


@query("m5_candidates", """SELECT event_id AS id, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN '#C' || user_id END AS club_tag, place FROM (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE value < 60) WHERE place <= 200""")
def m5(v):
    detail = F.when(F.col("event_id") % 3 == 0, "{malformed").otherwise(F.concat(F.lit('{"clubTag":"#C'), "user_id", F.lit('"}')))
    seen = v.table("events").select(
        F.col("event_id").alias("id"), (F.col("value") >= 60).alias("promoted"), F.col("ts").alias("first_observed_at"),
        F.when(F.col("event_type") == "click", "club_member").otherwise("match").alias("source"), detail.alias("detail"))
    return sampling.unpromoted(seen, 200).select("id", "club_tag", "place")


@query("m9_recent_fetch_guard", "SELECT player_id FROM players WHERE player_id IN (SELECT fetch_id FROM observations WHERE observed_at >= TIMESTAMP '2024-01-29' AND kind = 'view')")
def m9(v):
    recent = v.observations.where("observed_at >= TIMESTAMP_NTZ '2024-01-29' AND kind = 'view'").select(F.col("fetch_id").alias("player_id"))
    return v.players.join(recent, "player_id", "left_semi").select("player_id")


@query("m10_latest_accepted", "SELECT player_id, max(match_id) AS snapshot_id FROM matches WHERE version = 'O' GROUP BY 1")
def m10(v):
    return v.matches.where("version = 'O'").groupBy("player_id").agg(F.max("match_id").alias("snapshot_id"))


@query("m11_rule_set", """SELECT name, CAST(value AS DOUBLE) AS value, CAST(CASE name WHEN 'cap' THEN (SELECT count(*) FROM (SELECT 1 FROM facts GROUP BY entity_id, player_id HAVING count(*) > 20))
    WHEN 'overall_floor' THEN (SELECT count(*) FROM (SELECT 1 FROM facts GROUP BY entity_id HAVING count(*) >= 100))
    ELSE (SELECT count(*) FROM (SELECT 1 FROM facts WHERE mode IS NOT NULL GROUP BY entity_id, mode HAVING count(*) >= 30)) END AS BIGINT) AS groups
FROM (VALUES ('cap', 20.0), ('overall_floor', 100.0), ('mode_floor', 30.0)) t(name, value)""")
def m11(v):
    return ranking.rule_reach(st.facts(v), ranking.RuleSet())


@query("m12_run_statuses", "SELECT run_id, status, count(p.match_id) AS rows FROM runs LEFT JOIN participations p ON run_id = p.match_id GROUP BY 1, 2")
def m12(v):
    some = v.runs.select("run_id", "status")
    rows = v.participations.select(F.col("match_id").alias("run_id"), F.lit(1).alias("one"))
    return some.join(rows, "run_id", "left").groupBy("run_id", "status").agg(F.count("one").alias("rows"))


@query("m13_current_tiers", f"SELECT entity_id, tier FROM ({st.PUBLISHED}) WHERE entity_id % 2 = 0")
def m13(v):
    pointer = st.published(v).select((F.col("entity_id") % 2).alias("snapshot")).where("snapshot = 0").distinct()
    rows = st.published(v).withColumn("snapshot", F.col("entity_id") % 2)
    return rows.join(F.broadcast(pointer), "snapshot", "left_semi").select("entity_id", "tier")


@query("m14_snapshot_label", "SELECT match_id AS snapshot_id, coalesce(version, 'none') AS label FROM matches WHERE match_id = (SELECT max(match_id) FROM matches)")
def m14(v):
    labels = v.matches.select("version").where("version IS NOT NULL").distinct().withColumn("label", F.col("version"))
    newest = v.matches.orderBy(F.desc("match_id")).limit(1)
    return newest.join(labels, "version", "left").select(F.col("match_id").alias("snapshot_id"), F.coalesce("label", F.lit("none")).alias("label"))


@query("m29_publication_copy", f"SELECT entity_id FROM ({st.PUBLISHED}) WHERE entity_id % 10 = 1 OR entity_id % 14 = 2")
def m29(v):
    rows = st.published(v)
    copy = rows.where("entity_id % 10 <> 1").withColumn("score", F.when(F.col("entity_id") % 14 == 2, F.col("score") + 1).otherwise(F.col("score")))
    return sync.same_rows(rows, copy, "entity_id", ["entity_id", "tier", "score"])


@query("m30_monitoring_summary", """SELECT user_id AS environment, arg_max(event_type, (ts, event_id)) AS latest, count(*) FILTER (WHERE event_type = 'error') AS critical, count(*) FILTER (WHERE event_type = 'view') AS warning FROM events GROUP BY 1""")
def m30(v):
    return v.table("events").groupBy(F.col("user_id").alias("environment")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count_if(F.col("event_type") == "error").alias("critical"),
        F.count_if(F.col("event_type") == "view").alias("warning"))


@query("m33_inventory_report", """SELECT 'orders' AS name, count(*) AS rows, count(DISTINCT o_orderkey) AS identities, count(DISTINCT o_orderstatus) AS statuses FROM orders
UNION ALL SELECT 'events', count(*), count(DISTINCT event_id), count(DISTINCT event_type) FROM events""")
def m33(v):
    return reports.union_all([v.table(n).agg(
        F.lit(n).alias("name"), F.count("*").alias("rows"), F.count_distinct(key).alias("identities"), F.count_distinct(status).alias("statuses"))
        for n, key, status in (("orders", "o_orderkey", "o_orderstatus"), ("events", "event_id", "event_type"))])


# ---- composite runs -----------------------------------------------------

@query("r1_aggregation_run", """SELECT 'per_mode' AS scope, count(*) AS rows, 0 AS unreconciled FROM mode_stats UNION ALL SELECT 'matchup', count(*), 0 FROM pair_stats
UNION ALL SELECT 'overall', count(*), 0 FROM (SELECT DISTINCT f.entity_id, f.version FROM facts f JOIN entities e ON f.entity_id = e.entity_id WHERE e.is_active)""")
def r1(v):
    counts = aggregate.run(v.participations, v.matches, v.teams, v.entities, shared_path(v.spark, "aggregation-run"))
    return counts.select("scope", "rows", F.col("unreconciled").cast("int").alias("unreconciled"))


@query("r2_entity_ranking_inputs", f"""SELECT b.entity_id, b.matches, round(b.rate_raw, 5) AS win_rate, round(h.high_raw, 5) AS high_rate, s.regions, s.brackets, s.recent
FROM ({st.BLENDED.format(keys='entity_id', where='')}) b LEFT JOIN ({st.HIGH}) h ON b.entity_id = h.entity_id LEFT JOIN ({st.STRATA}) s ON b.entity_id = s.entity_id""")
def r2(v):
    out = ranking.entity_inputs(st.capped(v), st.as_of())
    return st.rounded(out.select("entity_id", "matches", "win_rate", "high_rate", "regions", "brackets", "recent"), "win_rate", "high_rate")


@query("r6_capacity_snapshot", f"""SELECT round(total, 2) AS total, round((cap - total) / cap * 100, 4) AS free_percent, round((cap - total) / rate, 3) AS days_to_limit, CASE WHEN (cap - total) / rate < 30 OR (cap - total) / cap * 100 < 20 THEN 'critical'
  WHEN (cap - total) / rate < 60 OR (cap - total) / cap * 100 < 30 THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT (SELECT bytes FROM ({ops.POINTS}) WHERE day = DATE '{ops.NOW}') AS total, 1000000.0::DOUBLE AS cap, {ops.CONSERVATIVE} AS rate)""")
def r6(v):
    points, now = ops._points(v), F.lit(ops.NOW).cast("timestamp")
    total = F.max(F.when(F.col("at") == F.lit(ops.NOW).cast("date"), F.col("bytes")))
    state = monitor.growth_rates(points, now, total).crossJoin(points.agg(total.alias("total"))).withColumn("cap", F.lit(1_000_000.0))
    free = (F.col("cap") - F.col("total")) / F.col("cap") * 100
    days = monitor.days_to_limit(F.col("total"), F.col("cap"), F.col("conservative"))
    return state.select(F.round("total", 2).alias("total"), F.round(free, 4).alias("free_percent"), F.round(days, 3).alias("days_to_limit"), monitor.status(days, free).alias("status"))


@query("r7_evaluate_alerts", """SELECT coalesce(f.k, o.k) AS alert_key, coalesce(f.severity, 'warning') AS severity, CASE WHEN f.k IS NULL THEN 'resolved' WHEN o.k IS NULL THEN 'opened' ELSE 'bumped' END AS action
FROM (SELECT 'days:' || p_partkey AS k, CASE WHEN p_partkey % 120 < 30 THEN 'critical' ELSE 'warning' END AS severity FROM part WHERE p_partkey % 120 < 60) f
FULL OUTER JOIN (SELECT 'days:' || p_partkey AS k FROM part WHERE p_partkey % 7 = 0) o ON f.k = o.k""")
def r7(v):
    rows = v.table("part").selectExpr("p_partkey AS id", "p_partkey % 120 AS days")
    fired = monitor.alerts(rows, [("days", "critical", F.col("days") < 30), ("days", "warning", F.col("days") < 60)])
    firing = fired.select(F.concat_ws(":", "alert_key", "id").alias("alert_key"), "severity")
    opened = v.table("part").where("p_partkey % 7 = 0").selectExpr("'days:' || p_partkey AS alert_key", "'warning' AS severity", "1 AS occurrences")
    return monitor.reconcile_alerts(opened, firing).select("alert_key", "severity", "action")


@query("c26_response_plan", """SELECT p_partkey AS id, step, action FROM part, (VALUES (1, 'raise_critical_capacity_alert'), (2, 'freeze_rebuildable_producers'), (3, 'keep_canonical_ingestion_running'),
  (4, 'request_additional_capacity'), (5, 'pause_canonical_writers_if_write_safety_threatened'), (6, 'keep_public_reads_online')) t(step, action) WHERE p_size < 10""")
def c26(v):
    levels = v.table("part").selectExpr("p_partkey AS id", "CASE WHEN p_size < 10 THEN 'critical' WHEN p_size < 20 THEN 'warning' ELSE 'healthy' END AS level")
    return monitor.response_plan(levels).select("id", "step", "action")


@query("r9_seed_refresh", """SELECT player_id AS player, coalesce(CASE WHEN player_id % 2 = 0 THEN 'global' END, CASE WHEN player_id % 3 = 0 OR player_id % 2 = 1 THEN 'br' END) AS region,
  coalesce(CASE WHEN player_id % 3 = 0 OR player_id % 2 = 1 THEN bracket END, CASE WHEN player_id % 2 = 0 THEN 'unranked' END) AS bracket FROM players""")
def r9(v):
    current = v.players.where("player_id % 2 = 0").selectExpr("player_id AS player", "'global' AS region", "'unranked' AS bracket")
    seeds = v.players.where("player_id % 3 = 0 OR player_id % 2 = 1").select(F.col("player_id").alias("player"), F.lit("br").alias("region"), scalars.bracket(F.col("trophies")).alias("bracket"))
    return sampling.seed_schedule(current, seeds)


@query("r11_club_members", "SELECT n_nationkey AS fetch_id, '#2PY' AS tag FROM nation WHERE n_nationkey % 2 = 0")
def r11(v):
    body = F.concat(F.lit('{"tag":"#C","name":"c","members":[{"tag":"'), F.when(F.col("n_nationkey") % 2 == 0, "2py").otherwise("#XXXX"), F.lit('","name":"m"},{"name":"no tag"}]}'))
    rows = ingest.clubs(v.table("nation").select(F.col("n_nationkey").alias("fetch_id"), body.alias("body"))).select("fetch_id", F.explode("members.tag").alias("raw"))
    return rows.where(scalars.tag_problem(F.col("raw")).isNull()).select("fetch_id", scalars.tag(F.col("raw")).alias("tag"))


@query("r12_catalog_sync", """SELECT previous, new, removed, changes, CASE WHEN changes > 0 THEN 2 ELSE 1 END AS versions FROM (SELECT count(*) FILTER (WHERE entity_id % 5 <> 0) AS previous, count(*) FILTER (WHERE entity_id % 7 <> 0) AS new,
  count(*) FILTER (WHERE entity_id % 5 <> 0 AND entity_id % 7 = 0) AS removed,
  count(*) FILTER (WHERE entity_id % 5 = 0 AND entity_id % 7 <> 0) + CAST(sum(CASE WHEN entity_id % 5 <> 0 AND entity_id % 7 <> 0 THEN
    CASE WHEN (entity_id % 4 <> 0) <> (entity_id % 3 <> 0) THEN 1 ELSE 0 END + CASE WHEN ((entity_id + 1) % 4 <> 0) <> ((entity_id + 1) % 3 <> 0) THEN 1 ELSE 0 END
    + CASE WHEN ((entity_id + 2) % 4 <> 0) <> ((entity_id + 2) % 3 <> 0) THEN 1 ELSE 0 END + CASE WHEN ((entity_id + 3) % 4 <> 0) <> ((entity_id + 3) % 3 <> 0) THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS changes FROM catalog)""")
def r12(v):
    new, previous = ing.snapshot(v, 7, 4), ing.snapshot(v, 5, 3)
    changes = catalog.entity_changes(new, previous)
    active = v.spark.range(1).selectExpr("'first' AS label", "'active' AS status")
    versions = catalog.infer_version(changes, active, F.lit(AS_OF).cast("timestamp"))
    return catalog.volume_anomaly(previous, new).select("previous", "new", "removed").crossJoin(
        changes.agg(F.count("*").alias("changes"))).crossJoin(versions.agg(F.count("*").cast("int").alias("versions")))


@query("r13_archive_batch", """SELECT run_id, 'raw/v1/' || strftime(started_at, '%Y/%m/%d') || '/log/' || workflow_id || '/' || run_id || '-' || substr(sha256('payload ' || run_id), 1, 16) || '.json.gz' AS key, true AS readable
FROM (SELECT * FROM runs WHERE status <> 'succeeded' ORDER BY started_at, run_id LIMIT 25)""")
def r13(v):
    claimed = v.runs.where("status <> 'succeeded'").orderBy("started_at", "run_id").limit(25).withColumn("payload", F.concat(F.lit("payload "), "run_id"))
    key = retention.archive_key(F.col("started_at"), F.lit("log"), F.col("workflow_id").cast("string"), F.col("run_id").cast("string"), F.sha2("payload", 256))
    made = claimed.select("run_id", key.alias("key"), "payload", archive.compressed(F.col("payload")).alias("data"))
    return made.select("run_id", "key", archive.decompressed(F.col("data")).eqNullSafe(F.col("payload")).alias("readable"))


@query("r14_archive_replay", """SELECT 'ranking' AS category, count(*) FILTER (WHERE i = 0 AND fetch_id % 7 <> 0) AS valid, count(*) FILTER (WHERE i > 0 OR fetch_id % 7 = 0) AS rejected, true AS passed
FROM (SELECT c_custkey AS fetch_id, unnest([0, 1]) AS i FROM customer WHERE c_custkey % 5 > 1)""")
def r14(v):
    stored = ing.landed(v).select("fetch_id", archive.compressed(F.col("body")).alias("data"), F.sha2("body", 256).alias("checksum"))
    back = stored.select("fetch_id", archive.decompressed(F.col("data")).alias("body"), "checksum").where(F.sha2("body", 256) == F.col("checksum"))
    items = ingest.ranking_items(ingest.envelope_items(back.select("fetch_id", "body")))
    return archive.replay_summary(items.withColumn("category", F.lit("ranking")))


@query("x3_overlap_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 600 SECOND AND ts <= TIMESTAMP '2024-01-12'")
def x3(v):
    return sync.overlap_range(v.table("events"), "ts", ntz("2024-01-10"), 600, ntz("2024-01-12")).select("event_id")


@query("x6_claim_batch", "SELECT run_id FROM runs WHERE status <> 'succeeded' AND run_id % 3 <> 0 ORDER BY started_at, run_id LIMIT 15")
def x6(v):
    """One driver selects, so a claim needs no row locks."""
    taken = v.runs.where("run_id % 3 = 0").select("run_id")
    return v.runs.where("status <> 'succeeded'").join(taken, "run_id", "left_anti").orderBy("started_at", "run_id").limit(15).select("run_id")
