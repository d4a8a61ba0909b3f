"""Plans: scalar rules, payload validation, catalog changes, fair sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import budgets, catalog, ingest, sampling
from ..sources.views import AS_OF, Views
from .base import query

# ---- scalar rules -------------------------------------------------------

NUMBERS = "SELECT p_partkey AS id, p_partkey % 260 AS n, p_size AS m FROM part"


def numbers(v: Views) -> DataFrame:
    return v.table("part").selectExpr("p_partkey AS id", "p_partkey % 260 AS n", "p_size AS m")


@query("f1_win_rate", f"SELECT id, CASE WHEN n + m - 1 > 0 THEN n / (n + m - 1) END AS win_rate FROM ({NUMBERS}) WHERE m > 0")
def f1(v):
    return numbers(v).where("m > 0").select("id", scalars.win_rate(F.col("n"), F.col("m") - 1).alias("win_rate"))


@query("f2_recency_weight", f"""SELECT id, round(CASE WHEN n <= 30 THEN 1.0 WHEN n <= 90 THEN 1.0 - (n - 30) / 60.0 * 0.5
  WHEN n <= 180 THEN 0.5 - (n - 90) / 90.0 * 0.5 ELSE 0.0 END, 6) AS weight FROM ({NUMBERS})""")
def f2(v):
    return numbers(v).select("id", F.round(scalars.recency_weight(F.col("n").cast("double")), 6).alias("weight"))


@query("f3_version_blend_weight", f"SELECT id, least(1.0, greatest(0, n) / 100) AS weight FROM ({NUMBERS})")
def f3(v):
    return numbers(v).select("id", scalars.version_blend_weight(F.col("n")).alias("weight"))


@query("f4_blend", f"""SELECT id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a * w + b * (1 - w) END, 6) AS rate
  FROM (SELECT id, CASE WHEN id % 5 > 0 THEN n / 260.0 END AS a, CASE WHEN id % 7 > 0 THEN m / 50.0 END AS b, least(1.0, n / 100.0) AS w FROM ({NUMBERS}))""")
def f4(v):
    a, b = F.when(F.col("id") % 5 > 0, F.col("n") / 260.0), F.when(F.col("id") % 7 > 0, F.col("m") / 50.0)
    return numbers(v).select("id", F.round(scalars.blend(a, b, scalars.version_blend_weight(F.col("n"))), 6).alias("rate"))


@query("f5_overall_score", f"""SELECT id, round((0.5 * w + 0.2 * p + 0.2 * coalesce(h, w) + 0.1 * coalesce(c, 0.5)) * 100, 4) AS score FROM (
  SELECT id, n / 260.0 AS w, m / 50.0 AS p, CASE WHEN id % 3 > 0 THEN m / 60.0 END AS h, CASE WHEN id % 4 > 0 THEN n / 300.0 END AS c FROM ({NUMBERS}))""")
def f5(v):
    h, c = F.when(F.col("id") % 3 > 0, F.col("m") / 60.0), F.when(F.col("id") % 4 > 0, F.col("n") / 300.0)
    return numbers(v).select("id", F.round(scalars.overall_score(F.col("n") / 260.0, F.col("m") / 50.0, h, c), 4).alias("score"))


@query("f6_mode_score", f"SELECT id, round((n / 260.0 * 0.7 + m / 50.0 * 0.3) * 100, 4) AS score FROM ({NUMBERS})")
def f6(v):
    return numbers(v).select("id", F.round(scalars.mode_score(F.col("n") / 260.0, F.col("m") / 50.0), 4).alias("score"))


@query("f7_tier", f"""SELECT id, CASE WHEN n / 2.6 >= 90 THEN 'S' WHEN n / 2.6 >= 70 THEN 'A' WHEN n / 2.6 >= 30 THEN 'B'
  WHEN n / 2.6 >= 10 THEN 'C' ELSE 'D' END AS tier FROM ({NUMBERS})""")
def f7(v):
    return numbers(v).select("id", scalars.tier(F.col("n") / F.lit(2.6)).alias("tier"))


CONFIDENCE = "CASE WHEN {x} < {a} THEN 'insufficient' WHEN {x} < {b} THEN 'low' WHEN {x} < {c} THEN 'medium' WHEN {g} THEN 'high' ELSE 'medium' END"


@query("f9_overall_confidence", f"SELECT id, {CONFIDENCE.format(x='n * 3', a=100, b=200, c=500, g='id % 3 = 0 AND m % 4 >= 2 AND m % 5 >= 2')} AS confidence FROM ({NUMBERS})")
def f9(v):
    gate = scalars.high_gate(F.col("id") % 3 == 0, F.col("m") % 4, F.col("m") % 5)
    return numbers(v).select("id", scalars.confidence(F.col("n") * 3, gate).alias("confidence"))


@query("f10_mode_confidence", f"SELECT id, {CONFIDENCE.format(x='n', a=30, b=60, c=150, g='id % 3 = 0 AND m % 4 >= 2 AND m % 5 >= 2')} AS confidence FROM ({NUMBERS})")
def f10(v):
    gate = scalars.high_gate(F.col("id") % 3 == 0, F.col("m") % 4, F.col("m") % 5)
    return numbers(v).select("id", scalars.confidence(F.col("n"), gate, (30, 60, 150)).alias("confidence"))


@query("f11_matchup_class", f"""SELECT id, CASE WHEN n < 20 THEN NULL WHEN m * 2 / 100 <= 0.35 THEN 'hard_counter' WHEN m * 2 / 100 < 0.45 THEN 'counter'
  WHEN m * 2 / 100 <= 0.55 THEN 'neutral' WHEN m * 2 / 100 < 0.65 THEN 'strong' ELSE 'hard_advantage' END AS class FROM ({NUMBERS})""")
def f11(v):
    return numbers(v).select("id", scalars.matchup_class(F.col("m") * 2 / 100, F.col("n")).alias("class"))


@query("f12_matchup_confidence", f"""SELECT id, CASE WHEN n < 20 THEN 'insufficient' WHEN n < 40 THEN 'weak_signal' WHEN n < 100 THEN 'probable_counter'
  WHEN m % 2 = 0 THEN 'high_confidence_counter' ELSE 'probable_counter' END AS confidence FROM ({NUMBERS})""")
def f12(v):
    return numbers(v).select("id", scalars.matchup_confidence(F.col("n"), F.col("m") % 2 == 0).alias("confidence"))


@query("f17_match_key", """SELECT o_orderkey AS id, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus,
  CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END)) AS match_key FROM (
  SELECT *, upper(CASE WHEN o_orderkey % 2 = 0 THEN 'ab' || o_custkey || ',zz' ELSE 'zz' || ',zzz' || o_custkey END) AS a, 'M' || o_custkey AS b FROM orders)""")
def f17(v):
    key = F.col("o_custkey").cast("string")
    even = F.array(F.lit("zz"), F.concat(F.lit("ab"), key))
    odd = F.array(F.concat(F.lit("zzz"), key), F.lit("zz"))
    teams = F.array(F.when(F.col("o_orderkey") % 2 == 0, even).otherwise(odd), F.array().cast("array<string>"), F.array(F.concat(F.lit("m"), key)))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), scalars.match_key(key, F.col("o_orderstatus"), teams).alias("match_key"))


@query("f18_incident_signature", """SELECT o_orderkey AS id, sha256('{"code":"' || o_orderstatus || '","entity":' ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_custkey || '"' END || ',"type":"unknown_entity"}') AS signature FROM orders""")
def f18(v):
    rows = v.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("code"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("entity"), F.lit("unknown_entity").alias("type"))
    return catalog.checksum(rows, "code", "entity", "type", out="signature").select("id", "signature")


@query("f19_version_label", "SELECT DISTINCT 'internal-' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || 'Z' AS label FROM orders")
def f19(v):
    return v.table("orders").select(scalars.version_label(F.col("o_orderdate")).alias("label")).distinct()


@query("f21_failure_delay", f"SELECT id, least(1440.0, 10 * pow(2, greatest(n % 12 - 1, 0))) AS minutes FROM ({NUMBERS})")
def f21(v):
    return numbers(v).select("id", scalars.failure_delay_minutes(F.col("n") % 12).alias("minutes"))


@query("f22_request_delay", f"""SELECT id, CASE WHEN id % 3 = 0 AND n > 0 THEN least(300000.0, n * 2000.0)
  ELSE least(300000.0, 2000 * pow(2, greatest(n % 10 - 1, 0))) END AS ms FROM ({NUMBERS})""")
def f22(v):
    after = F.when(F.col("id") % 3 == 0, F.col("n") * 2)
    return numbers(v).select("id", scalars.request_delay_ms(F.col("n") % 10, after).alias("ms"))


@query("f23_archive_delay", f"SELECT id, least(3600.0, 60 * pow(2, greatest(n % 9 - 1, 0))) AS seconds FROM ({NUMBERS})")
def f23(v):
    return numbers(v).select("id", scalars.archive_delay_s(F.col("n") % 9).alias("seconds"))


@query("f24_priority_after", f"""SELECT id, round(CASE WHEN id % 2 = 0 THEN least(10.0, n / 13.0 - 10 + 0.1) ELSE greatest(-10.0, n / 13.0 - 10 - 0.5) END, 6) AS priority FROM ({NUMBERS})""")
def f24(v):
    return numbers(v).select("id", F.round(scalars.priority_after(F.col("n") / 13.0 - 10, F.col("id") % 2 == 0), 6).alias("priority"))


@query("f25_days_ago", f"SELECT event_id AS id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0, 6) AS days FROM events")
def f25(v):
    return v.table("events").select(
        F.col("event_id").alias("id"),
        F.round(scalars.days_between(F.col("ts"), F.lit("2024-01-31").cast("timestamp")), 6).alias("days"))


@query("f26_match_time", """SELECT event_id AS id, date_trunc('second', ts) AS at FROM events WHERE event_id % 4 <> 0
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0""")
def f26(v):
    raw = F.when(F.col("event_id") % 4 != 0, F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit(".000Z"))).otherwise("none")
    return v.table("events").select(F.col("event_id").alias("id"), scalars.match_time(raw).cast("timestamp_ntz").alias("at"))


TAGS = "CASE c_custkey % 6 WHEN 0 THEN ' #2py' || c_custkey % 10 * 2 WHEN 1 THEN 'lq' || c_mktsegment WHEN 2 THEN '  ' WHEN 3 THEN '0289PYLQGRJCUV02' WHEN 4 THEN 'q' ELSE 'gR8v2' END"


@query("p11_tag_normalise", f"""SELECT id, CASE WHEN r IS NULL THEN t END AS tag, r AS problem FROM (SELECT id, t, CASE WHEN trim(raw) = '' THEN 'empty'
  WHEN length(t) < 4 THEN 'too_short' WHEN length(t) > 16 THEN 'too_long' WHEN NOT regexp_full_match(t, '#[0289PYLQGRJCUV]+') THEN 'invalid_characters' END AS r
  FROM (SELECT id, raw, CASE WHEN starts_with(upper(trim(raw)), '#') THEN upper(trim(raw)) ELSE '#' || upper(trim(raw)) END AS t
    FROM (SELECT c_custkey AS id, {TAGS} AS raw FROM customer)))""")
def p11(v):
    rows = v.table("customer").selectExpr("c_custkey AS id", f"{TAGS} AS raw")
    problem = scalars.tag_problem(F.col("raw"))
    return rows.select("id", F.when(problem.isNull(), scalars.tag(F.col("raw"))).alias("tag"), problem.alias("problem"))


@query("p12_tag_in_url", "SELECT c_custkey AS id, '%23P' || c_custkey AS path FROM customer")
def p12(v):
    return v.table("customer").select(F.col("c_custkey").alias("id"), scalars.tag_in_url(F.concat(F.lit("p"), F.col("c_custkey"))).alias("path"))


@query("p13_country", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'global' WHEN n_nationkey % 4 = 1 THEN 'br' END AS country FROM nation""")
def p13(v):
    raw = F.when(F.col("n_nationkey") % 4 == 0, " Global ").when(F.col("n_nationkey") % 4 == 1, "BR").otherwise(F.col("n_name"))
    return v.table("nation").select(F.col("n_nationkey").alias("id"), scalars.country(raw).alias("country"))


@query("p14_bracket", "SELECT player_id, trophies, bracket FROM players")
def p14(v):
    return v.players.select("player_id", "trophies", "bracket")


@query("p15_slug", """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'mr-p-' || s_suppkey WHEN 1 THEN 'elan-' || s_suppkey ELSE 'unnamed' END AS slug FROM supplier""")
def p15(v):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("--Mr. P! "), "s_suppkey")).when(
        F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Élan  "), "s_suppkey", F.lit(" ?"))).otherwise("?!")
    return v.table("supplier").select(F.col("s_suppkey").alias("id"), scalars.slug(raw).alias("slug"))


STATUS = "CASE n % 8 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 404 WHEN 5 THEN 500 WHEN 6 THEN 503 ELSE 418 END"
TRANSPORT = "CASE m % 9 WHEN 0 THEN 'proxy_timeout' WHEN 1 THEN 'proxy_unreachable' WHEN 2 THEN 'invalid_json_response' END"
CODE = """CASE WHEN transport = 'proxy_timeout' THEN 'timeout' WHEN transport = 'proxy_unreachable' THEN 'proxy_unavailable'
  WHEN transport = 'invalid_json_response' THEN 'schema_mismatch' WHEN status IS NULL THEN 'network_failure' WHEN status = 429 THEN 'rate_limited'
  WHEN status IN (401, 403) THEN 'unauthorized' WHEN status = 404 THEN 'not_found' WHEN status >= 500 THEN 'server_error' ELSE 'invalid_data' END"""


@query("p17_failure_code", f"SELECT id, {CODE} AS code FROM (SELECT id, {STATUS} AS status, {TRANSPORT} AS transport FROM ({NUMBERS}))")
def p17(v):
    rows = numbers(v).selectExpr("id", f"{STATUS} AS status", f"{TRANSPORT} AS transport")
    return rows.select("id", scalars.failure_code(F.col("status"), F.col("transport")).alias("code"))


@query("p19_retry_decision", f"""SELECT id, CASE WHEN code IN ('schema_mismatch', 'unauthorized', 'not_found', 'invalid_data') THEN 'dead'
  WHEN attempts >= CASE code WHEN 'rate_limited' THEN 5 ELSE 3 END THEN 'failed' ELSE 'retry' END AS decision
  FROM (SELECT id, attempts, {CODE} AS code FROM (SELECT id, m % 7 AS attempts, {STATUS} AS status, {TRANSPORT} AS transport FROM ({NUMBERS})))""")
def p19(v):
    rows = numbers(v).selectExpr("id", "m % 7 AS attempts", f"{STATUS} AS status", f"{TRANSPORT} AS transport")
    code = scalars.failure_code(F.col("status"), F.col("transport"))
    return rows.select("id", scalars.retry_decision(code, F.col("attempts")).alias("decision"))


@query("p1_clean_text", "SELECT p_partkey AS id, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '   ' ELSE ' ' || p_name || ' ' END), '') AS name FROM part")
def p1(v):
    raw = F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return v.table("part").select(F.col("p_partkey").alias("id"), scalars.clean_text(raw).alias("name"))


@query("p26_secret_shaped_text", """SELECT count(*) FILTER (WHERE contains(lower(text), 'password')) AS password,
  count(*) FILTER (WHERE contains(lower(text), 'secret')) AS secret, count(*) FILTER (WHERE contains(lower(text), 'api_key')) AS api_key FROM documents""")
def p26(v):
    low = F.lower("text")
    return v.table("documents").agg(*[F.count_if(low.contains(w)).alias(w) for w in ("password", "secret", "api_key")])


# ---- payloads -----------------------------------------------------------

LANDED = """SELECT c_custkey AS fetch_id, CASE c_custkey % 5 WHEN 0 THEN '{"ok":false,"status":503}' WHEN 1 THEN 'not json'
  ELSE '{"ok":true,"status":200,"payload":{"items":[{"tag":"#P' || c_custkey || '","name":"' || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END
    || '","rank":' || c_custkey || '},{"tag":"","name":"x"}]}}' END AS body FROM customer"""


def landed(v: Views) -> DataFrame:
    text = LANDED.split(", CASE", 1)[1].rsplit(" AS body", 1)[0]
    return v.table("customer").selectExpr("c_custkey AS fetch_id", f"CASE{text} AS body")


@query("s3_envelope", "SELECT c_custkey AS fetch_id, c_custkey % 5 > 1 AS accepted, CASE WHEN c_custkey % 5 > 1 THEN 2 END AS n_items FROM customer")
def s3(v):
    return ingest.envelope_status(landed(v)).select("fetch_id", "accepted", "n_items")


@query("p4_ranking_items", """SELECT fetch_id, i AS index, i = 0 AND fetch_id % 7 <> 0 AS valid FROM (
  SELECT c_custkey AS fetch_id, unnest([0, 1]) AS i FROM customer WHERE c_custkey % 5 > 1)""")
def p4(v):
    return ingest.ranking_items(ingest.envelope_items(landed(v))).select("fetch_id", "index", "valid")


@query("p2_players", """SELECT c_custkey AS fetch_id, '#P' || c_custkey AS tag, c_name AS name, c_custkey * 3 AS trophies,
  CASE WHEN c_custkey % 2 = 0 THEN '#C' || c_nationkey END AS club_tag FROM customer WHERE c_custkey % 6 <> 0""")
def p2(v):
    body = F.concat(
        F.lit('{"tag":"#P'), "c_custkey", F.lit('","name":"'), F.when(F.col("c_custkey") % 6 == 0, " ").otherwise(F.col("c_name")),
        F.lit('","trophies":'), F.col("c_custkey") * 3,
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(',"club":{"tag":"#C'), "c_nationkey", F.lit('"}'))).otherwise(""), F.lit("}"))
    return ingest.players(v.table("customer").select(F.col("c_custkey").alias("fetch_id"), body.alias("body")))


@query("p3_clubs", """SELECT n_nationkey AS fetch_id, '#C' || n_nationkey AS tag, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS members,
  CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS dropped_members FROM nation""")
def p3(v):
    body = F.concat(
        F.lit('{"tag":"#C'), "n_nationkey", F.lit('","name":"'), "n_name", F.lit('","members":[{"tag":"#M","name":"'),
        F.when(F.col("n_nationkey") % 2 == 0, "m").otherwise(""), F.lit('"},{"name":"no tag"}]}'))
    rows = ingest.clubs(v.table("nation").select(F.col("n_nationkey").alias("fetch_id"), body.alias("body")))
    return rows.withColumn("members", F.size("members"))


def match_log(v: Views) -> DataFrame:
    """Items like those of a match log, good and bad, from orders."""
    one = lambda tag, ent: F.concat(F.lit('{"tag":"'), tag, F.lit('","name":"n","brawler":{"id":'), ent, F.lit(',"power":9}}'))
    a = one(F.concat(F.lit("#A"), F.col("o_custkey")), (F.col("o_orderkey") % 12).cast("string"))
    b = one(F.concat(F.lit("#b"), F.col("o_custkey")), F.lit('"3"'))
    bad = F.lit('{"name":"no tag"}')
    teams = F.concat(F.lit('"teams":[['), a, F.lit(","), bad, F.lit("],["), b, F.lit("],["), bad, F.lit("]]"))
    solo = F.concat(F.lit('"players":['), a, F.lit(","), b, F.lit("]"))
    empty = F.lit('"teams":[[]]')
    kind = F.col("o_orderkey") % 5
    item = F.concat(
        F.lit("{"), F.when(kind == 4, "").otherwise(F.concat(F.lit('"battleTime":"'), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit('.000Z",'))),
        F.lit('"event":{"mode":"'), F.when(kind == 3, " ").otherwise(F.col("o_orderstatus")), F.lit('"},"battle":{"result":"'),
        F.when(kind == 0, "victory").otherwise("trophyless"), F.lit('","rank":2,'),
        F.when(kind == 1, solo).when(kind == 2, empty).otherwise(teams), F.lit("}}"))
    return v.table("orders").select(F.col("o_orderkey").alias("item_id"), item.alias("item"))


@query("p7_match_items", """SELECT item_id, CASE k WHEN 1 THEN 'solo_ranked' ELSE 'teams' END AS structure, CASE k WHEN 2 THEN 0 ELSE 2 END AS n_teams,
  CASE k WHEN 0 THEN 'victory,victory' WHEN 2 THEN '' ELSE 'unknown,unknown' END AS results,
  CASE k WHEN 4 THEN 'missing_time' WHEN 3 THEN 'missing_mode' WHEN 2 THEN 'no_participants' END AS reason
  FROM (SELECT o_orderkey AS item_id, o_orderkey % 5 AS k FROM orders)""")
def p7(v):
    rows = ingest.match_items(match_log(v))
    return rows.select("item_id", "structure", F.size("teams").alias("n_teams"), F.array_join("results", ",").alias("results"), "reason")


@query("p8_match_log_counts", """SELECT coalesce(CASE o_orderkey % 5 WHEN 4 THEN 'missing_time' WHEN 3 THEN 'missing_mode' WHEN 2 THEN 'no_participants' END, 'valid') AS outcome,
  count(*) AS n FROM orders GROUP BY 1""")
def p8(v):
    return ingest.match_items(match_log(v)).groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


KEYED = """SELECT o_orderkey AS item_id, o_orderkey % 12 AS entity, o_custkey, sha256(strftime(o_orderdate, '%Y%m%dT%H%M%S') || '.000Z|' || o_orderstatus
  || '|#A' || o_custkey || '|#B' || o_custkey) AS match_key FROM orders WHERE o_orderkey % 5 < 2"""


def keyed(v: Views) -> DataFrame:
    return ingest.with_match_key(ingest.match_items(match_log(v)).where("reason IS NULL"))


@query("w13_first_observation", f"""SELECT match_key, min(item_id) AS item_id, count(*) AS observations FROM ({KEYED}) GROUP BY 1""")
def w13(v):
    return ingest.first_observations(keyed(v), ["item_id"]).select("match_key", "item_id", "observations")


@query("r8_match_ingestion", f"""SELECT CASE WHEN entity % 10 IN (0) OR entity > 9 THEN 'quarantined' ELSE 'accepted' END AS outcome, count(*) AS matches, min(match_key) AS first_key
  FROM (SELECT match_key, arg_min(entity, item_id) AS entity FROM ({KEYED}) GROUP BY 1) GROUP BY 1""")
def r8(v):
    first = ingest.first_observations(keyed(v), ["item_id"])
    known = v.table("supplier").where("s_suppkey BETWEEN 1 AND 9").select(F.col("s_suppkey").alias("entity_id"))
    good, held = ingest.split_known(first, known)
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count("*").alias("matches"), F.min("match_key").alias("first_key"))
    return count(good, "accepted").union(count(held, "quarantined")).where("matches > 0")


@query("m7_match_teams", f"""SELECT item_id, i AS team_index, CASE WHEN item_id % 5 = 0 THEN 'victory' ELSE 'unknown' END AS result FROM (
  SELECT item_id, unnest([0, 1]) AS i FROM ({KEYED}))""")
def m7(v):
    rows = keyed(v).select("item_id", "results", F.posexplode("teams").alias("team_index", "team"))
    return rows.select("item_id", "team_index", F.get("results", F.col("team_index")).alias("result"))


@query("p6_participants", f"""SELECT item_id, i AS team_index, CASE i WHEN 0 THEN '#A' ELSE '#b' END || o_custkey AS tag, CASE i WHEN 0 THEN CAST(entity AS VARCHAR) ELSE '3' END AS entity_id
  FROM (SELECT *, unnest([0, 1]) AS i FROM ({KEYED}))""")
def p6(v):
    rows = keyed(v).withColumn("match_key", F.col("item_id"))
    return ingest.participations(rows).select(F.col("match_key").alias("item_id"), "team_index", "tag", "entity_id")


@query("m8_distinct_observations", "SELECT match_id, fetch_id, min(observation_id) AS first_id FROM observations GROUP BY 1, 2")
def m8(v):
    return v.observations.groupBy("match_id", "fetch_id").agg(F.min("observation_id").alias("first_id"))


@query("m1_mode_dimension", """SELECT coalesce(c.mode, s.mode) AS mode, coalesce(c.first_seen, s.at) AS first_seen, greatest(c.last_seen, s.at) AS last_seen,
  coalesce(CASE WHEN s.at IS NOT NULL THEN true END, c.is_active) AS is_active FROM (SELECT DISTINCT p_type AS mode, TIMESTAMP '1990-01-01' AS first_seen,
  TIMESTAMP '1999-01-01' AS last_seen, false AS is_active FROM part UNION ALL SELECT '5-LOW', TIMESTAMP '1990-01-01', TIMESTAMP '1999-01-01', false) c
  FULL OUTER JOIN (SELECT mode, max(occurred_at) AS at FROM matches WHERE mode IS NOT NULL GROUP BY 1) s ON c.mode = s.mode""")
def m1(v):
    old = v.table("part").select(F.col("p_type").alias("mode")).distinct().union(v.spark.range(1).select(F.lit("5-LOW")))
    old = old.selectExpr("mode", "TIMESTAMP_NTZ '1990-01-01' AS first_seen", "TIMESTAMP_NTZ '1999-01-01' AS last_seen", "false AS is_active")
    return ingest.dimension_rows(old, v.matches, "mode", "occurred_at")


@query("m2_player_stubs", "SELECT DISTINCT player_id FROM matches WHERE player_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def m2(v):
    known = v.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("player_id"))
    return v.matches.select("player_id").distinct().join(known, "player_id", "left_anti")


@query("m4_observed_players", f"""SELECT tag, min(id) AS id FROM (SELECT id, CASE WHEN starts_with(upper(trim(raw)), '#') THEN upper(trim(raw)) ELSE '#' || upper(trim(raw)) END AS tag
  FROM (SELECT c_custkey AS id, {TAGS} AS raw FROM customer)) WHERE length(tag) BETWEEN 4 AND 16 AND regexp_full_match(tag, '#[0289PYLQGRJCUV]+') GROUP BY 1""")
def m4(v):
    return ingest.observed_players(v.table("customer").selectExpr("c_custkey AS id", f"{TAGS} AS raw"), "raw", ["id"]).select("tag", "id")


@query("m6_latest_club", "SELECT user_id AS club, arg_max(event_type, (ts, event_id)) AS name, max(ts) AS seen FROM events GROUP BY 1")
def m6(v):
    return v.table("events").groupBy(F.col("user_id").alias("club")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("name"), F.max("ts").alias("seen"))


# ---- catalog ------------------------------------------------------------

@query("p9_catalog_items", """SELECT s_suppkey AS index, CASE WHEN s_suppkey % 5 > 1 THEN CAST(s_suppkey AS VARCHAR) END AS id,
  CASE WHEN s_suppkey % 5 IN (1, 3, 4) THEN s_name END AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'missing_or_invalid_id' WHEN 2 THEN 'missing_or_invalid_name' END AS reason FROM supplier""")
def p9(v):
    k = F.col("s_suppkey") % 5
    item = F.when(k == 0, "17").otherwise(F.concat(
        F.lit("{"), F.when(k > 1, F.concat(F.lit('"id":'), "s_suppkey", F.lit(","))).otherwise('"id":" ",'),
        F.lit('"name":"'), F.when(k == 2, " ").otherwise(F.col("s_name")), F.lit('"}')))
    return catalog.validate_items(v.table("supplier").select(F.col("s_suppkey").alias("index"), item.alias("item")))


ITEMS = """SELECT s_suppkey AS entity_id, s_name AS name, s_nationkey AS nation FROM supplier"""


def snapshot(v: Views, drop: int, extra: int) -> DataFrame:
    items = F.array_compact(F.array(*[
        F.when((F.col("entity_id") + i) % extra != 0, F.struct(F.lit(f"i{i}").alias("id"), F.lit(f"item {i}").alias("name"))) for i in range(4)]))
    rows = v.catalog.where(F.col("entity_id") % drop != 0).select("entity_id", "name", items.alias("items"))
    return catalog.checksum(rows, "entity_id", "name", "items")


@query("c1_entity_changes", """SELECT entity_id, 'new_entity' AS change, NULL AS field, NULL AS old_value, name AS new_value, 'info' AS severity FROM catalog WHERE entity_id % 7 <> 0 AND entity_id % 5 = 0
UNION ALL SELECT entity_id, 'item_change', 'i' || i, NULL, 'item ' || i, 'info' FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM catalog WHERE entity_id % 7 <> 0 AND entity_id % 5 <> 0)
  WHERE (entity_id + i) % 4 <> 0 AND (entity_id + i) % 3 = 0
UNION ALL SELECT entity_id, 'item_change', 'i' || i, 'item ' || i, NULL, 'warning' FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM catalog WHERE entity_id % 7 <> 0 AND entity_id % 5 <> 0)
  WHERE (entity_id + i) % 4 = 0 AND (entity_id + i) % 3 <> 0""")
def c1(v):
    return catalog.entity_changes(snapshot(v, 7, 4), snapshot(v, 5, 3))


@query("u5_subitem_diff", """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN (entity_id + i) % 4 <> 0 THEN 'info' ELSE 'warning' END AS severity
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM catalog WHERE entity_id % 7 <> 0 AND entity_id % 5 <> 0) WHERE ((entity_id + i) % 4 <> 0) <> ((entity_id + i) % 3 <> 0)) GROUP BY 1""")
def u5(v):
    changes = catalog.entity_changes(snapshot(v, 7, 4), snapshot(v, 5, 3)).where("change = 'item_change'")
    return changes.groupBy("severity").agg(F.count("*").alias("n"))


@query("u4_removed_entities", "SELECT entity_id, name FROM catalog WHERE (entity_id % 5 <> 0 OR entity_id % 7 = 0) AND entity_id % 7 = 0")
def u4(v):
    return catalog.removed_entities(v.catalog.where("(entity_id % 5 <> 0 OR entity_id % 7 = 0)"), v.catalog.where("entity_id % 7 <> 0")).select("entity_id", "name")


@query("c2_removals", "SELECT entity_id, 'removed_or_deprecated' AS change FROM catalog WHERE (entity_id % 5 <> 0 OR entity_id % 7 = 0) AND entity_id % 7 = 0")
def c2(v):
    gone = catalog.removed_entities(v.catalog.where("(entity_id % 5 <> 0 OR entity_id % 7 = 0)"), v.catalog.where("entity_id % 7 <> 0"))
    return gone.select("entity_id", F.lit("removed_or_deprecated").alias("change"))


@query("c3_volume_anomaly", """SELECT *, round(removed / previous, 3) AS removed_ratio, CASE WHEN removed / previous > 0.5 THEN 'unexpected_mass_change' END AS incident,
  removed / previous > 0.5 AS blocks FROM (SELECT count(*) FILTER (WHERE entity_id % 5 <> 0) AS previous, count(*) FILTER (WHERE entity_id % 3 = 0) AS new,
  count(*) FILTER (WHERE entity_id % 5 <> 0 AND entity_id % 3 <> 0) AS removed FROM catalog)""")
def c3(v):
    return catalog.volume_anomaly(v.catalog.where("entity_id % 5 <> 0"), v.catalog.where("entity_id % 3 = 0"))


@query("c4_catalog_merge", """SELECT entity_id, CASE WHEN entity_id % 7 <> 0 AND entity_id % 4 = 0 THEN name || ' II' ELSE name END AS name,
  CASE WHEN (entity_id % 5 <> 0 OR entity_id % 7 = 0) THEN 'kept-' || entity_id ELSE lower(replace(CASE WHEN entity_id % 4 = 0 THEN name || ' II' ELSE name END, '#', '-').replace(' ', '-')) END AS slug,
  CASE WHEN (entity_id % 5 <> 0 OR entity_id % 7 = 0) AND entity_id % 7 <> 0 AND entity_id % 4 = 0 THEN name END AS alias, entity_id % 7 <> 0 AS is_active,
  CASE WHEN entity_id % 7 <> 0 THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '2000-01-01' END AS last_seen FROM catalog WHERE (entity_id % 5 <> 0 OR entity_id % 7 = 0) OR entity_id % 7 <> 0""")
def c4(v):
    current = v.catalog.where("(entity_id % 5 <> 0 OR entity_id % 7 = 0)").selectExpr("entity_id", "name", "concat('kept-', entity_id) AS slug", "TIMESTAMP_NTZ '2000-01-01' AS last_seen")
    incoming = v.catalog.where("entity_id % 7 <> 0").selectExpr("entity_id", "CASE WHEN entity_id % 4 = 0 THEN name || ' II' ELSE name END AS name")
    return catalog.merge_catalog(current, incoming, F.lit("2001-08-02").cast("timestamp_ntz"))


@query("c5_version_inference", """SELECT DISTINCT o_orderstatus AS label, CASE WHEN o_orderstatus = 'O' THEN 'superseded' ELSE 'old' END AS status FROM orders
UNION ALL SELECT 'internal-20010802T000000Z', 'active'""")
def c5(v):
    versions = v.table("orders").select(F.col("o_orderstatus").alias("label")).distinct().withColumn(
        "status", F.when(F.col("label") == "O", "active").otherwise("old"))
    return catalog.infer_version(catalog.entity_changes(snapshot(v, 7, 4), snapshot(v, 5, 3)), versions, F.lit(AS_OF).cast("timestamp"))


@query("p16_catalog_checksum", """SELECT s_suppkey AS entity_id, sha256('{"entity_id":' || s_suppkey || ',"name":"' || s_name || '","nation":' || s_nationkey || '}') AS checksum FROM supplier""")
def p16(v):
    return catalog.checksum(v.catalog, "entity_id", "name", "nation").select("entity_id", "checksum")


@query("g40_incident_dedup", """SELECT event_type AS kind, user_id % 10 AS signature, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def g40(v):
    return v.table("events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("signature")).agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("w12_name_changes", """SELECT row_id, player_id, entity AS name, previous FROM (SELECT *, lag(entity) OVER (PARTITION BY player_id ORDER BY occurred_at, row_id) AS previous FROM cap_rows)
  WHERE previous IS NULL OR previous <> entity""")
def w12(v):
    from pyspark.sql import Window

    rows = v.cap_rows.withColumn("previous", F.lag("entity").over(Window.partitionBy("player_id").orderBy("occurred_at", "row_id")))
    return rows.where("previous IS NULL OR previous <> entity").select("row_id", "player_id", F.col("entity").alias("name"), "previous")


# ---- sampling -----------------------------------------------------------

SCHEDULE = {
    "id": "c_custkey", "region": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END", "next_due": "DATE '2001-01-01' + CAST(c_custkey % 400 AS INT)",
    "priority": "c_custkey % 5", "is_active": "c_custkey % 11 <> 0", "backoff_until": "CASE WHEN c_custkey % 4 = 0 THEN DATE '2001-06-01' + CAST(c_custkey % 100 AS INT) END",
    "leased_until": "CASE WHEN c_custkey % 6 = 0 THEN DATE '2001-07-20' + CAST(c_custkey % 30 AS INT) END",
}
SCHEDULE_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in SCHEDULE.items())} FROM customer"
DUE_SQL = f"""SELECT * FROM ({SCHEDULE_SQL}) WHERE is_active AND next_due <= DATE '2001-08-02' AND (backoff_until IS NULL OR backoff_until <= DATE '2001-08-02')
  AND (leased_until IS NULL OR leased_until < DATE '2001-08-02')"""


def due(v: Views) -> DataFrame:
    return sampling.due(v.table("customer").selectExpr(*[f"{e} AS {n}" for n, e in SCHEDULE.items()]), F.lit("2001-08-02").cast("date"))


@query("p20_due_queue", f"SELECT id FROM ({DUE_SQL})")
def p20(v):
    return due(v).select("id")


@query("p21_unprofiled_players", "SELECT player_id, name FROM players WHERE trophies < 0 ORDER BY name, player_id LIMIT 20")
def p21(v):
    return v.players.where("trophies < 0").orderBy("name", "player_id").limit(20).select("player_id", "name")


@query("w4_fair_batch", f"""SELECT id, region, k AS round FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(region, 'unknown') ORDER BY next_due, priority DESC, id) AS k FROM ({DUE_SQL}))
  ORDER BY k, coalesce(region, 'unknown') LIMIT 50""")
def w4(v):
    stratum = F.coalesce("region", F.lit("unknown"))
    rows = sampling.fair_batch(due(v), [stratum], [F.col("next_due"), F.desc("priority"), F.col("id")], 50)
    return rows.select("id", "region", F.col("round"))


@query("w5_fetch_limit", f"SELECT id, least(2000, greatest(200, n * 8)) AS n FROM ({NUMBERS})")
def w5(v):
    return numbers(v).select("id", sampling.fetch_limit(F.col("n")).alias("n"))


@query("w6_promotion_batch", """SELECT id, fine, k AS round FROM (SELECT id, fine, row_number() OVER (PARTITION BY fine ORDER BY id) AS k, coalesce(c.n, 0) AS n
  FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'club_member:' || c_nationkey ELSE c_mktsegment END AS fine,
    CASE WHEN c_custkey % 3 = 0 THEN 'club_member' ELSE c_mktsegment END AS coarse FROM customer) x
  LEFT JOIN (SELECT c_mktsegment AS coarse, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) c ON x.coarse = c.coarse) ORDER BY k, n, fine LIMIT 40""")
def w6(v):
    c = v.table("customer")
    club = F.col("c_custkey") % 3 == 0
    rows = c.select(
        F.col("c_custkey").alias("id"), F.when(club, F.concat(F.lit("club_member:"), "c_nationkey")).otherwise(F.col("c_mktsegment")).alias("fine"),
        F.when(club, "club_member").otherwise(F.col("c_mktsegment")).alias("coarse"))
    counts = c.where("c_custkey % 2 = 0").groupBy(F.col("c_mktsegment").alias("coarse")).agg(F.count("*").alias("n"))
    rows = rows.join(counts, "coarse", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sampling.fair_batch(rows, [F.col("fine")], [F.col("id")], 40, [F.col("n"), F.col("fine")]).select("id", "fine", "round")


@query("c9_crawl_outcome", f"""SELECT id, CASE WHEN k < 2 THEN 0 ELSE f + 1 END AS next_failures,
  CASE k WHEN 0 THEN 120.0 WHEN 1 THEN 720.0 WHEN 2 THEN least(1440.0, 10 * pow(2, f)) END AS delay_minutes,
  round(CASE WHEN k < 2 THEN least(10.0, p + 0.1) ELSE greatest(-10.0, p - 0.5) END, 4) AS next_priority, k <> 3 AS stays_active
  FROM (SELECT id, id % 4 AS k, m % 9 AS f, n / 13.0 - 10 AS p FROM ({NUMBERS}))""")
def c9(v):
    rows = numbers(v).selectExpr(
        "id", "CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'empty' WHEN 2 THEN 'failure' ELSE 'dead' END AS outcome", "m % 9 AS failures", "n / 13.0D - 10 AS priority")
    out = sampling.crawl_outcome(rows)
    return out.select("id", "next_failures", "delay_minutes", F.round("next_priority", 4).alias("next_priority"), "stays_active")


UPSERTS = "SELECT user_id AS player, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_type END AS region, CASE WHEN event_id % 4 = 0 THEN value END AS level FROM events"


def upserts(v: Views) -> DataFrame:
    return v.table("events").selectExpr(
        "user_id AS player", "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN event_type END AS region", "CASE WHEN event_id % 4 = 0 THEN value END AS level")


@query("c10_sticky_upsert", f"""SELECT player, arg_min(region, seq) FILTER (WHERE region IS NOT NULL) AS region, arg_min(level, seq) FILTER (WHERE level IS NOT NULL) AS level FROM ({UPSERTS}) GROUP BY 1""")
def c10(v):
    return sampling.sticky_merge(upserts(v), "player", ["region", "level"], ["seq"])


@query("c11_refresh_upsert", f"""SELECT player, arg_max(region, seq) FILTER (WHERE region IS NOT NULL) AS region, arg_max(level, seq) FILTER (WHERE level IS NOT NULL) AS level FROM ({UPSERTS}) GROUP BY 1""")
def c11(v):
    return sampling.refresh_merge(upserts(v), "player", ["region", "level"], ["seq"])


#: A row at a time, as the counter of a scope would: the state is what has been used.
GRANTED = "place <= 4 OR (priority AND urgent - common <= 2)"
PLACED = """SELECT *, coalesce(max(urgent) FILTER (WHERE place <= 4) OVER (PARTITION BY scope, {slot}), 0) AS common FROM (
  SELECT *, row_number() OVER w AS place, sum(CASE WHEN priority THEN 1 ELSE 0 END) OVER w AS urgent FROM ({rows})
  WINDOW w AS (PARTITION BY scope, {slot} ORDER BY ts, id))"""
REQUESTS = ("event_id AS id", "event_type AS scope", "user_id % 5 = 0 AS priority")


@query("c13_rate_budget", f"""SELECT id, scope, slot, {GRANTED} AS granted FROM ({PLACED.format(
    slot="slot", rows=f"SELECT {', '.join(REQUESTS)}, ts, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS slot FROM events")})""")
def c13(v):
    rows = v.table("events").selectExpr(*REQUESTS, "ts AS at")
    return sampling.rate_budget(rows, 3600, 6, 2, ["at", "id"]).select("id", "scope", "slot", "granted")


#: Each step looks for the first request behind the end of a window.
ANCHORED = """RECURSIVE requests AS MATERIALIZED (SELECT DISTINCT event_type AS scope, epoch_us(ts) // 1000 AS ms FROM events),
follows AS MATERIALIZED (SELECT a.scope, a.ms, b.ms AS begun FROM requests a ASOF LEFT JOIN requests b ON a.scope = b.scope AND a.ms + 21600000 <= b.ms),
windows AS (SELECT scope, min(ms) AS begun FROM requests GROUP BY 1
  UNION ALL SELECT w.scope, f.begun FROM windows w JOIN follows f ON w.scope = f.scope AND w.begun = f.ms WHERE f.begun IS NOT NULL)"""


@query("x5_anchored_windows", f"""WITH {ANCHORED} SELECT w.scope, w.begun AS window_start, count(*) AS used FROM events e
ASOF JOIN windows w ON e.event_type = w.scope AND epoch_us(e.ts) // 1000 >= w.begun GROUP BY 1, 2""")
def x5_anchored(v):
    rows = v.table("events").selectExpr("event_type AS scope", "ts AS at")
    return budgets.in_windows(rows, 21600).groupBy("scope", "window_start").agg(F.count("*").alias("used"))


IN_WINDOWS = f"""SELECT {', '.join(REQUESTS)}, ts, w.begun FROM events e
  ASOF JOIN windows w ON e.event_type = w.scope AND epoch_us(e.ts) // 1000 >= w.begun"""


@query("c13_anchored_budget", f"""WITH {ANCHORED}, placed AS ({PLACED.format(slot="begun", rows=IN_WINDOWS)})
SELECT id, scope, begun AS window_start, {GRANTED} AS granted FROM placed""")
def c13_anchored(v):
    rows = budgets.in_windows(v.table("events").selectExpr(*REQUESTS, "ts AS at"), 21600)
    return budgets.grant(rows, ["scope", "window_start"], ["at", "id"], 6, 2).select("id", "scope", "window_start", "granted")


#: Budgets beside the requests that they govern: an event's kind stands for a scope.
SCOPE_OF = {"click": "log", "view": "profile", "purchase": "catalog", "signup": "club", "error": "global"}
SCOPE_SQL = f"CASE event_type {' '.join(f"WHEN '{k}' THEN '{s}'" for k, s in SCOPE_OF.items())} END"


@query("s22_budget_seeds", f"""SELECT scope, window_s, ceiling, reserve, coalesce(max(n), 0) AS busiest, CAST(coalesce(sum(n), 0) AS BIGINT) AS requests
FROM (VALUES ('global', 86400, 5000, 200), ('catalog', 86400, 50, 0), ('rankings', 86400, 300, 0),
  ('profile', 3600, 500, 0), ('log', 3600, 1000, 0), ('club', 86400, 200, 0)) t(scope, window_s, ceiling, reserve)
LEFT JOIN (SELECT {SCOPE_SQL} AS s, w, floor(epoch(ts) / w) AS slot, count(*) AS n FROM events, (VALUES (3600), (86400)) x(w) GROUP BY ALL)
  ON s = scope AND w = window_s GROUP BY 1, 2, 3, 4""")
def s22(v):
    seeds = v.spark.createDataFrame(sampling.BUDGETS, "scope string, window_s int, ceiling int, reserve int")
    return sampling.budget_use(seeds, v.table("events").selectExpr(f"{SCOPE_SQL} AS scope", "ts AS at"))
