"""Registered queries of the operators in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, order_minhash, secrets
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < 3)

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"),
    )


#: The patterns again, without look-around and without case folding beyond ASCII.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_WORDS = r"[A-Za-z0-9]{0,20}(?:(?:(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,})|(?:(?i)abcdefgh|01234567|12345678|qwertyui))[A-Za-z0-9]{0,20}"
OP1_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, rank, pattern) AS (VALUES
  ('assign', 0, '{_ASSIGN}'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{{24,}}'), ('cand', 9, '[A-Za-z0-9+/_=-]{{20,}}'),
  ('chain', 9, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+){{2,}}')),
found AS (
  SELECT r, t, kind, rank, pattern, regexp_extract_all(t, pattern, 0) AS m, string_split_regex(t, pattern) AS p
  FROM docs, kinds WHERE regexp_matches(t, pattern)),
hits AS (
  SELECT r, kind, rank, pattern, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1),
    lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM found),
base AS (
  SELECT r, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM hits
  WHERE (kind = 'assign' AND length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6)
    OR (kind = 'access' AND length(m) >= 20) OR kind = 'hex'),
parts AS (
  SELECT h, r, m, s, i, p, s + list_sum(list_transform(x[1:i], lambda y: length(y))) + i - 1 - length(p) AS pos FROM (
    SELECT row_number() OVER () AS h, r, m, s, string_split(m, '-') AS x, unnest(string_split(m, '-')) AS p,
      unnest(range(1, length(m) - length(replace(m, '-', '')) + 2)) AS i
    FROM hits WHERE kind = 'chain' AND length(m) >= 20)),
-- parts that follow one another with one length
runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY h, length(p) ORDER BY i) AS run FROM parts WHERE length(p) BETWEEN 4 AND 8),
groups AS (
  SELECT r, string_agg(p, '-' ORDER BY i) AS m, min(pos) AS s FROM runs
  GROUP BY h, r, length(p), run HAVING count(*) * length(p) >= 20 AND count(*) > 1),
cand AS (
  SELECT row_number() OVER () AS c, r, CASE WHEN kind = 'cand' THEN m ELSE replace(m, '-', '') END AS m, CAST(s AS BIGINT) AS pos,
    kind, length(m) AS whole
  FROM (SELECT r, m, s, kind FROM hits WHERE kind = 'cand' UNION ALL SELECT r, m, s, 'group' FROM groups)
  WHERE regexp_matches(m, '[0-9]|[A-Z].*[A-Z]') AND NOT regexp_full_match(m, '[A-Za-z0-9+/]{{0,40}}EXAMPLEKEY')
    AND NOT regexp_full_match(m, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
    AND NOT (regexp_full_match(m, '[a-z0-9/_-]+') AND NOT regexp_matches(m, '[0-9][a-z]'))
    AND NOT regexp_full_match(m, '[0-9+/_=-]+')),
marks AS (
  SELECT c, list_transform(range(1, len(w) + 1), lambda i: {{'a':
      list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0),
      'n': length(w[i])}}) AS marks
  FROM (SELECT c, regexp_extract_all(m, '{_WORDS}', 0) AS w, string_split_regex(m, '{_WORDS}') AS p FROM cand)),
windows AS (
  SELECT c, r, pos, k, substr(m, k + 1, 20) AS w, string_split(substr(m, k + 1, 20), '') AS x, marks
  FROM (SELECT c, r, pos, m, marks, unnest(range(0, length(m) - 19)) AS k FROM cand JOIN marks USING (c))),
judged AS (
  SELECT *, list_aggregate(x, 'entropy') AS bits, length(regexp_replace(w, '[^A-Z]', '', 'g')) AS uppers,
    len(list_filter(range(2, 21), lambda i: regexp_matches(x[i], '[A-Z]') <> regexp_matches(x[i - 1], '[A-Z]'))) AS cases,
    len(list_filter(range(2, 21), lambda i: regexp_matches(x[i], '[0-9]') <> regexp_matches(x[i - 1], '[0-9]'))) AS turns
  FROM windows WHERE len(list_filter(marks, lambda q: q.a < k + 20 AND q.a + q.n > k)) = 0),
flagged AS (
  SELECT c, r, pos, k, CASE
    WHEN NOT regexp_matches(w, '[0-9]') THEN CASE WHEN regexp_full_match(w, '[A-Za-z]+')
      AND uppers BETWEEN 8 AND 15 AND cases >= 7 AND bits >= 3.7 THEN 4 END
    WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN CASE WHEN regexp_matches(w, '[a-fA-F]') AND bits >= 3.0 THEN 3 END
    WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') THEN CASE WHEN bits >= 3.5 THEN 4 END
    WHEN regexp_full_match(w, '[0-9a-z]+') THEN CASE WHEN bits >= 3.4 AND turns >= 5 THEN 5 END
    WHEN regexp_full_match(w, '[0-9A-Z]+') THEN CASE WHEN bits >= 3.4 AND turns >= 4 THEN 6 END END AS rank
  FROM judged),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY c, rank ORDER BY k) AS island FROM (
    SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY c, rank ORDER BY k) + 20 THEN 0 ELSE 1 END AS fresh
    FROM flagged WHERE rank IS NOT NULL AND c IN (SELECT c FROM cand WHERE kind = 'cand'))),
entropy AS (
  SELECT r, ['entropy_hex', 'entropy_base64', 'entropy_lower', 'entropy_upper'][rank - 2] AS kind, rank, s, e FROM (
    SELECT r, c, rank, island, min(pos + k) AS s, max(pos + k) + 20 AS e FROM islands GROUP BY r, c, rank, island)
  UNION ALL SELECT r, 'entropy_groups', 7, pos, pos + whole FROM cand
  WHERE kind = 'group' AND c IN (SELECT c FROM flagged WHERE rank IS NOT NULL)),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM entropy n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = n.r AND b.s <= n.s AND n.e <= b.e)),
digests AS (
  SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digests USING (r)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat.events_from_turns(table(spark, sf_dir, "conversations"))
    events = events.select(*chat.EVENT_COLUMNS).unionByName(chat.hostile_conversation(spark))
    out = chat.read_back(chat.format_conversations(events))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + 8
    + length(role) - length(translate(role, '\<#:', '')) + length(text) - length(translate(text, '\<#', ''))) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    own = F.col("fingerprint")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint_text(own).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        order_minhash.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        order_minhash.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op6_chat_format": op6_chat_format,
    "op10_order_minhash": op10_order_minhash,
}
ORACLE_SQL = {"op1_secret_scan": OP1_SQL, "op6_chat_format": OP6_SQL}
