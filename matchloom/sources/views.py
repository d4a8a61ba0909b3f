"""Domain views over the star-schema tables.

``VIEWS`` gives each single-table view as expressions that Spark and the SQL
twins share; what needs a join or a rule is written twice, here with the
DataFrame API and in ``DERIVED_SQL`` as SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "matches": ("orders", {
        "match_id": "o_orderkey", "player_id": "o_custkey", "occurred_at": "o_orderdate",
        "mode": "nullif(o_orderpriority, '4-NOT SPECIFIED')", "version": "nullif(o_orderstatus, 'P')",
    }),
    "participations": ("lineitem", {
        "match_id": "l_orderkey", "entity_id": "l_suppkey", "line": "l_linenumber", "item": "l_partkey",
        "price": "l_extendedprice", "shipped_at": "l_shipdate",
        "team_id": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey * 2 + l_linenumber % 2 END",
    }),
    "entities": ("supplier", {
        "entity_id": "s_suppkey", "name": "s_name", "is_active": "s_suppkey % 10 <> 0", "balance": "s_acctbal",
    }),
    "observations": ("events", {
        "observation_id": "event_id", "match_id": "event_id % 5000", "fetch_id": "user_id", "observed_at": "ts",
        "kind": "event_type",
    }),
    "cap_rows": ("events", {
        "row_id": "event_id", "player_id": "user_id", "entity": "event_type", "occurred_at": "ts", "amount": "value",
    }),
    "runs": ("orders", {
        "run_id": "o_orderkey", "workflow_id": "o_custkey", "scope": "o_orderkey % 3", "started_at": "o_orderdate",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'succeeded_with_warnings' END",
        "cost": "o_totalprice",
    }),
    "source_rows": ("part", {"id": "p_partkey", "name": "p_name", "price": "p_retailprice"}),
    "target_base": ("part", {
        "id": "p_partkey", "name": "p_name",
        "price": "CASE WHEN p_partkey % 17 = 0 THEN p_retailprice + 1 ELSE p_retailprice END",
    }),
    "catalog": ("supplier", {"entity_id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"}),
}
DERIVED_SQL = {
    "teams": """SELECT DISTINCT l_orderkey AS match_id, l_linenumber % 2 AS team_index,
        l_orderkey * 2 + l_linenumber % 2 AS team_id,
        CASE (l_orderkey + l_linenumber % 2) % 4 WHEN 0 THEN 'victory' WHEN 1 THEN 'defeat' WHEN 2 THEN 'draw'
          ELSE 'unknown' END AS result FROM lineitem""",
    "players": """SELECT c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE r_name END AS region,
        CAST(floor(c_acctbal * 8) AS BIGINT) AS trophies,
        CASE WHEN c_acctbal IS NULL OR floor(c_acctbal * 8) < 0 THEN 'unranked' WHEN floor(c_acctbal * 8) < 5000 THEN '0-5k'
          WHEN floor(c_acctbal * 8) < 15000 THEN '5k-15k' WHEN floor(c_acctbal * 8) < 30000 THEN '15k-30k'
          WHEN floor(c_acctbal * 8) < 50000 THEN '30k-50k' WHEN floor(c_acctbal * 8) < 75000 THEN '50k-75k'
          ELSE '75k+' END AS bracket
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "target_rows": "SELECT * FROM target_base WHERE id % 13 <> 0",
    "facts": """SELECT p.*, m.player_id, m.occurred_at, m.mode, m.version, t.result
        FROM participations p JOIN matches m ON p.match_id = m.match_id LEFT JOIN teams t ON p.team_id = t.team_id""",
    "mode_stats": """SELECT f.entity_id, f.mode, f.version, count(*) AS matches,
        count(*) FILTER (WHERE result = 'victory') AS wins, count(*) FILTER (WHERE result = 'defeat') AS losses,
        count(*) FILTER (WHERE result = 'draw') AS draws, max(occurred_at) AS latest
        FROM facts f JOIN entities e ON f.entity_id = e.entity_id WHERE e.is_active AND f.mode IS NOT NULL
        GROUP BY f.entity_id, f.mode, f.version""",
    "pair_stats": """SELECT a.entity_id, b.entity_id AS opponent_id, m.mode, m.version, count(*) AS matches,
        count(*) FILTER (WHERE t.result = 'victory') AS wins, count(*) FILTER (WHERE t.result = 'defeat') AS losses
        FROM participations a JOIN participations b ON a.match_id = b.match_id AND a.team_id <> b.team_id
          AND a.entity_id <> b.entity_id
        JOIN matches m ON a.match_id = m.match_id JOIN teams t ON a.team_id = t.team_id
        JOIN entities e ON a.entity_id = e.entity_id
        WHERE e.is_active AND m.mode IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "ranked": """SELECT f.*, pl.region, pl.bracket FROM (
        SELECT f.*, row_number() OVER (PARTITION BY f.entity_id, f.player_id
          ORDER BY f.occurred_at DESC, f.match_id, f.line, f.item, f.price, f.shipped_at) AS place
        FROM facts f JOIN entities e ON f.entity_id = e.entity_id WHERE e.is_active) f
        LEFT JOIN players pl ON f.player_id = pl.player_id WHERE place <= 20""",
}


class Views:
    """The tables and views of one folder, each read once it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source, columns = VIEWS[name]
        return self.table(source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    @cached_property
    def teams(self) -> DataFrame:
        rows = self.table("lineitem").select(
            F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2).alias("team_index")
        ).distinct()
        turn = F.pmod(F.col("match_id") + F.col("team_index"), F.lit(4))
        result = F.when(turn == 0, "victory").when(turn == 1, "defeat").when(turn == 2, "draw").otherwise("unknown")
        return rows.withColumn("team_id", F.col("match_id") * 2 + F.col("team_index")).withColumn("result", result)

    @cached_property
    def players(self) -> DataFrame:
        rows = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        trophies = F.floor(F.col("c_acctbal") * 8)
        return rows.select(
            F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 7 != 0, F.col("r_name")).alias("region"), trophies.alias("trophies"),
            scalars.bracket(trophies).alias("bracket"),
        )

    @cached_property
    def target_rows(self) -> DataFrame:
        return self.target_base.where("id % 13 <> 0")


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names, each after those it needs."""
    def text(name: str) -> str:
        if name in DERIVED_SQL:
            return DERIVED_SQL[name]
        source, columns = VIEWS[name]
        return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"

    order: list[str] = []

    def need(body: str) -> None:
        for name in [*VIEWS, *DERIVED_SQL]:
            if name not in order and re.search(rf"\b{name}\b", body):
                need(text(name))
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({text(n)})" for n in order)
    sql = sql.strip()
    return f"WITH {ctes},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes}\n{sql}"
