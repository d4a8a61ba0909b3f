"""Validation of landed JSON payloads, and what becomes of valid items.

All parsing is schema-on-read: required fields are checked, unknown fields are
ignored, and bad items are rejected one by one with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

PARTICIPANT = "struct<tag:string,name:string,brawler:struct<id:string,name:string,power:bigint,trophies:bigint>>"
MATCH_ITEM = (
    "struct<battleTime:string,event:struct<id:bigint,mode:string,map:string>,"
    "battle:struct<type:string,result:string,duration:bigint,trophyChange:bigint,rank:bigint,"
    f"starPlayer:struct<tag:string>,teams:array<array<{PARTICIPANT}>>,players:array<{PARTICIPANT}>>>"
)
ENVELOPE = "struct<ok:boolean,status:int,fetchedAt:string,payload:struct<items:array<string>>>"


def envelope_items(landed: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of each good envelope: the input's columns, index, item."""
    parsed = landed.withColumn("_e", F.from_json(body, ENVELOPE))
    good = parsed.where(F.col("_e.ok") & F.col("_e.payload.items").isNotNull())
    return good.select(*landed.columns, F.posexplode("_e.payload.items").alias("index", "item"))


def envelope_status(landed: DataFrame, body: str = "body") -> DataFrame:
    """Whether each envelope holds a payload of items."""
    e = F.from_json(body, ENVELOPE)
    ok = F.coalesce(e["ok"], F.lit(False)) & e["payload"]["items"].isNotNull()
    return landed.withColumn("accepted", ok).withColumn("n_items", F.when(ok, F.size(e["payload"]["items"])))


def players(landed: DataFrame, body: str = "body") -> DataFrame:
    """Player payloads with a tag and a name; the rest is dropped."""
    p = F.from_json(body, "struct<tag:string,name:string,trophies:bigint,club:struct<tag:string>>")
    rows = landed.select(
        *[c for c in landed.columns if c != body], scalars.clean_text(p["tag"]).alias("tag"),
        scalars.clean_text(p["name"]).alias("name"), p["trophies"].alias("trophies"),
        scalars.clean_text(p["club"]["tag"]).alias("club_tag"),
    )
    return rows.where("tag IS NOT NULL AND name IS NOT NULL")


def clubs(landed: DataFrame, body: str = "body") -> DataFrame:
    """Club payloads; members without tag or name are left out and counted."""
    c = F.from_json(body, "struct<tag:string,name:string,members:array<struct<tag:string,name:string,role:string>>>")
    rows = landed.select(
        *[x for x in landed.columns if x != body], scalars.clean_text(c["tag"]).alias("tag"),
        scalars.clean_text(c["name"]).alias("name"), F.coalesce(c["members"], F.array().cast(
            "array<struct<tag:string,name:string,role:string>>")).alias("all_members"),
    ).where("tag IS NOT NULL AND name IS NOT NULL")
    good = F.filter("all_members", lambda m: scalars.clean_text(m["tag"]).isNotNull() & scalars.clean_text(m["name"]).isNotNull())
    return rows.withColumn("members", good).withColumn(
        "dropped_members", F.size("all_members") - F.size("members")).drop("all_members")


def ranking_items(items: DataFrame, item: str = "item") -> DataFrame:
    """Player ranking items with a verdict."""
    r = F.from_json(item, "struct<tag:string,name:string,rank:bigint,trophies:bigint>")
    return items.select(
        *[c for c in items.columns if c != item], scalars.clean_text(r["tag"]).alias("tag"),
        scalars.clean_text(r["name"]).alias("name"), r["rank"].alias("rank"), r["trophies"].alias("trophies"),
    ).withColumn("valid", F.expr("tag IS NOT NULL AND name IS NOT NULL AND rank IS NOT NULL"))


def _participant(p: Column) -> Column:
    return F.struct(
        scalars.clean_text(p["tag"]).alias("tag"), scalars.clean_text(p["name"]).alias("name"),
        scalars.clean_text(p["brawler"]["id"]).alias("entity_id"), scalars.clean_text(p["brawler"]["name"]).alias("entity_name"),
        p["brawler"]["power"].alias("power"), p["brawler"]["trophies"].alias("trophies"),
    )


def match_items(items: DataFrame, item: str = "item", result_policy: str = "observer") -> DataFrame:
    """Match items with their teams and results, or with a reason of rejection.

    Teams win over players if both are given.  Under the ``observer`` policy
    every team gets the observer's result; ``inverted`` is an extension that
    gives the other team of two the opposite one.
    """
    m = F.from_json(item, MATCH_ITEM)
    parsed = items.withColumn("_m", m)
    battle = F.col("_m.battle")

    def good(team: Column) -> Column:
        return F.filter(F.transform(team, _participant), lambda p: p["tag"].isNotNull() & p["entity_id"].isNotNull())

    grouped = F.filter(F.transform(battle["teams"], good), lambda t: F.size(t) > 0)
    alone = F.transform(good(battle["players"]), lambda p: F.array(p))
    result = F.when(battle["result"].isin("victory", "defeat", "draw"), battle["result"]).otherwise("unknown")
    has_teams = battle["teams"].isNotNull()
    rows = parsed.select(
        *[c for c in items.columns if c != item], scalars.clean_text(F.col("_m.battleTime")).alias("time_raw"),
        scalars.clean_text(F.col("_m.event.mode")).alias("mode"), scalars.clean_text(F.col("_m.event.map")).alias("map"),
        F.when(has_teams, "teams").otherwise("solo_ranked").alias("structure"),
        F.when(has_teams, grouped).otherwise(alone).alias("teams"),
        F.when(has_teams, result).otherwise("unknown").alias("observed"), battle["rank"].alias("rank"),
        scalars.clean_text(battle["starPlayer"]["tag"]).alias("star_tag"),
    )
    reason = (
        F.when(F.col("time_raw").isNull(), "missing_time").when(F.col("mode").isNull(), "missing_mode")
        .when(F.coalesce(F.size("teams"), F.lit(0)) < 1, "no_participants")
    )
    opposite = F.when(F.col("observed") == "victory", "defeat").when(F.col("observed") == "defeat", "victory").otherwise(
        F.col("observed"))
    flip = F.lit(result_policy == "inverted") & (F.size("teams") == 2)
    results = F.transform("teams", lambda t, i: F.when(flip & (i == 1), opposite).otherwise(F.col("observed")))
    return rows.withColumn("results", results).withColumn("reason", reason)


def with_match_key(matches: DataFrame) -> DataFrame:
    tags = F.transform("teams", lambda t: F.transform(t, lambda p: p["tag"]))
    return matches.withColumn("match_key", scalars.match_key(F.col("time_raw"), F.col("mode"), tags))


def first_observations(matches: DataFrame, order: list[str], key: str = "match_key") -> DataFrame:
    """The first observation of each match; later ones only count."""
    rest = [c for c in matches.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    seen = matches.groupBy(key).agg(first, F.count("*").alias("observations"))
    return seen.select(*[key if c == key else F.col(f"_first.`{c}`").alias(c) for c in matches.columns], "observations")


def participations(matches: DataFrame) -> DataFrame:
    """One row per participant of valid matches, with team index and result."""
    teams = matches.select("match_key", "results", F.posexplode("teams").alias("team_index", "team"))
    return teams.select(
        "match_key", "team_index", F.get("results", F.col("team_index")).alias("result"), F.explode("team").alias("p")
    ).select("match_key", "team_index", "result", "p.tag", "p.entity_id", "p.power", "p.trophies")


def split_known(matches: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): one unknown entity quarantines the whole match."""
    unknown = participations(matches).join(
        entities.select(F.col("entity_id").cast("string").alias("entity_id")), "entity_id", "left_anti"
    ).select("match_key").distinct()
    return matches.join(unknown, "match_key", "left_anti"), matches.join(unknown, "match_key", "left_semi")


def dimension_rows(current: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """Get-or-create: the dimension after ``seen`` (key, at); re-sighted rows are active."""
    last = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias("_at"))
    both = current.join(last, key, "full_outer")
    return both.select(
        key, F.coalesce("first_seen", "_at").alias("first_seen"), F.greatest("last_seen", "_at").alias("last_seen"),
        F.coalesce(F.when(F.col("_at").isNotNull(), F.lit(True)), "is_active").alias("is_active"),
    )


def observed_players(raw: DataFrame, tag: str, order: list[str]) -> DataFrame:
    """Valid tags only, the first sighting of each."""
    clean = raw.where(scalars.tag_problem(F.col(tag)).isNull()).withColumn("tag", scalars.tag(F.col(tag)))
    return clean.withColumn("_n", F.row_number().over(Window.partitionBy("tag").orderBy(*order))).where("_n = 1").drop("_n")


def envelope_objects(landed: DataFrame, body: str = "body") -> DataFrame:
    """Whether each envelope holds one object, and the object's text."""
    e = F.from_json(body, "struct<ok:boolean,payload:string>")
    ok = F.coalesce(e["ok"] & F.trim(e["payload"]).startswith("{"), F.lit(False))
    return landed.withColumn("accepted", ok).withColumn("object", F.when(ok, e["payload"]))


def upsert_players(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Players after a profile sync, with the name that a rename leaves behind.

    Both: player_id, name, club_id, pending_club; current also is_reachable.
    A profile replaces all it holds and makes the player reachable again; a
    club that is known leaves nothing pending.
    """
    new = incoming.select("player_id", F.col("name").alias("_name"), F.col("club_id").alias("_club"), F.col("pending_club").alias("_pending"),
                          F.lit(True).alias("_seen"))
    both = current.withColumn("_known", F.lit(True)).join(new, "player_id", "full_outer")
    seen = F.coalesce("_seen", F.lit(False))
    return both.select(
        "player_id", F.when(seen, F.col("_name")).otherwise(F.col("name")).alias("name"),
        F.when(seen, F.col("_club")).otherwise(F.col("club_id")).alias("club_id"),
        F.when(seen, F.when(F.col("_club").isNull(), F.col("_pending"))).otherwise(F.col("pending_club")).alias("pending_club"),
        F.coalesce("_seen", "is_reachable").alias("is_reachable"),
        F.when(F.col("_known") & seen & (F.col("name") != F.col("_name")), F.col("name")).alias("previous_name"),
        F.when(F.col("_known").isNull(), "new").when(~seen, "kept").when(F.col("name") != F.col("_name"), "renamed").otherwise("same").alias("action"),
    )


def mark_unreachable(players: DataFrame, failed: DataFrame) -> DataFrame:
    """Players with (player_id, reason) in ``failed`` are reachable no more."""
    return players.join(failed.select("player_id", F.col("reason").alias("_reason")), "player_id", "left").select(
        *[c for c in players.columns if c != "is_reachable"],
        F.when(F.col("_reason").isNotNull(), F.lit(False)).otherwise(F.col("is_reachable")).alias("is_reachable"),
        F.col("_reason").alias("unreachable_reason"))


def timestamps(raw: Column) -> Column:
    """Database or ISO date-times of any offset as UTC milliseconds text; null where there is none.

    Dates without a time are midnight; zero dates and days that the calendar
    lacks are none.
    """
    text = F.trim(raw)
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$") & ~text.rlike("^0000-00-00")
    # longer fractions are cut, not rounded
    short = F.regexp_replace(text, r"(\.\d{3})\d+", "$1")
    at = F.try_to_timestamp(F.when(shape, short))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
