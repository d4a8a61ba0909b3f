"""Catalog validation, change detection and versioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def validate_items(items: DataFrame, item: str = "item") -> DataFrame:
    """id, name and the reason of rejection (null: valid) of raw JSON items."""
    r = F.from_json(item, "struct<id:string,name:string>")
    is_object = F.trim(item).startswith("{") & r.isNotNull()
    ident, name = scalars.clean_text(r["id"]), scalars.clean_text(r["name"])
    reason = (
        F.when(~F.coalesce(is_object, F.lit(False)), "not_an_object").when(ident.isNull(), "missing_or_invalid_id")
        .when(name.isNull(), "missing_or_invalid_name")
    )
    return items.select(*[c for c in items.columns if c != item], ident.alias("id"), name.alias("name"), reason.alias("reason"))


def checksum(df: DataFrame, *columns: str, out: str = "checksum") -> DataFrame:
    """SHA-256 of the canonical JSON of the columns in the order given."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def entity_changes(candidate: DataFrame, previous: DataFrame) -> DataFrame:
    """New entities, and added or removed sub-items of those whose checksum differs.

    Both sides: entity_id, name, checksum, items array<struct<id, name>>.
    """
    old = previous.select(
        "entity_id", F.col("checksum").alias("old_sum"), F.col("items").alias("old_items"), F.lit(True).alias("known"))
    both = candidate.join(old, "entity_id", "left")
    added = both.where("known IS NULL").select(
        "entity_id", F.lit("new_entity").alias("change"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"), F.col("name").alias("new_value"), F.lit("info").alias("severity"))
    changed = both.where("known AND checksum <> old_sum")
    here, there = F.transform("items", lambda i: i["id"]), F.transform("old_items", lambda i: i["id"])
    gained = F.transform(
        F.filter("items", lambda i: ~F.array_contains(there, i["id"])),
        lambda i: F.struct(i["id"].alias("field"), F.lit(None).cast("string").alias("old_value"), i["name"].alias("new_value"),
                           F.lit("info").alias("severity")))
    lost = F.transform(
        F.filter("old_items", lambda i: ~F.array_contains(here, i["id"])),
        lambda i: F.struct(i["id"].alias("field"), i["name"].alias("old_value"), F.lit(None).cast("string").alias("new_value"),
                           F.lit("warning").alias("severity")))
    items = changed.select("entity_id", F.explode(F.concat(gained, lost)).alias("c")).select(
        "entity_id", F.lit("item_change").alias("change"), "c.field", "c.old_value", "c.new_value", "c.severity")
    return added.unionByName(items)


def removed_entities(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.join(new.select("entity_id"), "entity_id", "left_anti")


def volume_anomaly(previous: DataFrame, new: DataFrame, most_removed: float = 0.5) -> DataFrame:
    """One row: counts, the incident if any, and whether it blocks acceptance."""
    counts = (
        previous.agg(F.count("*").alias("previous")).crossJoin(new.agg(F.count("*").alias("new")))
        .crossJoin(removed_entities(previous, new).agg(F.count("*").alias("removed")))
    )
    ratio = F.try_divide(F.col("removed").cast("double"), F.nullif("previous", F.lit(0)))
    incident = (
        F.when(F.col("previous") == 0, F.lit(None).cast("string")).when(F.col("new") == 0, "missing_source_data")
        .when(ratio > most_removed, "unexpected_mass_change")
    )
    return counts.withColumn("removed_ratio", F.round(ratio, 3)).withColumn("incident", incident).withColumn(
        "blocks", incident.isNotNull())


def merge_catalog(current: DataFrame, incoming: DataFrame, at) -> DataFrame:
    """The catalog after a sync: names follow, slugs stay, the missing go inactive."""
    new = incoming.select("entity_id", F.col("name").alias("_name"), F.lit(True).alias("_here"))
    both = current.join(new, "entity_id", "full_outer")
    here = F.coalesce("_here", F.lit(False))
    return both.select(
        "entity_id", F.coalesce("_name", "name").alias("name"),
        F.coalesce("slug", scalars.slug(F.col("_name"))).alias("slug"),
        F.when(F.col("name").isNotNull() & here & (F.col("name") != F.col("_name")), F.col("name")).alias("alias"),
        here.alias("is_active"), F.when(here, at).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def infer_version(changes: DataFrame, versions: DataFrame, at) -> DataFrame:
    """Any change supersedes the active version and opens a new one."""
    changed = changes.agg((F.count("*") > 0).alias("changed"))
    old = versions.crossJoin(changed).select(
        "label", F.when(F.col("changed") & (F.col("status") == "active"), "superseded").otherwise(F.col("status")).alias("status"))
    new = changed.where("changed").select(scalars.version_label(at).alias("label"), F.lit("active").alias("status"))
    return old.unionByName(new)


def sub_items(items: DataFrame, item: str = "item", field: str = "starPowers") -> DataFrame:
    """Well-formed sub-items of each item, by id, and how many were dropped."""
    kind = "array<struct<id:string,name:string>>"
    raw = F.coalesce(F.from_json(item, f"struct<{field}:{kind}>")[field], F.array().cast(kind))
    clean = F.transform(raw, lambda s: F.struct(scalars.clean_text(s["id"]).alias("id"), scalars.clean_text(s["name"]).alias("name")))
    good = F.array_sort(F.filter(clean, lambda s: s["id"].isNotNull() & s["name"].isNotNull()))
    return items.select(*[c for c in items.columns if c != item], good.alias("sub_items"), (F.size(raw) - F.size(good)).alias("dropped"))
