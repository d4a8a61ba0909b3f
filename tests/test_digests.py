"""Differences by ranges of keys, digests of many children, first observations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import digests, ingest, sync
from matchloom.plans import registry


def plain_digest(texts, fan):
    level = sorted(texts)
    n = len(level)
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return f"{n}:{level[0]}"


@pytest.mark.parametrize("fan", [3, 10, 1000])
def test_ordered_digests(spark, fan):
    rng = random.Random(fan)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(50), rng.choice(["x", None])) for _ in range(300)] + [(9, 1, "one"), (None, 5, "y")]
    df = spark.createDataFrame(rows, "p long, a int, b string")
    got = {r.p: r.digest for r in digests.ordered_digests(df, "p", ["a", "b"], fan).collect()}
    texts = {}
    for p, a, b in rows:
        texts.setdefault(p, []).append(f"{a}|{'\\N' if b is None else b}")
    assert got == {p: plain_digest(t, fan) for p, t in texts.items()}


def test_a_parent_with_a_million_children(spark):
    df = spark.range(1_000_000).select(F.lit(7).alias("p"), F.col("id"))
    (row,) = digests.ordered_digests(df, "p", ["id"]).collect()
    assert row.digest == plain_digest([str(i) for i in range(1_000_000)], 1000)


@pytest.mark.parametrize("n", [1, 3, 4, 9, 10, 28, 100])
def test_two_levels_end_at_one_hash(spark, n):
    df = spark.range(n).select(F.lit(7).alias("p"), F.col("id"))
    slices = [hashlib.sha256("\n".join(t).encode()).hexdigest() for t in (sorted(map(str, range(n)))[i : i + 3] for i in range(0, n, 3))]
    want = slices[0] if len(slices) == 1 else hashlib.sha256("\n".join(slices).encode()).hexdigest()
    (row,) = digests.ordered_digests(df, "p", ["id"], 3, levels=2).collect()
    assert row.digest == f"{n}:{want}"


def test_the_query_matches_its_sql_beyond_a_million_children(spark, tmp_path):
    """Lines with more than a thousand slices of a thousand rows beside lines of one slice and of few."""
    import duckdb

    n = F.col("id")
    line = F.when(n < 1_001_500, 1).when(n < 1_003_700, 2).otherwise(3)
    keys = {"l_orderkey": n * 7 % 1_004_001, "l_partkey": n % 200, "l_suppkey": n % 10}
    rows = spark.range(1_004_001).select(*[c.alias(k) for k, c in keys.items()], line.alias("l_linenumber"), F.lit(1.0).alias("l_extendedprice"), F.lit("d").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.queries()["g33_many_children"](spark, str(tmp_path)).select("line", "digest").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["g33_many_children"]).fetchall())


def changed(spark, n, lost=(), added=(), other=()):
    rows = spark.range(n).select("id", (F.col("id") % 101).alias("v"), F.concat(F.lit("n"), "id").alias("name"))
    out = rows.where(~F.col("id").isin(*lost)) if lost else rows
    if other:
        out = out.withColumn("name", F.when(F.col("id").isin(*other), "changed").otherwise(F.col("name")))
    if added:
        out = out.unionByName(spark.createDataFrame([(i, 0, "new") for i in added], "id long, v long, name string"))
    return out


@pytest.mark.parametrize("given", [{}, {"fan": 2, "leaf": 1}, {"fan": 8, "leaf": 5, "most_ranges": 3}])
def test_differences_are_found(spark, given):
    source = changed(spark, 3000, added=[5000, -7])
    target = changed(spark, 3000, lost=[0, 17, 2999], added=[4000], other=[64, 1500])
    found = digests.find_differences(source, target, "id", ["v", "name"], **given)
    want = {(5000, "source_only"), (-7, "source_only"), (0, "source_only"), (17, "source_only"), (2999, "source_only"), (4000, "target_only"), (64, "differs"), (1500, "differs")}
    assert {(r.id, r.side) for r in found.rows.collect()} == want


def test_one_difference_reads_a_small_part_again(spark):
    source, target = changed(spark, 60_000), changed(spark, 60_000, other=[31_415])
    found = digests.find_differences(source, target, "id", ["v", "name"])
    assert [tuple(r) for r in found.rows.collect()] == [(31_415, "differs")]
    assert found.reads[0] == 120_000 and sum(found.reads[1:]) < 12_000
    alike = digests.find_differences(source, source, "id", ["v", "name"])
    assert alike.rows.isEmpty() and alike.reads == [120_000]


def test_tables_without_rows(spark):
    empty, some = changed(spark, 0), changed(spark, 3)
    assert digests.find_differences(empty, empty, "id", ["v"]).rows.collect() == []
    assert {(r.id, r.side) for r in digests.find_differences(some, empty, "id", ["v"]).rows.collect()} == {(i, "source_only") for i in range(3)}


def test_sums_tell_lost_doubled_and_changed_rows(spark):
    rows = changed(spark, 500)
    sums = lambda df: tuple(df.agg(*digests.content_sums(["id", "v", "name"])).first())
    whole = sums(rows)
    assert sums(rows.repartition(7)) == whole
    assert sums(rows.where("id <> 3").union(rows.where("id = 4"))) != whole  # as many rows
    assert sums(changed(spark, 500, other=[9])) != whole


def test_key_difference(spark):
    s, t = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([*range(30), None], [*range(15, 33)]))
    assert sync.key_difference(s, t, "id").first().asDict() == {
        "source_only": 15, "source_sample": "0,1,2,3,4,5,6,7,8,9", "target_only": 3, "target_sample": "30,31,32"}
    assert sync.key_difference(s, s, "id").first().asDict() == {"source_only": 0, "source_sample": "", "target_only": 0, "target_sample": ""}


def test_first_observations_keep_nested_rows(spark):
    rows = [("k", 2, [1, 2], {"a": 1}), ("k", 1, [3], None), ("j", 5, None, {"b": 2})]
    df = spark.createDataFrame(rows, "match_key string, item_id int, teams array<int>, more map<string,int>")
    got = sorted(map(tuple, ingest.first_observations(df, ["item_id"]).collect()))
    assert got == [("j", 5, None, {"b": 2}, 1), ("k", 1, [3], None, 2)]
