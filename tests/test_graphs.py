"""Families with every reason, closures over levels, proofs of harmed copies, cursor pages."""

import datetime as dt
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.operators import digests, graphs
from matchloom.plans import registry, retention_graphs
from matchloom.sources import pages

NOW = dt.datetime(2024, 6, 1)


def ago(days):
    return NOW - dt.timedelta(days=days)


def outcomes(df, key="id"):
    return {r[key]: r.reason or r.outcome for r in df.collect()}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def as_of():
    return F.lit(NOW.isoformat()).cast("timestamp_ntz")


def test_workflow_audit_names_the_first_reason(spark):
    rows = [(1, "running", 400), (2, "succeeded", 400), (3, "succeeded", 400), (4, "failed", 400), (5, "failed", 731), (6, "succeeded", 400), (7, "succeeded", 364), (8, "queued", 900)]
    df = spark.createDataFrame([(i, s, ago(d)) for i, s, d in rows] + [(9, "failed", None)], "id long, status string, started_at timestamp_ntz")
    got = outcomes(graphs.plan(df, "workflow_audit", as_of(), references={"fetch": ids(spark, 1, 2, 3, None), "active_lock": ids(spark, 2, 6, 6)}))
    assert got == {1: "active_or_retryable", 2: "referenced_by_fetch", 3: "referenced_by_fetch", 4: "within_extended_retention",
                   5: "archive_and_delete", 6: "referenced_by_active_lock", 8: "active_or_retryable"}


def test_observed_players_have_two_cutoffs(spark):
    rows = [(1, False, 61, None), (2, False, 59, None), (3, False, None, None), (4, True, 900, None), (5, True, 900, 29), (6, True, 10, 31), (7, False, 900, None), (8, None, 61, 5)]
    df = spark.createDataFrame([(i, f"#{i}", p, None if a is None else ago(a), None if b is None else ago(b)) for i, p, a, b in rows],
                               "id long, tag string, promoted boolean, first_observed_at timestamp_ntz, promoted_at timestamp_ntz")
    crawl = spark.createDataFrame([("#7",), ("#7",)], "tag string")
    assert outcomes(graphs.plan(df, "observed_players", as_of(), references={"active_crawl": crawl})) == {
        1: "archive_and_delete", 2: "within_unpromoted_hot", 3: "within_unpromoted_hot", 4: "promoted_without_proof", 5: "within_promoted_hot",
        6: "archive_and_delete", 7: "active_crawl_dependency", 8: "archive_and_delete"}


def test_other_families(spark):
    df = spark.createDataFrame([(i, 10 * i, ago(d), b) for i, d, b in ((1, 366, True), (2, 366, False), (3, 300, False), (4, 2000, None))], "id long, fetch_id long, at timestamp_ntz, flag boolean")
    named = lambda c: df.withColumnRenamed("at", c)
    assert outcomes(graphs.plan(named("created_at"), "detected_changes", as_of(), references={"open_incident": ids(spark, 20)})) == {
        1: "archive_and_delete", 2: "open_incident_dependency", 4: "archive_and_delete"}
    assert outcomes(graphs.plan(named("created_at").withColumnRenamed("flag", "is_accepted"), "normalized_snapshots", as_of())) == {2: "archive_and_delete"}
    assert outcomes(graphs.plan(named("recorded_at"), "player_name_history", as_of())) == {1: "archive", 2: "archive", 4: "archive"}
    assert outcomes(graphs.plan(named("completed_at"), "crawl_batches", as_of())) == {i: "archive_and_delete" for i in (1, 2, 3, 4)}
    refs = {name: ids(spark, *some) for name, some in (("retry_chain", (1, 2)), ("raw_snapshot", (2,)))}
    assert outcomes(graphs.plan(named("started_at"), "fetch_audit", as_of(), references=refs)) == {
        1: "referenced_by_retry_chain", 2: "referenced_by_raw_snapshot", 4: "archive_and_delete"}
    observed = spark.createDataFrame([(1, 1, ago(181)), (2, 3, ago(181)), (3, 3, ago(179)), (4, 99, ago(500))], "id long, match_id long, observed_at timestamp_ntz")
    parents = df.select(F.col("id").alias("match_id"), "at")
    assert outcomes(graphs.plan(observed, "match_observations", as_of(), hot_parents=(parents, "match_id", "at"))) == {2: "archive_and_delete"}


@pytest.fixture
def family(spark, tmp_path):
    anchors = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "id long, name string")
    kids = spark.createDataFrame([(10 + i, i % 8, i) for i in range(24)], "kid long, id long, v int")
    grand = spark.createDataFrame([(k, k % 40) for k in range(80)], "g long, kid long")
    children = [graphs.Child("kids", kids, "id", "anchors", "id"), graphs.Child("grand", grand, "kid", "kids", "kid")]
    tables = graphs.closure("anchors", anchors.where("id < 3"), children)
    path = str(tmp_path / "copy")
    expected = graphs.store(tables, path)

    def prove(**other):
        where = {n: other.get(n, f"{path}/{n}") for n in tables}
        found = graphs.prove(spark, expected, where.get, "anchors", tables["anchors"], "id", children)
        return {(r["pass"], r.table): r.reason for r in found.collect()}

    return tables, children, path, prove, tmp_path


def test_closure_reaches_grandchildren(family):
    tables, children, _, prove, _ = family
    kids = {r.kid for r in tables["kids"].collect()}
    assert kids == {10 + i for i in range(24) if i % 8 < 3}
    assert {r.g for r in tables["grand"].collect()} == {k for k in range(80) if k % 40 in kids}
    assert graphs.deletion_order("anchors", children) == ["grand", "kids", "anchors"]
    assert prove() == {(p, t): None for p in (1, 2) for t in tables}


def test_tables_are_made_once_while_they_are_stored(spark, tmp_path):
    """The manifest comes from the rows that are written: no second pass, which could see others."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(100, numPartitions=3).mapInPandas(count, "id long")
    empty = spark.range(5).select((F.col("id") + 1).alias("k"), "id").where("k < 0")
    joined = empty.join(spark.range(9).withColumnRenamed("id", "up"), F.col("id") == F.col("up"), "left_semi")
    expected = {r["table"]: r for r in graphs.store({"rows": rows, "empty": joined}, str(tmp_path / "c")).collect()}
    assert made.value == 100
    assert expected["rows"].rows == 100 and expected["empty"].rows == 0 and expected["empty"].digest_1 == 0
    again = spark.read.parquet(str(tmp_path / "c" / "rows")).agg(*digests.content_sums(["id"])).first()
    assert tuple(again) == tuple(expected["rows"])[1:]


@pytest.mark.parametrize("table,change,reason", [
    ("kids", lambda df: df.where("kid <> 10"), "row_count_mismatch"),
    ("kids", lambda df: df.union(df.where("kid = 10")), "row_count_mismatch"),
    ("kids", lambda df: df.where("kid <> 10").union(df.where("kid = 11")), "content_checksum_mismatch"),
    ("kids", lambda df: df.withColumn("v", F.when(F.col("kid") == 10, 99).otherwise(F.col("v"))), "content_checksum_mismatch"),
    ("kids", lambda df: df.withColumn("id", F.when(F.col("kid") == 10, 77).otherwise(F.col("id"))), "fk_closure_violation"),
    ("anchors", lambda df: df.withColumn("id", F.when(F.col("id") == 2, 1).otherwise(F.col("id"))), "anchor_set_mismatch"),
])
def test_harm_is_found(family, table, change, reason):
    tables, _, path, prove, tmp = family
    change(tables[table].sparkSession.read.parquet(f"{path}/{table}")).write.parquet(str(tmp / "harmed"))
    got = prove(**{table: str(tmp / "harmed")})
    assert got[1, table] == got[2, table] == reason


def test_each_pass_reads_the_files_again(spark, family):
    """What happens to the files after the first pass is found by the second: it is no copy of the first."""
    tables, children, path, _, tmp = family
    expected, asked = spark.read.parquet(f"{path}/_manifest.parquet"), []

    def where(name):
        if name == "anchors" and asked[-1:] == ["grand"]:  # the second pass begins
            spark.read.parquet(f"{path}/kids").where("kid <> 10").write.parquet(str(tmp / "late"))
            shutil.rmtree(f"{path}/kids")
            shutil.move(tmp / "late", f"{path}/kids")
        asked.append(name)
        return f"{path}/{name}"

    found = graphs.prove(spark, expected, where, "anchors", tables["anchors"], "id", children)
    assert {(r["pass"], r.table): r.reason for r in found.collect()} == {
        (1, "anchors"): None, (1, "kids"): None, (1, "grand"): None, (2, "anchors"): None, (2, "kids"): "row_count_mismatch", (2, "grand"): "fk_closure_violation"}


def test_copies_are_proved_side_by_side(spark, family):
    tables, children, path, _, tmp = family
    spark.read.parquet(f"{path}/grand").where("g <> 11").write.parquet(str(tmp / "short"))
    copies = {"good": lambda n: f"{path}/{n}", "short": lambda n: str(tmp / "short") if n == "grand" else f"{path}/{n}", "none": lambda n: str(tmp / "nowhere")}
    found = graphs.prove_copies(spark, spark.read.parquet(f"{path}/_manifest.parquet"), copies, "anchors", tables["anchors"], "id", children)
    reasons = {(r["copy"], r["pass"], r.table): r.reason for r in found.collect()}
    assert reasons == {
        (c, p, t): "missing_child_table" if c == "none" else "row_count_mismatch" if (c, t) == ("short", "grand") else None for c in copies for p in (1, 2) for t in tables}


def test_graph_proof_has_the_whole_graph_twice(spark, tmp_path):
    """Observations belong to the graph of a match; here the match that is harmed, 7, has none."""
    day = dt.datetime(1999, 1, 1)
    tables = {
        "orders": ([(7, 1, day, "F", "1-URGENT"), (8, 1, day, "F", "1-URGENT"), (9, 2, dt.datetime(2001, 8, 1), "O", "1-URGENT"), (12, 2, day, "P", "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(k, n, n, n, 1.5, day) for k in (7, 8, 9) for n in (1, 2, 7)],
                     "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz"),
        "events": ([(i, 1, day, "view") for i in (8, 5008, 12, 9, 4)], "event_id long, user_id long, ts timestamp_ntz, event_type string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = registry.queries()["c19_graph_proof"](spark, str(tmp_path))
    got = {(r.harm, r["pass"], r.table): (r.expected_rows, r.rows, r.reason) for r in df.collect()}
    whole = {"matches": 3, "teams": 4, "participations": 6, "observations": 3}
    assert got.keys() == {(h, p, t) for h in ("none", *retention_graphs.HARM) for p in (1, 2) for t in whole}
    assert all(got["none", p, t] == (n, n, None) for p in (1, 2) for t, n in whole.items())
    assert [got["wrong_anchor", 2, t][2] for t in whole] == ["anchor_set_mismatch", "fk_closure_violation", "fk_closure_violation", None]
    want = con.execute(registry.oracle_sql()["c19_graph_proof"]).fetchdf().to_dict("records")
    named = {(r["harm"], r["pass"], r["table"]): (r["expected_rows"], r["rows"], r["reason"]) for r in want}
    assert got == {k: tuple(None if v != v else v for v in row) for k, row in named.items()}


def test_a_missing_table(family):
    _, _, _, prove, tmp = family
    assert prove(grand=str(tmp / "nowhere"))[2, "grand"] == "missing_child_table"


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(rng.randrange(200), i, f"r{i}") for i in range(4000)]
    path = str(tmp_path_factory.mktemp("pages"))
    pages.write_sorted(spark.createDataFrame(rows, "at int, id long, name string"), ["at", "id"], path, 20)
    return path, sorted(r[:2] for r in rows)


@pytest.mark.parametrize("after,upto,size", [(None, None, 50), ((30, 2000), None, 100), ((30, 2000), (31, 10), 1000), ((199, 9999), None, 5), ((50, 0), (120, 0), 7), (None, (-1, 0), 9)])
def test_pages(spark, keyed, after, upto, size):
    path, rows = keyed
    at = lambda c: None if c is None else F.struct(F.lit(c[0]), F.lit(c[1]).cast("long"))
    page = pages.read_page(spark, path, ["at", "id"], size, at(after), at(upto))
    want = [r for r in rows if (after is None or r > after) and (upto is None or r <= upto)][:size]
    assert [(r.at, r.id) for r in page.rows.collect()] == want
    assert len(page.files) <= size // 200 + 3


def test_all_pages_are_all_rows(spark, keyed):
    path, rows = keyed
    cursor, seen = None, []
    while True:
        found = pages.read_page(spark, path, ["at", "id"], 900, cursor).rows.collect()
        if not found:
            break
        seen += [(r.at, r.id) for r in found]
        cursor = F.struct(F.lit(seen[-1][0]), F.lit(seen[-1][1]).cast("long"))
    assert seen == rows
