"""Running sums and tiers over ranges, anchored windows and budgets, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import budgets, ordered, ranking

T0 = dt.datetime(2024, 1, 1)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, x int")
    got = ordered.running_sums(df, ["k"], ["i"], {"total": F.col("x"), "n": F.lit(1)}, 7).collect()
    total, n, want = {}, {}, {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        total[k], n[k] = total.get(k, 0) + x, n.get(k, 0) + 1
        want[i] = (total[k], n[k])
    assert {r.i: (r.total, r.n) for r in got} == want and len(got) == 3000


def test_one_key_spreads_over_the_ranges(spark):
    dealt = ordered.in_ranges(spark.range(200_000).withColumn("k", F.lit("only")), ["k", "id"], 8)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 50_000


@pytest.mark.parametrize("scope", [[], ["mode"]])
def test_shares(spark, scope):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, 5.0, rng.random()])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, mode string, score double")
    got = {r.id: r.share for r in ordered.shares_at_or_below(df, "score", scope).collect()}
    key = lambda r: (r[2] is not None, r[2] or 0.0)
    for r in rows:
        group = [q for q in rows if not scope or q[1] == r[1]]
        assert got[r[0]] == sum(key(q) <= key(r) for q in group) / len(group)


def test_tiers_put_no_rows_in_one_task(spark):
    df = spark.range(1000).select(F.col("id").alias("entity"), (F.col("id") % 97).cast("double").alias("score"))
    out = ranking.percentile_tiers(df, "score")
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    gathered = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    # what comes together is a sum for each range
    assert gathered and all("HashAggregate" in below and "_range" in below or "partial_max" in below for below in gathered)
    below = [sum(j % 97 <= i % 97 for j in range(1000)) for i in range(1000)]
    assert out.count() == 1000 and out.where("tier = 'S'").count() == sum(n >= 900 for n in below)


def plain_windows(requests, seconds):
    """(scope, ms) -> beginning of its window, a request at a time."""
    begun, out = {}, {}
    for scope, at in sorted(requests):
        if scope not in begun or at >= begun[scope] + 1000 * seconds:
            begun[scope] = at
        out[scope, at] = begun[scope]
    return out


def millis(at):
    return int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))


@pytest.mark.parametrize("segment", [1, 2, 32])
def test_windows_begin_at_the_first_request(spark, segment):
    rng = random.Random(segment)
    rows = []
    for scope, gap in (("busy", 400), ("steady", 9_000), ("rare", 400_000), ("burst", 50)):
        at = T0 + dt.timedelta(milliseconds=rng.randrange(10**7))
        for _ in range(600):
            rows.append((scope, at))
            at += dt.timedelta(milliseconds=rng.choice([0, rng.randrange(gap), gap, 10_000 if scope == "burst" and rng.random() < 0.02 else 1]))
    rows += [("before", dt.datetime(1969, 12, 31, 23, 59, 59)), ("before", dt.datetime(1970, 1, 1, 0, 0, 5)), ("before", dt.datetime(1970, 1, 1, 0, 0, 9))]
    df = spark.createDataFrame([(s, a, i) for i, (s, a) in enumerate(rows)] + [(None, T0, -1), ("rare", None, -2)], "scope string, at timestamp_ntz, id long")
    want = plain_windows([(s, millis(a)) for s, a in rows], 10)
    got = budgets.in_windows(df, 10, segment).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.window_start == (want[r.scope, millis(r.at)] if r.id >= 0 else None), r


def plain_grants(rows, ceiling, reserve):
    """A counter per window, as an update with a condition would keep it."""
    used, out = {}, {}
    for key, i, priority in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if used.setdefault(key, 0) < (ceiling if priority else ceiling - reserve):
            used[key] += 1
            out[i] = True
        else:
            out[i] = False
    return out


@pytest.mark.parametrize("ceiling,reserve", [(6, 2), (100, 0), (1, 1), (0, 0), (40, 39)])
def test_grants_equal_a_counter(spark, ceiling, reserve):
    rng = random.Random(ceiling)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, priority boolean")
    got = {r.i: r.granted for r in budgets.grant(df, ["k"], ["i"], ceiling, reserve, 5).collect()}
    assert got == plain_grants(rows, ceiling, reserve)


def test_a_window_with_a_million_requests(spark):
    df = spark.range(1_000_000).select(F.lit("all").alias("k"), F.col("id"), (F.col("id") % 10 == 0).alias("priority"))
    out = budgets.grant(df, ["k"], ["id"], 600_000, 50_000, 8)
    assert out.where("granted").count() == 550_000 + 45_000  # the priority ones behind 550,000
    assert out.where("granted AND id >= 550000 AND NOT priority").isEmpty()


def test_no_requests(spark):
    df = spark.createDataFrame([], "scope string, at timestamp_ntz, priority boolean, id long")
    rows = budgets.in_windows(df, 60)
    assert budgets.grant(rows, ["scope", "window_start"], ["at", "id"], 5, 1).collect() == []
