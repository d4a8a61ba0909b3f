"""Boundary values of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import scalars as s


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression.alias("x")).collect()]


def test_recency_weight(spark):
    days = [0, 30, 60, 90, 135, 180, 181, 10000, -5]
    got = values(spark, [(float(d),) for d in days], "d double", s.recency_weight(F.col("d")))
    assert got == pytest.approx([1, 1, 0.75, 0.5, 0.25, 0, 0, 0, 1])


def test_version_blend(spark):
    assert values(spark, [(0,), (50,), (100,), (500,)], "n int", s.version_blend_weight(F.col("n"))) == [0, 0.5, 1, 1]
    rows = [(0.9, 0.4, 0.0), (0.9, 0.4, 1.0), (0.8, 0.4, 0.5), (None, 0.6, 1.0), (0.6, None, 0.0), (None, None, 0.5)]
    got = values(spark, rows, "a double, b double, w double", s.blend(F.col("a"), F.col("b"), F.col("w")))
    assert got[-1] is None and got[:-1] == pytest.approx([0.4, 0.9, 0.6, 0.6, 0.6])


def test_scores(spark):
    rows = [(0.6, 0.5, 0.7, 0.4), (0.6, 0.5, None, None)]
    got = values(spark, rows, "w double, p double, h double, c double", s.overall_score(*map(F.col, "wphc")))
    assert got == pytest.approx([58.0, (0.5 * 0.6 + 0.2 * 0.5 + 0.2 * 0.6 + 0.1 * 0.5) * 100])


def test_win_rate_without_decision_is_null(spark):
    assert values(spark, [(0, 0), (2, 1), (0, 3)], "w int, l int", s.win_rate(F.col("w"), F.col("l"))) == [None, 2 / 3, 0]


def test_brackets(spark):
    rows = [(0.0,), (4999.0,), (5000.0,), (14999.0,), (15000.0,), (30000.0,), (50000.0,), (75000.0,), (-1.0,), (None,), (float("nan"),)]
    assert values(spark, rows, "t double", s.bracket(F.col("t"))) == [
        "0-5k", "0-5k", "5k-15k", "5k-15k", "15k-30k", "30k-50k", "50k-75k", "75k+", "unranked", "unranked", "unranked"]


def test_matchup_bands(spark):
    rows = [(0.35, 20), (0.36, 20), (0.45, 20), (0.55, 20), (0.56, 20), (0.65, 20), (0.5, 19), (None, 50)]
    assert values(spark, rows, "r double, n int", s.matchup_class(F.col("r"), F.col("n"))) == [
        "hard_counter", "counter", "neutral", "neutral", "strong", "hard_advantage", None, None]


def test_confidence(spark):
    rows = [(99, True), (100, True), (199, True), (200, False), (499, True), (500, True), (500, False)]
    assert values(spark, rows, "n int, g boolean", s.confidence(F.col("n"), F.col("g"))) == [
        "insufficient", "low", "low", "medium", "medium", "high", "medium"]
    rows = [(19, True), (20, True), (40, True), (100, True), (100, False)]
    assert values(spark, rows, "n int, g boolean", s.matchup_confidence(F.col("n"), F.col("g"))) == [
        "insufficient", "weak_signal", "probable_counter", "high_confidence_counter", "probable_counter"]


def test_tags(spark):
    rows = [(" 2py ",), ("#2PY",), ("",), ("#2",), ("#" + "2" * 16,), ("#ABC",), (None,)]
    assert values(spark, rows, "t string", s.tag_problem(F.col("t"))) == [
        None, None, "empty", "too_short", "too_long", "invalid_characters", "empty"]
    assert values(spark, rows[:1], "t string", s.tag_in_url(F.col("t"))) == ["%232PY"]


def test_slug(spark):
    rows = [("Mr. P",), ("Élan & Co",), ("--",), ("",)]
    assert values(spark, rows, "t string", s.slug(F.col("t"))) == ["mr-p", "elan-co", "unnamed", "unnamed"]


def test_match_key_ignores_order_and_case(spark):
    rows = [([["#a", "#b"], ["#c"]],), ([["#C"], ["#B", "#A"]],), ([["#c"], [], ["#b", "#a"]],), ([["#a"], ["#c"]],)]
    keys = values(spark, rows, "t array<array<string>>", s.match_key(F.lit("x"), F.lit("m"), F.col("t")))
    assert len(set(keys[:3])) == 1 and keys[3] != keys[0]


def test_retry(spark):
    rows = [("timeout", 2), ("timeout", 3), ("rate_limited", 4), ("not_found", 0)]
    assert values(spark, rows, "c string, n int", s.retry_decision(F.col("c"), F.col("n"))) == ["retry", "failed", "retry", "dead"]
