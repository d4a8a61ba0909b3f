"""Every registered query of the telemetry library against its SQL twin."""

import pytest

from matchloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = registry.oracle_sql()[name]
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    assert got == want
