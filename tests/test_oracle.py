"""Every registered query against its SQL text."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def norm(value):
    if value is None:
        return "NULL"
    if isinstance(value, float) and not math.isnan(value) and value == int(value):
        return str(int(value))
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    cur = duck.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected)


def test_every_query_of_the_directory_has_an_oracle():
    from slotatlas import plans
    registry = plans.load()
    assert set(registry.queries) == set(registry.oracles)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["type", "severity", "entity_id", "row_key", "field", "value", "expected_range", "message"]
