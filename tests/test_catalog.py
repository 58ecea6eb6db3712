"""Each registered query with SQL gives what DuckDB gives for that SQL on the same tables."""

import decimal

import pytest

from brookframe.catalog import QUERIES, SQL


def _plain(x):
    return x.normalize() if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in SQL:
        found = con.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = [tuple(_plain(r[columns.index(c)]) for c in order) for r in found.fetchall()]
        have = [tuple(_plain(r[c]) for c in order) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
