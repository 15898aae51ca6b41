"""The code operators on the small source trees give the rows written down for them."""

import duckdb
import pytest

from . import sample_queries
from .test_queries import plain


@pytest.mark.parametrize("name", sorted(sample_queries.ORACLES))
def test_rows(spark, name):
    df, rel = sample_queries.QUERIES[name](spark, ""), duckdb.sql(sample_queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
