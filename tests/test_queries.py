"""Registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

from meshwork.plans import queries as Q
from meshwork.plans.graphs import TABLES



@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.sql(Q.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


def test_without_oracle(spark, sf_dir):
    for name in ("betweenness", "matching_maximum_size", "markov_clusters"):
        assert Q.QUERIES[name](spark, sf_dir).count() > 0
