"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from terrane.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v) if isinstance(v, str) else 0.0 if v is None else float(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    res = db.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = ordered(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in w] == list(g)
