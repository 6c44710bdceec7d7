import math
import os

import duckdb
import pytest

from tessera.plans.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v)


def test_every_query_has_an_oracle():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_duckdb(spark, db, name):
    got = queries()[name](spark, SF)
    want = db.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    assert rows == sorted(str([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
