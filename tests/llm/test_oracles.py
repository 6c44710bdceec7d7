import os

import duckdb
import pytest

from tessera.llm import oracles
from tessera.llm.queries import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_duckdb(spark, db, name):
    got, want = queries()[name](spark, SF), db.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, ([r[n] for n in names] for r in got.collect()))) == sorted(map(str, map(list, want.fetchall())))


def test_sharding_by_brute_force(spark):
    """One pass over all rows in order, in plain Python, against the query; nulls, copies and repeated rows too."""
    import hashlib
    import random
    import zlib

    from tessera.llm.sharding import SPLITS, SPREAD, TOLERANCE, shard_by_bytes

    rng = random.Random(4)
    rows = [(rng.randrange(-500, 5000), rng.choice([None, "", "hot" * 50, "x" * rng.randint(0, 400)])) for _ in range(1500)] + [(None, "n"), (None, None), (7, "z"), (7, "z")]
    key = lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), ((r[0] if r[0] is not None else -(2**63)) % SPREAD) % SPLITS, r[0] if r[0] is not None else -(2**63))
    order, size = sorted(rows, key=key), lambda r: len((r[1] or "").encode()) + 8
    total, at, want, slots = sum(map(size, rows)), 0, [], {}
    own, start = {}, {}
    for r in order:
        d = key(r)[0]
        start.setdefault(d, at)
        own[d] = own.get(d, 0) + size(r)
        at += size(r)
    at = 0
    for r in order:
        d = key(r)[0]
        middle = start[d] + own[d] / 2 if own[d] <= total / 9 * TOLERANCE else at + size(r) / 2
        shard = min(int(middle / (total / 9)), 8)
        want.append((r[0], size(r), zlib.crc32((r[1] or "").encode()), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size(r)
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sharding_of_very_long_texts(spark):
    from tessera.llm.sharding import shard_by_bytes

    docs = spark.createDataFrame([(i, ("abc " * 400_000) + str(i // 2)) for i in range(6)], "doc_id long, text string")
    got = shard_by_bytes(docs, 3).collect()
    assert {r.size for r in got} == {1_600_009} and sorted(r.shard for r in got) == [0, 0, 1, 1, 2, 2]
