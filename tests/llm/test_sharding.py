import random
import zlib

from tessera.llm.sharding import shard_by_bytes


def test_balance_slots_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300) + str(i), 1) for i in range(3000)]
    rows += [(5000 + i, "hot" * 40, 2) for i in range(1500)] + [(9000 + i, "pair" + str(i // 2), 3) for i in range(40)]
    rows += [(None, "a", 0), (None, None, 0), (7, None, 0), (8, "", 0), (8, "", 0)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size int"), 24).collect()
    assert len(got) == len(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in got) == sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24))
    total = sum(r.size for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 24) < 0.05 * total / 24
    pairs = {}
    for r in got:
        if (r.doc_id or 0) >= 9000:
            pairs.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in pairs.values())


def test_empty_and_single(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 24).collect() == []
    assert [(r.shard in range(24), r.slot) for r in shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 24).collect()] == [(True, 0)]
