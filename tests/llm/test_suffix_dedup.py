import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import suffix_dedup as module
from tessera.llm.suffix_dedup import TIE, suffix_dedup
from tessera.llm.heavy import heavy_keys
from tessera.llm.suffixes import suffix_array


def brute(rows, length=100):
    rows = sorted({(d if d is not None else -(2**63), t or "") for d, t in rows})
    seen, gone = set(), {r: bytearray(len(r[1].encode())) for r in rows}
    starts = sorted((d, i, zlib.crc32(t.encode()) & TIE, t) for d, t in rows for i in range(len(t.encode()) - length + 1))
    for d, i, _, t in starts:
        w = t.encode()[i : i + length]
        if w in seen:
            gone[d, t][i : i + length] = b"\1" * length
        seen.add(w)
    out = {(d, t): bytes(b for b, g in zip(t.encode(), gone[d, t]) if not g) for d, t in rows}
    return out


def check(spark, rows):
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, gram string"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    want = brute([(r[0], r[1]) for r in rows])
    for d, kept in {(r.doc_id if r.doc_id is not None else -(2**63), bytes(r.kept)) for r in got}:
        assert kept in [v for (k, _), v in want.items() if k == d]
    by_id = {}
    for (d, _), v in want.items():
        by_id.setdefault(d, []).append(v)
    for d, all_kept in by_id.items():
        assert sorted({bytes(r.kept) for r in got if (r.doc_id if r.doc_id is not None else -(2**63)) == d}) == sorted(set(all_kept))


def test_suffix_array_by_grouping():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß€") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = " ".join(rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(passage)]) for _ in range(rng.randint(0, 6)))
        rows.append((i, t, None))
    for i in range(150, 260):  # near copies
        t = list(rows[rng.randrange(40)][1])
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyz\0")
        rows.append((i, "".join(t), None))
    rows += [(300, "a" * 500, "x"), (301, "ab" * 400, "x"), (302, None, None), (303, "", None), (None, passage[0] * 2, None), (304, "a" * 99, ""), (305, "a" * 100, "")]
    check(spark, rows)


def crowded():
    rng = random.Random(4)
    phrase = "a phrase of over forty bytes that is found everywhere, "
    passage = "and a long passage, " + phrase * 2 + "".join(rng.choice("abcdef ") for _ in range(200))
    rows = []
    for i in range(200):
        noise = lambda: "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 90)))
        rows.append((i, noise() + rng.choice([phrase, passage, phrase + noise() + passage]) + noise(), None))
    return rows + [(300, rows[5][1], "x"), (300, rows[6][1], "x"), (300, rows[6][1], "x"), (None, passage, None), (301, "a" * 700, "x"), (302, None, None)]


def test_hot_grams_and_parts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "WIDE", 5)  # small enough for a fixture: hot grams are dealt, large ones sorted in parts
    monkeypatch.setattr(module, "ARRAY", 5)
    monkeypatch.setattr(module, "ROWS", 7)
    rows, found = crowded(), []
    monkeypatch.setattr(module, "heavy_keys", lambda *a: found.append(heavy_keys(*a)) or found[-1])
    check(spark, rows)
    assert len(found[0]) > 3
    monkeypatch.setattr(module, "heavy_keys", lambda *a: np.zeros(0, np.int64))  # large grams that no list names
    check(spark, rows)


def test_equal_hashes_remove_nothing(monkeypatch):
    """Every gram has the same hash, so all contexts meet: only bytes tell windows apart."""
    monkeypatch.setattr(module, "_mix", lambda x: x & np.uint64(0xFFFFF))
    monkeypatch.setattr(module, "_POWER", np.zeros_like(module._POWER))
    rows = [(d, t) for d, t, _ in crowded()[:60]] + [(400, "one " + "x" * 120), (401, "two " + "y" * 120)]
    contexts, gone = [], {d: bytearray(len(t.encode())) for d, t in rows}
    for d, t in rows:
        gram, start, count, at = module.anchors(t.encode(), 100)
        assert not gram.any()
        contexts += [(0, d, int(module._pack(s, c, p, 0)), t.encode()[s : s + c + 99]) for s, c, p in zip(start, count, at)]
    contexts.sort(key=lambda r: (r[3], r[1], r[2]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*contexts[i : i + 30]), kinds)], names=["gram", "doc", "place", "bytes"]) for i in range(0, len(contexts), 30)]
    for out in module._settle(100, 10**6, np.zeros(0, np.int64), False)(iter(batches)):
        for _, _, d, p, _ in zip(*(c.to_pylist() for c in out.columns)):
            s, n, _, _ = module._unpack(p)
            gone[d][s : s + n + 99] = b"\1" * (n + 99)
    want = brute(rows)
    assert [bytes(b for b, g in zip(t.encode(), gone[d]) if not g) for d, t in rows] == [want[r] for r in rows]


def test_very_long_text(spark):
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (2, "x" + long[:300_000] + "y"), (3, "z" * 300_000)]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bytes(got[1].kept) == long.encode() and bytes(got[2].kept) == b"xy"
    assert bytes(got[3].kept) == b"z" and got[3].spans[0].start == 1 and len(got[3].spans) == 1


def test_heavy_keys_are_found_in_bounded_summaries(spark):
    rng = random.Random(6)
    keys = [rng.randrange(10**9) for _ in range(6000)] + [-5] * 900 + [7] * 400 + [8] * 3
    rng.shuffle(keys)
    got = heavy_keys(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), 50, 32).tolist()
    assert -5 in got and len(got) <= 32 and set(got) <= {-5, 7}
    assert heavy_keys(spark.createDataFrame([], "k long"), 1).tolist() == []


def test_repeated_rows_and_empty_table(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(130))
    check(spark, [(1, t + "q", None), (1, t + "q", None), (1, "z" + t, None), (2, t, None)])
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
