import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.simhash import bits_first, first_keys, fingerprint, fingerprint_components, front, gray_rank, index_components, near_duplicate_filter, simhash_dedup
from tessera.llm.components import connected_components


def plain_fingerprint(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(n)]


def test_index_against_all_pairs():
    rng = random.Random(1)
    for size, keys in [(1, 1), (40, 3), (700, 2), (500, 500)]:
        center = [rng.getrandbits(64) for _ in range(5)]
        code = {(rng.randrange(keys), rng.choice(center) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1)) for _ in range(size)}
        key, code = (np.array(x) for x in zip(*code))
        code = code.astype(np.uint64)
        s = np.lexsort((gray_rank(code), key))
        key, code = key[s], code[s]
        want = roots(len(key), lambda i, j: key[i] == key[j] and int(code[i] ^ code[j]).bit_count() <= 3)
        assert index_components(key, code, 3).tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(300)] + ["É", "ÀB", "x\x1cy"]
    rows = []
    for i in range(240):
        if i < 60 or rng.random() < 0.3:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        else:
            w = rows[rng.randrange(60)][1].split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            t = rng.choice([" ", "\n "]).join(w).upper() if rng.random() < 0.5 else " ".join(w)
        rows.append((i, t, "x"))
    rows += [(900, None, None), (901, "", None), (902, "a", None), (903, "a b", None), (905, " \t", None)]
    got = {r.doc_id: r for r in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fp = [plain_fingerprint(r[1]) for r in rows]
    want = roots(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert got[r[0]].fingerprint == f"{fp[i]:016x}"
        assert got[r[0]].component_id == rows[want[i]][0]
        assert fingerprint((r[1] or "").encode(), 3) == fp[i]
    assert len(set(want)) < len(rows) - 10


def test_band_of_the_index_against_all_pairs():
    rng = random.Random(7)
    center = [rng.getrandbits(64) for _ in range(3)]
    code = np.array(sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in center for _ in range(200)}), np.uint64)
    mask = 0xFF00000000FF
    turned = bits_first(code, mask)
    assert all((int(a ^ b)).bit_count() == (int(x ^ y)).bit_count() for a, b, x, y in zip(code, code[1:], turned, turned[1:]))
    assert {int(x >> np.uint64(48)) for x in turned} == {(int(c) >> 40 & 0xFF) << 8 | int(c) & 0xFF for c in code}
    turned = turned[np.argsort(gray_rank(turned))]
    want = roots(len(turned), lambda i, j: int(turned[i] ^ turned[j]).bit_count() <= 3 and int(turned[i] ^ turned[j]) >> 48 == 0)
    assert index_components(np.zeros(len(turned), np.int64), turned, 3, np.full(len(turned), front(16), np.uint64)).tolist() == want


def test_first_keys_follow_the_gray_order():
    rng = np.random.default_rng(9)
    code = rng.integers(0, 2**63, 3000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, np.uint64)
    for t, (key, band) in enumerate(first_keys(code, 3, 5)):
        turned = bits_first(code, int(band[0]))
        by = np.argsort(gray_rank(turned), kind="stable")
        assert (np.diff(key[by].astype(np.int64)) >= 0).all() and len(set(key.tolist())) == 32 and set((key >> np.uint64(48)).tolist()) == {t}
    assert sum(int(b[0]) for _, b in first_keys(code, 3, 5)) == 2**64 - 1


def test_upper_nodes_prune_whole_groups():
    rng = np.random.default_rng(8)
    code = np.unique(rng.integers(0, 2**63, 4096, np.uint64))
    code = code[np.argsort(gray_rank(code))]
    tally = {}
    index_components(np.zeros(len(code), np.int64), code, 3, np.full(len(code), front(16), np.uint64), tally)
    assert tally["pruned"] > 0.5 * tally["met"] and tally["compared"] < 20 * len(code) < len(code) ** 2 / 100, tally


def test_large_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    codes = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 9]))) for _ in range(900)})
    rows = [(i, c - 2**64 if c >= 2**63 else c) for i, c in enumerate(codes)]
    want = roots(len(codes), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 3)
    found = []
    real = simhash._larger
    monkeypatch.setattr(simhash, "ROWS", 40)
    monkeypatch.setattr(simhash, "HELD", 16)
    monkeypatch.setattr(simhash, "_larger", lambda sent, most: found.append(real(sent, most)) or found[-1])
    got = {r.fp: r.root for r in fingerprint_components(spark.createDataFrame(rows, "id long, fp long"), 3).collect()}
    assert [got[fp] for _, fp in rows] == want
    assert len(found) > 2 and found[-1] is None


def test_large_keys_of_the_filter(spark, monkeypatch):
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(["x", "y%d" % i]) if rng.random() < 0.01 else w for w in base)) for i in range(300)]
    rows += [(1000 + i, " ".join("v%d" % rng.randrange(10**6) for _ in range(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(r.doc_id for r in near_duplicate_filter(docs).collect())
    for name, value in (("WIDE", 60), ("HELD", 40), ("MEMBERS", 50)):
        monkeypatch.setattr(simhash, name, value)
    assert sorted(r.doc_id for r in near_duplicate_filter(docs).collect()) == plain
    assert len(plain) < 70 and {r[0] for r in rows[300:]} <= set(plain)


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 77, 88, "a", 5), (2, long + " x", 78, 89, "b", 6), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id_ long, tie_ long, id string, `row` long")
    got = near_duplicate_filter(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2]])) and got[0].asDict().keys() == set(docs.columns)
    assert {r.component_id for r in simhash_dedup(docs).collect()} <= {1, 2, None}


def test_nulls_repeats_and_empty(spark):
    got = simhash_dedup(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 0), (3, 0), (4, 4)]
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_components_of_random_graphs(spark):
    rng = random.Random(12)
    for n, m in ((200, 120), (60, 200), (400, 390)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(7, k) for k in range(100, 100 + m // 4)]  # a hub
        linked = set(edges) | {(b, a) for a, b in edges}
        want = roots(max(map(max, edges)) + 1, lambda i, j: (i, j) in linked)
        got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
        assert got == {k: want[k] for k in {x for a, b in edges if a != b for x in (a, b)}}
