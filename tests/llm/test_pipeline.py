import random

import numpy as np

import corpus_pipeline
from tessera.llm import simhash
from tessera.llm.common import DOC_COLUMNS
from tessera.llm.simhash import near_duplicate_filter, similarity_components
from tessera.llm.quality import quality_filter
from tessera.llm.suffix_dedup import without_repeats
from tessera.llm.toxicity import toxicity_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_texts_are_found(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 400))] for _ in range(150)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(base)]
    for i in range(150, 300):
        w = list(base[rng.randrange(75)])
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(400, rows[0][1], "en", "s", 1), (400, rows[0][1], "en", "s", 1), (None, "a b c d e f", None, None, None), (402, None, None, None, None), (403, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stay = [r.doc_id for r in near_duplicate_filter(docs).collect()]
    assert len(stay) == len(set(stay))
    kept = set(stay)
    own = {r[0]: shingles(r[1]) for r in rows}
    alike = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b])
    gone = [r[0] for r in rows if r[0] not in kept]
    missed = [i for i in range(150, 300) if i in kept and any(alike(i, j) >= 0.8 for j in range(i))]
    assert len(missed) <= 3
    assert set(range(75, 150)) <= kept and {None, 402} <= kept and not {400, 403} & kept
    assert all(any(alike(i, j) >= 0.6 for j in own if j != i) for i in gone)


def test_cut_texts(spark):
    p = " ".join(f"word{i}é" for i in range(40))
    rows = [(1, "one " + p, "en", "a", 5), (2, "two " + p + " end", "en", "b", 5), (3, None, None, None, None), (None, "x", "en", "c", 1)]
    got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "one " + p and got[2].text == "two end" and got[2].n_chars == 7 and got[2].source == "b"
    assert got[3].text == "" and got[None].text == "x"


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, lang string, n_chars long, `_` int, own string, row int, tie long, id_ int, tie_ int, gone int, stratum string, text_ string, n_words long"
    rows = [(1, "a b c d e f g h i j k l m n", "en", 1, 1, "x", 2, 3, 4, 5, 6, "s", "t", 7), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in without_repeats(docs).orderBy("doc_id").collect()] == [(None, "", None, 0, *[None] * 10), (1, rows[0][1], "en", 27, *rows[0][4:])]
    assert [tuple(r) for r in quality_filter(docs, labels).collect()] == rows[:1]
    assert sorted(map(str, map(tuple, toxicity_filter(docs, labels).collect()))) == sorted(map(str, rows))
    assert sorted(map(str, map(tuple, near_duplicate_filter(docs).collect()))) == sorted(map(str, rows))
    for stage in (without_repeats, near_duplicate_filter, lambda d: quality_filter(d, labels), lambda d: toxicity_filter(d, labels)):
        assert stage(docs).columns == docs.columns
    assert without_repeats(docs.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_run(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(30, 300)), "en", "s", 1) for i in range(300)]
    rows += [(500 + i, text(40) + " moron " + text(20), "en", "s", 1) for i in range(120)] + [(900 + i, rows[i][1], "en", "s", 1) for i in range(40)] + [(990, "few", "en", "s", 1), (991, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(300)] + [(500 + i, 1, 1) for i in range(100)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(300))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == DOC_COLUMNS
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.columns == DOC_COLUMNS and empty.collect() == []


def test_components_of_nothing(spark):
    _, roots = similarity_components(spark.createDataFrame([], "doc_id long, text string"))
    assert roots.collect() == []


def exact_roots(texts):
    own = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return set(up)


def varied(rng, words, edits):
    """Texts and, of each, copies with so many scattered words changed."""
    out = []
    for n in edits:
        w = [rng.choice(words) for _ in range(300)]
        out.append(" ".join(w))
        for at in range(n):
            w[(at * 300) // n + 2] = f"new{at}"
        out.append(" ".join(w))
    return out


def test_only_alike_texts_are_removed(spark, monkeypatch):
    rng = random.Random(3)
    texts = varied(rng, [f"w{i}" for i in range(3000)], [3, 4, 5, 8, 9, 10] * 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {r.doc_id for r in near_duplicate_filter(docs).collect()}
    assert exact_roots(texts) <= stay and len(stay) < len(texts)
    monkeypatch.setattr(simhash, "MEMBERS", 1)
    assert {r.doc_id for r in near_duplicate_filter(docs).collect()} == stay


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    rows = [(3, a), (5, a + " x"), (5, b), (7, b + " y"), (None, "c d e"), (None, "f g h"), (None, "f g h")]
    got = near_duplicate_filter(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {rows[k] for k in (0, 2, 4, 5)} and len(got) == 4


def test_texts_just_alike_enough_are_found(spark):
    rng = random.Random(5)
    texts = varied(rng, [f"w{i}" for i in range(3000)], [6] * 250)  # a similarity of 0.816
    few = [[f"s{i}x{k}" for k in range(16)] for i in range(60)]  # 12 shingles, and 14 of which 12 are the same: 0.857
    texts += [" ".join(w) for w in few] + [" ".join([*w, "p", "q"]) for w in few]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay, want = {r.doc_id for r in near_duplicate_filter(docs).collect()}, exact_roots(texts)
    assert want <= stay and len(stay - want) <= 1


def test_combined_loss_at_the_threshold():
    share = simhash.bit_share(0.8)
    assert 0.16 < share < 0.162
    tables = simhash.tables_needed(256, share, 64, 8, 0.001)
    rng = np.random.default_rng(6)
    far = rng.random((20_000, 256)) < share
    keys = [np.random.default_rng([7, t]).choice(256, 8, replace=False) for t in range(tables)]
    met = np.any([~far[:, k].any(1) for k in keys], axis=0) & (far.sum(1) <= 64)
    assert (~met).mean() < 0.002
