import random
import zlib

import numpy as np

from tessera.llm.toxicity import COST_DROP, COST_REPEAT, COST_SIGN, COST_SKIP, LETTERS, SEPARATORS, SIGNS, Restorer, _witnesses, count_trigrams, counted, learn, toxicity, toxicity_filter

DISGUISED = [
    "you m0r0n there", "what an i d i o t he is", "such a m.o.r.o.n. again", "moooooron and", "1d10t", "an !diot", "an iddiot", "m o-r o n", "i  d i   o t", "mmoron", "m-0-r-0-n",
]


def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choice(["ta", "re", "lo", "mi", "so", "ne", "pu"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.randint(10, 40))]
        if bad := i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, int(bad)))
    return rows, labels, words


def test_held_out_accuracy_and_disguises(spark):
    rows, labels, words = corpus()
    rows += [(10_000 + k, f"{words[0]} {words[3]} {t} {words[5]}") for k, t in enumerate(DISGUISED)]
    rows += [(20_000, None), (20_001, ""), (None, words[2]), (20_002, "call 555 1234, a b c, at 3.5 or v1.2 !!!! ###")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(labels + labels[:3] + [(None, 1), (99_999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert [got[i].predicted for i in range(1500)] == [int(i % 6 == 0) for i in range(1500)]
    assert all(got[10_000 + k].predicted for k in range(len(DISGUISED))), [(t, got[10_000 + k].score) for k, t in enumerate(DISGUISED)]
    assert not any(got[i].predicted for i in (20_000, 20_001, 20_002, None))
    model = learn(docs, labels)
    plain, full = model.scorer(decode=False), model.scorer()
    assert all(plain(t) < 0.5 <= full(t) for t in DISGUISED), [(t, plain(t), full(t)) for t in DISGUISED]
    assert len({r.score for r in got.values()}) > 3
    kept = toxicity_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(-1 if i is None else i for i, r in got.items() if not r.predicted)


def cheapest(cost, token):
    """Every path through a token's lattice, one after another: the least cost and its words."""
    found = []

    def walk(k, a, b, spent, word):
        if k == len(token):
            found.append((spent + cost[a][b][0], word))
            return
        sign = token[k]
        own = ord(sign) - 96 if "a" <= sign <= "z" else 0
        for letter, channel in [(own, 0.0)] * bool(own) + [(ord(x) - 96, COST_SIGN) for x in SIGNS.get(sign, "")]:
            walk(k + 1, b, letter, spent + channel + cost[a][b][letter], word + chr(96 + letter))
            if letter == b:
                walk(k + 1, a, b, spent + channel + COST_REPEAT, word)
        if sign in SEPARATORS or not own:
            walk(k + 1, a, b, spent + (COST_SKIP if sign in SEPARATORS else COST_DROP), word)

    walk(0, 0, 0, 0.0, "")
    least = min(found)[0]
    return least, {w for c, w in found if c < least + 1e-9}


def test_decoding_against_all_paths():
    import pyarrow as pa

    rng = random.Random(9)
    text = " ".join(rng.choice(["idiot", "moron", "test", "tool", "glass", "hello"]) for _ in range(400)).encode()
    counts = np.zeros(LETTERS**3, np.int64)
    for b in count_trigrams([pa.RecordBatch.from_arrays([pa.array([text, None])], names=["t"])]):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    own = Restorer(counts)
    for _ in range(400):
        token = "".join(rng.choice(list("idotmrn10!$.-o7*g%") + ["oo"]) for _ in range(rng.randint(1, 6)))
        assert own.decode(token) in cheapest(own.cost, token)[1], token
    assert own.decode("1d1.0t") == "idiot"


def test_null_labels_change_nothing(spark):
    rows, labels, _ = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    one = learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = learn(docs, spark.createDataFrame(labels + [(i, None) for i in range(0, 1500, 7)], "doc_id long, toxic int"))
    assert one.prior == two.prior and one.weights == two.weights and one.weights


def test_very_long_text(spark):
    rows, labels, words = corpus()
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = model.scorer()
    long = " ".join(words * 500)
    assert score(long) < 0.5 <= score(long + " m.o.r.o.n")
    assert score("x" * 300_000) < 0.5 and score("a " * 100_000) < 0.5


def test_without_labels_or_rows(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(none, labels).collect() == []
    assert [r.score for r in toxicity(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), labels).collect()] == [0.25, 0.25]


def test_witnesses_are_grouped_in_one_shuffle(spark):
    import pyarrow as pa

    def rows(texts, toxic):
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic, pa.int32())], names=["text", "toxic"])
        return [tuple(r.values()) for out in _witnesses(np.ones(LETTERS**3, np.int64))([batch]) for r in out.to_pylist()]

    one, other = rows(["a fine day", "so fine a day"], [0, 1]), rows(["not a fine day"], [0])
    assert sorted(rows(["a fine day"] * 500 + ["so fine a day"] * 500, [0] * 500 + [1] * 500)) == sorted(one)
    got = counted(spark.createDataFrame(one + other + one, "word string, near long, toxic int"))
    near = {}
    for word, n, toxic in one + other:
        near.setdefault(word, {})[n] = max(toxic, near.get(word, {}).get(n, 0))
    assert {tuple(r) for r in got.collect()} == {(w, sum(x.values()), len(x) - sum(x.values())) for w, x in near.items()}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
