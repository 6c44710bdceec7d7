import math
import random
import re
from collections import Counter
from fractions import Fraction

from tessera.llm.quality import GRID, PATH, count_features, quality_filter, quality_rules, within


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts():
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "#", "|", "\x1c", " ", "X", "a b a b a b c "]) for _ in range(rng.randint(0, 60)))
        assert count_features(t.encode())[:5] == plain(t)


def test_exact_bound():
    assert within(0, 300, 0.01, 0.05) and not within(0, 298, 0.01, 0.05)  # 0.99^299 < 0.05
    assert not within(3, 300, 0.01, 0.05) and not within(0, 0, 0.01, 0.05)
    assert within(10, 100_000, 0.01, 0.001)


def test_cutoffs_reject_junk_and_keep_good(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(4000):
        junk = i % 5 == 0
        rows.append((i, " ".join(word() + ("###" if junk else "") for _ in range(40)), "en", 1))
        if i % 2:
            labels.append((i, 0 if junk else 1))
    rows += [(9000, "few words", "en", 1), (9001, None, None, 1), (9002, " ".join(word() for _ in range(20)), "xx", 1), (None, " ".join(word() for _ in range(20)), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame(labels + labels[:5] + [(77777, 1), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert len(got) == len(rows)
    assert [got[k].kept for k in (9000, 9001, 9002, None)] == [False, False, True, True]
    assert sum(got[i].kept for i in range(4000) if i % 5) >= 0.98 * 3200
    assert not any(got[i].kept for i in range(0, 4000, 5))
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(k or -1 for k, r in got.items() if r.kept)


def exact_tail(k, n, p):
    return sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))


def test_verdict_against_brute_force(spark):
    """Levels tried one after another on plain counts, with exact fractions for the bound."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(1600):
        lang = rng.choice(["en", "en", "de", None, "few"]) if i % 40 else "few"
        lang = lang if lang != "few" or i % 8 == 0 else "en"
        kind = rng.random()
        words = [word() for _ in range(rng.randint(12, 40))]
        if kind < 0.1:
            words = [w + "#" * rng.randint(0, 6) for w in words]
        elif kind < 0.2:
            words = [w.upper() if rng.random() < kind * 5 - 0.3 else w for w in words]
        elif kind < 0.25:
            words = [w * rng.randint(1, 5) for w in words]
        rows.append((i, rng.choice([" ", " ", "\n"]).join(words), lang))
        if rng.random() < 0.8:
            labels.append((i, None if rng.random() < 0.05 else int(kind > 0.1 or rng.random() < 0.2)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(docs, marks).collect()}

    def measures(t):
        n, chars, symbols, dup, repeat = plain(t)
        lines, letters = sum(bool(x.strip()) for x in t.split("\n")), sum(c.isascii() and c.isalpha() for c in t)
        upper = sum("A" <= c <= "Z" for c in t)
        per = lambda a, b: min(1.0, a / b) if b else 0.0
        return {"symbols": per(symbols, chars), "dup_lines": per(dup, lines), "repeats": per(repeat, n), "upper": per(upper, letters), "long_words": per(chars, 32 * n), "short_words": 1.0 - per(chars, 32 * n)}

    own = {i: measures(t) for i, t, _ in rows}
    base = {i: (f := plain(t))[0] < 10 or 100 * f[4] > 20 * f[0] for i, t, _ in rows}
    rejects = lambda i, t: any(own[i][r] >= a + (b - a) * t / GRID - 1e-12 for r, (a, b) in PATH.items())
    good = {s: [i for i, _, x in rows if x == s and not base[i] and (i, 1) in set(labels)] for s in {r[2] for r in rows}}
    level = {}
    for s, ids in good.items():
        level[s] = 0
        for t in range(1, GRID + 1):
            if not ids or exact_tail(sum(rejects(i, t) for i in ids), len(ids), 0.02) > 0.05 / len(good):
                break
            level[s] = t
    assert 0 in level.values() and max(level.values()) > 10, level
    for i, _, s in rows:
        assert got[i] == (base[i], not base[i] and not (level[s] and rejects(i, level[s]))), (i, s, level)


def test_very_long_text(spark):
    t = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, t, "en"), (2, t + " ###", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got[1].n_words == 150_000 and got[1].kept and got[2].n_symbols == 3 and got[2].n_repeat_words == 0


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules(docs, labels).collect() == [] and quality_filter(docs, labels).collect() == []
