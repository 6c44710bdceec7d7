"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (its size is that of the alphabet).
2. Disguised words - letters written as digits or signs, letters pulled apart, letters repeated - become character
   lattices: what each sign may stand for, that separators may be skipped and repeats dropped, each at a channel
   cost.  Viterbi decoding under the trigram model restores the most likely word, which takes the place of the
   disguise: learning and scoring see restored texts only.
3. Weights are learned from a bounded, balanced sample of labelled documents (``sample`` of each class, smallest hashes
   first).  Terms are words, and stems that a document uses several times.  A term counts once for each different pair
   of neighbours, so copies of one document are one witness.  A term's weight is the probability that a document with
   it is toxic, by the lower bound of its rate in toxic documents and the upper bound of that in others (score
   intervals of ``SIGMAS`` standard deviations).  Every term whose bounds are ``LIFT`` times apart has a weight; there
   is no cap on their number, which the sample bounds.
4. A score is graded: each family of terms (words and stems with the same first letters) is one piece of evidence, as
   strong as its strongest term, and the score is the probability that any of them is right, or the rate of documents
   without any term.

Labels of held-out documents (crc32 of the id as text divisible by 5) are never read.  Language, source and id are
no inputs of a score.

Defined results: null and empty texts score the rate without any word; a null id isn't held out, and its labels don't
count, nor do null labels; of repeated labels of one id the worst counts; repeated rows score alike; with no usable
labels of either class every score is the prior, a quarter without any label; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean
from .memo import Memo

#: Labelled documents of each class that the lexicon is learned from, at most.
SAMPLE = 3000
#: Standard deviations of a term's bounds, and how far apart they must be.
SIGMAS, LIFT = 3.0, 4.0
#: Words whose weights are remembered in each of two generations.
WORDS = 100_000
#: Letters that terms of one family have in common.
FAMILY = 4
FOLDS = 5
#: Lengths of stems, and how often a document must use one.
STEMS, LEAST = (4, 5, 6, 7), (2, 3)
LETTERS = 28  # 0: none, 1-26: a-z, 27: any other
#: What a sign may stand for (fixed values), besides itself where it is a letter.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
}
SEPARATORS = " .-_*~·/\\'​‌‍­"
#: Channel costs in nats.
COST_SIGN, COST_SKIP, COST_REPEAT, COST_DROP = 1.0, 0.7, 1.0, 14.0

_WORD = re.compile(r"[^\W\d_]+")
#: Single characters with one to three separators, mixed ones too, between each two.
_APART = re.compile(r"(?<!\S)[^\s.\-_~·/\\](?:[ .\-_*~·/\\]{1,3}[^\s.\-_~·/\\,!?;:*](?![^\s.\-_*~·/\\,!?;:#$%&])){2,}")
_RUN = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_INNER = re.compile("[" + re.escape("".join(SIGNS) + ".-_~·/\\​‌‍­") + "]")
_TRAIL = re.compile(r"^[^\w@$!|(+€£]+|^([^\w])\1+|[^\w]+$")
_HOT = re.compile(r"[0-9@$!|+(€£¥*#._~·/\\​‌‍­Ѐ-ӿ-]|([^\W\d_])\1\1")


def _codes() -> np.ndarray:
    code = np.zeros(256, np.int64)
    code[97:123] = code[65:91] = np.arange(1, 27)
    code[128:] = 27
    return code


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, total = _codes(), np.zeros(LETTERS**3, np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            c = code[np.frombuffer(b"  " + (text or b"") + b" ", np.uint8)]
            total += np.bincount(c[:-2] * LETTERS**2 + c[1:-1] * LETTERS + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


class Restorer:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(LETTERS, LETTERS, LETTERS) + 0.01
        bi = counts.reshape(LETTERS, LETTERS, LETTERS).sum(0) + 0.1
        uni = (bi.sum(0) + 1) / (bi.sum(0) + 1).sum()
        back = 0.99 * bi / bi.sum(1, keepdims=True) + 0.01 * uni
        smooth = 0.98 * tri / tri.sum(2, keepdims=True) + 0.02 * back[None]
        self.cost = (-np.log(smooth)).tolist()
        self.memo = Memo(self.decode)

    def decode(self, token: str) -> str:
        """The word that a token most likely disguises."""
        # state: the last two letters -> (cost, letters so far, each with those before it, which paths share)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for sign in token:
            own = ord(sign) - 96 if "a" <= sign <= "z" else 27 if sign.isalpha() and sign not in SIGNS else 0
            edges = [(own, sign, 0.0)] if own else []
            edges += [(ord(x) - 96, x, COST_SIGN) for x in SIGNS.get(sign, "")]
            skip = COST_SKIP if sign in SEPARATORS else COST_DROP if not own else None
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, word) in states.items():
                row = self.cost[a][b]
                for letter, char, channel in edges:
                    c = cost + channel + row[letter]
                    if (b, letter) not in new or c < new[b, letter][0]:
                        new[b, letter] = c, (word, char)
                    if letter == b:
                        c = cost + channel + COST_REPEAT
                        if (a, b) not in new or c < new[a, b][0]:
                            new[a, b] = c, word
                if skip is not None and (((a, b) not in new) or cost + skip < new[a, b][0]):
                    new[a, b] = cost + skip, word
            states = new
        _, _, word = min((cost + self.cost[a][b][0], (a, b), word) for (a, b), (cost, word) in states.items())
        letters = []
        while word:
            word, letter = word
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, text: str) -> tuple[str, list[str]]:
        """A text in lower case with its disguised words restored, and those restored ones whose letters were pulled apart."""
        apart: list[str] = []

        def join(m: re.Match) -> str:
            apart.append(self.memo[m.group()])
            return apart[-1]

        out = []
        for token in _APART.sub(join, text.lower()).split():
            if _HOT.search(token):
                core = _TRAIL.sub("", token)
                if len(core) >= 3 and not core.isdigit() and (_RUN.search(core) or (_INNER.search(core) and any(map(str.isalpha, core)))):
                    out.append(self.memo[core])
                    if "-" in core or "/" in core:
                        out += [self.memo[part] for part in re.split("[-/]", core) if len(part) > 1]
                    continue
            out.append(token)
        return " ".join(out), apart

    def words(self, text: str) -> list[str]:
        return _WORD.findall(self.restored(text)[0])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def terms(words: list[str]) -> dict[str, int]:
    """The terms of a document, each with a checksum of where it stands: copies of one text give the same.

    A word is a term, and so is a stem that words begin with at least so many times: ``stem*2``, ``stem*3``.
    """
    out: dict[str, int] = {}
    stems: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w not in out:
            out[w] = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
        for k in STEMS:
            if len(w) >= k:
                stems.setdefault(w[:k], []).append(i)
    for stem, at in stems.items():
        for least in LEAST:
            if len(at) >= least:
                out[f"{stem}*{least}"] = zlib.crc32(" ".join(words[i] for i in at[:least]).encode())
    return out


def _witnesses(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)
        for b in batches:
            seen = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            rows = dict.fromkeys((t, near, toxic) for text, toxic in seen for t, near in terms(restorer.words(text or "")).items())  # copies give the same once
            term, near, toxic = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(near, pa.int64()), pa.array(toxic, pa.int32())], names=["word", "near", "toxic"])

    return run


def bounds(n: Column, sigmas: float = SIGMAS) -> tuple[Column, Column]:
    """Lower and upper bound of an expected count of which n were seen."""
    middle, half = n + sigmas**2 / 2, sigmas * F.sqrt(n + sigmas**2 / 4)
    return middle - half, middle + half


def counted(pairs: DataFrame) -> DataFrame:
    """Per word the different neighbours in toxic documents and those in others only.

    One shuffle, by word, serves both groupings: it takes less of an executor's memory than grouping before it would.  A word has
    no more rows than the sample has documents (of rows that repeat an id, one in each batch).
    """
    by_pair = pairs.repartition("word").groupBy("word", "near").agg(F.max("toxic").alias("toxic"))
    return by_pair.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def squeeze(word: str) -> str:
    """Decoding drops repeats, so restored words are compared without double letters."""
    return re.sub(r"(.)\1+", r"\1", word)


class Model:
    """``weights``: of each term the probability of toxicity that it alone gives; ``prior``: without any term."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], prior: float):
        self.counts, self.weights, self.prior = counts, weights, prior

    def scorer(self, decode: bool = True):
        """The score of a text; ``decode`` off: of the text as it is written (to see what decoding decides)."""
        restorer, weights = Restorer(self.counts), self.weights
        words = {t: p for t, p in weights.items() if "*" not in t}
        stems = {t.partition("*")[0] for t in weights if "*" in t}
        lengths, families = sorted({len(t) for t in stems}), {t[:FAMILY] for t in stems}
        squeezed = {squeeze(w): w for w in sorted(words, key=words.get)}
        longest = max(map(len, squeezed), default=0)

        def known(word: str) -> str | None:
            """The word that has a weight and that this one is, or is with letters doubled."""
            if word in words:
                return word
            return squeezed.get(squeeze(word)) if decode and _DOUBLE.search(word) else None

        same = Memo(known, WORDS)

        def inside(joined: str) -> Iterator[str]:
            """Known words in letters that were pulled apart: where words begin isn't known."""
            joined = squeeze(joined)
            for i in range(len(joined)):
                for j in range(i + FAMILY, min(len(joined), i + longest) + 1):
                    if joined[i:j] in squeezed:
                        yield squeezed[joined[i:j]]

        def score(text: str | None) -> float:
            if not text:
                return self.prior
            text, apart = restorer.restored(text) if decode else (text.lower(), [])
            found = _WORD.findall(text)
            hits = set(map(same.__getitem__, found))
            hits.discard(None)
            for joined in apart:
                hits.update(inside(joined))
            best: dict[str, float] = {}
            for w in hits:
                best[w[:FAMILY]] = max(best.get(w[:FAMILY], 0.0), words[w])
            if families and (near := [w for w in found if w[:FAMILY] in families]):
                for k in lengths:
                    times = Counter(w[:k] for w in near)
                    for stem in stems & times.keys():
                        for least in LEAST:
                            if times[stem] >= least and (p := weights.get(f"{stem}*{least}")):
                                best[stem[:FAMILY]] = max(best.get(stem[:FAMILY], 0.0), p)
            return 1 - (1 - self.prior) * math.prod(1 - best[f] for f in sorted(best))

        return score


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    text = F.col(text_col).cast("string").alias("text")
    counts = np.zeros(LETTERS**3, np.int64)
    for r in docs.select(text.cast("binary").alias("text")).mapInArrow(lean(count_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n  # at most 28^3 rows
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)
    known = labels.where(usable).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n, *seen = known.agg(F.count("*"), *(F.count_if(F.col("toxic") == t) for t in (0, 1))).first()
    prior = (seen[1] + 0.5) / (n + 2)  # a quarter where nothing is known, so that nothing is rejected
    if not all(seen):
        return Model(counts, {}, prior)
    chosen = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(sample) for t in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text).join(F.broadcast(chosen[0].unionAll(chosen[1])), "id")  # 2 x sample rows at most
    pairs = rows.select("text", "toxic").mapInArrow(lean(_witnesses(counts)), "word string, near long, toxic int")
    by_word = counted(pairs)
    size = {t: min(sample, seen[t]) for t in (0, 1)}
    lift = bounds(F.col("bad"))[0] / size[1] / (bounds(F.col("good"))[1] / size[0])
    odds = F.col("lift") * (prior / (1 - prior))
    weights = {r.word: r.p for r in by_word.select("word", lift.alias("lift")).where(F.col("lift") >= LIFT).select("word", (odds / (1 + odds)).alias("p")).collect()}
    return Model(counts, weights, 0.5 * prior / (0.5 * prior + 1 - prior) if weights else prior)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([score(t) for t in b.column(2).to_pylist()], pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lean(run), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_documents(docs, learn(docs, labels, id_col, text_col), id_col, text_col)


def toxicity_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, unchanged and without a shuffle.

    Defined results: as above; null and empty texts stay, repeated rows stay or go together, a score of exactly 0.5 goes, an
    empty table stays empty; all columns are kept as they are, whatever their names.
    """
    model = learn(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < 0.5 for t in b.column("text_")[:].to_pylist()], pa.bool_())).drop_columns(["text_"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
