"""Quality rules with risk-controlled thresholds.

Features are counted over each whole text.  A rule rejects a document whose measure lies at or above a cutoff.  All rules
tighten together along one fixed path (``PATH``) of ``GRID`` levels, from what nothing reaches to what is plainly junk.
For each stratum the level is chosen on labelled documents: from the loosest level to tighter ones, a level is taken
while the exact (Clopper-Pearson) upper bound of the share of good documents that any of its rules rejects is within
``limit``.  As the path is fixed beforehand, testing in its order and stopping at the first failure controls the error
over all levels, and as a level is tested by all its rules at once, the whole limit holds for the whole verdict; over
strata ``error`` is divided (Bonferroni).  So with probability 1 - ``error``, in every stratum at once, at most
``limit`` of the good documents are rejected by the chosen level.  Without any false rejection a stratum needs
log(error / strata) / log(1 - limit) good labels, 217 for four strata; one with fewer keeps all that the base rule keeps.

Defined results: null text has no words and fails the base rule; a null stratum is a stratum of its own; of repeated
labels of one id the best counts; null labels, and labels without a document or with a null id count nothing; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_column, lean, null_again, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Levels of the path.
GRID = 64
#: The cutoffs of each rule before the first level and at the last one; between them they move evenly.
PATH = {
    "symbols": (1.0, 0.02),
    "dup_lines": (1.0, 0.5),
    "repeats": (1.0, 0.2),
    "upper": (1.0, 0.3),
    "long_words": (1.0, 12 / 32),
    "short_words": (1.0, 1 - 2.5 / 32),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : n + k] for k in range(window))))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), bool, n))
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def count_features(data: bytes) -> tuple[int, ...]:
    words = data.split()  # bytes: splits at exactly the six ASCII white space characters
    each = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(each[128:192].sum()) - int(each[list(SPACES)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = int(each[65:91].sum()), int(each[97:123].sum())
    return len(words), chars, int(each[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, upper + lower


def _count(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [count_features(t or b"") for t in b.column("text_bytes").to_pylist()]
            found = np.array(found, np.int64).reshape(len(found), len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(found[:, k]) for k in range(len(COUNTS))], names=columns + COUNTS)

    return run


def features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    rows = docs.select(id_column(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").cast("binary").alias("text_bytes"))
    return rows.mapInArrow(lean(_count(["id", "stratum"])), "id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Measures in 0 to 1; larger is worse."""
    per = lambda a, b: F.coalesce(F.least(F.lit(1.0), a / F.nullif(b, F.lit(0))), F.lit(0.0))
    col = F.col
    mean = per(col("word_chars"), col("n_words") * F.lit(32))
    return {
        "symbols": per(col("n_symbols"), col("word_chars")),
        "dup_lines": per(col("n_dup_lines"), col("n_lines")),
        "repeats": per(col("n_repeat_words"), col("n_words")),
        "upper": per(col("n_upper"), col("n_letters")),
        "long_words": mean,
        "short_words": F.when(col("n_words") > 0, 1.0 - mean).otherwise(F.lit(0.0)),
    }


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    at = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in at]) + at * math.log(p) + (n - at) * math.log1p(-p)
    return float(np.exp(log).sum())


def within(k: int, n: int, limit: float, error: float) -> bool:
    """Whether the exact upper bound at ``error`` of a rate seen as k of n is at most ``limit``: P(X <= k | limit) <= error."""
    return n > 0 and k < limit * n and _tail(k, n, limit) <= error


def choose_levels(counts: dict, limit: float, error: float) -> dict:
    """counts: good documents of each stratum by the level that first rejects them (above ``GRID``: none does).

    The tightest sure level of each stratum; those without any are left out.
    """
    chosen = {}
    for stratum, own in counts.items():
        n, rejected = sum(own.values()), list(accumulate(own.get(t, 0) for t in range(1, GRID + 1)))
        sure = next((t for t, k in enumerate(rejected) if not within(k, n, limit, error / len(counts))), GRID)
        if sure:
            chosen[stratum] = sure
    return chosen


def level() -> Column:
    """The first level at which some rule rejects a row, from 1; above ``GRID`` none does."""
    first = [F.ceil((F.lit(loose) - measure) * (GRID / (loose - tight))) for (loose, tight), measure in ((PATH[r], m) for r, m in rules().items())]
    return F.greatest(F.lit(1), F.least(F.lit(GRID + 1), *first)).cast("int")


def learn_levels(counted: DataFrame, labels: DataFrame, limit: float, error: float, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """What comes to the driver: a count for each stratum and level."""
    best = labels.where(F.col(id_col).isNotNull()).groupBy(id_column(id_col).alias("id")).agg(F.max(label_col).alias("good")).where("good = 1").select("id")
    # no rule has to reject what the base rule does
    found = counted.where(~base_failed()).join(best, "id").groupBy("stratum", level().alias("level")).agg(F.count("*").alias("n")).collect()
    counts: dict = {}
    for r in found:
        counts.setdefault(r.stratum, {})[r.level] = r.n
    return choose_levels(counts, limit, error)


def verdict(levels: dict) -> Column:
    """True where the chosen level of its stratum rejects the row."""
    out = F.lit(False)
    for t in sorted(set(levels.values())):
        strata = [s for s, x in levels.items() if x == t and s is not None]
        here = F.coalesce(F.col("stratum").isin(strata), F.lit(False)) if strata else F.lit(False)
        if levels.get(None) == t:
            here = here | F.col("stratum").isNull()
        out = out | (here & (level() <= t))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """Per row: id, stratum, the counts, ``base_failed`` and ``kept``."""
    counted = written(features(docs, id_col, text_col, stratum_col), "quality")
    levels = learn_levels(counted, labels, limit, error)
    return counted.select(null_again("id").alias(id_col), "stratum", *COUNTS, base_failed().alias("base_failed"), (~(base_failed() | verdict(levels))).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.  Only counts are written; texts aren't shuffled but counted once more.

    Defined results: as above; null and empty texts go, as they fail the base rule; of repeated rows all stay or go; an
    empty table stays empty; all columns are kept as they are, whatever their names.
    """
    levels = learn_levels(written(features(docs, id_col, text_col, stratum_col), "quality"), labels, limit, error)
    row, text = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.col(text_col).cast("string").cast("binary")
    rows = docs.select(row.alias("row"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text_bytes"))
    kind = rows.schema["row"].dataType.simpleString()
    counted = rows.mapInArrow(lean(_count(["row", "stratum"])), f"row {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.where(~(base_failed() | verdict(levels))).select("row.*")
