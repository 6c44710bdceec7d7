"""Suffix-array dedup: remove every byte that a 100-byte string covers which also starts earlier.

How it scales.  A suffix array over all bytes of a corpus can't be cut into independent tasks, so only those
suffixes are sorted together that can be equal:

1. Every ``length``-byte window is owned by its minimizer, the leftmost smallest of its hashed 32-byte grams.
   Equal windows have equal minimizers at equal places.  A run of windows with one owner is an *anchor*; it goes
   to the task of its gram's hash, as 24 bytes.  An anchor whose gram is found once in the corpus is dropped.
2. The *contexts* of the other anchors (all bytes of all their windows) are read from the documents and brought
   together by gram, in byte order.  Equal contexts are neighbours there; the first of them stays, of the others
   all windows are repeated.
3. The different contexts of a gram are sorted by their suffixes: their bytes, cut into blocks aligned at the anchor,
   form one integer string, whose suffix array the linear grouping construction builds (``suffixes.py``).  Runs of the
   array with a common prefix of ``length`` bytes, with equal bytes before the first block, are equal windows; all but
   the first of a run are repeated.
4. Repeated windows are gathered by document, which turns them into spans.

No removal rests on a hash: hashes only choose what meets, and what meets is compared byte by byte.

Large groups.  A gram with more different contexts than ``ARRAY`` is sorted in parts of so many, and the parts are
merged: the windows that a part doesn't find repeated leave it with their bytes, and a sort by these brings equal ones
of different parts together.  The contexts of a gram that holds a large share of all anchors (``heavy.py``: a list of
bounded size) are first dealt by their bytes and a salt of the document, where copies are settled, and those that stay
by their bytes alone, in parts as above.  So no task holds more than some thousands of contexts.

Defined results: null text is empty; null ids sort first; a text under ``length`` bytes keeps everything; rows
that repeat an id *and* its text are one document and get the same result; rows that repeat an id with other
text are told apart by a checksum of the text, and at equal starts the smaller checksum comes first.  Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freed, id_column, lean, null_again, written
from .heavy import heavy_keys
from .suffixes import suffix_array

GRAM, BLOCK, SEGMENT = 32, 14, 1 << 18
#: Contexts of different grams that are sorted together at least, and contexts of one gram in a part.
CONTEXTS, ARRAY = 1500, 2500
#: Anchors that a gram must have to be dealt by context.
WIDE = 20_000
#: Rows of a batch of contexts or windows.
ROWS = 20_000
SALTS = 64
TIE = (1 << 18) - 1
U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


_POWER = _powers(_ODD, SEGMENT + 1)
_INVERSE = _powers(pow(_ODD, -1, 2**64), SEGMENT + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    out, step = x, 1
    while step * 2 <= width:
        out, step = np.minimum(out[:-step], out[step:]), step * 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - step : width - step + n]) if step < width else out


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Gram hash, first owned window, number of owned windows, place of the gram in the context."""
    found = []
    low = U(0xFFFFF)
    for at in range(0, max(1, len(data) - length + 1), SEGMENT - length + 1):
        b = np.frombuffer(data, np.uint8)[at : at + SEGMENT]
        if (n := len(b)) < length:
            break
        total = np.zeros(n + 1, U)
        np.cumsum((b.astype(U) + U(1)) * _POWER[:n], out=total[1:])
        gram = _mix((total[GRAM:] - total[:-GRAM]) * _INVERSE[: n - GRAM + 1])
        least = _window_min((gram & ~low) | np.arange(len(gram), dtype=U), length - GRAM + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, len(least)])
        place = (least[first] & low).astype(np.int64)
        found.append((gram[place].view(np.int64), first + at, count, place - first))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


# An anchor's place: start of its first window (32 bits), windows, place of the gram (7 bits each), tie (18 bits).
def _pack(start: np.ndarray, count: np.ndarray, place: np.ndarray, tie: int) -> np.ndarray:
    return (start << 32) | (count << 25) | (place << 18) | tie


def _unpack(p: np.ndarray) -> tuple[np.ndarray, ...]:
    return (p >> 32) & 0xFFFFFFFF, (p >> 25) & 127, (p >> 18) & 127, p & TIE


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _grams(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                if text is not None and len(data := text.encode()) >= length:
                    yield _batch(["gram"], anchors(data, length)[0])

    return run


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None or len(data := text.encode()) < length:
                    continue
                gram, start, count, place = anchors(data, length)
                out.append((gram, np.full(len(gram), doc, np.int64), _pack(start, count, place, zlib.crc32(data) & TIE)))
            if out:
                yield _batch(["gram", "doc", "place"], *(np.concatenate(x) for x in zip(*out)))

    return run


def _repeated_grams(hot: np.ndarray):
    """Stream of anchors sorted by gram, doc, place -> those whose gram is met twice; repeated rows leave.

    Of a hot gram a task sees a part only, so that all of its anchors stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = tuple(np.zeros(0, np.int64) for _ in range(3)), False  # the last anchor; whether its gram was met before it
        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.r_[x, b.column(i).to_numpy()] for i, x in enumerate(held)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows], 0)
            gram, doc, place = (x[new] for x in rows)
            even = gram[1:] == gram[:-1]
            keep = np.r_[met, even] | np.r_[even, False] | np.isin(gram, hot)
            met, held = bool(len(gram) > 1 and even[-1]) or (len(gram) == 1 and met), (gram[-1:], doc[-1:], place[-1:])
            keep[-1] = False
            if keep.any():
                yield _batch(["doc", "place"], doc[keep], place[keep])
        if len(held[0]) and (met or held[0][0] in hot):
            yield _batch(["doc", "place"], *held[1:])

    return run


def _read_contexts(length: int):
    """(doc, text, places) -> gram and bytes of each anchor's context, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(2).flatten().to_numpy()
            texts = [t.encode() for t in b.column(1).to_pylist()]
            size, each = np.array([len(t) for t in texts], np.int64), np.asarray(pc.list_value_length(b.column(2)))
            data, base = b"".join(texts), np.repeat(np.cumsum(size) - size, each)
            doc, byte = np.repeat(b.column(0).to_numpy(), each), np.frombuffer(data, np.uint8)
            for k in range(0, len(places), ROWS):
                place = places[k : k + ROWS]
                start, count, gram_at, _ = _unpack(place)
                first = base[k : k + ROWS] + start
                gram = _mix(((byte[(first + gram_at)[:, None] + np.arange(GRAM)].astype(U) + U(1)) * _POWER[:GRAM]).sum(1, dtype=U)).view(np.int64)
                found = [data[x:y] for x, y in zip(first.tolist(), (first + count - 1 + length).tolist())]
                yield _batch(["gram", "doc", "place", "bytes"], gram, doc[k : k + ROWS], place, pa.array(found, pa.binary()))

    return run


def _digits(text: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes as two numbers in base 257; 0 stands for what lies behind the end."""
    halves = []
    for half in (0, BLOCK // 2):
        x = np.zeros(len(at), U)
        for k in range(half, half + BLOCK // 2):
            x = x * U(257) + np.where(k < room, text[np.minimum(at + k, len(text) - 1)].astype(U) + U(1), U(0))
        halves.append(x)
    return halves[0], halves[1]


def repeated_windows(contexts: list[bytes], doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of the contexts that equal an earlier one, as runs: context, first window, number of windows."""
    start, count, gram_at, tie = _unpack(place)
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contexts), np.uint8)
    first = gram_at % BLOCK
    blocks = -(-(sizes - first) // BLOCK)
    owner = np.repeat(np.arange(len(contexts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    inside = first[owner] + nth * BLOCK
    at, room = base[owner] + inside, sizes[owner] - inside
    hi, lo = _digits(text, at, room)
    by = np.lexsort((lo, hi))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.r_[True, (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])])
    string = np.zeros(len(owner) + len(contexts), np.int64)  # a 0 ends each context
    where = np.arange(len(owner)) + owner
    string[where] = rank
    block_at = np.full(len(string), -1)
    block_at[where] = np.arange(len(owner))
    order = block_at[np.array(suffix_array(string.tolist()), np.int64)]
    order = order[(order >= 0)]
    order = order[inside[order] <= gram_at[owner[order]]]  # the first block of some window
    common = np.empty(max(0, len(order) - 1), np.int64)
    for k in range(0, len(common), 8192):
        near = text[np.minimum(at[order[k : k + 8193]][:, None] + np.arange(length), len(text) - 1)]
        unlike = near[1:] != near[:-1]
        common[k : k + 8192] = np.where(unlike.any(1), unlike.argmax(1), length)
    common = np.minimum(common, np.minimum(room[order][1:], room[order][:-1]))
    own, ins, left = owner[order], inside[order], [np.zeros(len(order), U), np.zeros(len(order), U)]
    doc_rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    found = []
    for r in range(BLOCK):
        if r:
            half = (r - 1) // (BLOCK // 2)
            left[half] = left[half] * U(257) + np.where(ins >= r, text[np.maximum(at[order] - r, 0)].astype(U) + U(1), U(0))
        run = np.cumsum(np.r_[0, common < length - r])
        w = ins - r
        k = np.flatnonzero((w >= 0) & (w < count[own]))
        if len(k) < 2:
            continue
        key = (run[k], left[0][k], left[1][k])
        when = (doc_rank[own[k]] << 32) | (start[own[k]] + w[k])
        text_tie = tie[own[k]]
        s = np.lexsort((text_tie, when, key[2], key[1], key[0]))
        again = np.ones(len(s), bool)
        for x in key:
            again[1:] &= x[s][1:] == x[s][:-1]
        again[0] = False
        again[1:] &= (when[s][1:] != when[s][:-1]) | (text_tie[s][1:] != text_tie[s][:-1])  # a repeated row isn't its own copy
        found.append(((own[k][s][again]).astype(np.int64) << 32) | (w[k][s][again]))
    if not found or not len(x := np.sort(np.concatenate(found))):
        return (np.zeros(0, np.int64),) * 3
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1] + 1])
    return x[heads] >> 32, x[heads] & 0xFFFFFFFF, np.diff(np.r_[heads, len(x)])


#: What a settled row is: repeated windows; a context of a hot gram that is left (with its gram); a window of a part that is left.
REPEATED, LEFT, WINDOW = 0, 1, 2
SETTLED = "kind int, gram long, doc long, place long, bytes binary"


def left_windows(rows: list[tuple], found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Context, first byte and bytes of each window that isn't among the found runs."""
    own, first, n = found
    start, count, _, tie = _unpack(np.array([r[2] for r in rows], np.int64))
    base = np.cumsum(count) - count
    step = np.zeros(int(count.sum()) + 1, np.int64)
    np.add.at(step, base[own] + first, 1)
    np.add.at(step, base[own] + first + n, -1)
    which = np.repeat(np.arange(len(rows)), count)
    stay = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    which, at = which[stay], stay - base[which[stay]]
    return which, _pack(start[which] + at, 1, 0, tie[which]), [rows[i][3][k : k + length] for i, k in zip(which.tolist(), at.tolist())]


def _settle(length: int, most: int, hot: np.ndarray, parts: bool):
    """Contexts sorted by gram, bytes, doc, place -> settled rows.

    With ``parts`` a task has a part only of every gram; without, the contexts of a hot gram that are left leave as they are.
    """
    names = ["kind", "gram", "doc", "place", "bytes"]

    def solve(rows: list[tuple], merge: bool) -> Iterator[pa.RecordBatch]:
        doc, place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        found = repeated_windows([r[3] for r in rows], doc, place, length) if len(rows) > 1 else (np.zeros(0, np.int64),) * 3
        own, first, n = found
        start, _, _, tie = _unpack(place)
        yield _batch(names, np.full(len(own), REPEATED, np.int32), np.zeros(len(own), np.int64), doc[own], _pack(start[own] + first, n, 0, tie[own]), pa.nulls(len(own), pa.binary()))
        if merge:
            which, at, windows = left_windows(rows, found, length)
            for k in range(0, len(at), ROWS):
                part = doc[which[k : k + ROWS]]
                yield _batch(names, np.full(len(part), WINDOW, np.int32), np.zeros(len(part), np.int64), part, at[k : k + ROWS], pa.array(windows[k : k + ROWS], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot = set(hot.tolist())
        held: list[tuple] = []
        gram, own, wide = None, 0, parts  # the gram that arrives, its first row in ``held``, whether it is sorted in parts
        last: tuple = (None, None, None, None)
        for b in batches:
            kinds, rows = [], []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if row[0] != gram:
                    if wide and len(held) > own:
                        yield from solve(held[own:], True)
                        del held[own:]
                    elif len(held) == own + 1:
                        held.pop()  # windows of one context differ
                    if len(held) >= CONTEXTS:
                        yield from solve(held, False)
                        held = []
                    gram, own, wide = row[0], len(held), parts
                elif row[3] == last[3]:
                    if row[1:3] != last[1:3]:
                        kinds.append(REPEATED)
                        rows.append((0, row[1], row[2], None))
                    last = row
                    continue
                last = row
                if gram in is_hot and not parts:
                    kinds.append(LEFT)
                    rows.append(row)
                    continue
                held.append(row)
                if len(held) - own >= most:
                    wide = True
                    yield from solve(held[own:], True)
                    del held[own:]
            if rows:
                kind = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield _batch(names, pa.array(kinds, pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows), kind)))
        if wide and len(held) > own:
            yield from solve(held[own:], True)
            del held[own:]
        if held:
            yield from solve(held, False)

    return run


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of windows sorted by bytes, doc, place -> those that equal an earlier one; repeated rows leave."""
    last: tuple = (None, None, None)
    for b in batches:
        out = []
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            if row[0] == last[0] and row != last:
                out.append(row[1:])
            last = row
        if out:
            yield _batch(["doc", "place"], *(pa.array(c, pa.int64()) for c in zip(*out)))


def _cut(length: int, whole_chars: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, spans, kept = [], [], []
            gone_lists = b.column("gone")
            packed = gone_lists.flatten().to_numpy()
            size = pc.fill_null(pc.list_value_length(gone_lists), 0).to_numpy()
            for text, at, n in zip(b.column("text").to_pylist(), np.cumsum(size) - size, size):
                data = (text or "").encode()
                start, windows = packed[at : at + n] >> 8, packed[at : at + n] & 255
                step = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + windows - 1 + length, minlength=len(data) + 1)
                gone = np.cumsum(step[:-1]) > 0
                if whole_chars and len(data):  # a character stays unless all its bytes go
                    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                    gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                n_bytes.append(len(data))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield _batch(
                ["doc", *keep, "n_bytes", "spans", "kept"], b.column("doc"), *(b.column(c) for c in keep), pa.array(n_bytes, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            )

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, whole_chars: bool = False, keep: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, removed ``spans`` (start, end in bytes) and the ``kept`` bytes.

    With ``keep`` a column ``row`` holds the other columns of ``docs`` as its field ``own``, whatever their names.

    ``whole_chars`` leaves characters whole of which only some bytes would go.
    """
    if not 2 * GRAM <= length <= 127:
        raise ValueError("length must be 64 to 127 bytes")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    others = F.struct((F.struct(*others) if others else F.lit(None).cast("int")).alias("own"))
    whole = docs.select(id_column(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), *([others.alias("row")] if keep else []))
    docs = whole.select("doc", "text")
    hot = heavy_keys(docs.select("text").mapInArrow(lean(_grams(length)), "gram long"), WIDE)
    is_hot = F.col("gram").isin(hot.tolist())
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    by_gram = lambda other: [F.when(is_hot, other).otherwise(F.col("gram"))] if len(hot) else ["gram"]
    places = docs.mapInArrow(lean(_find_anchors(length)), "gram long, doc long, place long")
    places = places.repartition(*by_gram(F.xxhash64("gram", "doc", "place"))).sortWithinPartitions("gram", "doc", "place")
    repeated = places.mapInArrow(lean(_repeated_grams(hot), None), "doc long, place long")
    tie = F.col("place").bitwiseAND(TIE)
    wanted = repeated.groupBy("doc", tie.alias("tie")).agg(F.collect_list("place").alias("wanted"))
    with_tie = whole.withColumn("tie", F.crc32(F.coalesce("text", F.lit(""))).bitwiseAND(TIE))
    contexts = with_tie.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).select("doc", "text", "wanted")
    # written as they stand in the documents, where neighbours overlap and compress well; the shuffles before can go then
    contexts = written(contexts.mapInArrow(lean(_read_contexts(length), 64), "gram long, doc long, place long, bytes binary"), "contexts")
    freed(docs.sparkSession)
    in_order = lambda df, *by: df.repartition(*by).sortWithinPartitions("gram", "bytes", "doc", "place")
    settled = written(in_order(contexts, *by_gram(F.xxhash64("gram", "bytes", salt))).mapInArrow(lean(_settle(length, ARRAY, hot, False), None), SETTLED), "settled")
    discard(contexts)
    freed(docs.sparkSession)
    if len(hot):
        left = settled.where(F.col("kind") == LEFT).select("gram", "doc", "place", "bytes")
        parts = in_order(left, F.xxhash64("gram", "bytes")).mapInArrow(lean(_settle(length, ARRAY, hot, True), None), SETTLED)
        settled = settled.where(F.col("kind") != LEFT).unionByName(written(parts, "parts"))
    sure = settled.where(F.col("kind") == REPEATED).select("doc", "place")
    windows = settled.where(F.col("kind") == WINDOW).select("bytes", "doc", "place")
    if not windows.isEmpty():
        windows = windows.repartition(F.xxhash64("bytes")).sortWithinPartitions("bytes", "doc", "place")
        sure = sure.unionByName(windows.mapInArrow(lean(_equal_windows, None), "doc long, place long"))
    sure = sure.select(
        "doc", tie.alias("tie"), F.shiftrightunsigned("place", 32).alias("start"), F.shiftrightunsigned("place", 25).bitwiseAND(127).alias("windows")
    )
    gone = sure.groupBy("doc", "tie").agg(F.collect_list(F.shiftleft("start", 8).bitwiseOR(F.col("windows"))).alias("gone"))
    kind = f"row {whole.schema['row'].dataType.simpleString()}, " if keep else ""
    carried = ["row"] if keep else []
    out = with_tie.join(gone, ["doc", "tie"], "left").select("doc", "text", "gone", *carried).mapInArrow(
        lean(_cut(length, whole_chars, carried)), f"doc long, {kind}n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return out.select(null_again("doc").alias(id_col), *carried, "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts (whole characters only) and ``count_col`` counted anew.

    Defined results: null texts become empty, and so do those that are repeated as a whole; no row goes; null ids sort first;
    repeated rows stay and are cut alike; an empty table stays empty; all columns are kept, whatever their names.
    """
    found = suffix_dedup(docs, id_col, text_col, length, whole_chars=True, keep=True)
    text = F.col("kept").cast("string")
    new = {id_col: F.col(f"`{id_col}`"), text_col: text, count_col: F.char_length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row.own.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
