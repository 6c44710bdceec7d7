"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are reduced to different ones first, so copies cost nothing.  Two fingerprints that differ in at most
``radius`` bits agree in at least one of ``radius + 1`` bands; each fingerprint is sent once for every band, and those
that agree in the leading bits of a band - as few as leave ``GROUP`` fingerprints to a key - are indexed together.  The
band's bits are moved to the front and one global sort, by ranges, brings each band's codes into the order of their Gray
ranks, where near codes are neighbours and those of a key lie together.  The index joins ``FAN`` neighbours at a time
and keeps of each node the bits that all below share; level by level up to one node for each key.
Two nodes whose shared bits differ too often, or anywhere in the band, are pruned with all that is below them; only
surviving leaves are compared bit by bit.  Links join components at once, and pairs of leaves that are in one component
already are skipped, so a dense group never emits its pairs: an index returns a star for each component.

No index holds more than ``ROWS`` fingerprints: the rows of a larger key are sent again under bands of the bits that its
band leaves free, until no key is larger; few free bits leave few different codes, so this ends.

``near_duplicate_filter`` asks for a similarity of shingle sets instead of a radius.  Its fingerprints are longer, and
its tables are drawn at random, because no set of bands guarantees so wide a radius; the index is the same.  It yields
candidates only: the sets of each component of candidates are compared themselves.  A key of over ``WIDE`` fingerprints,
or a component that is large, is dealt into blocks, and each two blocks meet: no link is lost, but the rows sent grow
with the blocks.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; null ids
sort first (a component with one has a null ``component_id``); rows that repeat an id are kept, each with its own
fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, lean, null_again, written
from .components import connected_components

FAN = 8
#: Fingerprints that a key of a band is meant to have, as a power of two.
GROUP = 12
#: Rows that one index holds; more than that of one key are sent again under finer keys.
ROWS = 1 << 20
#: Rows that are gathered before complete keys are indexed.
HELD = 1 << 17
#: Pairs that are expanded at once.
PAIRS = 1 << 20
#: Rows of a block that a key of the long fingerprints is dealt into.
WIDE = 20_000
#: Texts, and shingles, of a block that a large component of candidates is dealt into.
MEMBERS, SHINGLES = 4096, 1 << 22
SEED = 42
U = np.uint64


def fingerprint_words(h: np.ndarray, words64: int) -> np.ndarray:
    """A fingerprint of ``words64`` times 64 bits of hashed shingles; the first 64 are their majority."""
    if not len(h):
        return np.zeros(words64, U)
    more = [h]
    for k in range(1, words64):
        more.append(_mix(h + U(k * 0x9E3779B97F4A7C15 & 2**64 - 1)))
    return np.array([_majority(x) for x in more], U)


def _majority(h: np.ndarray) -> int:
    n = len(h)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(U)[0])


def fingerprint(data: bytes, shingle: int) -> int:
    h = shingle_hashes(data, shingle)
    return _majority(h) if len(h) else 0


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    words = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    ends = ends[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], U)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class _Level:
    """Nodes of one level: first child, number of children, bits that all share and their values."""

    def __init__(self, key: np.ndarray, ones: np.ndarray, zeros: np.ndarray, row: np.ndarray | None = None):
        head = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(key))
        place = place - np.maximum.accumulate(np.where(head, place, 0))
        self.first = np.flatnonzero(place % FAN == 0)
        self.count = np.diff(np.r_[self.first, len(key)])
        self.key = key[self.first]
        self.row = self.first if row is None else row[self.first]  # its first leaf
        self.ones = np.bitwise_and.reduceat(ones, self.first)
        self.zeros = np.bitwise_and.reduceat(zeros, self.first)


def _flatten(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := label[label], label):
        label = up
    return label


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of rows a and b; labels are the smallest row of a component."""
    while True:
        x, y = label[a], label[b]
        if not (k := x != y).any():
            return label
        a, b, x, y = a[k], b[k], x[k], y[k]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _flatten(label)


def index_components(key: np.ndarray, code: np.ndarray, radius: int, band: np.ndarray | None = None, tally: dict[str, int] | None = None) -> np.ndarray:
    """Rows sorted by (key, Gray rank of code) -> the first row of each row's component among the rows of its key.

    ``code`` may hold several words to a row.  Where ``band`` is given, a link may differ in none of its bits (the same
    for all rows of a key).  ``tally`` counts the pairs of nodes met and pruned, and of leaves compared.
    """
    code = code.reshape(len(key), -1)
    limit = max(1, PAIRS // code.shape[1])
    levels = [_Level(key, code, ~code)]
    while len(levels[-1].key) > 1 and (levels[-1].key[1:] == levels[-1].key[:-1]).any():
        levels.append(_Level(levels[-1].key, levels[-1].ones, levels[-1].zeros, levels[-1].row))
    label = np.arange(len(key))
    top = np.flatnonzero(levels[-1].count + (levels[0].count[levels[-1].first] if len(levels) > 1 else 0) > 1)
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        level = levels[depth]
        if depth == 0:
            same = lambda n: np.minimum.reduceat(label, level.first)[n] == np.maximum.reduceat(label, level.first)[n]
            k = ~(same(a) & same(b) & (label[level.first[a]] == label[level.first[b]]))
            a, b = a[k], b[k]
        per = level.count[a] * level.count[b]
        cut = np.searchsorted(np.cumsum(per), limit, side="left") + 1
        if cut < len(a):
            stack.append((depth, a[cut:], b[cut:]))
            a, b, per = a[:cut], b[:cut], per[:cut]
        if not len(a):
            continue
        pair = np.repeat(np.arange(len(a)), per)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(per) - per, per)
        width = level.count[b][pair]
        x, y = level.first[a][pair] + nth // width, level.first[b][pair] + nth % width
        k = x < y if depth == 0 else x <= y
        x, y = x[k], y[k]
        if depth == 0:
            apart, at = code[x] ^ code[y], x
        else:
            below = levels[depth - 1]
            apart, at = (below.ones[x] & below.zeros[y]) | (below.zeros[x] & below.ones[y]), below.row[x]
        k = np.bitwise_count(apart).sum(1, dtype=np.int64) <= radius
        if band is not None:
            k &= (apart[:, 0] & band[at]) == 0
        if tally is not None:
            tally["compared" if depth == 0 else "met"] = tally.get("compared" if depth == 0 else "met", 0) + len(k)
            tally["pruned"] = tally.get("pruned", 0) + (int((~k).sum()) if depth else 0)
        if depth == 0:
            label = _unite(label, x[k], y[k])
        else:
            stack.append((depth - 1, x[k], y[k]))
    return label


def bits_first(code: np.ndarray, mask: int) -> np.ndarray:
    """Codes with the bits of the mask, from its highest, moved to the front; the others follow in their order."""
    out = np.zeros_like(code)
    for bit in sorted(range(64), key=lambda b: (not mask >> b & 1, -b)):
        out = (out << U(1)) | ((code >> U(bit)) & U(1))
    return out


def front(n: int) -> int:
    return (1 << 64) - (1 << 64 - n) if n else 0


def _in_gray_order(columns: list[np.ndarray], words64: int) -> tuple[np.ndarray, ...]:
    """Rows (key, node, words..., band?) as (key, node, code, band) in the index's order."""
    key, node, code = columns[0], columns[1], np.stack(columns[2 : 2 + words64], 1).view(U)
    band = None
    if len(columns) > 2 + words64:
        masks, which = np.unique(columns[2 + words64].view(U), return_inverse=True)
        band = np.zeros(len(key), U)
        code = code.copy()
        for k, mask in enumerate(masks.tolist()):
            own = np.flatnonzero(which == k)
            code[own, 0] = bits_first(code[own, 0], mask)
            band[own] = front(mask.bit_count())
    s = np.lexsort((*(gray_rank(code[:, k]) for k in reversed(range(words64))), key))
    return key[s], node[s], code[s], None if band is None else band[s]


def _stars(radius: int, words64: int = 1, banded: bool = False):
    """Rows (key, node, words..., band if ``banded``) sorted by key -> a star for each component of a key."""

    def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, node, code, band = _in_gray_order(columns, words64)
        label = index_components(key, code, radius, band)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        root = least[label]
        k = root != node
        return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(root[k])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(i).to_numpy() for i in range(2 + words64 + banded)))
            n += b.num_rows
            if n >= HELD and held[0][0][0] != held[-1][0][-1]:
                columns = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1
                yield solve([c[:cut] for c in columns])
                held, n = [tuple(c[cut:] for c in columns)], len(columns[0]) - cut
        if n:
            yield solve([np.concatenate(x) for x in zip(*held)])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bands(known: int, radius: int) -> list[list[int]]:
    """The bits that ``known`` leaves free, from the highest, cut into ``radius + 1`` bands."""
    free = [b for b in reversed(range(64)) if not known >> b & 1]
    edges = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [free[x:y] for x, y in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def first_keys(code: np.ndarray, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band (key, band): the key is the number of the band and the Gray rank of its first ``bits`` bits, so that
    order by key and Gray rank is that by band and Gray rank alone."""
    for t, own in enumerate(bands(0, radius)):
        lead = own[:bits]
        rank = gray_rank(bits_first(code, _mask(lead)) >> U(64 - len(lead))) if lead else np.zeros(len(code), U)
        yield (U(t) << U(48)) | rank, np.full(len(code), _mask(own), U)


def finer_keys(key: np.ndarray, known: np.ndarray, code: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, key, band): rows of one key that differ in at most ``radius`` bits and in none of ``known`` meet again.

    In at least one of the bands of the free bits such rows agree; it makes the key, with the old key and all known
    bits.  Keys are hashed; a collision costs comparisons only.  ``band`` has the known bits and the band's.
    """
    for mask in np.unique(known).tolist():
        rows = np.flatnonzero(known == U(mask))
        old = _mix(key[rows]) ^ (code[rows] & U(mask))
        for t, own in enumerate(bands(mask, radius), 1):
            yield rows, _mix(_mix(old + U(t)) ^ (code[rows] & U(_mask(own)))), np.full(len(rows), mask | _mask(own), U)


def _send(radius: int, bits: int):
    """(node, fp) -> the row under each of its first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, band in first_keys(b.column("fp").to_numpy().view(U), radius, bits):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("node"), b.column("fp"), pa.array(band.view(np.int64))], names=["key", "node", "fp", "band"])

    return run


def _send_again(radius: int):
    """(key, node, fp, band) -> the rows under each of their finer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = (b.column(k).to_numpy() for k in ("node", "fp"))
            for rows, key, band in finer_keys(*(b.column(k).to_numpy().view(U) for k in ("key", "band", "fp")), radius):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), node[rows], fp[rows], band.view(np.int64))], names=["key", "node", "fp", "band"])

    return run


def _larger(sent: DataFrame, most: int) -> DataFrame | None:
    """(key, n) of the keys with more than ``most`` rows, written; None if there are none."""
    found = written(sent.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).coalesce(8), "larger")
    return None if found.isEmpty() else found


def _block_pairs(names: list[str]):
    """(key, node, ..., n): deals the rows of a key into n blocks and sends each to every pair of blocks with its own,
    so that any two rows of a key still meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, n = b.column(0).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            own = (_mix(b.column(1).to_numpy().view(U)) % n.astype(U)).astype(np.int64)
            for k in range(int(n.max())):
                rows = np.flatnonzero(k < n)
                pair = (np.minimum(own, k)[rows] << 32) | np.maximum(own, k)[rows]
                new = _mix(_mix(key[rows].view(U) + U(1)) ^ pair.view(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(new), *(b.column(c).take(pa.array(rows)) for c in range(1, b.num_columns - 1))], names=names)

    return run


def in_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...), those of a key of ``large`` (key, blocks) under keys of pairs of blocks."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.join(large.select("key", F.col("blocks").cast("long")), "key").mapInArrow(_block_pairs(rows.columns), kind)
    return rows.join(large.select("key"), "key", "left_anti").unionAll(dealt)


def fingerprint_components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(id, fp) -> (fp, root): for each different fingerprint the smallest id that links reach."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7: more bands leave too few bits to a key")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    n = nodes.count()
    kind, edges, order = "key long, node long, fp long, band long", [], ["key", "node", "fp", "band"]
    sent, dealt = nodes.select("node", "fp").mapInArrow(_send(radius, max(0, n.bit_length() - GROUP)), kind), DataFrame.repartitionByRange
    while True:  # ends: a key that has few free bits left can't be large
        large = _larger(sent, ROWS) if n > ROWS else None
        few = sent if large is None else sent.join(large, "key", "left_anti")
        edges.append(dealt(few.select(*order), "key").sortWithinPartitions("key").mapInArrow(lean(_stars(radius, banded=True), None), "u long, v long"))
        if large is None:
            break
        sent, dealt = sent.join(large, "key", "left_semi").select(*order).mapInArrow(_send_again(radius), kind), DataFrame.repartition
    edges = functools.reduce(DataFrame.unionAll, edges)
    roots = connected_components(edges)
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id that links reach)."""
    prints = written(
        docs.select(id_column(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(lean(_fingerprints(shingle)), "id long, fp long"), "prints"
    )
    out = prints.join(fingerprint_components(prints, radius), "fp")
    return out.select(null_again("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null_again("root").alias("component_id"))


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, shingle))


def _wide_fingerprints(shingle: int, words64: int):
    names = ["id", "tie", "node", "n", *(f"w{k}" for k in range(words64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((b.num_rows, 2 + words64), U)
            for i, t in enumerate(b.column(2).to_pylist()):
                h = shingle_set(t or b"", shingle)
                found[i, 0], found[i, 1], found[i, 2:] = xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), fingerprint_words(h, words64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in found.view(np.int64).T.copy())], names=names)

    return run


def _sets(shingle: int, names: list[str]):
    """The last column, a text, becomes its sorted hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t or b"", shingle).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=names)

    return run


def alike_components(code: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """The first row of each row's component under links of rows whose sets are at least so similar.

    Only pairs within ``radius`` are compared, and none that is in one component already.
    """
    size = np.array([len(x) for x in sets])
    seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.r_[0, np.cumsum(size)]
    mark, label = np.zeros(len(seen), bool), np.arange(len(sets))
    for x in range(len(sets) - 1):
        y = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])]
        y = y[np.bitwise_count(code[y] ^ code[x]).sum(1, dtype=np.int64) <= radius]
        if not len(y):
            continue
        own = flat[edge[x] : edge[x + 1]]
        mark[own] = True
        both = np.array([np.count_nonzero(mark[flat[edge[k] : edge[k + 1]]]) for k in y])
        mark[own] = False
        y = y[both >= similarity * (size[x] + size[y] - both)]
        label = _unite(label, np.full(len(y), x), y)
    return label


def _alike_stars(radius: int, similarity: float, words64: int):
    """(key, node, w0.., set) sorted by key -> a star for each component of alike sets of a key."""

    def solve(node: np.ndarray, code: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
        label = alike_components(code, [np.frombuffer(x, U) for x in sets], radius, similarity)
        k = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[label[k]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, codes, sets = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            key, node = (b.column(k).to_numpy() for k in range(2))
            code = np.stack([b.column(2 + k).to_numpy() for k in range(words64)], 1).view(U)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(starts, [*starts[1:], len(key)]):
                if last is not None and key[s] != last:
                    yield solve(np.concatenate(nodes), np.concatenate(codes), sets)
                    nodes, codes, sets = [], [], []
                last = key[s]
                nodes.append(node[s:e])
                codes.append(code[s:e])
                sets.extend(b.column(2 + words64).slice(s, e - s).to_pylist())
        if nodes:
            yield solve(np.concatenate(nodes), np.concatenate(codes), sets)

    return run


def _sampled_keys(words64: int, bits: int, tables: int):
    """Keys of some bits each, drawn once for all (the draw depends only on the numbers asked for)."""
    chosen = [np.random.default_rng([7, t]).choice(64 * words64, bits, replace=False) for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.stack([b.column(1 + k).to_numpy() for k in range(words64)], 1).view(U) if b.num_rows else np.zeros((0, words64), U)
            for t, own in enumerate(chosen):
                key = np.full(len(code), t, U)
                for bit in own:
                    key = (key << U(1)) | ((code[:, bit // 64] >> U(bit % 64)) & U(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], names=["key", "node", *(f"w{k}" for k in range(words64))])

    return run


def bit_share(similarity: float, smallest: int = 5, largest: int = 40) -> float:
    """The share of fingerprint bits in which two sets of so high a similarity differ, at most: that of the angle between
    large sets, or more between small ones, of which ``smallest`` to ``largest`` shingles in common are tried."""

    def differ(c: int, a: int, b: int) -> float:
        above = lambda k, n: sum(math.comb(n, x) for x in range(n + 1) if 2 * (k + x) > c + n) / 2**n
        each = ((above(k, a), above(k, b), math.comb(c, k) / 2**c) for k in range(c + 1))
        return sum(p * (x * (1 - y) + y * (1 - x)) for x, y, p in each)

    own = ((c, int(c / similarity - c + 1e-9)) for c in range(smallest, largest + 1))
    return max(math.acos(2 * similarity / (1 + similarity)) / math.pi, *(differ(c, a, n - a) for c, n in own for a in range(n // 2 + 1)))


def tables_needed(bits_all: int, share: float, radius: int, bits: int, missed: float) -> int:
    """Tables of keys of ``bits`` drawn bits by which two fingerprints meet within ``radius`` but for a probability of ``missed``."""
    n, d = bits_all, np.arange(radius + 1)
    chance = np.array([math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in d])
    apart = 1 - np.array([math.comb(n - k, bits) / math.comb(n, bits) for k in d])
    if 1 - chance.sum() >= missed:
        raise ValueError("the radius alone misses more")
    return next(t for t in itertools.count(1) if 1 - chance.sum() + (chance * apart**t).sum() <= missed)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words64: int = 4, missed: float = 0.0001, sigmas: float = 4.5):
    """Components of texts whose sets of shingles are alike: (a row for each different set, (node, root)).

    A similarity of ``similarity`` means a share of bits in which fingerprints differ on average (``bit_share``); texts
    are candidates at that many differing bits plus ``sigmas`` standard deviations.  That is far more than bands can
    guarantee, so keys are bits drawn at random, as many as leave about 1024 texts to a key, in so many tables that
    two texts just alike enough are no candidates, by radius or by tables, with a probability of ``missed`` at most.
    Components of candidates are then taken apart: two texts are linked only if their sets themselves are alike, so no
    link is a false one.
    """
    bits_all = 64 * words64
    share = bit_share(similarity)
    radius = int(bits_all * share + sigmas * math.sqrt(bits_all * share * (1 - share)))
    names = [f"w{k}" for k in range(words64)]
    longs = ", ".join(f"{n} long" for n in names)
    texts = docs.select(*_tied(id_col, text_col), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    prints = texts.mapInArrow(lean(_wide_fingerprints(shingle, words64)), f"id long, tie long, node long, n long, {longs}")
    least = F.min(F.struct("id", "tie")).alias("least")
    nodes = written(prints.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("n", *names))).select("node", "least.id", "least.tie", "n", *names), "nodes")
    n = nodes.count()
    bits = max(8, round(math.log2(max(2, n))) - 10)
    tables = tables_needed(bits_all, share, radius, bits, missed)
    columns = f"node long, {longs}"
    sent = nodes.select("node", *names).mapInArrow(_sampled_keys(words64, bits, tables), f"key long, {columns}")
    if n > WIDE and (large := _larger(sent, WIDE)):
        sent = in_blocks(sent, large.select("key", F.ceil(2 * F.col("n") / WIDE).alias("blocks")))
    maybe = connected_components(sent.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_stars(radius, words64), None), "u long, v long"))
    members = written(nodes.join(maybe.withColumnRenamed("root", "key"), "node"), "members")
    found = members.select("key", "node", *names, "id", "tie").join(texts, ["id", "tie"]).dropDuplicates(["node"])
    kept = ["key", "node", *names, "set"]
    sets = found.select("key", "node", *names, "text").mapInArrow(lean(_sets(shingle, kept)), f"key long, {columns}, set binary")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum("n") / F.lit(SHINGLES))).cast("long")
    large = written(members.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1").coalesce(8), "large")
    if not large.isEmpty():
        sets = in_blocks(written(sets, "sets"), large)
    links = sets.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_alike_stars(radius, similarity, words64), None), "u long, v long")
    return nodes, nodes.select("node").join(connected_components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _tied(id_col: str, text_col: str) -> list:
    """``id`` and ``tie``, which tell rows of different texts apart where an id is repeated."""
    return [id_column(id_col).alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tie")]


def near_duplicate_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those near another of smaller id: of each component the smallest id stays, once.

    Defined results: texts that are null, empty or white space have no shingles, are one group and leave one row; null ids
    sort first; of rows that repeat an id and its text one stays, rows that repeat an id with other texts are told apart
    by a hash of the text; an empty table stays empty; all columns are kept as they are, whatever their names.
    """
    nodes, roots = similarity_components(docs, id_col, text_col, shingle, similarity)
    stay = nodes.join(roots, "node").groupBy("root").agg(F.min(F.struct("id", "tie")).alias("least")).select("least.id", "least.tie")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_tied(id_col, text_col))
    return rows.join(stay, ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"]).select("row.*")
