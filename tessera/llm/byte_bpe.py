"""Byte-level BPE by prefix dynamic programming.

Of every prefix of a piece the table keeps the one token that can end its encoding: a token that fits there and
whose predecessor - the token already kept for the shorter prefix - stays its neighbour when the two are encoded
together.  So a piece is encoded in one pass, bytes can be appended without looking back further than the longest
token, and after an edit the table is recomputed only until it runs as before again.  An automaton over the prefixes of
tokens, built as texts walk it, gives the tokens that end at a byte: no other ones are tried.

Defined results: null text is empty; an empty text has no tokens; null ids stay null; rows are independent, so
repeated rows and empty tables need nothing special.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .memo import Memo
from .spines import NEVER, Spines


#: Steps of the automaton that are remembered.
STEPS = 1_000_000


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.spines = Spines(lambda token: ranks.get(token, NEVER), self.merge)
        self.makes = Memo(self.spines.makes, len(ranks) + 1)  # whether a token encodes to itself
        self.prefixes = {t[:n] for t in ranks for n in range(len(t) + 1)}
        self.nodes: dict[bytes, tuple[dict, tuple, bytes]] = {}  # of a prefix: the nodes after each byte, the tokens that end with it, the prefix
        self.steps = 0
        self.pieces = Memo(self._piece)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The definition: the pair with the lowest rank is merged first, the left one of equals, down to ``least`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def node(self, seen: bytes) -> tuple[dict, tuple, bytes]:
        """Of the longest end of ``seen`` that begins a token; its tokens, with their lengths, are those that encode to themselves, longest first."""
        while seen not in self.prefixes:
            seen = seen[1:]
        if seen not in self.nodes:
            self.nodes[seen] = {}, tuple((t, len(t)) for t in (seen[i:] for i in range(len(seen))) if t in self.ranks and self.makes[t]), seen
        return self.nodes[seen]

    def step(self, node: tuple[dict, tuple, bytes], byte: int) -> tuple[dict, tuple, bytes]:
        if self.steps >= STEPS:
            self.nodes.clear()
            self.steps = 0
            node = self.node(node[2])
        self.steps += 1
        after = node[0][byte] = self.node(node[2] + bytes((byte,)))
        return after

    def extend(self, data: bytes, last: list[bytes], until: int | None = None) -> list[bytes]:
        """``last[i]``: the last token of data[:i]; goes on for the prefixes that ``last`` doesn't have."""
        near, known, start = self.spines.neighbours, self.spines.known, len(last)
        node = self.node(data[max(0, start - 1 - self.longest) : start - 1])
        for i, byte in enumerate(data[start - 1 : until], start):
            node = node[0].get(byte) or self.step(node, byte)
            for token, n in node[1]:
                if i == n:
                    last.append(token)
                    break
                pair = last[i - n], token
                fits = known.get(pair)
                if fits or (fits is None and near(*pair)):
                    last.append(token)
                    break
        return last

    def edit(self, data: bytes, last: list[bytes], start: int, end: int, new: bytes) -> tuple[bytes, list[bytes]]:
        """Replaces data[start:end]; what lies behind is taken over once the tables have agreed over the longest token."""
        out, table, shift = data[:start] + new + data[end:], last[: start + 1], len(new) - (end - start)
        agreed = 0
        while len(table) <= len(out):
            self.extend(out, table, len(table))
            i = len(table) - 1
            agreed = agreed + 1 if i > start + len(new) and i - shift < len(last) and last[i - shift] == table[i] else 0
            if agreed > self.longest:
                table += last[i - shift + 1 :]
        return out, table

    def tokens(self, data: bytes, last: list[bytes] | None = None) -> list[bytes]:
        last = self.extend(data, [b""]) if last is None else last
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return [self.ranks[t] for t in self.tokens(piece)]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split.findall(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        """Decimal ids, their number, and the bytes that these ids decode to."""
        ids = self.encode_piece(piece.encode())
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        found = list(map(self.pieces.__getitem__, self.split.findall(text)))
        ids = " ".join([f[0] for f in found])
        return sum([f[1] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids`` (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, ids array<long>").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` of the encoded and ``decoded_sha256`` of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            n, ids, decoded = zip(*(bpe.digest(t or "") for t in b.column(1).to_pylist())) if b.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
