"""Ids of the lower-casing word tokenizer, word by word, as the tokenizers library gives them for a whole text.

White space only separates there, so every word is encoded once and remembered.  The merges run in tiktoken's merge
loop: the end of a word is a byte that no text holds, which the first ranks attach to the last byte.  That loop
merges any two neighbours whose union is a token, the library only the listed pair; both give the same if every token
encodes to itself, which ``load`` checks against the listed merges; only words that meet an exception need the
library, which is loaded for the first of them.

The strings of special tokens are their ids wherever they stand, as by the library's default.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import regex
import tiktoken
from tokenizers import Tokenizer

from .memo import Memo

END = b"\xff"
#: Words that are remembered in each of two generations.
WORDS = 150_000
#: Fixed by the file's own pre-tokenizer; white space is what Unicode says.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character and the others as those from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            found = json.load(f)
        vocab = found["model"]["vocab"]
        byte = _byte_of_symbol()
        self.added = {t["content"].encode(): t["id"].to_bytes(4, "little") for t in found["added_tokens"]}
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        special = {t["id"] for t in found["added_tokens"]}
        ranks = {}
        for token, i in vocab.items():
            if i not in special:
                word = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in word) + END * (word != token)] = i
        ranks[END] = max(vocab.values()) + 1  # never alone
        self.core = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.odd = self._not_itself(ranks, _pairs(found["model"]["merges"]))
        self.split = regex.compile(PATTERN)
        self.words = Memo(self._word, WORDS)

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _not_itself(self, ranks: dict[bytes, int], listed: list[tuple[str, str]]) -> set[int]:
        """Tokens that the tiktoken loop would make and the listed merges wouldn't."""
        merges = {pair: k for k, pair in enumerate(listed)}
        byte = _byte_of_symbol()
        name = {bytes(byte[c] for c in t.removesuffix("</w>")) + END * t.endswith("</w>"): t for pair in merges for t in (pair[0], pair[1], _union(*pair))}
        odd = set()
        for data, i in ranks.items():
            if len(data.removesuffix(END)) < 2 or data not in name:
                continue
            token = name[data]
            parts = list(token.removesuffix("</w>"))
            if token.endswith("</w>"):
                parts[-1] += "</w>"
            while len(parts) > 1:
                k, at = min((merges.get(p, len(merges)), n) for n, p in enumerate(zip(parts, parts[1:])))
                if k == len(merges):
                    break
                parts[at : at + 2] = [_union(parts[at], parts[at + 1])]
            if parts != [token]:
                odd.add(i)
        return odd

    def _word(self, word: bytes) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit numbers."""
        text = unicodedata.normalize("NFC", word.decode()).replace("Σ", "σ").lower()
        ids = [i for part in self.split.findall(text) for i in self.core.encode_single_piece(part.encode() + END)]
        if self.odd and not self.odd.isdisjoint(ids):
            ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, data: bytes) -> bytes:
        if self.specials and not self.specials.search(data):
            return b"".join(map(self.words.__getitem__, data.split()))
        parts = self.specials.split(data) if self.specials else [data]
        return b"".join(self.added[part] if k % 2 else b"".join(map(self.words.__getitem__, part.split())) for k, part in enumerate(parts))


def _union(a: str, b: str) -> str:
    return a.removesuffix("</w>") + b


def _pairs(merges: list) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
