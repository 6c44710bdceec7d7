"""Token counts by a compiled finite-state transducer.

The tokenizer is a merge tokenizer over pieces with scores.  What it makes of a prefix is settled by the last few
characters: for each of the last places from which a piece may still reach on, the piece that ends the encoding up to
there.  That window is the state; a transition reads one character and is annotated with the number of tokens it adds
(it may be negative: a longer piece takes the place of several).  States and transitions are compiled when they are
first met and then only looked up; the windows are bounded, so the machine is finite and deterministic.  No piece goes over a *seam* - the start of a run of spaces, or either side of a character
that is in no longer piece - so the machine restarts there, and a whole run between seams is kept as one transition.

A long text is cut into chunks, and each chunk becomes a state map: from the states in which it may be entered to the
state in which it is left and the tokens in between.  Where the chunk before holds a seam, the one state at its end is
known from what stands behind its last seam, so maps don't wait for each other; only a chunk that follows one without a
seam is mapped on what that one's map leads to.  Maps compose associatively, and ``scan`` composes them to all prefixes by
doubling; the count of a text is the last prefix at the start state.  States are written as what they stand for, so maps
outlive a machine that is compiled anew.

Defined results: null text is empty and has no bytes and no tokens; null ids stay null; rows are independent, so
repeated rows and empty tables need nothing special.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .memo import Memo
from .spines import NEVER, Spines

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 15
#: States that are kept before the machine is compiled anew.
STATES = 200_000


#: A state: the characters of the window, and for each place in it the piece that ends there and its tokens less than now.
State = tuple[str, tuple]
START: State = ("", (("", 0),))
#: From states of entry to the state that follows and the tokens in between.
StateMap = dict[State, tuple[State, int]]


class Transducer:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.inside = {c for p in scores if len(p) > 1 for c in p}
        self.alone = re.compile("[^" + re.escape("".join(sorted(self.inside))) + "]")
        self.seam = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Proper prefixes of pieces: only from where one starts can a longer piece reach over what comes next.
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p))}
        self.spines = Spines(self.rank, self.merge)
        self.restart()
        self.runs = Memo(self._run)
        self.after_space = Memo(lambda word: self.count_run(SPACE + word))
        self.from_start = Memo(lambda text: self._walk(START, text))

    @classmethod
    def load(cls, path: str) -> Transducer:
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)))
        return cls({p.id_to_piece(i): p.get_score(i) for i in plain})

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The definition: the neighbours with the best score of their union are merged first, the left ones of equals."""
        parts = list(text)
        while len(parts) > least:
            rank, at = min((self.rank(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def rank(self, piece: str) -> float:
        return -self.scores[piece] if piece in self.scores else NEVER

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state under a character: next state, tokens that it adds."""
        chars, places = self.states[state]
        text, near = chars + char, self.spines.neighbours
        for j, place in enumerate(places):
            if place is None:
                continue
            piece = text[j:]
            if len(piece) == 1 or piece in self.scores:
                if near(place[0], piece) if place[0] else self.spines.makes(piece):
                    tokens = place[1] + (1 if piece in self.scores else len(piece.encode()))
                    break
        here = [*places, (piece, tokens)]
        kept = [p if k == len(text) or text[k:] in self.prefixes else None for k, p in enumerate(here)]
        from_ = next(k for k, p in enumerate(kept) if p is not None)
        new = (text[from_:], tuple(p and (p[0], p[1] - tokens) for p in kept[from_:]))
        to = self.number(new)
        self.steps[state][char] = to, tokens
        return to, tokens

    def number(self, state: State) -> int:
        if (at := self.numbers.get(state)) is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return at

    def restart(self) -> None:
        self.states: list[State] = [START]
        self.numbers: dict[State, int] = {START: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def _run(self, run: str) -> int:
        if len(self.states) > STATES:
            self.restart()
        state, tokens, steps = 0, 0, self.steps
        for char in run:
            state, more = steps[state].get(char) or self.compile(state, char)
            tokens += more
        return tokens

    def count_run(self, text: str) -> int:
        """Tokens of a text without a seam at its ends that neighbours could close; seams inside are found."""
        total = 0
        for part in self.seam.findall(text):
            at = 0
            for m in self.alone.finditer(part):
                if m.start() > at:
                    total += self.runs[part[at : m.start()]]
                total += self._char(m.group())
                at = m.end()
            if at < len(part):
                total += self.runs[part[at:]]
        return total

    def _char(self, char: str) -> int:
        return 1 if char in self.scores else len(char.encode())

    def _walk(self, entry: State, text: str) -> tuple[State, int]:
        """The machine itself: from a state over a text without seams at spaces."""
        tokens = 0
        for k in range(0, len(text), STATES):
            if len(self.states) > STATES:
                self.restart()
            state, steps = self.number(entry), self.steps
            for char in text[k : k + STATES]:
                if char in self.inside:
                    state, more = steps[state].get(char) or self.compile(state, char)
                    tokens += more
                else:
                    state, tokens = 0, tokens + self._char(char)
            entry = self.states[state]
        return entry, tokens

    def walk(self, entry: State, text: str) -> tuple[State, int]:
        return self.from_start[text] if entry == START else self._walk(entry, text)

    def seams(self, chunk: str, before: str) -> tuple[int, int] | None:
        """The first and the last place in a chunk where a run of spaces starts; ``before`` is the character before it."""
        m = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
        first = 0 if chunk[0] == SPACE and before and before != SPACE else m.start() if m else None
        if first is None:
            return None
        end = chunk.rfind(SPACE)
        while end and chunk[end - 1] == SPACE:
            end -= 1
        return first, max(first, end)

    def map_chunk(self, chunk: str, before: str, entries: Iterable[State]) -> StateMap:
        found = self.seams(chunk, before)
        if not found:
            return {s: self.walk(s, chunk) for s in entries}
        first, last = found
        inner = self.count_inner(chunk[first:last]) if last > first else 0
        leave, tail = self.walk(START, chunk[last:])
        return {s: (leave, self.walk(s, chunk[:first])[1] + inner + tail) for s in entries}

    def map_chunks(self, text: str, chunk: int) -> list[StateMap]:
        maps: list[StateMap] = []
        for at in range(0, len(text), chunk):
            if not at:
                entries = [START]
            else:
                own = text[at - chunk : at]
                found = self.seams(own, text[at - chunk - 1] if at > chunk else "")
                entries = [self.walk(START, own[found[1] :])[0]] if found else {leave for leave, _ in maps[-1].values()}
            maps.append(self.map_chunk(text[at : at + chunk], text[at - 1] if at else "", entries))
        return maps

    def count_inner(self, text: str) -> int:
        """Runs that each start with spaces."""
        if SPACE + SPACE in text:
            return self.count_run(text)
        return sum(map(self.after_space.__getitem__, text[1:].split(SPACE)))

    @staticmethod
    def compose(a: StateMap, b: StateMap) -> StateMap:
        return {s: (b[middle][0], tokens + b[middle][1]) for s, (middle, tokens) in a.items()}

    @classmethod
    def scan(cls, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefixes, by doubling: each round composes independent pairs."""
        out, step = list(maps), 1
        while step < len(out):
            out = [cls.compose(out[i - step], m) if i >= step else m for i, m in enumerate(out)]
            step *= 2
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        return self.scan(self.map_chunks(SPACE + text.replace(" ", SPACE), chunk))[-1][START][1]


_loaded: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens`` and ``over_limit``; texts are counted in chunks of so many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [machine.count(t, chunk) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
