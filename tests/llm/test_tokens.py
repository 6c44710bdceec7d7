import base64
import random
import zlib

import pytest

from tessera.llm.byte_bpe import ByteBpe, encode_documents, roundtrip_digests
from tessera.llm import word_bpe
from tessera.llm.packing import fullest, pack, plan
from tessera.llm.token_counts import START, Transducer, token_counts

P = pytest.importorskip("public_tokenizers")
ALPHABET = list("abcthe  \n\n\t▁éß🙂ñ.,!'s0123ΣİK") + [" the", "ing", "́", "\x00", "<s>", "  ", "▁▁", "\x1c", " ", "中", "　", "<|endoftext|>", "x" * 300]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(300))) + [(900, None), (None, "the a"), (7, "again"), (901, " ".join(texts(400, 3)))]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string"), rows


def test_counts_equal_the_library(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), Transducer.load(path)
    for t in texts(2000, 2):
        assert {machine.count(t, c) for c in (1, 3, 8, 1000)} == {len(library.encode(t))}
    key = lambda r: (str(r[0]), r[1], r[2])
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in docs[1]], key=key)
    for chunk in (1, 3, 1 << 15):
        got = token_counts(docs[0], path, chunk=chunk).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], key=key) == want


def test_state_maps_compose_to_prefixes():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), Transducer.load(path)
    rng = random.Random(8)
    for text in ["aaaaaaaaabab" * 30, "thething" * 40 + " a  b " + "x" * 50, *filter(None, texts(40, 9))]:
        t = "▁" + text.replace(" ", "▁")
        maps = machine.map_chunks(t, 5)
        done = {START}
        for k, m in enumerate(maps):
            assert done <= m.keys()  # every state that leads into a chunk is mapped
            done = {leave for leave, _ in m.values()}
        prefixes = machine.scan(maps)
        want = maps[0]
        for k, m in enumerate(maps):
            want = machine.compose(want, m) if k else m
            assert prefixes[k] == want
        assert prefixes[-1][START][1] == len(library.encode(text))
        if len(maps) > 2:
            a, b, c = maps[(k := rng.randrange(len(maps) - 2)) : k + 3]
            assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))
    assert machine.count("ab" * 400_000) == len(library.encode("ab" * 400_000))


def test_byte_bpe_equals_the_library(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = ByteBpe.load(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    for t in texts(1500, 4):
        assert own.encode(t) == library.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    rng = random.Random(5)
    for _ in range(200):
        data = "".join(rng.choice("thing abe") for _ in range(200)).encode()
        table = own.extend(data, [b""])
        a = rng.randrange(200)
        edited, new = own.edit(data, table, a, a + rng.randrange(4), b"thx"[: rng.randrange(4)])
        assert new == own.extend(edited, [b""])
    got = {(r.doc_id, tuple(r.ids)) for r in encode_documents(docs[0], path, P.PATTERN).collect()}
    assert got == {(i, tuple(library.encode_ordinary(t or ""))) for i, t in docs[1]}
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {tuple(r) for r in roundtrip_digests(docs[0], path, P.PATTERN).collect()}
    assert got == {(i, len(e := library.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in docs[1]}


def test_byte_bpe_tries_only_tokens_that_end_there(monkeypatch):
    class Counted(dict):
        looked = 0

        def __contains__(self, token):
            self.looked += 1
            return super().__contains__(token)

    own = ByteBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    data = b"unanhestionthndor" * 20
    table = own.extend(data, [b""])
    own.ranks = Counted(own.ranks)
    assert own.extend(data, [b""]) == table and own.tokens(data) == own.merge(data)
    own.ranks.looked = 0
    own.extend(data, [b""])
    assert own.ranks.looked <= len(data)
    monkeypatch.setattr("tessera.llm.byte_bpe.STEPS", 7)  # forgets all the time
    own.nodes.clear()
    for t in texts(200, 8):
        assert own.tokens(t.encode()) == own.merge(t.encode())
        assert own.steps <= 7


def test_fullest_against_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 30)
        best = max(s for m in range(1 << len(lengths)) if (s := sum(x for k, x in enumerate(lengths) if m >> k & 1)) <= room)
        got = fullest({x: lengths.count(x) for x in lengths}, room)
        assert sum(got) == best and all(got.count(x) <= lengths.count(x) for x in got)


def test_plan_uses_everything():
    rng = random.Random(1)
    counts = {rng.randint(1, 2048): rng.randint(1, 10**6) for _ in range(900)}
    used = {}
    for lengths, times in plan(counts, 2048):
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_packing_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    own = word_bpe.load(path)
    for t in ["a <|endoftext|> b", "a<|endoftext|>b<|startoftext|>", "A<|EndOfText|>b", "<|endoftext|>", "it's<|endoftext|>'s x́<|endoftext|>́", "<|endoftext", *texts(500, 6)]:
        assert own.encode(t.encode()) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids), t
    assert "library" not in vars(own)  # no exception in this vocabulary
    got = pack(docs[0], path, 64).collect()
    want = []
    for i, t in docs[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = ids[s : s + 64]
            want.append((i, k, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.02 * sum(w[3] for w in want) / 64 + 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none, P.path("word_bpe_49k.json")).collect() == []
    assert token_counts(none, P.path("piece_bpe_32k.model")).collect() == []
    assert roundtrip_digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
