"""Byte-level BPE of many pieces at once: the work that it does, and what it remembers."""

import random
import struct

import pytest

from tidewater.llm import bpe

tokenizers_at = pytest.importorskip("public_tokenizers")
PATTERN = tokenizers_at.PATTERN


@pytest.fixture
def path():
    bpe._coder.cache_clear()
    yield tokenizers_at.path("byte_bpe_50k.tiktoken")
    bpe._coder.cache_clear()


def brute_force(text, path):
    import regex

    ranks = bpe.load_ranks(path)
    ids = [i for piece in regex.findall(PATTERN, text) for i in bpe.merge_by_rank(piece.encode(), ranks)]
    return struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_share_the_entries_of_their_prefixes(path, monkeypatch):
    rng, computed, grow = random.Random(6), [], bpe.PrefixEncoder._grow

    def counted(self, piece, last, begin, end):
        computed.append(end - begin + 1)
        grow(self, piece, last, begin, end)

    monkeypatch.setattr(bpe.PrefixEncoder, "_grow", counted)
    pieces = {" " + "".join(rng.choice(("qwx", "zé", "tion", "vj")) for _ in range(rng.randint(3, 6))) for _ in range(600)}
    text = "".join(rng.sample(sorted(pieces), len(pieces)))
    assert bpe.encode(text, path, PATTERN) == brute_force(text, path)
    assert sum(computed) <= len({p.encode()[:n] for p in pieces for n in range(1, len(p.encode()) + 1)}) < sum(len(p.encode()) for p in pieces) / 2


def test_what_is_remembered_does_not_change_results(path, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 40)
    rng = random.Random(7)
    words = ["".join(rng.choice("abeinorstéß日") for _ in range(rng.randint(1, 9))) for _ in range(200)] + ["x" * 70, "ab" * 60, "ab" * 61]
    for _ in range(30):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) + rng.choice(("", "\n\n ", "!?")) for _ in range(rng.randint(0, 5))]
        packed = bpe.encode_all(texts, path, PATTERN)
        assert packed == [brute_force(t, path) for t in texts]
        assert [bpe.decode(p, path, PATTERN) for p in packed] == [t.encode() for t in texts]
    remembered = bpe._coder(path, PATTERN)[2]
    assert remembered.older and max(map(len, (*remembered.known, *remembered.older))) <= 64


def test_ids_that_a_vocabulary_does_not_have(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\nYg== 1\nYWI= 5\n")
    path = str(tmp_path / "few")
    assert bpe.encode("aab", path, r"\w+") == struct.pack("<2I", 0, 5)
    assert bpe.decode(struct.pack("<3I", 5, 1, 0), path, r"\w+") == b"abba"
    for unknown in (3, 6):
        with pytest.raises((KeyError, IndexError)):
            bpe.decode(struct.pack("<2I", 0, unknown), path, r"\w+")


def test_memory_of_a_slice_and_of_what_is_remembered(path):
    import tracemalloc

    rng = random.Random(8)
    words = ["".join(rng.choices("abeinorst", k=4)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=5_000)) for _ in range(40)]  # 1 MB of few pieces
    once = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60)) for _ in range(40)) for _ in range(25)]
    bpe.encode("warm", path, PATTERN)
    tracemalloc.start()
    try:
        packed, before = bpe.encode_all(texts, path, PATTERN), tracemalloc.get_traced_memory()
        assert before[1] < 6 * sum(map(len, texts))  # not a string for each of the 200,000 pieces
        assert packed[0] == brute_force(texts[0], path)
        assert bpe.encode_all(once, path, PATTERN)[7] == brute_force(once[7], path)
    finally:
        tracemalloc.stop()
    _, vocabulary, pieces = bpe._coder(path, PATTERN)
    assert not any(ord(p[-1]) >= 0x4E00 for p in pieces.known)  # met once: not remembered
    bpe.encode_all(once, path, PATTERN)
    assert not any(len(p) > 50 for p in pieces.known)  # long ids: never
    assert all(x is vocabulary.tokens[vocabulary.ranks[x]] for pair in vocabulary.known for x in pair if x)
    bpe.encode_all(texts, path, PATTERN)
    assert {" " + w for w in words} <= pieces.known.keys()
