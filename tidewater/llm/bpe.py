"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 9).

For every byte prefix of a piece there is exactly one last token that the merge-by-rank encoding of
that prefix can end with. :class:`PrefixEncoder` stores these last tokens. A token t that ends at byte
i is the last token of the prefix i if it begins the piece, or if the pair (last token of the prefix
before it, t) is one that merging leaves as it is. So

* the encoding of any prefix is read off by walking back from its end,
* appending bytes only adds entries (exact appends),
* pieces that begin with the same bytes share the entries of these: new pieces of a slice of documents are encoded in the order
  of their bytes, and each goes on from the prefix that it shares with the one before,
* an edit recomputes entries from the edit on, until as many entries in a row as the longest token has
  bytes agree with the old ones; the rest is reused.

Decoding is the concatenation of the tokens' bytes.

Defined results: a null text is the empty text (0 tokens); texts are encoded whole; special strings in a
text are ordinary text; rows are kept as they are, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Set
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices, text_column

#: Pieces whose ids a Python worker remembers; beyond, they become the older ones, and it forgets those before. Bounds memory, not results.
PIECES_KEPT = 150_000
#: The same for pairs of tokens; beyond, it starts anew.
PAIRS_KEPT = 250_000
#: Code points of a piece, and bytes of its ids, beyond which it is not remembered.
LONG, LONG_IDS = 64, 128
#: Marks of pieces that were met: only a piece that is met in a second slice is remembered, as most are met in one only. When half
#: are set, all are taken away.
MARKS = 1 << 22


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a ``.tiktoken`` file on every machine (a parameter, see the README)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The rank of pairs that do not merge; the lengths to try where no longer token ends.
NEVER, _SHORT = 1 << 60, (2, 1)


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) < NEVER:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
    return [ranks[p] for p in parts]


class Vocabulary:
    """Ranks, the bytes of each id, and which pairs of tokens merging leaves as they are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = of_id = {v: k for k, v in ranks.items()}
        #: The bytes of each id, null where a file leaves an id out.
        self.of_id = pa.array([of_id.get(k) for k in range(max(of_id, default=-1) + 1)], pa.large_binary())
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], {1, 2}).add(len(token))
        #: Last three bytes to the lengths of the tokens that can end there, longest first.
        self.lengths = {k: sorted(x, reverse=True) for k, x in lengths.items()}
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of a and b gives the two tokens a, b (only b, if a is empty)."""
        if (known := self.known.get((a, b))) is None:
            if len(self.known) > PAIRS_KEPT:
                self.known.clear()
            wanted = [self.ranks[a], self.ranks[b]] if a else [self.ranks[b]]
            pair = tuple(map(self.tokens.__getitem__, wanted))  # the vocabulary's own bytes, not cuttings of a piece, are kept
            known = self.known[pair if a else (b"", *pair)] = merge_by_rank(a + b, self.ranks) == wanted
        return known


class PrefixEncoder:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece, self.last = vocabulary, b"", [b""]
        self.append(piece)

    def _grow(self, piece: bytes, last: list[bytes], begin: int, end: int) -> None:
        """Adds to ``last`` the entries of the prefixes ``begin`` to ``end`` (inclusive)."""
        v = self.v
        ranks, lengths, known = v.ranks, v.lengths, v.known
        for i in range(begin, end + 1):
            for n in lengths.get(piece[i - 3 : i], _SHORT):
                token = piece[i - n : i] if n <= i else b""
                if token not in ranks:
                    continue
                pair = (last[i - n], token)  # the piece's first token follows the empty one
                fits = known.get(pair)
                if v.fits(*pair) if fits is None else fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {i}")

    def append(self, more: bytes) -> None:
        begin = len(self.piece)
        self.piece += more
        self._grow(self.piece, self.last, begin + 1, len(self.piece))

    def turn_into(self, piece: bytes) -> None:
        """Another piece in place of this one: only what follows the prefix that both share is computed."""
        same = len(commonprefix((self.piece, piece)))
        del self.last[same + 1 :]
        self.piece = piece
        self._grow(piece, self.last, same + 1, len(piece))

    def edit(self, at: int, gone: int, new: bytes) -> int:
        """Replace ``gone`` bytes at ``at`` by ``new``; returns how many entries were computed anew."""
        piece = self.piece[:at] + new + self.piece[at + gone :]
        last, shift, same = self.last[: at + 1], gone - len(new), 0
        for i in range(at + 1, len(piece) + 1):
            self._grow(piece, last, i, i)
            inside = i > at + len(new)
            same = same + 1 if inside and last[i] == self.last[i + shift] else 0
            if same >= self.v.longest:
                last += self.last[i + shift + 1 :]
                break
        else:
            i = len(piece)
        self.piece, self.last = piece, last
        return i - at

    def tokens(self, end: int | None = None) -> list[bytes]:
        end, out = len(self.piece) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]

    def ids(self, end: int | None = None) -> list[int]:
        return [self.v.ranks[t] for t in self.tokens(end)]


class _Pieces:
    """Pieces to their ids, packed as little-endian unsigned 32-bit integers: ``known``, and ``older`` ones from before; those
    met for the first time are marked in ``met``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met, self.marks = bytearray(MARKS), 0

    def learn(self, pieces: Set[str]) -> dict[str, bytes]:
        """The ids of those of these pieces that are not among the known ones."""
        if len(self.known) > PIECES_KEPT:
            self.known, self.older = {}, self.known
        if self.marks > MARKS // 2:
            self.met, self.marks = bytearray(MARKS), 0
        known, met, new, encoder = self.known, self.met, {}, PrefixEncoder(self.v)
        for piece in sorted(pieces - known.keys()):  # by code points, which is by bytes
            if (packed := self.older.get(piece)) is not None:
                known[piece] = packed
                continue
            raw = piece.encode()
            if (whole := self.v.ranks.get(raw)) is None:
                encoder.turn_into(raw)
            ids = encoder.ids() if whole is None else [whole]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            mark = hash(piece) % MARKS
            if met[mark] and len(piece) <= LONG and len(packed) <= LONG_IDS:
                known[piece] = packed
            else:
                self.marks += not met[mark]
                met[mark] = 1
                new[piece] = packed
        return new


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str):
    import regex

    v = Vocabulary(load_ranks(path))
    return regex.compile(pattern), v, _Pieces(v)


def encode_all(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Packed ids of each text."""
    split, _, pieces = _coder(path, pattern)
    one: dict[str, str] = {}  # of equal pieces, only one string outlives its text's turn
    found = [[*map(one.setdefault, f, f)] for f in map(split.findall, texts)]
    new = pieces.learn(one.keys())
    ids = {piece: packed if (packed := new.get(piece)) is not None else pieces.known[piece] for piece in one}
    return [b"".join(map(ids.__getitem__, f)) for f in found]


def encode(text: str, path: str, pattern: str) -> bytes:
    """Packed ids of a text."""
    return encode_all([text], path, pattern)[0]


def decode(packed: bytes, path: str, pattern: str) -> bytes:
    if not packed:
        return b""
    tokens = _coder(path, pattern)[1].of_id.take(pa.array(np.frombuffer(packed, "<u4")))
    if tokens.null_count:
        raise KeyError("an id that the vocabulary doesn't have")
    _, ends, joined = tokens.buffers()  # the tokens' bytes lie one after the other
    begin, end = np.frombuffer(ends, np.int64)[[tokens.offset, tokens.offset + len(tokens)]]
    return memoryview(joined)[begin:end].tobytes()


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the
    packed ids and the decoded text. Narrow: no shuffle; one row in, one row out."""

    def coded(part: pa.RecordBatch) -> pa.RecordBatch:
        packed = encode_all(text_column(part).to_pylist(), path, pattern)
        raw = [decode(x, path, pattern) for x in packed]
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (packed, raw)]
        arrays = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), *digests]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            arrays += [pa.array(packed, pa.binary()), pa.array([x.decode() for x in raw], pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(coded, slices(batch))  # nothing of a slice is held while the next one is encoded

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
