"""Words of whole texts, as NumPy arrays: shared by the text operators.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. These bytes never occur inside a
multi-byte UTF-8 character, so the work is done on the UTF-8 bytes of an Arrow column without
building Python strings. Arrow batches are cut into slices of bounded size first, so memory does not
grow with the partition; a text longer than a slice is a slice of its own and is still whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large_string without nulls (a null is the empty text)."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.binary_length(text_column(batch, name)).to_numpy(zero_copy_only=False) + 8)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a few texts: ``starts``/``ends`` are byte positions in ``buf``; document i has the
    bytes ``offsets[i]:offsets[i+1]`` and the words ``first[i]:first[i+1]``."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        size = int(off[-1] - off[0])
        self.buf = np.zeros(size + 8, np.uint8)
        if size:
            self.buf[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
        self.offsets, self.n, self.size = off - off[0], n, size
        body = self.buf[:size]
        inside = IS_WORD[body]
        opens, closes = inside.copy(), inside.copy()
        if size:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            cut = self.offsets[(self.offsets > 0) & (self.offsets < size)]  # a word ends with its document
            opens[cut] = inside[cut]
            closes[cut - 1] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        lanes = np.ndarray((max(0, len(self.buf) - 7),), "<u8", self.buf, strides=(1,))
        left = self.ends - self.starts
        h = left.astype(np.uint64) * _M2
        at, pos, idx = self.starts, self.starts, None
        while len(pos):
            v = lanes[pos] & _LOW_BYTES[np.minimum(left, 8)]
            if idx is None:
                h = mix(h ^ v)
                idx = np.arange(len(at))
            else:
                h[idx] = mix(h[idx] ^ v)
            more = left > 8
            idx, pos, left = idx[more], pos[more] + 8, left[more] - 8
        return h

    def windows(self, h: np.ndarray, k: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of k consecutive words of one document."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        q = np.uint64(factor)
        w = h[:n].copy()
        for j in range(1, k):
            w *= q
            w += h[j : j + n]
        last = np.repeat(self.first[1:], np.diff(self.first))[:n] - k  # of each word's document, the last window
        at = np.flatnonzero(np.arange(n) <= last)
        return at, mix(w[at])

    def joined(self, keep: np.ndarray | None = None) -> tuple[memoryview, np.ndarray]:
        """The words (with ``keep`` only some), each followed by one space; and where each word begins in them."""
        s, e = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        place = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum((self.ends - self.starts + 1) * (1 if keep is None else keep), out=place[1:])
        mark = np.zeros(self.size + 2, np.int8)  # a word may begin where one of the text before ends
        mark[s] += 1
        mark[e] -= 1
        out = np.full(int(place[-1]), 0x20, np.uint8)
        filled = np.ones(len(out), bool)
        filled[np.cumsum(e - s + 1) - 1] = False
        out[filled] = self.buf[: self.size + 2][np.cumsum(mark, dtype=np.int8).view(bool)]
        return memoryview(out), place
