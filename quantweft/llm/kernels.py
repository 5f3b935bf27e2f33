"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow chunk at a time: the UTF-8 bytes of many
documents lie in one numpy buffer, and words, k-grams and minimizers of all of
them come out of whole-array passes.  Nothing depends on the process, so the
same text gives the same numbers on every executor and on every retry.

Words are the runs of bytes other than 0x20 and 0x09-0x0D; a word never crosses
a document.  Hashes have 64 bits.  Each block of 8 bytes of a word goes through an
avalanche step together with its place before it is added to the others, and k-grams
are folded with a step after each unit: no sum of powers of a base, which strings of
two letters in Thue-Morse order defeat.  `Words.second` starts from the bytes again, with
other keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _G = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_ODD = U64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the splitmix64 finaliser)."""
    x = x + _G
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as an integer; beyond the end are zeros."""
    padded = np.zeros(len(b) + 8, dtype=np.uint8)
    padded[: len(b)] = b
    return np.ndarray(len(b) + 1, np.dtype("<u8"), padded.data, strides=(1,))


#: Keeps the first 0..8 bytes of an integer.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def block_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Hash of the bytes of each span (none is empty)."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(start)), n)
    i = np.arange(len(owner)) - first[owner]
    value = eights(b)[start[owner] + 8 * i] & _KEEP[np.minimum(size[owner] - 8 * i, 8)]
    keys = mix(np.arange(int(n.max()), dtype=U64) * _ODD + U64(key))
    total = np.add.reduceat(mix(value ^ keys[i]), first)
    return mix(total + size.astype(U64) * _ODD)


#: Byte maps for text_chunks: A-Z to a-z; besides, ASCII punctuation to spaces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


class Chunk:
    """Some documents of a batch: ids, one byte buffer, and where each begins."""

    def __init__(self, rows: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
        self.rows, self.buf, self.offsets = rows, buf, offsets

    def __len__(self) -> int:
        return len(self.rows)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, mapped: np.ndarray | None = None) -> Iterator[Chunk]:
    """Splits a string column into chunks of about `limit` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        part = whole[offsets[lo] : offsets[hi]]
        yield Chunk(np.arange(lo, hi), part if mapped is None else mapped[part], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words:
    """The words of a chunk: byte starts and ends, document index, 64-bit hashes."""

    def __init__(self, chunk: Chunk, hashed: bool = True):
        b, off = chunk.buf, chunk.offsets
        n = len(b)
        solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, off)  # words of document i: bounds[i]:bounds[i+1]
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(chunk)), self.count)
        self._bytes = b
        if hashed:
            self.hash = block_hash(b, self.start, self.end, 1)

    def second(self) -> np.ndarray:
        """Hashes independent of `hash`."""
        return block_hash(self._bytes, self.start, self.end, 2)

    def grams(self, k: int, salt: int = 0, of: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 of a document are rubbish (see `fits`).

        of: other hashes of the words than `hash`.
        """
        return folded(self.hash if of is None else of, k, salt)

    def fits(self, k: int) -> np.ndarray:
        """Whether k words of the same document start at each word."""
        left = np.repeat(self.bounds[1:], self.count) - np.arange(len(self.start))
        return left >= k


def folded(units: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k units from each on; the last k-1 are of fewer."""
    out = np.full(len(units), (salt + 1) * int(_ODD) & (1 << 64) - 1, dtype=U64)
    for j in range(min(k, len(units))):
        out[: len(units) - j] = mix(out[: len(units) - j] + units[j:])
    return out


def byte_grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place that has so many from it on, by doubling."""
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    have = 8 if k >= 8 else 1
    h = mix(np.array(eights(b)[: len(b) - have + 1]) & _KEEP[have])
    while have * 2 <= k:
        h = mix((h[: len(h) - have] * _ODD) ^ h[have:])
        have *= 2
    return h if have == k else mix((h[:n] * _ODD) ^ h[k - have : k - have + n])


def span_hash(grams: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the units start .. end-1 (k or more), from the k-grams that tile them."""
    size = end - start
    out = mix(size.astype(U64))
    for j in range(-(-int(size.max(initial=0)) // k)):
        at = start + j * k
        more = at < end
        out = np.where(more, mix(out + grams[np.where(more, np.minimum(at, end - k), 0)]), out)
    return out


def sliding_argmin(order: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest of order[i : i+w] (leftmost of equal ones) for every i with w values from it on.

    Only the upper 32 bits of `order` are compared.
    """
    n = len(order)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    m = (order & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: n - w + 1], m[w - span : w - span + n - w + 1])
    return (m & U64(0xFFFFFFFF)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
