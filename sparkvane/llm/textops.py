"""Vectorised text primitives over Arrow string buffers.

Tokenising, hashing and shingling all work on the raw UTF-8 bytes of an Arrow
column with numpy, so that no Python object is made per token. Work is cut
into chunks of whole documents (about ``CHUNK_BYTES`` of text, or one longer
document), which bounds the memory of a Python worker whatever the batch size.

Two kinds of tokens exist:

* ``split``: maximal runs of bytes that are not ASCII white space; case and
  punctuation count. Used where results are cut out of the text again.
* ``fold``: maximal runs of letters, digits and non-ASCII bytes, with ASCII
  and Latin-1 capitals folded to small letters. Used for matching.

A null text is an empty text: it has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_K1, _K2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.ones(256, bool)
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False
_PUNCT[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * _K1
    x ^= x >> U64(27)
    x *= _K2
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & ((1 << 64) - 1)], dtype=U64))[0])


def combine(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """An order-sensitive name of the pair (a, b)."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(seed & ((1 << 64) - 1))))


class _Powers:
    """Powers of the hashing base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            grown = []
            for base in (_BASE, _BASE_INV):
                a = np.full(size, U64(base), dtype=U64)
                a[0] = 1
                grown.append(np.multiply.accumulate(a))
            if size > 4 * CHUNK_BYTES:  # one huge document: don't keep its tables
                return grown[0][:n], grown[1][:n]
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of documents of at most ``size`` bytes, or of one longer document."""
    size = CHUNK_BYTES if size is None else size
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Tokens:
    """The tokens of a chunk: ``hash``, byte ``start``/``end`` within the chunk, ``doc`` index, ``first`` token of each document."""

    __slots__ = ("_down", "_total", "doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: bool = False) -> None:
        self.n_docs = len(offs) - 1
        n = len(data)
        if n == 0:
            self.hash = np.zeros(0, U64)
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            self._total = self._down = np.ones(1, U64)
            return
        inside = ~(_PUNCT if fold else _SPACE)[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # A document's edge also ends a token.
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begin[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        if fold:
            values = _FOLDED_VALUES[data]
            lead = np.flatnonzero(data[:-1] == 0xC3)
            if len(lead):
                low = data[lead + 1]
                upper = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
                values[lead[upper] + 1] = _BYTE_VALUES[low[upper] + np.uint8(0x20)]
        else:
            values = _BYTE_VALUES[data]
        up, down = _powers.upto(n)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * up, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self._total, self._down = total, down
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def part(self, which: np.ndarray, head: int = 0, tail: int = 0) -> np.ndarray:
        """Hashes of the first ``head`` or last ``tail`` bytes of the tokens ``which`` (they must be that long)."""
        a, b = (self.start[which], self.start[which] + head) if head else (self.end[which] - tail, self.end[which])
        return mix((self._total[b] - self._total[a]) * self._down[a] + U64(head * 257 + tail))


def tokens_of(data: np.ndarray, offs: np.ndarray, fold: bool = False, size: int | None = None) -> Iterator[tuple[int, int, Tokens]]:
    """Tokens of each chunk of documents, as (from, to, tokens)."""
    for i, j in chunks(offs, size):
        yield i, j, Tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], fold)


class Ranges:
    """Karp-Rabin hashes of ranges [a, b) of token hashes."""

    def __init__(self, h: np.ndarray) -> None:
        up, self._down = _powers.upto(len(h) + 1)
        self._total = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * up[: len(h)], out=self._total[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._total[b] - self._total[a]) * self._down[a] + (b - a).astype(U64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` consecutive token hashes: entry i covers i .. i + width - 1."""
    at = np.arange(max(0, len(h) - width + 1))
    return Ranges(h).hash(at, at + width)


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same tokens, for a check that doesn't share the first hash's collisions of sums."""
    return mix(h ^ U64(0xA5A5A5A55A5A5A5B))


def token_hashes(text: str, fold: bool = True) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return Tokens(data, np.array([0, len(data)]), fold).hash


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
