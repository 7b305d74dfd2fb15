"""Words, lines and hashes of many texts at a time, as numpy arrays over the UTF-8 bytes of an Arrow column.

Texts are taken whole. They are gone through in slices of rows of about SLICE bytes, which bounds memory; a longer
text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
#: Texts hash to polynomials modulo the prime 2^31 - 1, with two bases and two tables of byte values drawn at random: 62 bits
#: together. Modulo a power of two, texts as the Thue-Morse word would collide whatever the base.
_M = (1 << 31) - 1
_PRIME, _BITS = np.uint64(_M), np.uint64(31)
_BYTE = _RNG.integers(1, _M, (2, 256), dtype=np.uint64)
_BASE = [int(x) for x in _RNG.integers(1 << 20, _M, 2)]
#: Multiplier that joins hashes of words, which are mixed already, to those of windows.
_P = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, below 2^33 for any 64 bits and below 2^32 for less than 2^62."""
    return (x & _PRIME) + (x >> _BITS)


def _residue(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(_fold(x)))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _geometric(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of a base modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate((out, _residue(out * np.uint64(pow(base, len(out), _M)))))
    return out


def _pow(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers 0 to n, at least, and those of its inverse."""
    if not _tables or len(_tables[0][0]) <= n:
        size = max(n + 1, SLICE + 1)
        _tables[:] = [(_geometric(b, size), _geometric(pow(b, -1, _M), size)) for b in _BASE]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts: maximal runs of bytes that ``gap`` doesn't mark, never across texts.

    start, end: byte positions; doc: index of the text; hash: of the word's bytes, after ``fold`` (62 bits, spread over 64).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray | None = None):
        base = offsets[0]
        self.offsets = offsets - base
        self.bytes = data[base : offsets[-1]]
        self.n_docs = len(offsets) - 1
        n = len(self.bytes)
        inside = ~gap[self.bytes]
        self.inside = inside
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.sums = self._sums(self.bytes if fold is None else fold[self.bytes])
        self.hash = self.span_hash(self.start, self.end)
        self.first_word = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    @staticmethod
    def _sums(b: np.ndarray) -> list[np.ndarray]:
        """For each base the sums of the bytes' terms up to each place; a term is below 2^32, so 2^32 of them fit."""
        out = []
        for values, (powers, _) in zip(_BYTE, _pow(len(b)), strict=True):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_fold(values[b] * powers[: len(b)]), out=sums[1:])
            out.append(sums)
        return out

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, the same wherever the span stands."""
        one, two = (_residue(_residue(sums[end] - sums[start]) * inverse[start]) for sums, (_, inverse) in zip(self.sums, _pow(len(self.bytes)), strict=True))
        return mix((one << _BITS | two) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def same_bytes(self, start: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of one length at ``start`` and at ``other`` have the same bytes."""
        out = np.ones(len(start), bool)
        step = np.cumsum(length)
        lo = 0
        while lo < len(start):  # some bytes of spans at a time
            hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + SLICE, "right")))
            n = length[lo:hi]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differs = self.bytes[np.repeat(start[lo:hi], n) + place] != self.bytes[np.repeat(other[lo:hi], n) + place]
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), weights=differs, minlength=hi - lo) == 0
            lo = hi
        return out

    def same_words(self, first: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of the first one of its hash; by eight bytes at a time, which overlap at a word's end."""
        length = self.end - self.start
        ok = length == length[first][inverse]
        eight = np.zeros(len(self.bytes) + 8, np.uint8)
        eight[: len(self.bytes)] = self.bytes
        eight = np.lib.stride_tricks.as_strided(eight.view(np.uint8), (len(self.bytes) + 1, 8), (1, 1))
        mask = np.concatenate((np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64), [np.uint64(0xFFFFFFFFFFFFFFFF)]))
        word = np.flatnonzero(ok)
        a, b = self.start[word], self.start[first[inverse[word]]]
        left = length[word]
        while len(word):
            x, y = (np.ascontiguousarray(eight[i]).view(np.uint64).ravel() for i in (a, b))
            differs = ((x ^ y) & mask[np.minimum(left, 8)]) != 0
            ok[word[differs]] = False
            go = (left > 8) & ~differs
            word, a, b, left = word[go], a[go] + 8, b[go] + 8, left[go] - 8
        return ok

    def count(self, marked: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are marked."""
        total = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return np.diff(total[self.offsets])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words within a text, and the index of its first word."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[: n - width + 1].copy()
        for k in range(1, width):
            h = h * np.uint64(_P) + self.hash[k : n - width + 1 + k]
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        return mix(h[at]), at


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words gives one shingle, of all its words; one without words gives none.
    """
    h, at = words.windows(width)
    doc = words.doc[at]
    bound = np.searchsorted(doc, np.arange(words.n_docs + 1))
    out = []
    for d in range(words.n_docs):
        x = h[bound[d] : bound[d + 1]]
        if len(x):
            x = np.sort(x)
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            own = words.hash[words.first_word[d] : words.first_word[d + 1]]
            if len(own):
                v = int(own[0])
                for w in own[1:]:
                    v = (v * _P + int(w)) & 0xFFFFFFFFFFFFFFFF
                x = mix(np.array([v ^ 0xA5A5A5A5 ^ len(own)], np.uint64))
        out.append(x)
    return out
