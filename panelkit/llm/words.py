"""Words of Arrow string columns as numpy arrays.

All texts of a chunk are handled at once on the column's own UTF-8 bytes:
ASCII white space never occurs inside a longer UTF-8 sequence, so the words
``[^\\x20\\x09-\\x0D]+`` are the runs of other bytes.  Words and sequences of
words are compared by 64-bit polynomial hashes (running sums modulo 2**64),
finished by a bit mixer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and ASCII punctuation as white space.
BARE = LOWER.copy()
BARE[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
#: Bytes of text that are handled at once (a longer text is a chunk alone); the
#: arrays of a chunk take some 35 times as much.
CHUNK = 256 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = 1 << 20  # longer tables are made for one long text and not kept
            kept = n <= most
            n = max(n, min(most, max(1 << 16, 2 * len(self.up)))) if kept else n
            one = np.ones(1, np.uint64)
            up = np.cumprod(np.concatenate([one, np.full(n - 1, self.base)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([one, np.full(n - 1, self.inverse)]), dtype=np.uint64)
            if not kept:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


@dataclass
class Words:
    """data: bytes of all texts; start, end: of each word; first: index of
    each text's first word, and the number of words at the end."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        if not hasattr(self, "_total"):
            up, self._down = _BYTES.to(len(self.data) + 1)
            self._total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE[self.data] * up[: len(self.data)], out=self._total[1:])
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, array) of consecutive rows of at most ``limit`` bytes; nulls
    are empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(column):
        base = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield row, column.slice(row, to - row)
        row = to


def split(texts: pa.Array, fold: np.ndarray | None = None) -> Words:
    """The words of an Arrow string array without nulls; ``fold`` maps bytes
    first (LOWER, or BARE, which also lowers the accented Latin capitals)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if fold is not None:
        raw = fold[raw]
    if fold is BARE:
        latin = np.zeros(len(raw), bool)
        latin[1:] = raw[:-1] == 0xC3
        raw[latin & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    word = IS_WORD[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, at)
    first[-1] = len(start)
    return Words(raw, start, end, first)


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (also across texts: see
    window_starts); empty when there are fewer than k words."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sequence_hashes(word_hash: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from ``start`` up to ``stop``, of any length."""
    n = len(word_hash)
    up, down = _WORDS.to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * up[:n], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """For each position with a hash, whether the k words lie in one text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)
    return left[: n - k + 1] >= k
