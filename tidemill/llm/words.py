"""Word and window hashing over the buffers of Arrow text columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
SPACE = bytes([0x20, *range(0x09, 0x0E)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE)] = False

ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.empty(max(n, PIECE + 1), dtype=np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[name] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def row_ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = max(start + 1, min(end, len(offsets) - 1))
        yield start, end
        start = end


class Words:
    """Words of some rows: byte ranges in ``data``, 64-bit hashes, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        """``data`` and ``offsets`` of some rows; ``kinds`` tells which bytes belong to words."""
        low, high = int(offsets[0]), int(offsets[-1])
        self.data, self.offsets = LOWER[data[low:high]], offsets - low
        inside = kinds[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hashes = self._hash()

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        first = 0
        while first < len(out):
            base = int(self.starts[first])
            last = max(first + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            size = int(self.ends[last - 1]) - base
            power, back = _power("p", BASE, size + 1), _power("i", pow(BASE, -1, 1 << 64), size + 1)
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum((self.data[base:base + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
            a, b = self.starts[first:last] - base, self.ends[first:last] - base
            out[first:last] = (sums[b] - sums[a]) * back[a]
            first = last
        return mix(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(STEP))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words that lies in one row."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(length):
            out += self.hashes[k:k + n] * np.uint64(pow(STEP, 2 * k + 1, 1 << 64))
        at = np.flatnonzero(self.rows[:n] == self.rows[length - 1:])
        return at, mix(out[at] + np.uint64(length))

    def joined(self, first: int, length: int) -> bytes:
        """The lower-cased words from ``first`` on, parted by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(
            self.starts[first:first + length], self.ends[first:first + length], strict=True))
