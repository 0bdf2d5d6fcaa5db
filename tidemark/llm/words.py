"""Words as 64-bit hashes in numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the polynomial hashes, wrapping at 64 bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Bytes that are hashed at once; a longer word is taken as a whole.
_BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Spans:
    """Hash of any stretch of values from prefix sums."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) < n:
            for name, factor in (("_power", BASE), ("_inverse", BASE_INVERSE)):
                table = np.full(max(n, 2 * len(cls._power)), factor, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))
        return cls._power[:n], cls._inverse[:n]

    def __init__(self, values: np.ndarray) -> None:
        power, self.inverse = self._tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.add.accumulate(values * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes."""
    edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    return Spans(_BYTE[raw])(starts, ends - starts), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and how many each text has."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    hashes, places, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(joined):
        high = min(len(joined), low + _BLOCK)
        while high < len(joined) and not _SPACE[joined[high - 1]]:
            blanks = np.flatnonzero(_SPACE[joined[high : high + _BLOCK]])
            high += int(blanks[0]) + 1 if len(blanks) else min(_BLOCK, len(joined) - high)
        found, starts = _hash_words(joined[low:high])
        hashes.append(found)
        places.append(starts + low)
        low = high
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(np.concatenate(places), ends)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def hashed_runs(raw: np.ndarray, gap: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each longest run of bytes that aren't in ``gap``; ``table`` has a value for each byte."""
    hashes, starts, ends, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while low < len(raw):
        high = min(len(raw), low + _BLOCK)
        while high < len(raw) and not gap[raw[high - 1]]:
            blanks = np.flatnonzero(gap[raw[high : high + _BLOCK]])
            high += int(blanks[0]) + 1 if len(blanks) else min(_BLOCK, len(raw) - high)
        edges = np.flatnonzero(np.diff(gap[raw[low:high]], prepend=True, append=True))
        hashes.append(Spans(table[raw[low:high]])(edges[::2], edges[1::2] - edges[::2]))
        starts.append(edges[::2] + low)
        ends.append(edges[1::2] + low)
        low = high
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + m]
    return mix(out)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each window of ``width``, by doubling."""
    best, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        first = best[:n] <= best[step:]
        place = np.where(first, place[:n], place[step:])
        best = np.where(first, best[:n], best[step:])
        size += step
    return place


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the Python objects of one batch stay few."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, in each of which ``column`` takes about ``most`` bytes at most, or there is one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(sizes, dtype=np.int64), 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(low, high - low)
            low = high
