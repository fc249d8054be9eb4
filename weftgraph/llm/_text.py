"""Vectorised byte-level helpers for the Arrow operators: texts as one byte buffer, hashes of its pieces."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [\x20\x09-\x0D]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Words of more bytes are told apart by a cryptographic hash: longer ones can be built so that their sums of powers are equal.
LONG_WORD = 64

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n + n // 8, (1 << 19) + (1 << 17))
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(buf: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Sums with which :func:`piece_hashes` hashes any piece of buf."""
    powers, _ = _grow(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers[: len(buf)], out=sums[1:])
    return sums


def piece_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]: equal bytes have equal hashes, wherever they stand."""
    _, inverse = _grow(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words buf[start:end] by which words are told apart: :func:`piece_hashes`, of long words BLAKE2b of their bytes."""
    out = piece_hashes(prefix_sums(buf), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def rolling_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """The :func:`piece_hashes` of all pieces of `size` bytes, by slices."""
    sums = prefix_sums(buf)
    _, inverse = _grow(len(sums))
    return mix((sums[size:] - sums[:-size]) * inverse[: len(sums) - size] + np.uint64(size))


def text_chunks(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about limit bytes, at least a row each; null: empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and how many words stand before each text
    (one entry more than texts)."""
    n = len(buf)
    word = ~IS_SPACE[buf]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border = border[:n]
    behind, ahead = np.zeros(n, bool), np.zeros(n, bool)
    behind[1:], ahead[:-1] = word[:-1], word[1:] & ~border[1:]
    starts = np.flatnonzero(word & (~behind | border))
    ends = np.flatnonzero(word & ~ahead) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives free memory back to the system when its task ends: workers wait for further
    tasks, and what they hold meanwhile is missing elsewhere in the executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """np.unique by sorting; its own way, by hashing, is several times slower on short arrays of hashes."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
