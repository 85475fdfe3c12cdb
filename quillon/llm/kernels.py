"""Vectorised byte work on Arrow text columns, shared by the operators' tasks.

A kernel handles a slice of documents of about a mebibyte at a time, so that its
temporaries stay small whatever the batch; one longer document is a slice by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, after which the worker hands its free memory back: it stays alive
    for the next task, and what it holds then counts against the executor."""

    @wraps(run)
    def work(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return work


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U) * U(_MULTIPLIER))


@lru_cache(maxsize=1)
def _folded_bytes() -> np.ndarray:
    """A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2^64."""
    name = "inverse" if inverse else "plain"
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 4096) + 1, _INVERSE if inverse else _MULTIPLIER, dtype=U)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) <= 8 * SLICE_BYTES:
            _POWERS[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of value(byte) * multiplier^place; n + 1 entries."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.multiply(_byte_values()[data], powers(len(data)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] with A-Z as a-z, the same wherever a word stands.

    A word is read eight bytes at a time. Each of these blocks is mixed, mixed again with its number in the
    word, and the sum is mixed with the length: a polynomial modulo 2^64 would give long words of
    two letters in Thue-Morse order one hash with their mirrors.
    """
    if not len(starts):
        return np.zeros(0, U)
    padded = np.concatenate((_folded_bytes()[data], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place
    length = ends - starts
    out = _block_hash(eight[starts], length, np.zeros(1, U))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8
        word = np.repeat(long, more)
        number = np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more) + 1
        at = starts[word] + 8 * number
        out[long] += np.add.reduceat(_block_hash(eight[at], ends[word] - at, number.astype(U)), np.cumsum(more) - more)
    return mix64(out + length.astype(U) * U(_MULTIPLIER))


def _block_hash(block: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of blocks of which the first ``left`` bytes count."""
    mask = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (8 - np.clip(left, 1, 8)).astype(U))
    return mix64(mix64((block & mask) + U(_INVERSE)) ^ mix64(number * U(_MULTIPLIER) + U(1)))


@lru_cache(maxsize=1)
def space_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; ``starts`` are the documents' first bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space_bytes()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[starts < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
