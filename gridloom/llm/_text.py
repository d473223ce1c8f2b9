"""Whole texts as NumPy arrays: chunks of rows, 64-bit polynomial hashes of any span, words, look-ups of hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as arrays at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's last step)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if len(have) == CHUNK_BYTES + 1:  # those of a longer text are not kept
            _powers[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P for span_hash: of bytes by a table, of 64-bit values as they are."""
    terms = _BYTE[values] if values.dtype == np.uint8 else values
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; the same for equal spans wherever they stand."""
    return mix((p[end] - p[start]) * powers(_INVERSE, len(p))[start] + (end - start).astype(np.uint64))


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more bytes are hashed by running sums over the bytes, shorter ones eight bytes a step.
_SHORT = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of many short spans data[start:end], the same for equal spans."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.uint64, padded.data, 0, (1,))  # the eight bytes from each place
    n = end - start
    h = mix(mix(n.astype(np.uint64)) ^ eight[start] & _MASK[np.minimum(n, 8)])
    todo = np.flatnonzero((n > 8) & (n <= _SHORT))
    at, left = start[todo] + 8, n[todo] - 8
    while len(todo):
        h[todo] = mix(h[todo] ^ eight[at] & _MASK[np.minimum(left, 8)])
        on = left > 8
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    far = np.flatnonzero(n > _SHORT)
    if len(far):
        h[far] = span_hash(prefix_sums(data), start[far], end[far])
    return h


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in bytes) for consecutive rows; null: empty."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last, whole[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run without ASCII white space) and, for each text, its first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


class HashIndex:
    """Numbers of distinct, well mixed 64-bit hashes by open addressing: a look-up is a gather or two, not a binary search."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = _U(64 - bits)
        # Room behind the last slot: a run of taken slots never wraps.
        self.key = np.zeros((1 << bits) + len(keys) + 1, np.uint64)
        self.number = np.full(len(self.key), -1, np.int32)
        todo, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.number[at[first]] < 0]
            self.number[at[first]] = todo[first]
            self.key[at[first]] = keys[todo[first]]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], at[left] + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is none of the keys."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.number[at]
        far = np.flatnonzero((out >= 0) & (self.key[at] != hashes))
        while len(far):
            at[far] += 1
            out[far] = self.number[at[far]]
            far = far[(out[far] >= 0) & (self.key[at[far]] != hashes[far])]
        return out


def _release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task shouldn't hold what the last one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with freed memory given back at the end of each task."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()
    return wrapped
