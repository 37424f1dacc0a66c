"""Vectorised text primitives shared by the operators: everything works on the raw UTF-8 bytes of a
whole Arrow batch at once, so no Python code runs per word, line or shingle."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
#: Powers of a base are products of one below STEP and one of a multiple of it, so no table of all of them is kept.
SHIFT = 11
STEP = 1 << SHIFT
_LOW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that one numpy pass takes at once; a longer text makes a pass of its own.
CHUNK = 2 << 20


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: ASCII digits, a-z and every non-ASCII byte.
ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]
SPACE = _class((0x20, 0x20), (0x09, 0x0D))
NONSPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: One odd 64-bit value per byte, so that single bytes are already spread out.
_TABLES = [np.random.default_rng(7 + k).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1) for k in range(3)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply) over uint64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    p = np.full(n, U64(base % (1 << 64)))
    p[:1] = 1
    return np.multiply.accumulate(p)


class Sums:
    """Prefix sums of a sequence of uint64 values; gives the hash of any stretch in O(1)."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        n = len(values)
        base = int(_BASES[kind])
        back = pow(base, -1, 1 << 64)
        if kind not in _LOW:
            _LOW[kind] = _powers(base, STEP), _powers(back, STEP)
        low, self._low = _LOW[kind]
        blocks = n // STEP + 1
        high, self._high = (_powers(pow(b, STEP, 1 << 64), blocks) for b in (base, back))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        whole, full = n - n % STEP, self.sums[1:]
        rows = full[:whole].reshape(-1, STEP)
        np.multiply(values[:whole].reshape(-1, STEP), low, out=rows)
        rows *= high[: blocks - 1, None]
        full[whole:] = values[whole:] * low[: n - whole] * high[-1]
        np.cumsum(full, out=full)

    def inverse(self, at: np.ndarray) -> np.ndarray:
        """base**-i modulo 2**64 for each place i."""
        return self._low[at & (STEP - 1)] * self._high[at >> SHIFT]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse(start) + (end - start).astype(np.uint64))


def byte_sums(data: np.ndarray, kind: int = 0) -> Sums:
    return Sums(_TABLES[kind][data], kind)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def release() -> None:
    """Gives what is free back to the system: a worker stays for later tasks and would keep it beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of `column`; what they took goes back after the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table` that stay in one text, and each text's first run."""
    m = table[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    some = off[1:] > off[:-1]
    head, tail = off[:-1][some], off[1:][some] - 1
    first[head], last[tail] = m[head], m[tail]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for every i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = count > 0
    start, count = start[some], count[some]
    at = np.cumsum(count)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - start[:-1] - count[:-1] + 1
    return np.cumsum(out)


def windows(word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n words within one text, and the text of each."""
    count = np.maximum(np.diff(word_off) - n + 1, 0)
    return expand(word_off[:-1], count), np.repeat(np.arange(len(count)), count)


class Lookup:
    """Membership of uint64 values in a sorted key array, behind a small bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U64(64 - 20)
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `values` that are keys, and the key number of each."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.flags[values >> self.shift])
        k = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        hit = self.keys[k] == values[at]
        return at[hit], k[hit]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length of the array at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted intervals that cover the same positions; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]


def binary_rows(data: bytes | np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column from one buffer and its offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(off) - 1,
        [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data if isinstance(data, bytes) else data.tobytes())],
    )
