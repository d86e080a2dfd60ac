"""Vectorised views of Arrow text columns, shared by the operators that work on bytes inside tasks.

Everything here is bounded by one chunk: rows are taken in runs of about ``CHUNK_BYTES`` of text, or a single
row where that row alone is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Word separators: space and the bytes 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 10), "down": _powers(_BASE_INVERSE, 1 << 10)}


def _power_table(kind: str, n: int) -> np.ndarray:
    if len(_CACHE[kind]) < n:
        _CACHE[kind] = _powers(_BASE if kind == "up" else _BASE_INVERSE, max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)))
    return _CACHE[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def release() -> None:
    """Give freed memory back, so that a worker which lives on does not hold the largest of its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """One column as a single array; a text column has its nulls replaced by the empty text."""
    out = batch.column(name)
    if isinstance(out, pa.ChunkedArray):
        out = out.combine_chunks()
        if isinstance(out, pa.ChunkedArray):
            out = pa.concat_arrays(out.chunks) if out.num_chunks else pa.array([], out.type)
    if pa.types.is_string(out.type) or pa.types.is_large_string(out.type):
        out = pc.fill_null(out, "")
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``, a whole number without nulls: no more is held than one batch
    and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch) and held and batch.column(key)[len(batch) - 1] != held[0].column(key)[0]:
            table = pa.Table.from_batches([*held, batch])
            keys = column(table, key).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(keys[1:] != keys[:-1])[-1]) + 1
            yield table.slice(0, cut)
            held = [b for b in table.slice(cut).to_batches() if len(b)]
        elif len(batch):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text array without nulls and its n + 1 offsets, starting at 0."""
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=kind)[values.offset : values.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Chunk:
    """Bytes of consecutive rows with prefix hashes, so that the hash of any byte range costs O(1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.at = offsets[lo : hi + 1] - offsets[lo]
        self.data = data[offsets[lo] : offsets[hi]]
        self.rows = hi - lo
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[self.data] * _power_table("up", max(n, 1))[:n], out=self._sums[1:])
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges, independent of where they stand."""
        down = _power_table("down", len(self.data) + 1)
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of the ``size`` bytes from each position, not finalised: only their upper bits are mixed well."""
        n = len(self.data) - size + 1
        return (self.sums[size:] - self.sums[:n]) * _power_table("down", n)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, at, side="right") - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """For each row, how many of its bytes are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of every maximal run of bytes that are no separators; runs end with their row."""
        inside = ~IS_SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.at[1:-1]
        before[edge[edge < len(inside)]] = False
        after[edge[edge > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return start, end, self.row_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the \\n-split lines, but for empty ones at the end of a row."""
        breaks = np.flatnonzero(self.data == 10)
        more = breaks + 1
        more = more[more < self.at[1:][self.row_of(breaks)]] if len(breaks) else more
        start = np.union1d(self.at[:-1][self.at[:-1] < self.at[1:]], more)
        row = self.row_of(start)
        end = self.at[1:][row]
        k = np.searchsorted(breaks, start)
        has = k < len(breaks)
        end[has] = np.minimum(end[has], breaks[k[has]])
        return start, end, row
