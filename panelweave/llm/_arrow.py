"""Vectorised word and shingle hashing over Arrow text columns.

A batch is worked on in slices of a few MB of text, so that the arrays behind it stay
small however many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0xBF58476D1CE4E5B9)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty string."""
    return pc.fill_null(column.cast(pa.string()), "")


def text_slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(texts_of(batch.column(text))).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' bounds in them."""
    column = texts_of(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of every row: hashes, byte positions, rows' bounds."""

    def __init__(self, column: pa.Array):
        self.data, self.rows = raw(column)
        n = len(self.data)
        solid = ~_SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.rows] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.rows)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[self.data] * up[:n], out=total[1:])
        self.hashes = scramble((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `width` words within a row, and the rows' bounds among them.

        A row with fewer words, but one at least, has its whole word sequence as one shingle.
        """
        count = np.diff(self.bounds)
        made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(made)])
        out = np.zeros(bounds[-1], dtype=np.uint64)
        h = self.hashes
        if len(h) >= width:
            full = np.full(len(h) - width + 1, width, dtype=np.uint64)
            for k in range(width):
                full = scramble(full * STEP + h[k : len(h) - width + 1 + k])
            at = np.arange(len(full))
            row = np.searchsorted(self.bounds, at, side="right") - 1
            fits = at + width <= self.bounds[row + 1]
            where = np.flatnonzero(np.repeat(count >= width, made))
            out[where] = full[fits]
        for row in np.flatnonzero((count > 0) & (count < width)):
            one = np.array([count[row]], dtype=np.uint64)
            for x in h[self.bounds[row] : self.bounds[row + 1]]:
                one = scramble(one * STEP + x)
            out[bounds[row]] = one[0]
        return out, bounds


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Every row's set of shingle hashes, sorted."""
    hashes, bounds = Words(column).shingles(width)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
