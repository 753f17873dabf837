"""Vectorised helpers that tasks apply to a batch of texts (numpy over Arrow buffers).

A batch of strings is one byte array with offsets. Word and window hashes are
computed for the whole batch at once; no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one kernel call handles, so that its arrays stay in tens of MB.
CHUNK_BYTES = 2 << 20

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document is alone in its range."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of non-space bytes; runs never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    end[edge] = solid[edge]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(offsets, ws, "right") - 1


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch with one space after each that is not its document's last; start, end and document of each."""
    ws, we, wd = words(data, offsets)
    if not len(ws):
        return data[:0], ws, we, wd
    keep = ~SPACE[data]
    gap = we[:-1][wd[1:] == wd[:-1]]
    keep[gap] = True
    new = np.cumsum(keep)
    spaced = data.copy()
    spaced[gap] = 0x20
    return spaced[keep], new[ws] - 1, new[we - 1], wd


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = we - ws
    h = mix(size.astype(U) + U(_BASE))
    left, at, todo = size, ws, None
    while True:
        part = eights[at]
        short = left < 8
        part[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        if todo is None:
            h = mix(h ^ part)
        else:
            h[todo] = mix(h[todo] * U(3) ^ part)
        more = left > 8
        if not more.any():
            return h
        todo = np.flatnonzero(more) if todo is None else todo[more]
        left, at = left[more] - 8, at[more] + 8


def word_ids(data: np.ndarray, ws: np.ndarray, we: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each word, equal where and only where the bytes are; h is word_hashes of the words."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    size, like = we - ws, first[ids]
    if (size != size[like]).any():
        return _slow_ids(data, ws, we)
    for part in range(0, len(ws), 1 << 18):
        mine = slice(part, part + (1 << 18))
        owner = np.repeat(np.arange(len(ws))[mine], size[mine])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
        if (data[ws[owner] + place] != data[ws[like[owner]] + place]).any():
            return _slow_ids(data, ws, we)
    return ids


def _slow_ids(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    # Two words of a batch share a 64-bit hash.
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(ws, we)], np.int64)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, U)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any range of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(values * up[: self.n], out=self.sums[1:])

    def window(self, size: int) -> np.ndarray:
        """Of each window of `size` values, by its start."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, U)
        return mix((self.sums[size:] - self.sums[:m]) * self.down[:m])

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each range lo:hi; its length is part of the hash."""
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U) * U(_BASE))


def sliding(op, values: np.ndarray, size: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of `size` values, in log(size) steps."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least value of some window of `window` positions (ties: all)."""
    if len(h) <= window:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = sliding(np.minimum, h, window)
    top = np.zeros(len(low) + 2 * (window - 1), U)
    top[window - 1 : window - 1 + len(low)] = low
    return np.flatnonzero(sliding(np.maximum, top, window) == h)
