"""Words of whole Arrow columns at once, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. These six separators are single bytes in UTF-8, so the bytes of a column can be cut
without decoding. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[:, SPACE] = 0
_SEED = _rng.integers(1, 1 << 63, 2, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of a string column: ``start`` and ``end`` in ``data``, ``doc`` (row), ``first`` (row -> its first word)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.rows, self.offsets = len(offsets) - 1, offsets
        space = SPACE[self.data]
        opens, closes = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        opens[1:-1], closes[:-1] = space[:-1], space
        edges = offsets[:-1][np.diff(offsets) > 0]
        opens[edges] = closes[edges] = True
        self.start = np.flatnonzero(~space & opens[:-1])
        self.end = np.flatnonzero(~space & closes[1:]) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` (0 or 1) picks one of two independent functions.

        A byte's random number times a random number of its place, added up. The numbers of the places are unrelated, not
        powers of one base, so no pattern of letters makes words collide more often than by chance.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        longest = int((self.end - self.start).max())
        factor = mix(np.arange(1, longest + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SEED[which]) | np.uint64(1)
        spans = np.diff(np.append(self.start, len(self.data)))
        place = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, spans)
        values = _BYTE[which][self.data[self.start[0] :]] * factor[np.minimum(place, longest)]
        return mix(np.add.reduceat(values, self.start - self.start[0]) + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word shingles and their rows. A row of 1 to k - 1 words has its whole sequence as one."""
        n = len(hashes)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            total[: n - j] += hashes[j:] * _PLACE[j]
        at = np.flatnonzero(np.arange(n) + k <= self.first[self.doc + 1])
        value, doc = mix(total[at]), self.doc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = self.count[short] > j
                whole[has] += hashes[self.first[short[has]] + j] * _PLACE[j]
            value = np.concatenate((value, mix(whole + self.count[short].astype(np.uint64))))
            doc = np.concatenate((doc, short))
        return value, doc
