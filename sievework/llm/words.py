"""Words, word hashes and window hashes of whole Arrow batches, as numpy arrays.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return.  All hashes depend on content alone, so tasks and executors agree on them.

Every step of a hash goes through a mixing function, of eight bytes of a word, of two neighbouring windows or of a word and
its place, so regular texts have no sums or powers in which they could agree.  Words are told apart by 64 bits, sequences of
words by 128 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text hashed at a time; temporary arrays take some forty times as much.
SLICE_BYTES = 1 << 19

#: Words of more bytes are hashed one at a time.
LONG_WORD = 64

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_SALTS = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the words raw[start:end]."""
    length = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))      # the eight bytes from each place on
    out = _mix(length.astype(_U) + _ODD)
    for at in range(0, min(int(length.max(initial=0)), LONG_WORD), 8):
        open_ = np.flatnonzero(length > at)
        left = np.minimum(length[open_] - at, 8).astype(_U)
        part = eight[start[open_] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        out[open_] = _mix((out[open_] ^ part) * _ODD + _U(at + 1))
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k]:end[k]].data)
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches."""
    return _mix(_mix(left + _ODD) + right)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The value so many places on; zero past the end."""
    return np.concatenate([values[by:], np.zeros(min(by, len(values)), _U)])


class Words:
    """Words of some rows: ``hashes`` of all words, row r holding ``hashes[first[r]:first[r + 1]]``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)      # a row ends here
        cut[ends] = True
        begins = inside[1:] & (~inside[:-1] | cut)
        stops = inside[:-1] & (~inside[1:] | cut)
        start, end = np.flatnonzero(begins), np.flatnonzero(stops)
        self.first = np.searchsorted(start, ends)
        self.hashes = _word_hashes(_LOWER[raw] if lower else raw, start, end)

    def windows(self, width: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each word on; only ``room(width)`` entries are meaningful."""
        level = _mix(self.hashes + _SALTS[0] * _U(salt)) if salt else self.hashes
        found, taken, size = None, 0, 1
        while True:
            if width & size:
                found = level if found is None else _joined(found, _ahead(level, taken))
                taken += size
            size *= 2
            if size > width:
                return _mix(found + _U(width))
            level = _joined(level, _ahead(level, size // 2))

    def room(self, width: int) -> np.ndarray:
        """Whether that many words of the same row are left from each word on."""
        counts = np.diff(self.first)
        last = np.repeat(self.first[1:], counts)
        return np.arange(len(self.hashes)) + width <= last

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the word sequence of each row."""
        counts = np.diff(self.first)
        place = (np.arange(len(self.hashes)) - np.repeat(self.first[:-1], counts)).astype(_U) * _ODD
        sums = np.zeros((2, len(self.hashes) + 1), _U)
        for k, salt in enumerate(_SALTS):
            np.cumsum(_mix(_mix(self.hashes + salt) + place), out=sums[k, 1:])
        return tuple(_mix(s[self.first[1:]] - s[self.first[:-1]] + counts.astype(_U)) for s in sums)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most SLICE_BYTES of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[i:i + width]`` for each i; runs past the end look at what is there."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out
