"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, BLOCK := 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_BLANK] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts [first, first + n) of a batch, in order.

    raw: bytes of these texts; begin: where each text begins in raw (n + 1 values); start, end: byte span of each word;
    bounds: index of the first word of each text (n + 1 values); value: 64-bit hash of each word.
    """

    first: int
    n: int
    raw: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    value: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words within a text."""
        m = len(self.value) - k + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        inside = np.repeat(self.bounds[1:], np.diff(self.bounds))[:m] >= np.arange(m) + k
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h += self.value[i : i + m] * _ROW[i % 64]
            if i % 8 == 7:
                h = mix(h)
        at = np.flatnonzero(inside)
        return at, mix(h[at])


def words(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words (runs of bytes other than space and U+0009 to U+000D) of a string array, chunk by chunk; null: none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        last = min(last, len(texts))
        begin = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        yield _chunk(first, _LOWER[raw] if lower else raw, begin)
        first = last


def _chunk(first: int, raw: np.ndarray, begin: np.ndarray) -> Words:
    n = len(begin) - 1
    ink = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[begin] = True
    before = np.empty(len(raw), bool)
    before[:1], before[1:] = False, ink[:-1]
    after = np.empty(len(raw), bool)
    after[-1:], after[:-1] = False, ink[1:]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    bounds = np.searchsorted(start, begin)
    if len(start):
        lead = start[0]
        place = np.arange(lead, len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
        value = np.add.reduceat(_BYTE[raw[lead:]] * _PLACE[place & (BLOCK - 1)], start - lead)
        value = mix(value ^ (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > BLOCK):  # a place beyond the block would count as one within it
            value[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    else:
        value = np.empty(0, np.uint64)
    return Words(first, n, raw, begin, start, end, bounds, value)
