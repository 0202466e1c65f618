"""A minimal perfect hash over 64-bit keys, and its file: every key has a slot of its own among exactly as many slots.

Level by level the keys left are thrown into a bit array some two times their number; those alone at their bit stay there
and the others go on. A key's slot is the number of bits set before its own, read off a running count a machine word. A
slot stores a fingerprint of its key and what the key maps to, so that a key which is not in the set is told apart (but
for one in 2^32). All steps take whole numpy arrays; a look-up takes the same few steps whatever the number of keys.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from textora.llm.wordhash import mix

MAGIC = b"TXTMPH01"
SLOT = np.dtype([("print", "<u4"), ("first", "<u8"), ("rows", "<u8")])
#: Bits a key at each level, and levels after which keys must be equal.
GAMMA, LEVELS = 2.0, 100
_STEP = 0x9E3779B97F4A7C15


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype("<u4")


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys + np.uint64(_STEP * (level + 1) % 2**64)) % np.uint64(size)


@dataclass
class KeyIndex:
    """sizes: bits of each level; words: the bits of all levels; before: bits set before each word; slots: one a key."""

    sizes: list[int]
    words: np.ndarray
    before: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, first: np.ndarray, rows: np.ndarray) -> KeyIndex:
        """Of distinct keys (equal ones are an error); first and rows are what each key maps to."""
        left, sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys of an index must differ")
            size = max(64, -int(-GAMMA * len(left) // 64) * 64)
            at = _at(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate([*bits, np.zeros(0, bool)]), bitorder="little").view("<u8")
        count = np.bitwise_count(packed).astype("<u4")
        made = cls(sizes, packed, (np.cumsum(count) - count).astype("<u4"), np.zeros(len(keys), SLOT))
        slot = made.places(keys.astype(np.uint64))
        made.slots["print"][slot], made.slots["first"][slot], made.slots["rows"][slot] = fingerprint(keys.astype(np.uint64)), first, rows
        return made

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where no level holds it."""
        found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _at(keys[open_], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[held]] = (self.before[word] + np.bitwise_count(below))[held]
            open_, base = open_[~held], base + size
        return found

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are in the set, their slots)."""
        keys = keys.astype(np.uint64)
        at = self.places(keys)
        if not len(self.slots):
            return at >= 0, self.slots[:0]
        held = (at >= 0) & (self.slots["print"][at] == fingerprint(keys))
        return held, self.slots[at[held]]

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QQ", len(self.slots), len(self.sizes)) + np.array(self.sizes, "<u8").tobytes()
        return head + self.words.tobytes() + self.before.tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> KeyIndex:
        if raw[:8] != MAGIC:
            raise ValueError("no key index")
        n, levels = struct.unpack_from("<QQ", raw, 8)
        sizes = np.frombuffer(raw, "<u8", levels, 24)
        words = int(sizes.sum()) // 64
        at = 24 + 8 * levels
        return cls(sizes.tolist(), np.frombuffer(raw, "<u8", words, at), np.frombuffer(raw, "<u4", words, at + 8 * words), np.frombuffer(raw, SLOT, n, at + 12 * words))
