"""Texts to token ids by a public tokenizer, each distinct piece of text encoded once.

A tokenizer that splits at white space before it merges (byte-level with its own pattern, nothing normalised) never makes
a token over the place between a letter, digit or mark and a single space that such a character follows. Texts are cut
there, and the ids of a piece are kept for the pieces that equal it. The ids of the pieces in order are those of the whole
text; other tokenizers get whole texts.
"""

from __future__ import annotations

import functools
import json
import string
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces after which those not used since are forgotten, characters of a text that are worked on at a time, and of texts together.
KEPT, SLICE, TOGETHER = 3 << 16, 1 << 20, 6 << 20
_MARKS = frozenset(string.punctuation)


def _solid(c: str) -> bool:
    """Whether c is surely no white space to any pattern."""
    return c in _MARKS or c.isalnum()


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """text in parts of about so many characters, cut before single spaces between solid characters."""
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while 0 <= at < len(text) - 1 and not (_solid(text[at - 1]) and _solid(text[at + 1])):
            at = text.find(" ", at + 1)
        if not 0 <= at < len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def pieces(text: str) -> list[str]:
    """text cut before every single space between solid characters."""
    out, run = [], []
    for before, now in pairwise(["", *text.split(" ")]):
        if run and before and now and _solid(before[-1]) and _solid(now[0]):
            out.append(" ".join(run))
            run = ["", now]
        else:
            run.append(now)
    return [*out, " ".join(run)]


class Kept:
    """Ids of pieces by their strings. Of two generations the older goes when the younger is full."""

    def __init__(self, encode: Callable[[list[str]], list[bytes | None]]) -> None:
        self.encode, self.young, self.old = encode, {}, {}

    def get(self, part: str) -> bytes | None:
        return self.young.get(part) or self.old.get(part)

    def each(self, parts: list[str]) -> list[bytes | None]:
        """The ids of each part, None where encode() gives none."""
        out = list(map(self.young.get, parts))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        if gaps:
            if len(self.young) > KEPT:
                self.young, self.old = {}, self.young
            missing = list(dict.fromkeys([parts[i] for i in gaps]))
            held = list(map(self.old.get, missing))
            made = iter(self.encode([w for w, ids in zip(missing, held, strict=True) if ids is None]))
            held = [next(made) if ids is None else ids for ids in held]
            if len(missing) == len(gaps):
                for i, ids in zip(gaps, held, strict=True):
                    out[i] = ids
                self.young.update(zip(missing, held, strict=True))
            else:
                self.young.update(zip(missing, held, strict=True))
                for i in gaps:
                    out[i] = self.young[parts[i]]
        return out


class Encoder:
    """Ids as little-endian unsigned integers of `width` bytes (2 where the vocabulary allows). Strings of special tokens
    in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"  # as little-endian machines hold them
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.apart = made.get("normalizer") is None and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.spaced, self.other = Kept(self._spaced), Kept(self._encode)
        self.model, self.tails = self.tokenizer.model, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}  # what stands for a byte in a byte-level vocabulary
        self.space, self.latin = odd[32], {c: "".join(odd.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 0x250)}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes | None]:
        """Ids of words, each with a space before it; None for those that do not begin and end with a solid character.

        The pattern keeps a space and letters together, and marks after them, so that such words go to the merges straight
        away; letters are those of old Latin blocks, on which all agree.
        """
        out, rest, merges, code, space = [], [], self.model.tokenize, self.code, self.space
        for i, word in enumerate(words):
            core = word if word.isalpha() else word.rstrip(string.punctuation)
            if not core.isalpha() or not (plain := core.isascii()) and max(core) > "\u024f":
                if word and _solid(word[0]) and _solid(word[-1]):
                    rest.append(i)
                out.append(None)
                continue
            ids = None if core is word else self.spaced.get(core)
            if ids is None:
                ids = array(code, [t.id for t in merges(space + (core if plain else core.translate(self.latin)))]).tobytes()
            out.append(ids if core is word else ids + self._tail(word[len(core) :]))
        for i, ids in zip(rest, self._encode([f" {words[i]}" for i in rest]) if rest else (), strict=True):
            out[i] = ids
        return out

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > KEPT:
                self.tails.clear()
            self.tails[marks] = self._encode([marks])[0]
        return self.tails[marks]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.apart:
            return self._encode([text])[0]
        return b"".join(self._together(list(slices(text))))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Texts are taken together up to TOGETHER characters, so that a piece is looked up once."""
        held, size = [], 0
        for text in texts:
            if not self.apart or len(text) > SLICE:
                yield from self._together(held)
                yield self.encode(text)
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[bytes]:
        """Texts split at spaces; the ids of their distinct pieces are laid out in order of the pieces."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        ids = [x or b"" for x in self.spaced.each(coded.dictionary.to_numpy(zero_copy_only=False).tolist())]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat, begin = np.frombuffer(b"".join(ids), f"<u{self.width}"), np.cumsum(n) - n
        piece, bound = coded.indices.to_numpy(), split.offsets.to_numpy()
        to = np.concatenate([[0], np.cumsum(n[piece])])
        laid = np.empty(to[-1], flat.dtype)
        for a in range(0, len(piece), 1 << 17):  # a part at a time bounds what the places take
            part = piece[a : a + (1 << 17)]
            size = n[part]
            first, last = to[a], to[a + len(part)]
            laid[first:last] = flat[np.repeat(begin[part] - (to[a : a + len(part)] - first), size) + np.arange(last - first)]
        strange = np.concatenate([[0], np.cumsum(n[piece] == 0)])  # pieces that encode() gave nothing for
        heads = [t if b == a + 1 else t[: t.index(" ")] for t, a, b in zip(texts, bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        out, raw = [], memoryview(laid.tobytes())
        for text, head, lead, a, b in zip(texts, heads, self.other.each(heads), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if strange[b] > strange[a + 1] or head and b > a + 1 and not _solid(head[-1]):
                out.append(b"".join(self.other.each(pieces(text))))
            else:
                out.append(lead + raw[to[a + 1] * self.width : to[b] * self.width])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker; what it has encoded serves the tasks that follow."""
    return Encoder(path)
