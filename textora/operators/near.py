"""Passages that stand nearly in a text: positional q-gram postings, a count filter along diagonals, then exact ratios.

A window whose ratio with a fact is r or more shares M >= r/2 (L + W) characters with it in order, in blocks that lie on
diagonals (text position less fact position) at most L + W - 2M apart. Blocks of b characters hold b - q + 1 of the fact's
q-grams, so that a bound follows for the q-grams a stretch of diagonals must have in common with the fact. Every text is
read once: its q-grams look up the postings of all facts, matches are counted by fact and stretch of diagonals, and only
the windows of words that begin within a stretch that has enough are compared, character by character. Nothing that
reaches the ratio is lost. Facts are a stated set of questions: they go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.functions import text as tx

#: Ratio from which a passage is nearly the fact, characters of facts that go to the tasks at a time, characters of a text looked up at a time.
NEARLY, BLOCK, SLICE = 0.9, 1 << 20, 1 << 16
#: Steps, at least, in which a window's diagonals are counted.
STEPS = 4
#: Part of a fact's length within which windows begin that are first looked at together.
RUN = 6


def normal(text: str) -> str:
    """NFKC, blanks as single spaces, case folded; what tidy() did before is kept."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def least_shared(length: int, q: int, least: float = NEARLY) -> int:
    """q-grams that a fact of this length shares at least with any window of the ratio."""
    return ceil((length + length * least / (2 - least)) * (least / 2 * (2 * q - 1) - (q - 1)) - (q - 1) - 1e-9)


def _codes(chars: np.ndarray, q: int) -> np.ndarray:
    n = len(chars) - q + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(q if n > 0 else 0):
        code = code * np.uint64(0x100000001B3) + chars[i : i + n]
    return code


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


@dataclass
class Postings:
    """Grams of the facts of one q and one width of steps (2 ** shift diagonals): fact and place of each, by the codes of all
    facts of that q; those of the i-th code begin at begin[i].

    facts: their numbers, by `span`, the steps that hold all diagonals of a window; need: the grams those must hold.
    """

    q: int
    shift: int
    over: int
    facts: np.ndarray
    span: np.ndarray
    need: np.ndarray
    begin: np.ndarray
    fact: np.ndarray
    place: np.ndarray

    def reaching(self, bins: np.ndarray, steps: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fact, step) from which the span of a fact has what is needed; bins: steps of the matches, by fact of `of`.

        Sums run over all facts in a row; that of a fact's last steps, which are empty, can only come out too large.
        """
        total = np.zeros(len(of) * steps + int(self.span[-1]) + 1, np.int64)
        np.cumsum(np.bincount(bins, minlength=len(of) * steps), out=total[1 : len(of) * steps + 1])
        total[len(of) * steps + 1 :] = len(bins)
        out, span = [], self.span[of]
        for wide in np.unique(span).tolist():
            a, z = np.searchsorted(span, wide), np.searchsorted(span, wide, side="right")
            held = (total[a * steps + wide : z * steps + wide] - total[a * steps : z * steps]).reshape(-1, steps)
            out.append(np.flatnonzero(held >= self.need[of[a:z], None]) + a * steps)
        good = np.concatenate(out)
        return of[good // steps], good % steps


class Facts:
    def __init__(self, texts: list[str], least: float) -> None:
        self.texts, self.least = texts, least
        length = np.array([len(t) for t in texts], np.int64)
        self.spread = np.floor((1 - least) * 2 / least * length + 1e-9).astype(np.int64)  # most that diagonals of blocks differ
        self.longest = length + self.spread
        grams = [next((q for q in (4, 3, 2) if least_shared(n, q, least) >= 4), 1) for n in length.tolist()]
        shift = [(n // STEPS + 1).bit_length() - 1 for n in self.spread.tolist()]
        self.codes = {q: np.unique(np.concatenate([_codes(_chars(t), q) for t, g in zip(texts, grams, strict=True) if g == q])) for q in set(grams)}
        self.postings: list[Postings] = []
        for q, s in sorted(set(zip(grams, shift, strict=True))):
            span = lambda i: (int(self.spread[i]) + (1 << s) - 1 >> s) + 1  # noqa: B023, E731
            mine = sorted((i for i, g in enumerate(zip(grams, shift, strict=True)) if g == (q, s)), key=span)
            codes = [_codes(_chars(texts[i]), q) for i in mine]
            code, fact = np.concatenate(codes), np.repeat(np.arange(len(mine)), [len(c) for c in codes])
            place, by = np.concatenate([np.arange(len(c)) for c in codes]), np.argsort(code, kind="stable")
            begin = np.append(np.searchsorted(code[by], self.codes[q]), len(code))
            need = np.array([max(1, least_shared(len(texts[i]), q, least)) for i in mine], np.int64)
            over = int((self.longest + self.spread)[mine].max()) + 2
            self.postings.append(Postings(q, s, over, np.array(mine), np.array([span(i) for i in mine]), need, begin, fact[by], place[by]))

    def stretches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(fact, first and last place at which a window may begin) wherever enough q-grams share a stretch of diagonals.

        The diagonals of a window's blocks and the window's own begin lie within `spread` of each other. They are counted
        in steps of a power of two, a quarter of that at most. Long texts are looked up in slices that overlap by more
        than a window.
        """
        chars, most = _chars(text), max((p.over for p in self.postings), default=0)
        for start in range(0, len(chars), SLICE):
            part, known = chars[start : start + SLICE + 2 * most], {}
            for q, have in self.codes.items():
                code = _codes(part, q)
                which = np.minimum(np.searchsorted(have, code), len(have) - 1)
                at = np.flatnonzero(have[which] == code)
                known[q] = at, which[at]
            for p in self.postings:
                at, which = known[p.q]
                low = p.begin[which]
                n = p.begin[which + 1] - low
                entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                steps = (len(part) + p.over >> p.shift) + int(p.span[-1]) + 1  # the last stay empty
                zero = p.fact * (steps << p.shift) + p.over - p.place  # step of a match at place 0, times the width
                bins = zero[entry] + np.repeat(at, n) >> p.shift
                fact, step = p.reaching(bins, steps, np.arange(len(p.facts)))
                if not len(fact):
                    continue
                # where matches are enough, count again how many places of the fact have one: a text that repeats itself has many of each
                inside = np.zeros(len(p.facts) * steps + 1, np.int64)
                np.add.at(inside, fact * steps + step, 1)
                np.add.at(inside, fact * steps + step + p.span[fact], -1)
                mine = np.flatnonzero((np.cumsum(inside) > 0)[bins])
                stride = int(self.longest.max()) + 1
                once = np.unique(bins[mine] * stride + p.place[entry[mine]]) // stride
                of = np.unique(fact)
                fact, step = p.reaching(np.searchsorted(of, once // steps) * steps + once % steps, steps, of)
                first = start + (step << p.shift) - p.over
                yield from zip(p.facts[fact].tolist(), np.maximum(first, 0).tolist(), (first + (p.span[fact] << p.shift) - 1).tolist(), strict=True)

    def best(self, text: str) -> tuple[dict[int, float], int]:
        """({fact: best ratio}, windows compared): facts that stand in the text, and those with a window of the ratio."""
        from difflib import SequenceMatcher

        found = {i: 1.0 for i, t in enumerate(self.texts) if t in text}
        words = text.split(" ")
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        starts: dict[int, set[int]] = {}
        for fact, first, last in self.stretches(text):
            if fact not in found:
                starts.setdefault(fact, set()).update(range(*np.searchsorted(begin[:-1], [first, last + 1]).tolist()))
        looked = 0
        for fact, places in starts.items():
            what = self.texts[fact]
            size, top = what.count(" ") + 1, 0.0
            match, widths = SequenceMatcher(autojunk=False), sorted({max(1, size - 1), size, size + 1})
            match.set_seq2(what)
            masks: dict[str, int] = {}
            for i, c in enumerate(what):
                masks[c] = masks.get(c, 0) | 1 << i
            windows = [(i, ends) for i in sorted(places) if (ends := sorted({min(i + w, len(words)) for w in widths if i + w <= len(words) or i == 0}))]
            size_of = lambda i, end: int(begin[end] - 1 - begin[i])
            for run in _runs(windows, begin, len(what) // RUN):
                # all windows of a run lie in one stretch of text: none has more in common with the fact than that has
                looked += sum(len(ends) for _, ends in run)
                least = min(size_of(i, ends[0]) for i, ends in run)
                whole = text[begin[run[0][0]] : max(begin[ends[-1]] for _, ends in run) - 1]
                if len(run) > 1 and 2 * common(masks, len(what), whole, [len(whole)])[0] < max(top, self.least) * (len(what) + least) - 1e-6:
                    continue
                for i, ends in run:
                    sizes = [size_of(i, end) for end in ends]
                    for end, n, shared in zip(ends, sizes, common(masks, len(what), text[begin[i] : begin[ends[-1]] - 1], sizes), strict=True):
                        if 2 * shared >= max(top, self.least) * (len(what) + n) - 1e-6:
                            match.set_seq1(text[begin[i] : begin[end] - 1])
                            top = max(top, match.ratio())
            if top >= self.least:
                found[fact] = round(top, 4)
        return found, looked


def _runs(windows: list[tuple[int, list[int]]], begin: np.ndarray, most: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Windows (first word, ends), in order, in runs that begin within so many characters of each other."""
    run: list[tuple[int, list[int]]] = []
    for w in windows:
        if run and begin[w[0]] - begin[run[0][0]] > most:
            yield run
            run = []
        run.append(w)
    if run:
        yield run


def common(masks: dict[str, int], length: int, text: str, sizes: list[int]) -> list[int]:
    """Characters that a string of this length, given by where each character stands in it, has in common in order with
    the prefixes of text of these sizes, which rise: no matching of blocks can have more. A row of the usual table is the
    bits of one integer."""
    row = all_ = (1 << length) - 1
    out, at = [], 0
    for n in sizes:
        for c in text[at:n]:
            if c in masks:
                hit = row & masks[c]
                row = ((row + hit) | (row - hit)) & all_
        at = n
        out.append(length - row.bit_count())
    return out


def _blocks(facts: DataFrame) -> Iterator[list[tuple]]:
    """The facts (fact, what) in blocks of bounded size."""
    block, held = [], 0
    for row in facts.toLocalIterator():
        block.append((row.fact, row.what))
        held += len(row.what)
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def near_scores(pages: DataFrame, facts: DataFrame, key: str = "doc_id", least: float = NEARLY) -> DataFrame:
    """(fact, key, score, windows, of_windows) of the facts (fact, text) that stand in pages (key, text) exactly (score 1) or
    nearly: the best ratio of a window of as many words, one less or one more, `least` at least.

    windows: how many windows of the page were compared, for all facts of a block; of_windows: how many there are. Null
    and blank facts are found nowhere, null pages hold nothing; null keys are a page like others, repeated rows give one.
    """
    want = facts.select("fact", tx.tidy(F.col("text")).alias("what")).where("trim(what) <> ''").distinct()
    body = pages.select(key, tx.tidy(tx.empty_as(F.col("text"))).alias("body")).where("body <> ''")
    shape = ", ".join([f"fact {dict(facts.dtypes)['fact']}", f"`{key}` {dict(pages.dtypes)[key]}", "score double", "windows long", "of_windows long"])
    if body.rdd.getNumPartitions() < body.sparkSession.sparkContext.defaultParallelism:
        body = body.repartition(body.sparkSession.sparkContext.defaultParallelism)  # a small table, to all cores
    kind = want.select("fact").limit(0).toArrow().schema.field("fact").type
    found = [body.mapInArrow(_compare(block, kind, least), shape) for block in _blocks(want)]
    return reduce(DataFrame.unionByName, found).distinct() if found else body.sparkSession.createDataFrame([], shape)


def _compare(block: list[tuple], kind: pa.DataType, least: float):
    """mapInArrow: (key, body) to a row for each fact of the block that a body holds."""
    given, names = Facts([normal(what) for _, what in block], least), pa.array([fact for fact, _ in block], kind)
    sizes = np.array([t.count(" ") + 1 for t in given.texts])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("body")):
                plain = normal(text.as_py())
                found, looked = given.best(plain)
                n = plain.count(" ") + 1
                whole = int(sum(np.maximum(1, n - np.maximum(1, sizes + d) + 1).sum() for d in (-1, 0, 1)))
                rows += [(i, f, score, looked, whole) for f, score in found.items()]
            at, fact, score, looked, whole = zip(*rows, strict=True) if rows else [()] * 5
            each = names.take(pa.array(fact, pa.int64())), b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*each, pa.array(score, pa.float64()), pa.array(looked, pa.int64()), pa.array(whole, pa.int64())], ["fact", b.schema.names[0], "score", "windows", "of_windows"])

    return compare
