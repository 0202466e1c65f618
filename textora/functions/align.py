"""Words of two readings aligned in order, without a comparison of all words with all.

Readings of up to WHOLE words are matched block by block, as `difflib` does: the longest block first, then to either side.
Where the blocks of SPAN words or more follow each other in both readings without an overlap, their order of choice does
not matter, so they are found by their runs of SPAN words and only what lies between them is searched. Of longer ones, words that stand once in either are
anchors; the longest run of anchors that rises in both is kept, and only the stretches between neighbouring anchors are
matched. A stretch that is still long has no such word: its longest common run of words in order is counted exactly, a
row of the table an integer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

WHOLE = 2000
#: Words of a run by which blocks are found; the next where blocks of so many words stand out of order or overlap.
SPAN = (3, 6, 12, 24)
#: Words of a reading up to which it is searched as it is.
FEW = 8


def similarity(a: list[str], b: list[str]) -> float:
    """2 * matched / all of two lists of words, to four places; equal ones 1, one empty 0."""
    if a == b:
        return 1.0
    return round(2 * matched(a, b) / (len(a) + len(b)), 4) if a and b else 0.0


_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Blanks to split() that stand inside words here.
_INNER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def same_words(a: str, b: str) -> bool:
    """Whether two texts hold the same words between ASCII blanks, in any order."""
    x, y = (_WORDS.findall(t) if _INNER.search(t) else t.split() for t in (a, b))
    if len(x) != len(y):
        return False
    other = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return {p for p, _ in other} == {q for _, q in other} and sorted(p for p, _ in other) == sorted(q for _, q in other)


def matched(a: list[str], b: list[str]) -> int:
    """Words of a and b that are matched in order."""
    if not a or not b:
        return 0
    if len(a) + len(b) <= 2 * WHOLE:
        return in_blocks(a, b)
    run = rising(anchors(a, b))
    if not run:
        return common(a, b)
    edges = [(-1, -1), *run, (len(a), len(b))]
    between = (matched(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True) if i + 1 < k and j + 1 < m)
    return len(run) + sum(between)


def in_blocks(a: list[str], b: list[str]) -> int:
    """Words in the matching blocks of difflib."""
    found = next((x for x in (blocks(a, b, k) for k in SPAN) if x is not None), []) if min(len(a), len(b)) > FEW else []
    n, i, j = 0, 0, 0
    for at, to, size in [*found, (len(a), len(b), 0)]:
        if i < at and j < to:
            x, y = a[i:at], b[j:to]
            if not set(x).isdisjoint(y):
                n += 1 if len(x) == 1 or len(y) == 1 else sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        n, i, j = n + size, at + size, to + size
    return n


def blocks(a: list[str], b: list[str], k: int) -> list[tuple[int, int, int]] | None:
    """(place in a, place in b, words) of all common runs of k words or more that cannot be extended, in order; None if
    one begins before another ends in either."""
    of_b = list(zip(*(b[i:] for i in range(k)), strict=False))
    place = dict(zip(of_b, range(len(of_b)), strict=True))
    if len(place) < len(of_b):
        seen: set[tuple] = set()
        for run in of_b:
            if run in seen:
                place[run] = -1
            seen.add(run)
    out: list[tuple[int, int, int]] = []
    at = to = size = 0  # the last block ends at these places
    for i, run in enumerate(zip(*(a[i:] for i in range(k)), strict=False)):
        j = place.get(run)
        if j is None:
            continue
        if j >= 0 and i + k == at + 1 and j + k == to + 1:
            size += 1
        elif j >= to and i >= at:
            if size:
                out.append((at - size, to - size, size))
            size = k
        else:
            return None
        at, to = i + k, j + k
    return [*out, (at - size, to - size, size)] if size else out


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of the words that stand once in each, by their places in a."""

    def once(words: list[str]) -> dict[str, int]:
        n = Counter(words)
        return {w: i for i, w in enumerate(words) if n[w] == 1}

    other = once(b)
    return [(i, other[w]) for w, i in once(a).items() if w in other]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in the second place too; pairs come by the first."""
    ends, last, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that both have in order."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = all_ = (1 << len(a)) - 1
    for w in b:
        if w in places:
            hit = row & places[w]
            row = ((row + hit) | (row - hit)) & all_
    return len(a) - row.bit_count()
