"""Set similarity join over word n-grams, exact, by a size-aware heavy-light scheme, and its connected classes.

Documents with one shingle set are one class from the start. Classes are split by size at a boundary chosen by cost:
- light (small sets): every subset of the fixed size that a link needs is enumerated and hashed; sets that meet in a
  subset are linked by their sizes alone, through the smallest of them, without any comparison;
- heavy (large sets): inverted lists of shingles are scanned. Two linked sets share k shingles among the first
  n - ceil(t * n) + k of each in any common order. A first scan, in hash order and with k about a 25th of a set, keeps the
  sets of which k shingles lie in lists that hold another set at all. A second, with k = 1 for these alone, puts frequent
  shingles last, so that lists of edited copies part. In it every set first meets one set of each list; pairs are tested by
  an upper bound of what they share, then by exact Jaccard similarity, and linked components merge. Sets near one another
  make clusters with a reference set each: two sets of a cluster that both differ little from the reference are linked for
  sure, and others must share some of what differs, which is rare, so large groups of near copies make no pairs among
  themselves that this does not call for. Of two clusters the pairs are enumerated that still lie in two components.
Nothing is capped: every pair left out is either linked through others already or cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, save, small
from textora.llm.components import connected_components
from textora.llm.wordhash import words

#: Largest size at which subsets are considered at all: beyond it a set has thousands of them.
MOST_LIGHT = 24
#: Slots of the frequency table that orders shingles in the second scan (4 bytes each): order sets cost, not results.
SLOT_BITS = 18
#: Least hashes of a set by which sets are told to be near one another: this groups sets, and decides no link.
SKETCH = 24


def overlap(a: int, b: int, t: tuple[int, int]) -> int:
    """Least common size with which sets of sizes a and b are linked: t is the threshold as a fraction."""
    p, q = t
    return -(-p * (a + b) // (p + q))


def prefix(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def spare(n: int, t: tuple[int, int]) -> int:
    """How many members of a set of size n a linked set can lack."""
    return n - -(-t[0] * n // t[1])


def extra(n: int, t: tuple[int, int]) -> int:
    """Members beyond spare(n) in the first scan: that many, or the partner's number, are common to both leads."""
    return 1 + spare(n, t) // 4


def text_key(text):
    """Tells texts apart: 128 bits of the whole text, null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _subset_sizes(n: int, t: tuple[int, int]) -> range:
    """Sizes of the subsets that a set of size n shares with any set it is linked to."""
    return range(-(-t[0] * n // t[1]), n + 1)


def _subsets(n: int, t: tuple[int, int]) -> int:
    return sum(comb(n, c) for c in _subset_sizes(n, t))


def boundary(sizes: dict[int, int], t: tuple[int, int], list_cost: float = 4.0) -> int:
    """The size up to which enumerating subsets costs no more rows than scanning inverted lists does.

    sizes: classes per size, up to MOST_LIGHT. A subset costs one row. A list entry costs list_cost rows: its own, its
    share of the second scan and of the verification that subsets do without. Sets up to bound / t can meet sets up to
    the bound, so they are enumerated too.
    """
    best, least = 0, None
    for x in range(MOST_LIGHT + 1):
        top = x * t[1] // t[0]
        cost = sum(k * _subsets(n, t) for n, k in sizes.items() if n <= top) + sum(k * list_cost * prefix(n, t) for n, k in sizes.items() if n > x)
        if least is None or cost < least:
            best, least = x, cost
    return best


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, sorted shingle hashes of each text) chunk by chunk; too few words make one shingle of all."""
    for w in words(texts, lower=True):
        at, h = w.runs(n)
        owner = np.searchsorted(w.bounds, at, side="right") - 1
        few = np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < n))
        spelled = lambda d, w=w: b" ".join(w.raw[w.begin[d] : w.begin[d + 1]].tobytes().split())
        extra = [int.from_bytes(hashlib.blake2b(spelled(d), digest_size=8).digest(), "big") for d in few]
        owner, h = np.concatenate([owner, few]), np.concatenate([h, np.array(extra, np.uint64)])
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        owner, h = owner[new], h[new]
        cut = np.searchsorted(owner, np.arange(w.n + 1))
        yield w.first, [h[cut[i] : cut[i + 1]] for i in range(w.n)]


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _scan(n: int, t: tuple[int, int]):
    """Per document: size and digest of its set, and the first shingles in hash order (all of a small set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in _sets(b.column("text"), n):
                lead = [s if len(s) <= MOST_LIGHT * t[1] // t[0] else s[: spare(len(s), t) + extra(len(s), t)] for s in sets]
                cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lead])]).astype(np.int32))
                flat = np.concatenate(lead).view(np.int64) if lead else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(first, len(sets)), "text_key": b.column("text_key").slice(first, len(sets)), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([_digest(s) for s in sets], pa.binary()), "lead": pa.ListArray.from_arrays(cut, pa.array(flat)),
                })

    return scan


def _full(n: int):
    """Whole sets, as sorted 64-bit hashes, of the texts of classes that the first scan kept."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in _sets(b.column("text"), n):
                yield pa.RecordBatch.from_pydict({
                    "set_id": b.column("set_id").slice(first, len(sets)), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "hashes": pa.array([s.tobytes() for s in sets], pa.binary()), "tally": pa.array([_counts(s) for s in sets], pa.binary()),
                    "sketch": pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()),
                })

    return full


def _counts(h: np.ndarray) -> bytes:
    """How many of a set's hashes begin with each run of bits, two to four on average, a byte each; empty where one overflows."""
    bits = max(0, len(h).bit_length() - 2)
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _weigh(t: tuple[int, int]):
    """Of pairs with their tallies and sketches: `possible`, whether they can be linked (no more is common than the lesser
    count of each run of bits), and `near`, whether their sketches hold about a third in common. Others end here."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = t
        for b in batches:
            possible, near = [], []
            for n, x, y, u, v in zip(*(b.column(c).to_pylist() for c in ("n", "x", "y", "u", "v")), strict=True):
                some, more = (np.frombuffer(k, np.uint8).astype(np.int32) for k in sorted((x, y), key=len))
                possible.append(not len(some) or int(np.minimum(some, more.reshape(len(some), -1).sum(1)).sum()) * (p + q) >= p * n)
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = np.union1d(u, v)[:SKETCH]
                near.append(3 * int((np.isin(both, u) & np.isin(both, v)).sum()) >= len(both))
            kept = np.array(possible, bool) | np.array(near, bool)
            out = {k: b.column(k).filter(pa.array(kept)) for k in ("a", "b")}
            yield pa.RecordBatch.from_pydict(out | {"possible": pa.array(np.array(possible, bool)[kept]), "near": pa.array(np.array(near, bool)[kept])})

    return weigh


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall in each slot, of all sets of a task, in 64 pieces."""
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for b in batches:
        for s in b.column("hashes").to_pylist():
            table += np.bincount(_slot(np.frombuffer(s, np.uint64)), minlength=len(table)) if len(s) > len(table) else 0
            if len(s) <= len(table):
                np.add.at(table, _slot(np.frombuffer(s, np.uint64)), 1)
    yield pa.RecordBatch.from_pydict({"piece": pa.array(range(64), pa.int32()), "counts": pa.array([x.tobytes() for x in table.reshape(64, -1)], pa.binary())})


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Shingles per slot over all sets: a table of fixed size, summed by tasks, piece by piece."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    kind = "piece int, counts binary"
    got = sets.select("hashes").mapInArrow(_tally, kind).repartition(8, "piece").mapInArrow(add, kind).collect()  # 64 rows of 32 KB
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(got, key=lambda r: r["piece"])])


def _postings(freq, t: tuple[int, int]):
    """(shingle, set_id, n, place): the first shingles of each set, rare slots first, then in hash order."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for set_id, s in zip(b.column("set_id").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                h = np.frombuffer(s, np.uint64)
                lead = h[np.lexsort((h, freq.value[_slot(h)]))[: prefix(len(h), t)]]
                out.append((lead.view(np.int64), np.full(len(lead), set_id), np.full(len(lead), len(h)), np.arange(len(lead))))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_pydict(dict(zip(("shingle", "set_id", "n", "place"), map(pa.array, cols), strict=True)))

    return post


def _verify(t: tuple[int, int]):
    """Of pairs with their sets, the ids of those that are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = t
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(u) + len(v) - len(np.union1d(u, v))
                ok.append(same * (p + q) >= p * (len(u) + len(v)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([i for i, k in zip(a, ok, strict=True) if k], pa.int64()), "b": pa.array([i for i, k in zip(c, ok, strict=True) if k], pa.int64())})

    return verify


def _weighed(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b, possible, near) of pairs (a, b), saved: only tallies and sketches travel."""
    side = lambda k, n, x, u: sets.select(F.col("set_id").alias(k), F.col("n").alias(n), F.col("tally").alias(x), F.col("sketch").alias(u))
    both = pairs.join(side("a", "na", "x", "u"), "a").join(side("b", "nb", "y", "v"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y", "u", "v")
    return save(both.mapInArrow(_weigh(t), "a long, b long, possible boolean, near boolean"), "ngram-weighed")


def _verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The linked ones of pairs (a, b), by their whole sets."""
    x, y = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return save(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(t), "a long, b long"), "ngram-links")


def _parts(edges: DataFrame, name: str) -> DataFrame:
    """(set_id, name) of the components of edges (a, b), saved."""
    return save(connected_components(edges, "a", "b").select(F.col("node").alias("set_id"), F.col("component").alias(name)), "ngram-parts")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(m: str, n: str, t: tuple[int, int]) -> Column:
    """Whether the sizes of two sets allow a link."""
    return F.least(m, n) * t[1] >= F.greatest(m, n) * t[0]


def _stars(postings: DataFrame, sets: DataFrame, t: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, near, tested): every set meets one set of each of its lists, the one with the fewest rarer shingles of its
    own, which of edited copies is the least edited."""
    lists = postings.groupBy("shingle").agg(F.min_by(F.struct("set_id", "n"), F.struct("place", "set_id")).alias("hub"))
    lists = lists.select("shingle", F.col("hub.set_id").alias("hub"), F.col("hub.n").alias("hub_n"))
    met = postings.join(lists, "shingle").where((F.col("set_id") != F.col("hub")) & _fits("n", "hub_n", t))
    tested = save(met.select(*_pair("set_id", "hub")).distinct(), "ngram-pairs")
    weighed = _weighed(tested, sets, t)
    return _verified(weighed.where("possible"), sets, t), weighed.where("near").select("a", "b"), tested


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What differs between a set and the reference of its cluster: size and hashes."""
    for b in batches:
        gone = [np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        cut = pa.array(np.concatenate([[0], np.cumsum([len(d) for d in gone])]).astype(np.int32))
        flat = pa.array(np.concatenate(gone) if gone else np.empty(0, np.int64))
        yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("cluster", "set_id", "n")} | {"size": pa.array([len(d) for d in gone], pa.int64()), "delta": pa.ListArray.from_arrays(cut, flat)})


def _differences(near: DataFrame, postings: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(cluster, set_id, n, size, delta, g, least, m) of the sets that stars found near one another, saved.

    delta is what differs between a set and the reference of its cluster, its member with the fewest rare shingles. With
    g = size * (p + q) - n * (q - p) two sets are linked for sure where g + g' <= 0, as they then differ in little enough;
    m is the member of least g, and least that g.
    """
    p, q = t
    clusters = _parts(near, "cluster")
    own = postings.groupBy("set_id").agg(F.min("place").alias("own"))
    members = save(own.join(small(clusters), "set_id"), "ngram-members")
    refs = members.groupBy("cluster").agg(F.min(F.struct("own", "set_id")).alias("r")).select("cluster", F.col("r.set_id").alias("set_id"))
    refs = save(refs.join(sets.select("set_id", F.col("hashes").alias("y")), "set_id").select("cluster", "y"), "ngram-references")
    both = members.join(sets.select("set_id", "n", F.col("hashes").alias("x")), "set_id").join(small(refs), "cluster")
    deltas = both.select("cluster", "set_id", "n", "x", "y").mapInArrow(_differ, "cluster long, set_id long, n long, size long, delta array<long>")
    deltas = save(deltas.withColumn("g", F.col("size") * (p + q) - F.col("n") * (q - p)), "ngram-deltas")
    least = deltas.groupBy("cluster").agg(F.min(F.struct("g", "set_id")).alias("m"))
    return save(deltas.join(small(save(least.select("cluster", F.col("m.g").alias("least"), F.col("m.set_id").alias("m")), "ngram-least")), "cluster"), "ngram-clustered")


def _alike(clustered: DataFrame, parts: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of one cluster that can be linked though g + g' > 0, less those in one component.

    They share at least alpha = (g + g') / (2 (p + q)) members of their deltas, so one among the first size - alpha + 1 of
    each, rare ones first. Sets with g + least <= 0 are linked with m and so with one another: one of a pair is far from m,
    with g > -least, which bounds alpha from below for the other.
    """
    p, q = t
    flat = clustered.select("cluster", "set_id", "n", "size", "g", "least", F.explode("delta").alias("gram"))
    often = flat.groupBy("cluster", "gram").agg(F.count("*").alias("often")).where("often > 1")
    mine = flat.join(often, ["cluster", "gram"]).groupBy("cluster", "set_id", "n", "size", "g", "least").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    each = mine.withColumn("shared", F.size("grams")).select("cluster", "set_id", "n", "size", "g", "least", "shared", F.posexplode("grams").alias("i", "x"))
    each = each.withColumns({"gram": F.col("x.gram"), "place": F.col("size") - F.col("shared") + F.col("i"), "far": F.col("g") + F.col("least") > 0})
    alpha = lambda g: F.greatest(F.lit(1), F.ceil(g / F.lit(2.0 * (p + q)) - 1e-9))
    held = F.ceil((F.col("g") - F.col("n") * (q - p) * q / F.lit(p)) / F.lit(p + q) - 1e-9)  # a partner's delta holds alpha
    each = each.withColumns({"for_far": F.col("size") - F.greatest(alpha(F.col("g") - F.col("least")), held) + 1, "for_near": F.col("size") - F.greatest(alpha(F.col("g") + F.col("least")), held) + 1})
    each = each.where(F.col("place") < F.when(F.col("far"), F.greatest("for_far", "for_near")).otherwise(F.col("for_far")))
    each = each.join(small(parts), "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    each = save(each.select("cluster", "gram", "set_id", "n", "size", "g", "place", "far", "for_far", "for_near", "part"), "ngram-alike")
    x, y = each.where("far").alias("x"), each.alias("y")
    met = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.part") != F.col("y.part")) & _fits("x.n", "y.n", t)
    met &= F.when(F.col("y.far"), (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.place") < F.col("x.for_far"))).otherwise(F.col("x.place") < F.col("x.for_near")) & (F.col("y.place") < F.col("y.for_far"))
    met &= F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) * (2 * (p + q)) >= F.col("x.g") + F.col("y.g")
    return x.join(y, met).select(*_pair("x.set_id", "y.set_id"))


def _apart(postings: DataFrame, clusters: DataFrame, parts: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of two clusters and two components, met at a place from which enough shingles can still follow."""
    p, q = t
    now = postings.join(small(parts), "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    now = now.join(small(clusters), "set_id", "left").withColumn("cluster", F.coalesce("cluster", "set_id"))
    now = save(now, "ngram-apart")
    some = now.groupBy("shingle").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.min("part").alias("one"), F.max("part").alias("other")).where("least < most and one < other").select("shingle")
    left = now.join(some, "shingle")
    x, y = left.alias("x"), left.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * p / F.lit(p + q) - 1e-9)
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.part") != F.col("y.part")) & (F.col("x.cluster") != F.col("y.cluster")) & _fits("x.n", "y.n", t) & (room >= need)
    return x.join(y, met).select(*_pair("x.set_id", "y.set_id"))


def _heavy_links(postings: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): links that make all components of the sets."""
    links, near, tested = _stars(postings, sets, t)
    clustered = _differences(near, postings, sets, t)
    links = links.union(clustered.where("set_id <> m and g + least <= 0").select(*_pair("set_id", "m")))
    parts = _parts(links, "part")
    pairs = _alike(clustered, parts, t).union(_apart(postings, clustered.select("set_id", "cluster"), parts, t))
    pairs = save(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
    return links.union(_verified(_weighed(pairs, sets, t).where("possible"), sets, t))


def _light(t: tuple[int, int], bound: int):
    """Subsets of small sets: (subset, set_id, n, c), c being the subset's size."""
    top = bound * t[1] // t[0]

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, sizes, cs = [], [], [], []
            for set_id, n, lead in zip(b.column("set_id").to_pylist(), b.column("n").to_pylist(), b.column("lead").to_pylist(), strict=True):
                if n <= top:
                    values = sorted(lead)
                    for c in _subset_sizes(n, t):
                        for sub in combinations(values, c):
                            keys.append(_digest(np.array(sub, np.int64)))
                            ids.append(set_id)
                            sizes.append(n)
                            cs.append(c)
            yield pa.RecordBatch.from_pydict({"subset": pa.array(keys, pa.binary()), "set_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "c": pa.array(cs, pa.int64())})

    return enumerate_


def ngram_classes(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_shingles, component_id.

    threshold is a fraction (4, 5): linked when |A and B| / |A or B| >= 4/5. Words are runs of characters other than space
    and U+0009 to U+000D, A-Z lower-cased. Fewer than n words make one shingle; no words, or null, an empty set, linked
    with nothing: component_id is then the row's own id. component_id is the smallest id reachable by links; rows without
    an id are linked like others, but lend no id (null if no row reachable has one). Repeated rows are linked with one another.
    Other columns are not looked at.
    """
    t, p, q = threshold, *threshold
    key = text_key(F.col(text_col))
    given = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    rows = save(given.mapInArrow(_scan(n, t), f"doc_id {kind}, text_key binary, n long, digest binary, lead array<long>"), "ngram-rows")
    some = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.any_value(F.struct("n", "lead", "text_key")).alias("s"))
    classes = save(some.select(F.monotonically_increasing_id().alias("set_id"), "digest", "least_id", "s.*"), "ngram-classes")

    counted = {r["n"]: r["count"] for r in classes.where(F.col("n") <= MOST_LIGHT * q // p).groupBy("n").count().collect()}  # a row per small size
    bound = boundary(counted, t)
    subsets = classes.where(F.col("n") <= bound * q // p).select("set_id", "n", "lead").mapInArrow(_light(t, bound), "subset binary, set_id long, n long, c long")
    subsets = save(subsets, "ngram-subsets")
    hubs = subsets.groupBy("subset").agg(F.count("*").alias("k"), F.min(F.struct("n", "set_id")).alias("h")).where("k > 1")
    hubs = save(hubs.select("subset", F.col("h.set_id").alias("hub"), F.col("h.n").alias("hub_n")), "ngram-hubs")
    met = subsets.join(small(hubs), "subset").where("hub <> set_id")
    light = save(met.where(F.col("c") * (p + q) >= p * (F.col("n") + F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct(), "ngram-light")

    spares = lambda m: m - F.ceil(m * p / F.lit(q) - 1e-9)
    extras = lambda m: 1 + F.floor(spares(m) / 4)
    lead = F.when(F.col("n") <= MOST_LIGHT * q // p, F.slice("lead", 1, (spares(F.col("n")) + extras(F.col("n"))).cast("int"))).otherwise(F.col("lead"))
    heavy = classes.where(F.col("n") > bound)
    lists = heavy.select("set_id", "n", F.explode(lead).alias("shingle")).repartition("shingle")
    shared = lists.groupBy("shingle").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a < b").select("shingle")
    met = lists.join(shared, "shingle").groupBy("set_id", "n").agg(F.count("*").alias("met"))
    kept = save(met.where(F.col("met") >= extras(F.ceil(F.col("n") * p / F.lit(q) - 1e-9))).select("set_id"), "ngram-kept")
    kept = save(classes.select("set_id", "text_key").join(small(kept), "set_id"), "ngram-asked")
    texts = given.select("text_key", "text").join(small(kept), "text_key").dropDuplicates(["set_id"])
    sets = save(texts.mapInArrow(_full(n), "set_id long, n long, hashes binary, tally binary, sketch binary"), "ngram-sets")
    freq = docs.sparkSession.sparkContext.broadcast(_frequencies(sets))
    postings = save(sets.mapInArrow(_postings(freq, t), "shingle long, set_id long, n long, place long"), "ngram-postings")
    # Lists of the same sets (of one shared passage, say) become one, named by their members, with each set's first place.
    members = F.xxhash64(F.count("*"), F.min("set_id"), F.max("set_id"), F.bit_xor(F.xxhash64("set_id")))
    several = postings.groupBy("shingle").agg(F.count("*").alias("k"), members.alias("members")).where("k > 1").select("shingle", "members")
    merged = postings.join(several, "shingle").groupBy(F.col("members").alias("shingle"), "set_id", "n").agg(F.min("place").alias("place"))
    merged = save(merged, "ngram-lists")
    drop_saved(postings)
    postings = merged
    links = light.union(_heavy_links(postings, sets, t))

    parts = save(connected_components(links, "a", "b"), "ngram-parts").select(F.col("node").alias("set_id"), "component")
    joined = classes.select("set_id", "digest", "least_id").join(small(parts), "set_id", "left").withColumn("part", F.coalesce("component", "set_id"))
    least = joined.where("component is not null").groupBy("component").agg(F.min("least_id").alias("of_all"))
    named = save(joined.join(small(save(least, "ngram-least")), "component", "left").select("digest", F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("of_all")).alias("component_id")), "ngram-named")
    drop_saved(sets)
    out = rows.select("doc_id", "text_key", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are the one of their class with the smallest id.

    Rows without words, or without an id, always stay. Of rows that repeat an id all stay with the first.
    """
    classes = ngram_classes(docs, n, threshold, id_col, text_col)
    gone = small(save(classes.where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "ngram-gone")).alias("g")
    d = docs.alias("d")
    return d.join(gone, (F.col(f"d.{id_col}") == F.col("g.doc_id")) & (text_key(F.col(f"d.{text_col}")) == F.col("g.text_key")), "left_anti")
