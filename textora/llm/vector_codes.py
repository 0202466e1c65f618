"""Vectors as product codes, whose codebooks Lloyd's rounds learn with trees over both parts and entries.

Vectors become integers and are packed in blocks; each block keeps, for each part position, a tree over its parts: halves
along the widest side, down to small leaves, with the box, number and sum of every node. A codebook is a tree as well.
A round walks both trees together: of a node of parts and the nodes of entries still open for it, box distances bound how
far the nearest entry can lie; entry nodes that lie beyond the bound are dropped. A node of parts with one entry left is
assigned whole by its kept number and sum; leaves that stay uncertain compute exact integer distances to what is left.
Blocks are written once and read by every round; a round's sums are added up by Spark, a row an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, save, small, unused

#: Vectors of a block, and parts of a leaf.
BLOCK, LEAF = 4096, 16
#: Components beyond this size have no code: sums of their squares over a vector could leave 64 bits.
LARGEST = 1 << 24
CARRIED = ("vec_id", "label")


@dataclass
class Tree:
    """Node i has the children i's `child` range; nodes from `singles` on are single points. order: points by place."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @property
    def extent(self) -> np.ndarray:
        return ((self.high - self.low) ** 2).sum(axis=1)


def _ranges(n: int, leaf: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(depth, start, end) of the nodes of a tree over n points, level by level; no node is empty."""
    depth = max(0, (n // leaf).bit_length() - 1)
    cuts = [np.arange(2**d + 1) * n // 2**d for d in range(depth + 1)]
    return depth, np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])


def sort_points(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in a tree: every node halved along its widest side."""
    n = len(points)
    order = np.arange(n)
    depth, _, _ = _ranges(n, leaf)
    for d in range(depth):
        cut, half = np.arange(2**d + 1) * n // 2**d, np.arange(2 ** (d + 1) + 1) * n // 2 ** (d + 1)
        for j in range(2**d):
            mine = order[cut[j] : cut[j + 1]]
            inside = points[mine]
            side = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
            order[cut[j] : cut[j + 1]] = mine[np.argpartition(inside[:, side], half[2 * j + 1] - cut[j])]
    return order


def tree(points: np.ndarray, order: np.ndarray, leaf: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Tree:
    """The tree of points that stand in `order`; boxes are taken from the points where they are not given."""
    n = len(points)
    depth, start, end = _ranges(n, leaf)
    at, inner = 2**depth - 1, 2 ** (depth + 1) - 1
    if low is None:
        low, high = boxes(points, start)
    child = np.empty((inner + n, 2), np.int64)
    child[:at, 0], child[:at, 1] = 2 * np.arange(at) + 1, 2 * np.arange(at) + 3
    child[at:inner, 0], child[at:inner, 1] = inner + start[at:], inner + end[at:]
    child[inner:] = 0
    is_leaf = np.zeros(inner + n, bool)
    is_leaf[at:inner] = True
    return Tree(order, points, np.append(start, np.arange(n)), np.append(end, np.arange(1, n + 1)), np.vstack([low, points]), np.vstack([high, points]), child, is_leaf)


def boxes(points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest corner of every node, level by level."""
    lows, highs, level = [], [], 1
    for first in (2**d - 1 for d in range(int(np.log2(len(start) + 1)))):
        at = start[first : first + level]
        lows.append(np.minimum.reduceat(points, at, axis=0))
        highs.append(np.maximum.reduceat(points, at, axis=0))
        level *= 2
    return np.vstack(lows), np.vstack(highs)


def nearest(parts: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(nodes of parts, the one entry each goes to whole, uncertain leaves with the entries left for each, ascending).

    Works on all open pairs of nodes at once, sorted by node of parts.
    """
    singles, size_p, size_e = int(np.argmax(entries.leaf)) + int(entries.leaf.sum()), parts.extent, entries.extent
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole_p, whole_e, left = [], [], []
    while len(p):
        gap = np.maximum(np.maximum(entries.low[e] - parts.high[p], parts.low[p] - entries.high[e]), 0)
        far = np.maximum(entries.high[e] - parts.low[p], parts.high[p] - entries.low[e])
        first = np.flatnonzero(np.diff(p, prepend=-1))
        bound = np.minimum.reduceat((far * far).sum(axis=1), first)
        keep = (gap * gap).sum(axis=1) <= np.repeat(bound, np.diff(np.append(first, len(p))))
        p, e = p[keep], e[keep]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        count = np.diff(np.append(first, len(p)))
        node, single = p[first], e >= singles
        every = np.logical_and.reduceat(single, first)
        done, stuck = every & (count == 1), every & (count > 1) & parts.leaf[node]
        whole_p.append(node[done])
        whole_e.append(entries.order[e[first[done]] - singles])
        left += [(int(node[i]), np.sort(entries.order[e[first[i] : first[i] + count[i]] - singles])) for i in np.flatnonzero(stuck)]
        larger = np.logical_or.reduceat(~single & ((size_e[e] >= size_p[p]) | parts.leaf[p]), first)  # then entries open, else parts
        gone, opens = np.repeat(done | stuck, count), np.repeat(larger, count)
        a = ~gone & opens
        fan = np.where(single[a], 1, entries.child[e[a], 1] - entries.child[e[a], 0])
        base = np.where(single[a], e[a], entries.child[e[a], 0])
        step = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        b = ~gone & ~opens
        lower = np.concatenate([parts.child[p[b], 0], parts.child[p[b], 0] + 1])
        p, e = np.concatenate([np.repeat(p[a], fan), lower]), np.concatenate([np.repeat(base, fan) + step, e[b], e[b]])
        by = np.argsort(p, kind="stable")
        p, e = p[by], e[by]
    return np.concatenate(whole_p), np.concatenate(whole_e), left


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def _blocks(dims: int, parts: int):
    """mapInArrow: vectors as blocks, each part position with its tree."""
    width = dims // parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims).astype(np.int64)
                out = {c: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c)) for c in CARRIED}
                for k in range(parts):
                    points = v[:, k * width : (k + 1) * width]
                    order = sort_points(points, LEAF)
                    points = points[order]
                    _, start, end = _ranges(len(points), LEAF)
                    low, high = boxes(points, start)
                    total = np.vstack([np.zeros((1, width), np.int64), np.cumsum(points, axis=0)])
                    held = [order.astype(np.int32), points.astype(np.int32), low.astype(np.int32), high.astype(np.int32), total[end] - total[start]]
                    out[f"part{k}"] = pa.array([b"".join(x.tobytes() for x in held)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return pack


def _unpack(raw: bytes, n: int, width: int) -> tuple[Tree, np.ndarray]:
    """(tree, sums of its nodes) of a block's part position."""
    _, start, _ = _ranges(n, LEAF)
    shapes, at, held = [(n,), (n, width), (len(start), width), (len(start), width)], 0, []
    for shape in shapes:
        held.append(np.frombuffer(raw, np.int32, int(np.prod(shape)), at).reshape(shape).astype(np.int64))
        at += 4 * int(np.prod(shape))
    order, points, low, high = held
    return tree(points, order, LEAF, low, high), np.frombuffer(raw, np.int64, offset=at).reshape(len(start), width)


def _trees(books: np.ndarray) -> list[Tree]:
    orders = [sort_points(b, 1) for b in books]
    return [tree(b[o], o, 1) for b, o in zip(books, orders, strict=True)]


def _round(books: np.ndarray):
    """mapInArrow: a row an entry of a part position with the number and sum of the parts assigned to it in the task."""
    positions, entries, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, count, total = _trees(books), np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                for k in range(positions):
                    held, sums = _unpack(batch.column(f"part{k}")[row].as_buffer(), n, width)
                    node, entry, left = nearest(held, trees[k])
                    np.add.at(count[k], entry, held.end[node] - held.start[node])
                    np.add.at(total[k], entry, sums[node])
                    for leaf, open_ in left:
                        points = held.points[held.start[leaf] : held.end[leaf]]
                        to = open_[np.argmin(distances(points, books[k][open_]), axis=1)]
                        np.add.at(count[k], to, 1)
                        np.add.at(total[k], to, points)
        k, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(entry), pa.array(count[k, entry]), pa.array(list(total[k, entry]), pa.list_(pa.int64()))], ["k", "entry", "n", "sums"])

    return assign


def _codes(books: np.ndarray):
    """mapInArrow: every vector with its code and error."""
    positions, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                codes, error = np.zeros((n, positions), np.int64), np.zeros(n, np.int64)
                for k in range(positions):
                    held, _ = _unpack(batch.column(f"part{k}")[row].as_buffer(), n, width)
                    node, entry, left = nearest(held, trees[k])
                    by_place, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    size = held.end[node] - held.start[node]
                    at = np.repeat(held.start[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    by_place[at] = np.repeat(entry, size)
                    far[at] = ((held.points[at] - books[k][by_place[at]]) ** 2).sum(axis=1)
                    for leaf, open_ in left:
                        a, b = held.start[leaf], held.end[leaf]
                        d = distances(held.points[a:b], books[k][open_])
                        best = np.argmin(d, axis=1)
                        by_place[a:b], far[a:b] = open_[best], d[np.arange(b - a), best]
                    codes[held.order, k] = by_place
                    error[held.order] += far
                text = pa.array(["".join(f"{c:02x}" for c in code) for code in codes.tolist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[row].values for c in CARRIED), text, pa.array(error)], [*CARRIED, "code", "error"])

    return assign


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """A row per vector kept: vec_id, label, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components go. The number of components is that of the row with the
    smallest id (it must divide into the parts: an error otherwise); vectors of other lengths, and those with a component
    beyond LARGEST after scaling, stay as rows whose code and error are null, and shape no codebook. Rows that repeat an id
    each have a code; the first entries come from the smallest ids, ties by components, null ids last. Fewer rows than
    entries make smaller codebooks. No rows give no rows. A label's error is the sum over rows of equal labels (null one
    of them), null where none has a code. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col("x").isNotNull() & finite)
    fits = F.forall("x", lambda c: F.abs(c * scale) <= LARGEST)
    whole = kept.where(fits).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))
    lead = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dims = len(lead[0].v) if lead else 0
    if dims % parts:
        raise ValueError(f"{dims} components do not divide into {parts} parts")
    if not dims:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    whole = whole.where(F.size("v") == dims)
    start = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # a codebook's worth
    books = np.array([r.v for r in start], np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    kinds = dict(whole.dtypes)
    block = ", ".join([f"vec_id array<{kinds['vec_id']}>", f"label array<{kinds['label']}>", *(f"part{k} binary" for k in range(parts))])
    blocks = save(whole.mapInArrow(_blocks(dims, parts), block).withColumn("n", F.size("vec_id")), "code-blocks")
    width = dims // parts
    for _ in range(rounds):
        sums = blocks.select("n", *(f"part{k}" for k in range(parts))).mapInArrow(_round(books), "k long, entry long, n long, sums array<long>")
        added = sums.groupBy("k", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        books = books.copy()
        for r in added.collect():  # parts x entries rows at most
            books[r.k, r.entry] = np.array(r.sums, np.int64) // r.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = blocks.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    odd = kept.where(~fits | (F.size("x") != dims)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = save(coded.unionByName(odd), "codes")
    drop_saved(blocks)
    key = unused(coded, "label_key")
    sums = small(save(coded.groupBy(F.struct("label").alias(key)).agg(F.sum("error").alias("label_error")), "code-labels"))
    return coded.withColumn(key, F.struct("label")).join(sums, key).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
