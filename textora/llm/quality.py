"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise interactions of all
features, of low rank, in time linear in the features of a document (the sum-of-squares identity). It is fitted by Adam on
a bounded sample of labelled rows (MAX_ROWS, those with the least hashes of their ids, so the same in every rerun) and
scores every whole text in Arrow batches; what the tasks get is the fitted table of 2^HASH_BITS * (RANK + 1) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm.wordhash import words

HASH_BITS = 14
RANK = 8
MAX_ROWS = 8_000
EPOCHS = 6
BATCH = 128
RATE = 0.02
DECAY = 1e-5
THRESHOLD = 0.7
#: Names of the dense features, in order; "told_chars" is metadata, what the table says of a text's length.
DENSE = ("words", "word_length", "upper", "digit", "symbol", "stop", "comma", "wide", "line_words", "distinct", "top_word", "repeats", "told_chars", "told_gap")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in b"#$%&*+<=>@^_`{|}~\\/!"]] = True
_RANGE = lambda lo, hi: np.isin(np.arange(256), np.arange(lo, hi + 1))
_CLASSES = (_RANGE(65, 90), _RANGE(48, 57), _SYMBOLS, np.isin(np.arange(256), [46, 63]), np.isin(np.arange(256), [44, 59, 58]), _RANGE(128, 255), np.isin(np.arange(256), [10]))


@dataclass
class Features:
    """Sparse rows (row bounds, feature numbers, values) and dense rows of a batch."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def featurise(texts: pa.Array, told: pa.Array | None = None) -> Iterator[Features]:
    """Features of whole texts, chunk by chunk; null texts count as empty, unknown lengths as zero."""
    size = 1 << HASH_BITS
    for w in words(texts):
        n = w.n
        length = np.diff(w.begin).astype(float)
        ends = np.cumsum
        per = []
        for c in _CLASSES:
            total = np.concatenate([[0], ends(c[w.raw], dtype=np.int64)])
            per.append(np.diff(total[w.begin]))
        upper, digit, symbol, stop, comma, wide, line = per
        count = np.diff(w.bounds)
        spelled = np.concatenate([[0], np.cumsum(w.end - w.start)])
        letters = np.diff(spelled[w.bounds])
        owner = w.owner
        key = (owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (w.value >> np.uint64(64 - HASH_BITS))
        held, times = np.unique(key, return_counts=True)
        row = (held >> np.uint64(HASH_BITS)).astype(np.int64)
        index = (held & np.uint64(size - 1)).astype(np.int32)
        bounds = np.searchsorted(row, np.arange(n + 1))
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(row, value**2, n))
        value = value / np.maximum(norm, 1e-9)[row]
        again = np.zeros(len(w.value), bool)
        again[1:] = (w.value[1:] == w.value[:-1]) & (owner[1:] == owner[:-1])
        top = np.zeros(n)
        np.maximum.at(top, row, times)
        c, b = np.maximum(count, 1), np.maximum(length, 1)
        if told is None:
            said = np.zeros(n)
        else:
            said = np.array([x or 0 for x in told.slice(w.first, n).to_pylist()], float)
        dense = np.stack([
            np.log1p(count), letters / c, upper / b, digit / b, symbol / b, stop / c, comma / c, wide / b, np.log1p(count / (line + 1)), np.diff(bounds) / c,
            top / c, np.bincount(owner, again, n) / c, np.log1p(said), np.where(said > 0, np.log1p(length) - np.log1p(said), 0.0),
        ], axis=1)
        yield Features(bounds, index, value.astype(np.float32), dense)


@dataclass
class Machine:
    """A fitted machine: bias, linear weights, factors (hashed words first, then dense features), mean and scale of the dense ones."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row bounds, feature numbers, values) of words and dense features together."""
        n, d = f.dense.shape
        x = np.clip((f.dense - self.mean) / self.scale, -6, 6) / np.sqrt(d)
        index = np.insert(f.index, np.repeat(f.bounds[1:], d), np.tile(np.arange(d, dtype=np.int32) + (1 << HASH_BITS), n))
        value = np.insert(f.value, np.repeat(f.bounds[1:], d), x.ravel())
        return f.bounds + np.arange(n + 1) * d, index, value

    def forward(self, bounds, index, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margin, sum_i v_if x_i per row, v_if x_i per entry)."""
        entry = self.v[index] * value[:, None]
        total = np.add.reduceat(entry, bounds[:-1], axis=0)
        square = np.add.reduceat((entry**2).sum(1), bounds[:-1])
        return self.w0 + np.add.reduceat(self.w[index] * value, bounds[:-1]) + 0.5 * ((total**2).sum(1) - square), total, entry

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(*self.inputs(f))[0], -35, 35))) if len(f.dense) else np.empty(0)


def fit(rows: list[Features], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam over logistic loss; classes weigh alike, so that a rare class is learned too. Without both classes: a constant."""
    rng = np.random.default_rng(seed)
    dense = np.concatenate([r.dense for r in rows]) if rows else np.zeros((0, len(DENSE)))
    size, d = 1 << HASH_BITS, len(DENSE)
    mean, scale = (dense.mean(0), dense.std(0) + 1e-6) if len(dense) else (np.zeros(d), np.ones(d))
    m = Machine(0.0, np.zeros(size + d), rng.normal(0, 0.05, (size + d, RANK)), mean, scale)
    rate = labels.mean() if len(labels) else 1.0
    if rate in (0.0, 1.0):
        m.w0, m.v[:] = (9.0 if rate else -9.0), 0
        return m
    flat = [m.inputs(r) for r in rows]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for b, _, _ in flat]))])
    index, value = np.concatenate([i for _, i, _ in flat]), np.concatenate([x for _, _, x in flat])
    weight = np.where(labels > 0, 0.5 / rate, 0.5 / (1 - rate))
    slopes = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in (("w", m.w), ("v", m.v))}
    b1, b2, t, g0 = 0.9, 0.999, 0, [0.0, 0.0]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick, t = order[at : at + BATCH], t + 1
            spans = np.diff(bounds)[pick]
            took = np.repeat(bounds[pick] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            own, i, x = np.concatenate([[0], np.cumsum(spans)]), index[took], value[took]
            margin, total, entry = m.forward(own, i, x)
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[pick]) * weight[pick] / len(pick)
            each = np.repeat(error, spans)
            hit, place = np.unique(i, return_inverse=True)
            gw = np.bincount(place, each * x) + DECAY * m.w[hit]
            slope = (np.repeat(total, spans, axis=0) - entry) * (each * x)[:, None]
            gv = np.stack([np.bincount(place, slope[:, k]) for k in range(RANK)], 1) + DECAY * m.v[hit]
            step = RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - b2**t) / (1 - b1**t)
            for k, a, g in (("w", m.w, gw), ("v", m.v, gv)):
                s1, s2 = slopes[k]
                s1[hit], s2[hit] = b1 * s1[hit] + (1 - b1) * g, b2 * s2[hit] + (1 - b2) * g**2
                a[hit] -= step * s1[hit] / (np.sqrt(s2[hit]) + 1e-8)
            g0 = [b1 * g0[0] + (1 - b1) * error.sum(), b2 * g0[1] + (1 - b2) * error.sum() ** 2]
            m.w0 -= step * g0[0] / (np.sqrt(g0[1]) + 1e-8)
    return m


def is_held_out(id_col: Column) -> Column:
    """Rows that no fit sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", told_col: str | None = "n_chars", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted on at most max_rows labelled rows that are not held out.

    Only ids and labels are sorted to draw the sample; the texts of its rows, a bounded number, are featurised by tasks and
    their features gathered. Rows without a label or an id are not drawn; of several labels of an id the greatest counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").where(~is_held_out(F.col("id")))
    drawn = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    told = F.col(told_col).cast("double") if told_col else F.lit(None).cast("double")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), told.alias("told")).join(F.broadcast(drawn), "id")
    sample = sample.groupBy("id").agg(F.min(F.struct("text", "told", "label")).alias("r")).select("id", "r.*")  # a repeated id counts once

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for f in featurise(b.column("text"), b.column("told")):
                n = len(f.dense)
                cut = lambda a, f=f: pa.array([a[x:y].tobytes() for x, y in zip(f.bounds, f.bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_pydict({"id": b.column("id").slice(done, n), "label": b.column("label").slice(done, n).cast(pa.float64()), "index": cut(f.index), "value": cut(f.value), "dense": pa.array([x.tobytes() for x in f.dense], pa.binary())})
                done += n

    got = sample.mapInArrow(features, f"id {dict(sample.dtypes)['id']}, label double, index binary, value binary, dense binary").toArrow().sort_by("id")
    joined = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in got[c]), kind)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(got["index"]).to_numpy() // 4)]).astype(np.int64)
    rows = Features(bounds, joined("index", np.int32), joined("value", np.float32), joined("dense", np.float64).reshape(-1, len(DENSE)))
    return fit([rows] if len(bounds) > 1 else [], (got["label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", told_col: str | None = "n_chars", into: str = "quality_score") -> DataFrame:
    """docs with a column `into`, between 0 and 1, for every row; null text counts as empty, a null length as unknown."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(text: pa.Array, told: pa.Array) -> pa.Array:
        at = [held.value.score(f) for f in featurise(text.cast(pa.large_string()), told)]
        return pa.array(np.concatenate(at) if at else np.empty(0), pa.float64())

    told = F.col(told_col).cast("double") if told_col else F.lit(None).cast("double")
    return docs.withColumn(into, scored(F.col(text_col), told))
