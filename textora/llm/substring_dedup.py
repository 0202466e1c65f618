"""Substring dedup: windows of consecutive words that occur more than once, counted exactly over super-k-mers.

Each window of `window` words has a minimiser, the least hash of its runs of `run` words; consecutive windows with one
minimiser make a super-k-mer. Equal windows have equal minimisers, so
1. one pass over the texts finds super-k-mers (as positions) and their minimisers; a minimiser seen once in the whole
   corpus has no repeated window, and most super-k-mers end here, before any text has travelled;
2. of the others the words travel as one packed string to the bucket of their minimiser; a minimiser with more than HOT
   super-k-mers sends its windows one by one instead, which are grouped by their words and counted together on the way,
   so no bucket grows with a frequent passage;
3. in its bucket every window of the packed strings is sorted, and equal neighbours are counted by their exact words;
4. what is repeated goes back to the texts as positions, and the words it covers are left out.
Texts that are equal byte for byte are worked on once, with their number as weight.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, save, small
from textora.llm.wordhash import Words, words

WINDOW = 35
RUN = 8
#: Super-k-mers of one minimiser beyond which its windows travel one by one.
HOT = 4096
#: Listed super-k-mers (16 bytes each in a broadcast, so 128 MB) up to which the lists are broadcast; beyond it texts are shuffled to them.
LISTED = 8_000_000


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _joined(w: Words, t: int, keep: np.ndarray | None = None) -> bytes:
    """Words of text t (those marked in keep) joined by one space."""
    lo, hi = w.bounds[t], w.bounds[t + 1]
    raw = w.raw[w.begin[t] : w.begin[t + 1]].tobytes().split()
    return b" ".join(raw if keep is None else [x for x, k in zip(raw, keep[lo:hi], strict=True) if k])


def _super_kmers(w: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of every super-k-mer of a chunk, in order.

    The leftmost of equal runs counts, so a text that repeats itself within one window ends its super-k-mer at each.
    """
    m = len(w.value) - window + 1
    none = np.empty(0, np.int64)
    if m <= 0:
        return none, none, none
    bits = np.uint64(28)  # of the place in the chunk: the same everywhere, so that ties of the other bits go to the leftmost everywhere
    value = np.zeros(len(w.value), np.uint64)
    at, h = w.runs(run)
    value[at] = h
    packed = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64)
    span, least, step = window - run + 1, packed, 1
    while step * 2 <= span:  # minima over spans that double, then over the exact span
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: m], least[span - step : span - step + m])
    whole = np.repeat(w.bounds[1:], np.diff(w.bounds))[:m] >= np.arange(m) + window
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | (place[1:] != place[:-1])
    return value[place[first]].view(np.int64), first, np.flatnonzero(stop) + 1 - first


def _survey(window: int, run: int):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("text")):
                mins, first, size = _super_kmers(w, window, run)
                own = np.searchsorted(w.bounds, first, side="right") - 1
                cut = np.searchsorted(own, np.arange(w.n + 1)).astype(np.int32)
                rel = (first - w.bounds[own]).astype(np.int32)
                lists = lambda a, t, cut=cut: pa.ListArray.from_arrays(pa.array(cut), pa.array(a, t))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(w.first, w.n), "digest": b.column("digest").slice(w.first, w.n), "n_words": pa.array(np.diff(w.bounds), pa.int64()),
                    "whole_sha256": pa.array([_sha(_joined(w, t)) for t in range(w.n)]), "mins": lists(mins, pa.int64()), "starts": lists(rel, pa.int32()), "sizes": lists(size, pa.int32()),
                })

    return survey


def _pack(window: int):
    """Packed strings of the listed super-k-mers; of hot ones (their sizes are negative) each window by itself, without a bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            for text, text_id, weight, mins, starts, sizes in zip(*(b.column(c).to_pylist() for c in ("text", "text_id", "weight", "mins", "starts", "sizes")), strict=True):
                split = (text or "").encode().split()
                for least, lo, n in zip(mins, starts, sizes, strict=True):
                    parts = [(lo, n)] if n > 0 else [(lo + i, 1) for i in range(-n)]
                    for start, many in parts:
                        out["packed"].append(b" ".join(split[start : start + many + window - 1]))
                        out["bucket"].append(least if n > 0 else None)
                        out["text_id"].append(text_id)
                        out["start"].append(start)
                        out["weight"].append(weight)
                if len(out["start"]) >= 20_000:
                    yield _batch(out)
                    out = defaultdict(list)
            yield _batch(out)

    return pack


PACKED = "bucket long, packed binary, text_id long, start int, weight long"


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "packed": pa.binary(), "text_id": pa.int64(), "start": pa.int32(), "weight": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})


def _count(window: int):
    """Per packed string that has any: the numbers of its windows that occur twice or more in its bucket."""

    def repeated(strings: list[bytes], weights: list[int]) -> Iterator[tuple[bytes, list[int]]]:
        rows = []
        for s, (packed, weight) in enumerate(zip(strings, weights, strict=True)):
            split = packed.split()
            rows += [(split[i : i + window], s, i, weight) for i in range(len(split) - window + 1)]
        rows.sort(key=lambda r: r[0])
        hits: dict[int, list[int]] = defaultdict(list)
        i = 0
        while i < len(rows):
            j, total = i, 0
            while j < len(rows) and rows[j][0] == rows[i][0]:
                total += rows[j][3]
                j += 1
            if total > 1:
                for r in rows[i:j]:
                    hits[r[1]].append(r[2])
            i = j
        for s, at in hits.items():
            yield strings[s], sorted(at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, defaultdict(int)
        out_key, out_at = [], []

        def close() -> None:
            if len(held) > 1 or any(weight > 1 or packed.count(b" ") >= window for packed, weight in held.items()):
                for packed, at in repeated(list(held), list(held.values())):
                    out_key.append(hashlib.md5(packed).digest())
                    out_at.append(at)

        flush = lambda: pa.RecordBatch.from_pydict({"packed_key": pa.array(out_key, pa.binary()), "at": pa.array(out_at, pa.list_(pa.int32()))})
        for b in batches:
            for k, packed, weight in zip(*(b.column(c).to_pylist() for c in ("bucket", "packed", "weight")), strict=True):
                if k != bucket:
                    close()
                    bucket, held = k, defaultdict(int)
                held[packed] += weight
            if len(out_key) >= 5_000:
                yield flush()
                out_key, out_at = [], []
        close()
        yield flush()

    return count


def _cut(window: int):
    """Texts less the words covered by repeated windows: text_id, n_removed, kept (the rest, joined by one space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, removed, kept = [], [], []
            for text, text_id, starts in zip(*(b.column(c).to_pylist() for c in ("text", "text_id", "starts")), strict=True):
                split = (text or "").encode().split()
                change = np.zeros(len(split) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, np.asarray(starts) + window, -1)
                covered = np.cumsum(change[:-1]) > 0
                ids.append(text_id)
                removed.append(int(covered.sum()))
                kept.append(b" ".join(x for x, c in zip(split, covered, strict=True) if not c).decode())
            yield pa.RecordBatch.from_pydict({"text_id": pa.array(ids, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return cut


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, found).

    rows: doc_id, digest, n_words, whole_sha256 per row of docs. texts: text_id, digest, weight per distinct text.
    found: text_id, starts (of all repeated windows) for texts with weight 1 that have any.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    given = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.col(text_col).alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    survey = save(given.mapInArrow(_survey(window, run), f"doc_id {kind}, digest binary, n_words long, whole_sha256 string, mins array<long>, starts array<int>, sizes array<int>"), "windows")
    lists = F.any_value(F.struct("mins", "starts", "sizes")).alias("s")
    texts = survey.where(F.col("n_words") >= window).groupBy("digest").agg(F.count("*").alias("weight"), F.min("doc_id").alias("one"), F.any_value("n_words").alias("n_words"), lists)
    texts = save(texts.withColumn("text_id", F.monotonically_increasing_id()), "window-texts")
    rows = save(survey.drop("mins", "starts", "sizes"), "window-rows")
    drop_saved(survey)
    each = texts.select("text_id", "weight", F.explode(F.arrays_zip("s.mins", "s.starts", "s.sizes")).alias("k"))
    each = each.select("text_id", "weight", F.col("k.mins").alias("min"), F.col("k.starts").alias("start"), F.col("k.sizes").alias("size"))
    seen = each.groupBy("min").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").select("min", (F.col("rows") > HOT).alias("hot"))
    seen = save(seen, "window-mins")  # read again, it joins as a table of its own and Spark can split the rows of a frequent minimiser
    found = each.join(seen, "min").select("text_id", F.struct("min", "start", F.when(F.col("hot"), -F.col("size")).otherwise(F.col("size")).alias("size")).alias("f"))
    shared = found.groupBy("text_id").agg(F.collect_list("f").alias("f")).select("text_id", *(F.col(f"f.{a}").alias(b) for a, b in (("min", "mins"), ("start", "starts"), ("size", "sizes"))))
    shared = save(shared.join(texts.select("text_id", "digest", "weight", "one"), "text_id"), "window-shared")
    many = shared.agg(F.coalesce(F.sum(F.size("mins")), F.lit(0))).first()[0]
    listed = F.broadcast(shared) if many <= LISTED else shared
    # of a text with copies the rows of its smallest id go on: every window of it is repeated, so how many they are does not count
    body = given.join(listed, "digest").where((F.col("weight") == 1) | F.col("doc_id").eqNullSafe(F.col("one")))
    body = save(body.select("text_id", "text", "weight", "mins", "starts", "sizes"), "window-bodies")
    packed = save(body.mapInArrow(_pack(window), PACKED), "packed")
    key = F.unhex(F.md5("packed")).alias("packed_key")
    cold = packed.where("bucket is not null").select("bucket", "packed", "weight").repartition("bucket").sortWithinPartitions("bucket")
    hot = packed.where("bucket is null").groupBy("packed").agg(F.sum("weight").alias("n")).where("n > 1").select(key, F.array(F.lit(0)).alias("at"))
    hits = cold.mapInArrow(_count(window), "packed_key binary, at array<int>").unionByName(hot).groupBy("packed_key").agg(F.flatten(F.collect_set("at")).alias("at"))
    hits = save(hits, "window-hits")  # so that the join can split the rows of a frequent string
    where = packed.where("weight = 1").select(key, "text_id", "start")
    found = where.join(small(hits), "packed_key").select("text_id", F.explode(F.transform("at", lambda a: a + F.col("start"))).alias("start"))
    found = save(found.groupBy("text_id").agg(F.collect_list("start").alias("starts")), "window-found")
    cut = save(body.where("weight = 1").select("text_id", "text").join(found, "text_id").mapInArrow(_cut(window), "text_id long, n_removed long, kept string"), "window-cut")
    for used in (packed, body, shared, seen, found, hits):
        drop_saved(used)
    return rows, texts.select("text_id", "digest", "weight", "n_words"), cut


def dedup_substrings(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (null: all words stay).

    A word goes if any window of `window` words that covers it starts in a second place too, in the same or another row.
    All copies go; windows are judged on the input. Null text has no words; texts of fewer words than a window lose none.
    Repeated rows are rows of their own, and so remove each other's windows. Other columns are not looked at.
    """
    rows, texts, cut = repeated_windows(docs, window, run, id_col, text_col)
    known = texts.join(cut, "text_id", "left")
    gone = F.when(F.col("weight") > 1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    known = known.select("digest", gone.cast("long").alias("n_removed"), F.when(F.col("weight") > 1, F.lit("")).otherwise(F.col("kept")).alias("kept")).where("n_removed > 0")
    known = known.select("digest", "n_removed", "kept", F.sha2("kept", 256).alias("kept_sha256"))
    out = rows.join(known, "digest", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
