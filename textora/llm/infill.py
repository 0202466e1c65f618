"""Fill-in-the-middle texts, cut at unit boundaries that a learned rank index finds.

The boundaries of a text (its begin and the end of every unit) grow with their rank, so that few straight segments come
near them: each segment is grown as long as one slope keeps all its boundaries within an error bound, and what a segment
misses by is stored as a small residual a boundary. A cut at rank k is the prediction of k's segment plus the residual of
k, which is exact whatever the text. Python only fits the index; cuts, output and restoration are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm._common import let, unused

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a prediction may lie off, in code points, before rounding.
ERROR = 64
INDEX = "struct<n:long,chars:long,first:array<long>,at:array<long>,slope:array<double>,residual:array<short>>"


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Offsets in code points of the begin of a text (UTF-8 bytes) and of the end of every line; an empty text has one."""
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    ends = np.concatenate([[0], ends])
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return lead[ends]


def segments(y: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[float]]:
    """(first rank, offset there, slope) of segments, each as long as a slope through its first boundary keeps within error.

    A segment is tried over stretches that double in length: running bounds of the slope show where it must end.
    """
    first, at, slope, k, n = [], [], [], 0, len(y)
    while k < n:
        low, high, end, span = 0.0, np.inf, k + 1, 16
        while end < n:
            x = np.arange(end, min(end + span, n))
            rise, run = y[x] - y[k], x - k
            lows, highs = np.maximum.accumulate(np.maximum((rise - error) / run, low)), np.minimum.accumulate(np.minimum((rise + error) / run, high))
            bad = np.flatnonzero(lows > highs)
            good = int(bad[0]) if len(bad) else len(x)
            if good:
                low, high, end = float(lows[good - 1]), float(highs[good - 1]), end + good
            if len(bad):
                break
            span *= 2
        first.append(k)
        at.append(int(y[k]))
        slope.append((low + high) / 2 if end > k + 1 else 0.0)
        k = end
    return first, at, slope


def predicted(first: np.ndarray, at: np.ndarray, slope: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """As the column expression of cut_at() predicts."""
    s = np.searchsorted(first, rank, side="right") - 1
    return at[s] + np.floor(slope[s] * (rank - first[s]).astype(np.float64)).astype(np.int64)


def rank_index(text: Column, error: int = ERROR) -> Column:
    """The index of the line boundaries of a text (null: empty): its lines, code points, segments and residuals."""

    @F.arrow_udf(INDEX)
    def fit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("chars", pa.int64()), ("first", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("slope", pa.list_(pa.float64())), ("residual", pa.list_(pa.int16()))])
        for batch in texts:
            made = []
            for t in batch:
                body = t.as_buffer() if t.is_valid else None
                y = boundaries(np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8))
                first, at, slope = segments(y, error)
                off = y - predicted(np.array(first), np.array(at), np.array(slope), np.arange(len(y)))
                made.append({"n": len(y) - 1, "chars": int(y[-1]), "first": first, "at": at, "slope": slope, "residual": off.astype(np.int16)})
            yield pa.array(made, kind)

    return fit(text)


def cut_at(index: Column, rank: Column) -> Column:
    """The offset of a boundary: what its segment predicts, corrected by its residual."""
    segment = F.size(F.filter(index["first"], lambda f: f <= rank)) - 1
    line = index["at"][segment] + F.floor(index["slope"][segment] * (rank - index["first"][segment]).cast("double"))
    return line + F.element_at(index["residual"], (rank + 1).cast("int"))


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, error: int = ERROR) -> DataFrame:
    """Every row of docs with n, form, prefix_chars, middle_chars and output, and its rank index; other columns stay.

    Forms: plain (the text as it is) where the text is empty, holds a mark, or is not drawn (rate in 100); else spm (spm
    in 100) or psm. Draws depend on seed and id alone, so rows that repeat an id cut alike by their own lines; a null id
    draws as an empty one. Null text is empty, with 0 lines. Names that docs has already are replaced by the new columns.
    """
    raw, index, digest, cuts = (unused(docs, c) for c in ("fim_text", "fim_index", "fim_digest", "fim_cuts"))
    body, at, h = F.col(raw), F.col(index), F.col(digest)
    made = docs.withColumn(raw, F.coalesce(F.col(text), F.lit(""))).withColumn(index, rank_index(body, error))
    made = made.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = F.when((body == "") | marked | (_draw(h, 2) % 100 >= rate), "plain").when(_draw(h, 3) % 100 < spm, "spm").otherwise("psm")
    one, two = _draw(h, 0) % (at["n"] + 1), _draw(h, 1) % (at["n"] + 1)
    made = made.withColumn(cuts, F.struct(form.alias("form"), cut_at(at, F.least(one, two)).alias("a"), cut_at(at, F.greatest(one, two)).alias("b")))
    kind, a, b = (F.col(cuts)[c] for c in ("form", "a", "b"))
    part = lambda start, end: body.substr((start + 1).cast("int"), (end - start).cast("int"))
    prefix = F.concat(F.lit(PREFIX), part(F.lit(0), a))
    suffix = F.concat(F.lit(SUFFIX), part(b, at["chars"]))
    middle = F.concat(F.lit(MIDDLE), part(a, b))
    output = F.when(kind == "plain", body).when(kind == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    apart = kind != "plain"
    new = {"n": at["n"], "form": kind, "prefix_chars": F.when(apart, a), "middle_chars": F.when(apart, b - a), "output": output, "rank_index": at}
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in new]
    return made.select(*kept, *(v.alias(k) for k, v in new.items()))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: a text with marks in it is plain, so that the marks of an output are its own."""
    whole = let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    return F.when(form == "plain", output).otherwise(whole)
