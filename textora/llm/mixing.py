"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often the mix takes it on average. Of all rates that meet each source's token target and
stay below a limit, those with the least relative entropy to one copy each are exponentially tilted: the rate of a
document of size n in source s is min(limit, exp(lambda_s * n / mean size of s)). The multipliers lambda solve the convex
dual, found by Newton steps: each is one distributed sum of gradient and curvature over strata (documents of one source
and size have one rate, so their counts suffice), guarded by a bracket. Rates become copies by cumulative rounding over
the strata of a source, with the remaining words made up stratum by stratum; within a stratum the copies beyond the common
number go to the documents with the least hashes. All is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textora.llm._common import WORD, drop_saved, save, small

LIMIT = 3.0
TOLERANCE = 1e-7
ROUNDS = 80
REPAIRS = 4
#: Rows a hash cell is meant to hold at most; cells split the ranking of equal documents over tasks.
CELL_ROWS = 1_000_000


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source):
    """A key by which sources sort by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def capped_targets(sources: DataFrame, limit: float = LIMIT) -> DataFrame:
    """sources (key, source_size, weight) with target: shares of all words by weight, none above limit * source_size.

    What a source cannot take is shared among the others by weight again, until none is above. That fixed point gives
    every source min(limit * size, theta * weight) for one theta, which is read off the sources in order of
    limit * size / weight by running sums: one row per source goes through this window.
    """
    order = Window.orderBy(F.col("ratio"), F.col("key"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    rows = sources.withColumn("top", limit * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    rows = rows.withColumns({"total": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole), "full": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # theta if exactly the sources before this one are full; the first source whose own ratio exceeds it is the first free one
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone")))
    theta = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(whole)["level"]
    return rows.withColumn("theta", theta).select("key", "source_size", F.least("top", F.col("theta") * F.col("weight")).alias("target"))


def _solve(strata: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """sources (key, source_size, target) with lam, the multiplier; null where every document takes the limit."""
    mean = strata.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    free = F.col("target") < limit * F.col("source_size") * (1 - 1e-12)
    start = sources.join(mean, "key").withColumns({"lam": F.when(free, F.lit(0.0)), "lo": F.lit(-1e9), "hi": F.lit(1e9), "off": F.when(free & (F.col("target") > 0), F.lit(1.0)).otherwise(0.0)})
    state = save(start, "mix-state")
    for _ in range(ROUNDS):
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
        open_ = state.where(F.col("off") > TOLERANCE)
        tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
        mass = F.col("n") * F.col("size")
        sums = strata.join(small(open_), "key").groupBy("key").agg(F.sum(mass * F.least(tilt, F.lit(limit))).alias("g"), F.sum(F.when(tilt < limit, mass * F.col("size") / F.col("mean") * tilt).otherwise(0.0)).alias("h"))
        at = state.join(sums, "key", "left")
        lo, hi = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("g") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        at = at.withColumns({"lo": F.when(F.col("g").isNull(), F.col("lo")).otherwise(lo), "hi": F.when(F.col("g").isNull(), F.col("hi")).otherwise(hi)})
        # Newton on log g = log target: the dual's gradient and curvature, on a scale where distant starts converge
        step = F.col("lam") + F.try_divide(F.log(F.try_divide(F.col("target"), F.col("g"))) * F.col("g"), F.col("h"))
        inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
        at = at.withColumns({"off": F.when(F.col("g").isNull(), F.col("off")).otherwise(F.abs(F.col("g") - F.col("target")) / F.col("target"))})
        narrow = (F.col("hi") - F.col("lo")) <= 1e-13 * F.abs(F.col("lo"))
        at = at.withColumns({"lam": F.when(F.col("g").isNull() | (F.col("off") <= TOLERANCE), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2), "off": F.when(narrow, 0.0).otherwise(F.col("off"))})
        after = save(at.select(state.columns), "mix-state")
        drop_saved(state)
        state = after
    if (off := state.agg(F.max("off")).first()[0] or 0.0) > TOLERANCE:
        raise RuntimeError(f"a source is {off:.2g} of its target away after {ROUNDS} Newton steps")
    return state


def _rounded(strata: DataFrame, solved: DataFrame, limit: float) -> DataFrame:
    """strata with copies, the whole number of copies that its n documents take together."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))
    rate = F.when(F.col("target") <= 0, F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.least(tilt, F.lit(limit)), F.lit(limit)))
    rated = strata.join(small(solved), "key").withColumn("rate", rate)
    upto = Window.partitionBy("key").orderBy("size")
    cum = F.sum(F.col("n") * F.col("rate")).over(upto)
    rated = rated.withColumn("cum", F.round(cum)).withColumn("copies", (F.col("cum") - F.coalesce(F.lag("cum").over(upto), F.lit(0.0))).cast("long"))
    rated = rated.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), (F.lit(int(limit)) * F.col("n")))))
    now = save(rated.select("key", "size", "n", "rate", "copies", "target", "source_size"), "mix-copies")
    for _ in range(REPAIRS):
        taken = now.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
        both = now.join(small(taken), "key")
        room = F.when(F.col("rest") > 0, F.lit(int(limit)) * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (room > 0)
        pick = both.where(fits).groupBy("key").agg(F.max("size").alias("pick"))
        both = both.join(pick, "key", "left")
        more = F.when(F.col("size") == F.col("pick"), F.least(room, F.floor(F.abs("rest") / F.col("size"))) * F.signum("rest")).otherwise(0).cast("long")
        after = save(both.select("key", "size", "n", "rate", (F.col("copies") + more).alias("copies"), "target", "source_size"), "mix-copies")
        drop_saved(now)
        now = after
    return now


def mix(docs: DataFrame, weights, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies, taken (copies * size).

    weights: a function of the sources, a DataFrame (key, source_size) with keys of source_key(), that adds a column
    weight (positive). Null text has size 0; null is a source of its own. Documents without words take one copy and no
    word; a source without words has target 0. No document takes more than limit copies. An empty table gives no rows.
    Repeated rows each get their own copies. Other columns are not looked at.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), size_of(F.col(text_col)).alias("size"), h.alias("h")), "mix-rows")
    cells = 1 << max(6, (rows.count() // CELL_ROWS).bit_length())
    rows = rows.withColumn("cell", F.pmod("h", F.lit(cells)))
    counts = save(rows.groupBy("key", "size", "cell").agg(F.count("*").alias("n")), "mix-cells")
    strata = save(counts.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-strata")
    sources = strata.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = _solve(strata, save(capped_targets(weights(sources), limit), "mix-targets"), limit)
    copies = _rounded(strata, solved, limit)
    whole = F.floor(F.col("copies") / F.col("n"))
    copies = copies.select("key", "size", "rate", "target", "source_size", whole.alias("whole"), (F.col("copies") - whole * F.col("n")).alias("extra"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = counts.withColumn("before", before).join(copies, ["key", "size"]).select("key", "size", "cell", "rate", "target", "source_size", "whole", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("extra"))
    dealt = save(dealt, "mix-dealt")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "cell").orderBy("h", "doc_id")))
    out = ranked.join(dealt, ["key", "size", "cell"]).withColumn("copies", (F.col("whole") + (F.col("rank") <= F.col("extra")).cast("long")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def cycling_weights(cycle: tuple[float, ...] = (1.0, 2.0, 3.0)):
    """Weights 1, 2, 3, 1, 2, 3 ... along the sources by code point, null last."""

    def add(sources: DataFrame) -> DataFrame:
        place = (F.row_number().over(Window.orderBy("key")) - 1) % len(cycle)
        return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place + 1).cast("int")))

    return add
