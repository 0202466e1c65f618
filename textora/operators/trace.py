"""Trees of spans: depth, root, all ancestors and a span's own time, by joins whose number grows with the log of depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.functions.shared import checkpointed

#: Doublings after which a tree has a cycle: no chain is as long as 2^ROUNDS.
ROUNDS = 40


def depths(spans: DataFrame) -> DataFrame:
    """(span, root, depth) of spans (span, parent): steps up to the outermost span.

    Each span points to its parent; in every round it points to where that one points, so a chain of n ends in log n
    rounds, with a row a span. A parent that is not in the table, or null, makes its span a root. A cycle is an error.
    """
    known = spans.select(F.col("span").alias("parent")).distinct().withColumn("_known", F.lit(True))
    at = spans.select("span", "parent").join(known, "parent", "left").select("span", F.when(F.col("_known"), F.col("parent")).alias("up"))
    now = checkpointed(at.select("span", F.coalesce("up", "span").alias("to"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNull().alias("done")))
    for _ in range(ROUNDS):
        if now.where("not done").isEmpty():
            return now.select("span", F.col("to").alias("root"), "depth")
        upper = now.select(F.col("span").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        both = now.where("not done").join(upper, "to").select("span", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        now = checkpointed(now.where("done").unionByName(both))
    raise ValueError("spans are their own ancestors")


def ancestors(spans: DataFrame) -> DataFrame:
    """(span, ancestor, distance) for every ancestor in the table, distance 1 being the parent: paths that double in length.

    The result has as many rows as the depths of all spans together.
    """
    steps = spans.select("span", F.col("parent").alias("ancestor")).where("parent is not null")
    steps = steps.join(spans.select(F.col("span").alias("ancestor")).distinct(), "ancestor").select("span", "ancestor", F.lit(1).cast("long").alias("distance"))
    all_, reach = checkpointed(steps), 1
    for _ in range(ROUNDS):
        last = all_.where(F.col("distance") == reach).select("span", F.col("ancestor").alias("_via"))
        upper = all_.select(F.col("span").alias("_via"), "ancestor", F.col("distance").alias("_d"))
        more = checkpointed(last.join(upper, "_via").select("span", "ancestor", (F.col("_d") + reach).alias("distance")))
        if more.isEmpty():
            return all_
        if not more.where("span = ancestor").isEmpty():
            break
        all_, reach = all_.unionByName(more), 2 * reach
    raise ValueError("spans are their own ancestors")


def own_time(spans: DataFrame) -> DataFrame:
    """(span, seconds, inside, own): a span's seconds, those of its children, and the rest; null seconds count as none."""
    n = lambda c: F.coalesce(c, F.lit(0))
    inner = spans.where("parent is not null").groupBy(F.col("parent").alias("span")).agg(F.sum(n(F.col("seconds"))).alias("inside"))
    return spans.select("span", n(F.col("seconds")).alias("seconds")).join(inner, "span", "left").select("span", "seconds", n(F.col("inside")).alias("inside"), (F.col("seconds") - n(F.col("inside"))).alias("own"))
