"""As-of join: the last row of another table at or before a row's time, without a sort of one key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textora.functions.shared import checkpointed


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, values: tuple[str, ...]) -> DataFrame:
    """rows with the values of the last of facts (key, at, values) of the same key at or before their time, else null.

    Both tables are laid in ranges of key and time. Within a range the last fact before each row is carried along; what a
    range begins with is the last fact of its key in the ranges before, a row a range and key. Of facts of one time the one
    with the greatest values counts; null keys and times meet nothing. Rows keep their number; values replace columns of
    their name.
    """
    kept = [c for c in rows.columns if c not in values]
    held = F.struct(*(F.col(v) for v in values))
    left = rows.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"), F.lit(None).cast(facts.select(held.alias("h")).schema["h"].dataType).alias("_fact"))
    right = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), held.alias("_fact"))
    ranged = checkpointed(left.unionByName(right).repartitionByRange("_k", "_at", "_side").withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", "_k").orderBy("_at", "_side", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.where("_side = 0").groupBy("_range", "_k").agg(F.max(F.struct("_at", "_fact")).alias("_end"))
    starts = ranged.select("_range", "_k").distinct().join(ends, ["_range", "_k"], "left")
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = starts.select("_range", "_k", F.last("_end", ignorenulls=True).over(before).alias("_start")).where("_start is not null")
    carried = ranged.withColumn("_own", F.last("_fact", ignorenulls=True).over(own)).where("_side = 1").join(starts, ["_range", "_k"], "left")
    met = F.when(F.col("_k").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_own", "_start._fact"))
    return carried.select("_row.*", met.alias("_met")).select(*kept, *(F.col(f"_met.`{v}`").alias(v) for v in values))
