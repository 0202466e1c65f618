"""Summaries that are kept per batch and merged later: distinct counts and quantiles without a second look at the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct count (error about 1.04 / sqrt(2^n)), and the size parameter of quantiles.
REGISTERS, LEVELS = 12, 200


def sketched(rows: DataFrame, *keys: str, distinct: str, number: str) -> DataFrame:
    """(keys, n, people, sizes): per group its rows, a sketch of the distinct values of one column and of the quantiles of another.

    Nulls are left out of sketches; a group without values has null sketches.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(REGISTERS)).alias("people"), F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(LEVELS)).alias("sizes"))


def merged(batches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of several batches as one per group; batches are those of sketched(), with further columns if need be."""
    return batches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("sizes").alias("sizes"))


def read_off(held: DataFrame, *keys: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(keys, n, distinct, q50, q95, ...) of sketches."""
    named = [F.kll_sketch_get_quantile_double("sizes", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles]
    return held.select(*keys, "n", F.hll_sketch_estimate("people").alias("distinct"), *named)
