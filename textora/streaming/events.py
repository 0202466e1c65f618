"""Streams: the stateless operators run on them unchanged; windows and duplicates need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None, at: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """hour, kind, n, seconds per window, which slides if asked to; on a stream, whose times become timestamps with a zone, rows later than
    `late` are left out, on a table none."""
    source = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if rows.isStreaming else rows
    total = F.round(F.sum(F.col(value).cast("decimal(18,4)")).cast("double"), 4)
    return source.groupBy(F.window(at, width, slide).alias("w"), kind).agg(F.count("*").alias("n"), total.alias("seconds")).select(F.col("w.start").alias("hour"), kind, "n", "seconds")


def sessions(rows: DataFrame, *keys: str, gap: str = "30 minutes", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """(keys, started, ended, n): rows of a key no further apart than the gap; a session ends a gap after its last row."""
    source = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if rows.isStreaming else rows
    found = source.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def met(stages: DataFrame, runs: DataFrame, key: str = "run", within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Stages (run, ts, ...) with the run (run, started, ...) they belong to, begun at most so long before; on streams both
    sides are kept only while a partner can still come."""
    left, right = (d.withColumn(c, F.col(c).cast("timestamp")).withWatermark(c, late) if d.isStreaming else d for d, c in ((stages, "ts"), (runs, "started")))
    named = right.withColumnRenamed(key, "_run")
    return left.join(named, (F.col(key) == F.col("_run")) & (F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("started") + F.expr(f"INTERVAL {within}"))).drop("_run")


def first_seen(rows: DataFrame, *keys: str, at: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state older than that is given up."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def append_tables(stream: DataFrame, make: dict[str, Callable[[DataFrame], DataFrame]], target: str, checkpoint: str):
    """Each batch of documents, through each function, to its own folder of Parquet; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        for name, f in make.items():
            f(batch).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
