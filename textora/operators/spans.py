"""Stretches of text: lines with their places, unions of finds, and what no find covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions import text as tx

#: Characters that a sentence around a find may have, and how many of them before the find.
SENTENCE, LEAD = 240, 80


def line_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, start, end, text): each line of a text with the offsets of its characters; a null text has none."""
    text = F.col("text")
    start = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    lines = F.split(text, "\n", -1)
    starts = F.aggregate(lines, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), start)["out"]
    each = docs.where(text.isNotNull()).select(key, F.posexplode(F.arrays_zip(lines.alias("text"), starts.alias("start"))).alias("line", "l"))
    return each.select(key, "line", F.col("l.start").alias("start"), (F.col("l.start") + F.length("l.text")).alias("end"), F.col("l.text").alias("text"))


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end): the union of the stretches [start, end) of each text; those that overlap or touch are one.

    Empty stretches and nulls cover nothing; null keys are a text like others.
    """
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("start < end").select(*keys, "start", "end").withColumn("_new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def uncovered(texts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end): the stretches of each text (key, text) that no span covers; spans may lie beyond a text's end.

    Keys that repeat are an error of the caller: a text is known by its key. Null and empty texts have no stretch.
    """
    sizes = texts.select(key, F.length("text").alias("_n")).where("_n > 0")
    edges = merged(spans, key).select(key, F.lit(1).alias("_side"), "start", "end").unionByName(sizes.select(key, F.lit(2).alias("_side"), F.col("_n").alias("start"), F.col("_n").alias("end")))
    by = Window.partitionBy(key)
    open_ = edges.withColumn("_n", F.max(F.when(F.col("_side") == 2, F.col("start"))).over(by)).withColumn("_from", F.coalesce(F.max("end").over(by.orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    to = F.least("start", "_n")
    return open_.where(F.col("_n").isNotNull() & (F.col("_from") < to)).select(key, F.col("_from").cast("long").alias("start"), to.cast("long").alias("end"))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of the sentence that holds [start, end): from the last end of a sentence before it to the first
    one at or after its end; longer ones are cut to SENTENCE characters, LEAD of them before the find."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    head = F.length(F.regexp_extract(before, r"(?s)^(.*(?:[.!?]\s+|\n))", 1))
    tail = F.length(F.regexp_extract(after, r"(?s)^(.*?(?:[.!?](?=\s|$)|(?=\n)|$))", 1))
    first, last = head, end + tail
    long = last - first > SENTENCE
    cut = F.greatest(first, start - LEAD)
    return F.struct(F.when(long, cut).otherwise(first).alias("start"), F.when(long, F.greatest(end, F.least(last, cut + SENTENCE))).otherwise(last).alias("end"))


def paragraphs_left(texts: DataFrame, spans: DataFrame, key: str = "doc_id", least: int = 1) -> DataFrame:
    """(key, start, end, text): what a classifier still has to see: uncovered stretches with at least so many letters."""
    left = uncovered(texts, spans, key).join(texts.select(key, F.col("text").alias("_t")), key)
    piece = F.substring(F.col("_t"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return left.select(key, "start", "end", piece.alias("text")).where(tx.count_of(F.col("text"), r"\p{L}") >= least)
