"""Expected facts: texts, values and absences, looked for in each reading of a document.

A fact is found exactly where its plain form stands in a page, nearly where a window of about as many words is almost the
same (near.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import near

NEARLY = near.NEARLY
#: Numbers in any grouping; the group is a space, a point, a comma or an apostrophe.
NUMBER = r"(?<![\d.,])(?:\d{1,3}([   .,'’])\d{3}(?:\1\d{3})*(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?!\d)"


def plain(c: Column) -> Column:
    return F.lower(tx.squeezed(c))


def readings(token: Column) -> Column:
    """The numbers that a token can be read as: 1,234 in two ways, 78.500,00 in one; empty where it is no number.

    A group of three digits after a point or comma is thousands, or a fraction if it is the only group; any other last
    point or comma begins a fraction; spaces and apostrophes only group.
    """
    number = lambda c: c.try_cast("decimal(28,6)")
    bare = F.regexp_replace(token, r"[   '’]", "")
    digits = F.regexp_replace(bare, r"[.,]", "")
    tail = F.regexp_extract(bare, r"[.,](\d+)$", 1)
    marks = F.length(bare) - F.length(digits)
    kinds = (bare.contains(",")).cast("int") + (bare.contains(".")).cast("int")
    grouped = bare.rlike(r"^\d{1,3}(?:[.,]\d{3})+$") & (kinds == 1)
    whole, part = number(digits), number(F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(tail)), F.lit("."), tail))
    spaced = F.length(bare) < F.length(token)
    both = F.when(marks == 0, F.array(whole)).when(grouped & (marks > 1), F.array(whole)).when(grouped & ~spaced, F.array(whole, part)).when((tail != "") & ((marks == 1) | (kinds == 2)), F.array(part)).otherwise(F.array(whole).cast("array<decimal(28,6)>"))
    return F.when(token.rlike(rf"^(?:{NUMBER})$"), F.array_compact(both)).otherwise(F.array().cast("array<decimal(28,6)>"))


def numbers_in(c: Column) -> Column:
    """array<struct<token, values>> of every number in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 0), lambda t: F.struct(t.alias("token"), readings(t).alias("values")))


def near_texts(pages: DataFrame, facts: DataFrame, key: str = "doc_id", least: float = NEARLY) -> DataFrame:
    """(fact, key, score) of the facts (fact, text) that stand in pages (key, text) exactly or nearly, as near_scores() finds them."""
    return near.near_scores(pages, facts, key, least).select("fact", key, "score")


def values_found(pages: DataFrame, facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fact, key): pages (key, text) that hold a number which can be read as the fact's value (fact, value), in any grouping.

    Values and numbers meet by what they can be read as, an equality join.
    """
    each = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(numbers_in(c), lambda x: x["values"])))).alias("value")
    want = facts.select("fact", F.explode(F.get(numbers_in(F.col("value")), 0)["values"]).alias("value"))
    return pages.select(key, each(tx.empty_as(F.col("text")))).join(want, "value").select("fact", key).distinct()


def results(facts: DataFrame, found: DataFrame, readers: DataFrame) -> DataFrame:
    """(fact, reader, kind, passed): a text or value passes where it was found in a reading, an absence where it was not.

    facts: fact, kind (text, value, absent); found: fact, reader; readers: reader, the loaders compared. A null reader is a
    reader like others. The result has a row for each fact and reader, so the two tables are crossed.
    """
    hit = found.select("fact", "reader").distinct().withColumn("hit", F.lit(True)).alias("h")
    both = facts.select("fact", "kind").crossJoin(readers.select("reader").distinct()).alias("b")
    same = (F.col("b.fact") == F.col("h.fact")) & F.col("b.reader").eqNullSafe(F.col("h.reader"))
    return both.join(hit, same, "left").select("b.fact", "b.reader", "b.kind", (F.coalesce("hit", F.lit(False)) != (F.col("b.kind") == "absent")).alias("passed"))


def scores(checked: DataFrame) -> DataFrame:
    """(reader, kind, passed, facts, share) of results(): how many facts of each kind a reader passes."""
    out = checked.groupBy("reader", "kind").agg(F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count("*").alias("facts"))
    return out.withColumn("share", F.bround(F.col("passed") / F.col("facts"), 4))
