"""Comparing readings of the same documents: by several loaders, and one report with an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions import text as tx


def presence(found: DataFrame, readings: DataFrame, keys: tuple[str, ...] = ("doc_id", "category", "masked")) -> DataFrame:
    """keys, found_by, missed_by (sorted) of what some loader holds and another that returned the document misses.

    found: loader and keys. readings: loader, doc_id.
    """
    have = found.select("loader", *keys).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("loader")).alias("found_by"))
    all_ = readings.select("doc_id", "loader").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_set("loader")).alias("loaders"))
    both = have.join(all_, "doc_id").withColumn("missed_by", F.array_except("loaders", "found_by"))
    return both.where(F.size("missed_by") > 0).select(*keys, "found_by", "missed_by")


def uneven_keys(metadata: DataFrame) -> DataFrame:
    """Metadata keys, whatever their case, that not all loaders give. metadata: loader, key."""
    loaders = metadata.agg(F.countDistinct("loader").alias("_n"))
    each = metadata.groupBy(F.lower("key").alias("key")).agg(F.countDistinct("loader").alias("loaders"))
    return each.join(F.broadcast(loaders)).where(F.col("loaders") < F.col("_n")).select("key", "loaders")


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, similarity, reordered): the worst page's likeness; a page that one side lacks counts as empty. a, b: doc_id, page, text."""
    both = a.select("doc_id", "page", F.col("text").alias("x")).join(b.select("doc_id", "page", F.col("text").alias("y")), ["doc_id", "page"], "full")
    score = both.select("doc_id", tx.readings_compared(tx.empty_as(F.col("x")), tx.empty_as(F.col("y"))).alias("r")).select("doc_id", "r.*")
    return score.groupBy("doc_id").agg(F.min("similarity").alias("similarity"), (F.bool_and("same_words") & (F.min("similarity") < 1.0)).alias("reordered"))


def coverage(a: Column, b: Column) -> Column:
    """Share of the words of a, with repeats, that b holds too."""
    bag = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    times = lambda w, t: F.size(F.filter(bag(t), lambda x: x == w))
    shared = F.aggregate(F.array_distinct(bag(a)), F.lit(0), lambda n, w: n + F.least(times(w, a), times(w, b)))
    return F.round(shared / F.greatest(F.lit(1), F.size(bag(a))), 4)


def loader_rows(readings: DataFrame, found: DataFrame, failures: DataFrame) -> DataFrame:
    """loader, documents, pages, characters, seconds, identifiers, failures. readings: loader, doc_id, page, text, seconds."""
    base = readings.groupBy("loader").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.sum(F.length(tx.empty_as(F.col("text")))).alias("characters"), F.round(F.sum("seconds"), 6).alias("seconds"))
    n = found.groupBy("loader").agg(F.count("*").alias("identifiers"))
    bad = failures.groupBy("loader").agg(F.count("*").alias("failures"))
    return base.join(n, "loader", "full").join(bad, "loader", "full").na.fill(0)


def ranking(rows: DataFrame) -> DataFrame:
    """loader, place, ahead_of: fewest failures, then most documents, most identifiers kept, then quickest, then name."""
    by = Window.orderBy("failures", F.desc("documents"), F.desc("identifiers"), "seconds", "loader")  # a row per loader
    return rows.select("loader", F.row_number().over(by).alias("place"), F.lead("loader").over(by).alias("ahead_of"))


def disagreement(chars_a: Column, chars_b: Column, alike: Column) -> Column:
    """reordered words aside: differ in amount (over 10 %), in words (below 0.95 alike), or agree."""
    gap = F.abs(chars_a - chars_b) / F.greatest(chars_a, chars_b, F.lit(1))
    return F.when(gap > 0.10, "amount").when(alike < 0.95, "words").otherwise("agree")


def documents_changed(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, change: added or removed."""
    gone = before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("removed"))
    new = after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def counted(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """keys, delta of what occurs more or less often than before, as multisets; null keys are one key.

    One grouped sum over both tables, +1 for a row after and -1 for one before, needs no join.
    """
    both = before.select(*keys, F.lit(-1).alias("_n")).unionByName(after.select(*keys, F.lit(1).alias("_n")))
    return both.groupBy(*keys).agg(F.sum("_n").alias("delta")).where("delta <> 0")


def scores_changed(before: DataFrame, after: DataFrame, key: str = "doc_id", column: str = "score", least: float = 0.5) -> DataFrame:
    """key, before, after, direction of scores that moved by `least` at least, in documents of both reports."""
    both = before.select(key, F.col(column).alias("before")).join(after.select(key, F.col(column).alias("after")), key)
    return both.where(F.abs(F.col("after") - F.col("before")) >= least).withColumn("direction", F.when(F.col("after") < F.col("before"), "worse").otherwise("better"))


def ratings_changed(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id", "signal")) -> DataFrame:
    both = before.select(*keys, F.col("rating").alias("before")).join(after.select(*keys, F.col("rating").alias("after")), list(keys))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def new_limitations(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("limitation").distinct().join(before.select("limitation").distinct(), "limitation", "left_anti")


def benchmark_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """category, labelled, hit, missed, wrong, recall, precision. Both: id, category, start, end.

    As in the reference, each find in turn, by where it starts, claims the first label of its text and category that it
    overlaps and that is not claimed yet.
    """
    spans = lambda df: df.groupBy("id", "category").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    both = spans(expected).withColumnRenamed("spans", "labels").join(spans(found).withColumnRenamed("spans", "finds"), ["id", "category"])

    def claim(taken: Column, find: Column) -> Column:
        free = lambda label, i: (find["start"] < label["end"]) & (label["start"] < find["end"]) & ~F.array_contains(taken, i)
        at = F.transform("labels", lambda label, i: F.when(free(label, i), i))
        return F.concat(taken, F.slice(F.filter(at, lambda i: i.isNotNull()), 1, 1))

    claimed = both.select("category", F.size(F.aggregate("finds", F.array().cast("array<int>"), claim)).alias("hit"))
    rows = [expected.groupBy("category").agg(F.count("*").alias("labelled")), claimed.groupBy("category").agg(F.sum("hit").alias("hit")), found.groupBy("category").agg(F.count("*").alias("reported"))]
    out = rows[0].join(rows[1], "category", "full").join(rows[2], "category", "full").na.fill(0)
    share = lambda n, d: F.bround(F.try_divide(n * 100.0, d), 1)
    return out.select("category", "labelled", "hit", (F.col("labelled") - F.col("hit")).alias("missed"), (F.col("reported") - F.col("hit")).alias("wrong"), share(F.col("hit"), F.col("labelled")).alias("recall"), share(F.col("hit"), F.col("reported")).alias("precision"))


def confusion(predicted: DataFrame, labels: DataFrame, key: str = "doc_id", flag: str = "flag", label: str = "label") -> DataFrame:
    """One row: tp, fp, fn, tn over documents with a label; no prediction counts as no flag."""
    both = labels.select(key, (F.col(label) == 1).alias("_y")).join(predicted.select(key, F.col(flag).cast("boolean").alias("_p")), key, "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    n = lambda p, y, name: F.count(F.when((F.col("_p") == p) & (F.col("_y") == y), 1)).alias(name)
    return both.agg(n(True, True, "tp"), n(True, False, "fp"), n(False, True, "fn"), n(False, False, "tn"))
