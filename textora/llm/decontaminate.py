"""Benchmark decontamination: short test items found inside long documents by MinHash containment.

A document may be a thousand times as long as an item, so their Jaccard similarity says nothing and banding would need
thousands of hashes. Containment is searched from the small side instead: items are parted into size classes, and the
MinHash sketch of an item is its m least shingle hashes, with m set by its class so that a document that holds the
threshold share of the item's shingles must hold one of the m (more than n - ceil(t * n) of n are looked up; the others
cannot all be the missing ones). So the search loses no pair. Pairs found are verified by exact shingle containment.
Only DataFrame functions. What is broadcast is the sketch, within a checked number of rows; beyond it the join shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm._common import let, save, small

SHINGLE = 5
THRESHOLD = 0.8
#: Item shingles (about 50 bytes each) up to which items are broadcast for verification.
ITEM_SHINGLES = 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty string can stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _shingles(text: Column, make, width: int) -> Column:
    """make(words of a shingle) at every place of a text; empty for fewer words than a shingle has."""
    at = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make(*[F.get(w, i + k) for k in range(width)]))
    return let(words(text), lambda w: F.when(F.size(w) >= width, at(w)).otherwise(F.array()))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _text(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key")]


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_found, containment) of every pair with containment >= threshold.

    Words are lower-cased runs of letters and digits; shingles are sets of five consecutive words. An item of fewer words
    is one shingle, and found where its words stand in that order. Items without words match nothing; null texts count as
    empty. Repeated document rows give one row; items with equal ids are told apart by their texts. text_key is xxhash64
    of the document's text, so rows without an id are told apart.
    """
    own = items.select(F.col(item_id).alias("item_id"), _plain(F.col(item_text)).alias("plain")).where("plain <> ''")
    own = own.withColumn("width", F.least(F.lit(SHINGLE), F.size(F.split("plain", " "))))
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())  # five at most
    each = [_contained(docs, own.where(F.col("width") == w).drop("width"), threshold, id_col, text_col, w) for w in widths or [SHINGLE]]
    return reduce(DataFrame.union, each)


def _contained(docs: DataFrame, items: DataFrame, threshold: float, id_col: str, text_col: str, width: int) -> DataFrame:
    """contained() for items (item_id, plain) whose shingles have that many words."""
    inside = items.select("item_id", "plain", F.array_distinct(_shingles(F.col("plain"), _text, width)).alias("shingles")).distinct()
    inside = save(inside.select("item_id", F.xxhash64("plain").alias("item_key"), "shingles"), "items")
    sized = items.select("plain").distinct().select(F.xxhash64("plain").alias("item_key"), F.sort_array(F.array_distinct(_shingles(F.col("plain"), F.xxhash64, width))).alias("hashes"))
    upper = F.pow(2.0, F.floor(F.log2(F.size("hashes").cast("double"))) + 1) - 1  # greatest size of the class
    length = F.least(F.size("hashes"), (F.floor(F.lit(1 - threshold + 1e-9) * upper) + 1).cast("int"))
    sketch = small(save(sized.select("item_key", F.explode(F.slice("hashes", 1, length)).alias("h")), "sketch"))

    places = docs.select(*_key(id_col, text_col), F.explode(_shingles(F.col(text_col), F.xxhash64, width)).alias("h"))
    pairs = save(places.join(sketch, "h").select("doc_id", "text_key", "item_key").distinct(), "suspects")

    total = inside.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    inside = F.broadcast(inside) if total <= ITEM_SHINGLES else inside
    p = small(pairs).alias("p")
    d = docs.select(*_key(id_col, text_col), F.col(text_col).alias("body")).alias("d")
    both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))).select("d.doc_id", "d.text_key", "body", "item_key").join(inside, "item_key")
    n = F.size("shingles")
    found = both.select("doc_id", "text_key", "item_id", n.cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", _shingles(F.col("body"), _text, width))).cast("long").alias("n_found"))
    return found.distinct().where(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)).withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item."""
    hit = small(save(contained(docs, items, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_key").distinct(), "leaks")).alias("h")
    d = docs.alias("d")
    return d.join(hit, F.col(f"d.{id_col}").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("h.text_key")), "left_anti")
