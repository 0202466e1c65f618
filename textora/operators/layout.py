"""Readiness signals from tables of pages, page tables and fonts: plain aggregates, in the form of text_signals().

Each function gives (doc_id, signal, value, status); a value is null, and the status not_applicable, where a document has
nothing to measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.operators import spans

#: How a bare text is set: lines of a page, points of a character, points of a page.
LINES, CHAR, PAGE = 60, (6.0, 12.0), (612.0, 720.0)


def _rows(out: DataFrame, measured: dict[str, Column]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("value")) for k, v in measured.items()])).alias("s")
    return out.select("doc_id", pairs).select("doc_id", "s.*").withColumn("status", F.when(F.col("value").isNull(), "not_applicable").otherwise("measured"))


def page_signals(pages: DataFrame) -> DataFrame:
    """From pages (doc_id, width, height, rotation, text_share, image_share, confidence, dpi): coverage, rotation, sizes, scans.

    Shares are fractions of the page. Rotation is the greatest, in degrees below 360; recognition and resolution are those
    of the worst page; sizes are told apart in whole points; resolution counts only pages that are mostly picture.
    """
    mean = lambda c: F.bround(F.avg(F.col(c).cast("decimal(18,6)")).cast("double") * 100, 2)
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct(F.bround("width").alias("w"), F.bround("height").alias("h")))
    out = pages.groupBy("doc_id").agg(
        mean("text_share").alias("text"), mean("image_share").alias("image"), F.max(F.abs("rotation") % 360).alias("rotation"), F.bround(F.min("confidence") * 100, 2).alias("confidence"),
        F.min(F.when(F.col("image_share") >= 0.5, F.col("dpi"))).alias("dpi"), F.countDistinct(size).alias("sizes"),
    )
    sizes = F.when(F.col("sizes") > 0, F.col("sizes"))
    return _rows(out, {"text_layer_coverage_pct": F.col("text"), "image_area_ratio_pct": F.col("image"), "page_rotation": F.col("rotation"), "ocr_confidence": F.col("confidence"), "scan_dpi": F.col("dpi"), "page_size_variance": sizes})


def table_signals(tables: DataFrame) -> DataFrame:
    """From ruled tables (doc_id, intact, compared, header_depth, merged): rows kept of those compared, deepest header, merged cells."""
    out = tables.groupBy("doc_id").agg(F.sum("intact").alias("intact"), F.sum("compared").alias("compared"), F.max("header_depth").alias("depth"), F.sum("merged").alias("merged"))
    return _rows(out, {"table_fidelity": F.bround(F.try_divide(F.col("intact"), F.col("compared")) * 100, 2), "table_max_header_depth": F.col("depth"), "table_merged_cells": F.col("merged")})


def font_signals(fonts: DataFrame) -> DataFrame:
    """From fonts of pages (doc_id, font, embedded): distinct fonts, and whether all that are known about are embedded."""
    out = fonts.groupBy("doc_id").agg(F.countDistinct("font").alias("fonts"), F.bool_and("embedded").alias("embedded"))
    return _rows(out, {"font_count": F.col("fonts"), "fonts_embedded": F.col("embedded").cast("double")})


def file_signals(files: DataFrame) -> DataFrame:
    """From files (doc_id, encrypted, form_fields): both as they are."""
    return _rows(files, {"encrypted": F.col("encrypted").cast("double"), "acroform_fields": F.col("form_fields")})


def estimated_dpi(pixels: Column, points: Column) -> Column:
    """Dots per inch of a picture of that many pixels across a span of that many points; null without a span."""
    return F.bround(F.try_divide(pixels, points / 72.0))


def gutters(left: Column, right: Column, width: float, bins: int = 200, share: float = 0.035) -> Column:
    """Aggregate over the words of a page (left and right edges): empty vertical strips of at least `share` of its width
    between words, plus one: how many columns of text stand side by side; null for pages of fewer than 25 words.

    Every bin that a word touches is marked; stretches of unmarked bins inside the text are counted.
    """
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(c / width * bins))).cast("int")
    touched = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(at(left), F.greatest(at(left), at(right)))))))
    wide = F.filter(F.transform(F.sequence(F.lit(1), F.size(touched) - 1), lambda i: F.get(touched, i) - F.get(touched, i - 1) - 1), lambda gap: gap >= share * bins)
    return F.when(F.count(left) >= 25, F.when(F.size(touched) > 1, F.size(wide) + 1).otherwise(1))


def covered_area(boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys, area): the area of the union of boxes (keys, x0, y0, x1, y1) of each page, each place counted once.

    The page is swept from edge to edge downwards: between two neighbouring edges the boxes that are there cover a set of
    stretches, whose union is a running greatest end. Empty boxes and nulls cover nothing; null keys are a page like others.
    """
    real = boxes.where("x0 < x1 and y0 < y1").select(*keys, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    edges = real.select(*keys, F.explode(F.array("y0", "y1")).alias("top")).distinct()
    bands = edges.withColumn("bottom", F.lead("top").over(Window.partitionBy(*keys).orderBy("top"))).where("bottom is not null").alias("e")
    same = [F.col(f"b.`{k}`").eqNullSafe(F.col(f"e.`{k}`")) for k in keys]
    inside = reduce(lambda a, b: a & b, [*same, F.col("b.y0") <= F.col("e.top"), F.col("b.y1") >= F.col("e.bottom")])
    there = real.alias("b").join(bands, inside).select(*(F.col(f"b.`{k}`") for k in keys), "top", "bottom", "x0", "x1")
    by = Window.partitionBy(*keys, "top").orderBy("x0", "x1")
    reached = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("x1") - F.greatest("x0", F.coalesce(reached, F.col("x0"))))
    return there.withColumn("_area", fresh * (F.col("bottom") - F.col("top"))).groupBy(*keys).agg(F.sum("_area").alias("area"))


def text_boxes(docs: DataFrame, key: str = "doc_id", lines: int = LINES, width: float = CHAR[0], height: float = CHAR[1]) -> DataFrame:
    """(key, page, x0, y0, x1, y1): where the lines of a text stand when set in characters of one size, so many to a page."""
    at = F.col("line") % lines
    lead = F.length(F.regexp_extract("text", r"^(\s*)", 1))
    each = spans.line_spans(docs, key).where(F.trim("text") != "")
    return each.select(key, F.floor(F.col("line") / lines).cast("int").alias("page"), (lead * width).alias("x0"), (at * height).alias("y0"), (F.length(F.rtrim("text")) * width).alias("x1"), ((at + 1) * height).alias("y1"))


def set_pages(docs: DataFrame, key: str = "doc_id", page_width: float = PAGE[0], lines: int = LINES) -> DataFrame:
    """Pages for page_signals() of texts set as text_boxes() says: the share of each page that text covers; lines are cut at
    its edge. A text of blank lines has pages that nothing covers; null texts have none."""
    edge = lambda c: F.least(F.lit(page_width), F.col(c))
    area = covered_area(text_boxes(docs, key, lines).withColumns({"x0": edge("x0"), "x1": edge("x1")}), key, "page")
    pages = docs.where(F.col("text").isNotNull()).select(key, F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n", -1)) - 1) / lines).cast("int"))).alias("page")).alias("p")
    height = lines * CHAR[1]
    both = pages.join(area.alias("a"), F.col(f"p.`{key}`").eqNullSafe(F.col(f"a.`{key}`")) & (F.col("p.page") == F.col("a.page")), "left")
    none = F.lit(None).cast("double")
    return both.select(F.col(f"p.`{key}`").alias(key), "p.page", F.lit(page_width).alias("width"), F.lit(height).alias("height"), F.lit(0).alias("rotation"), (F.coalesce("area", F.lit(0.0)) / (page_width * height)).alias("text_share"), none.alias("image_share"), none.alias("confidence"), none.alias("dpi"))
