"""What documents cost to read by model, path and resolution, and the route of every page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import text as tx

#: Long edges of the resolutions at which pages are rendered.
RESOLUTIONS = {"low": 768, "medium": 1536, "high": 2048}


@dataclass(frozen=True)
class Model:
    """Prices in USD per million input tokens; formula: area, tiled, flat, or None for a model without vision."""

    name: str
    price: float
    formula: str | None = None
    batch: float | None = None
    ratio: float = 1.0


EXAMPLE_MODELS = (Model("plain", 0.5), Model("area", 3.0, "area", 1.5), Model("tiled", 2.5, "tiled", 1.25), Model("flat", 0.3, "flat"))


def rendered(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Pixels of a page whose long edge is `edge`; zero without a size."""
    longer = F.greatest(width, height)
    side = lambda s: F.when((width > 0) & (height > 0), F.bround(s / longer * edge)).otherwise(0)
    return side(width), side(height)


def fit(width: Column, height: Column, longest: float, shortest: float) -> tuple[Column, Column]:
    """Scaled down so that neither limit is exceeded."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height), shortest / F.least(width, height))
    return width * scale, height * scale


def vision_tokens(formula: Column, width: Column, height: Column) -> Column:
    """Tokens of an image: width * height / 750, 1600 at most; 85 and 170 a tile of 512; or 258 an image or tile of 384."""
    w, h = fit(width, height, 2000.0, 768.0)
    tiles = lambda a, b, px: F.ceil(a / px) * F.ceil(b / px)
    area = F.bround(F.least(width * height / 750.0, F.lit(1600.0)))
    flat = F.when((width <= 384) & (height <= 384), 258).otherwise(tiles(width, height, 384) * 258)
    value = F.when(formula == "area", area).when(formula == "tiled", 85 + tiles(w, h, 512) * 170).when(formula == "flat", flat)
    return F.when((width > 0) & (height > 0), value.cast("long")).when(formula.isNotNull(), F.lit(0).cast("long"))


def model_table(spark, models: tuple[Model, ...] = EXAMPLE_MODELS) -> DataFrame:
    """One row per model; the caller's list, so small."""
    return spark.createDataFrame([(m.name, m.price, m.formula, m.batch, m.ratio) for m in models], "model string, price double, formula string, batch double, ratio double")


def known(models: tuple[Model, ...], names: list[str]) -> tuple[Model, ...]:
    if missing := set(names) - {m.name for m in models}:
        raise ValueError(f"no such models: {', '.join(sorted(missing))}")
    return tuple(m for m in models if m.name in names)


def cube(pages: DataFrame, models: tuple[Model, ...] = EXAMPLE_MODELS, key: str = "doc_id") -> DataFrame:
    """key, model, path (text, or vision at a resolution), tokens, usd: a missing path is null, never 0.

    pages: key, text, width, height (a row per page). Pages are summed first; models join as literals of a few rows.
    """
    spark = pages.sparkSession
    sizes = [F.struct(F.lit(r).alias("resolution"), *(c.alias(n) for n, c in zip(("w", "h"), rendered(F.col("width"), F.col("height"), e), strict=True))) for r, e in RESOLUTIONS.items()]
    text = pages.groupBy(key).agg(F.sum(F.length(tx.empty_as(F.col("text")))).alias("chars"), F.max((F.trim(tx.empty_as(F.col("text"))) != "").cast("int")).alias("some"), F.max(((F.col("width") > 0) & (F.col("height") > 0)).cast("int")).alias("sized"))
    table = F.broadcast(model_table(spark, models))
    tokens = F.when(F.col("some") == 1, F.bround(F.bround(F.col("chars") / F.lit(4.0)) * F.col("ratio")).cast("long"))
    texts = text.join(table).select(key, "model", F.lit("text").alias("path"), tokens.alias("tokens"), "price")
    each = pages.select(key, F.explode(F.array(*sizes)).alias("s")).join(table).where(F.col("formula").isNotNull())
    seen = each.groupBy(key, "model", "price", F.concat(F.lit("vision_"), F.col("s.resolution")).alias("path")).agg(F.sum(vision_tokens(F.col("formula"), F.col("s.w"), F.col("s.h"))).alias("tokens"))
    seen = seen.join(text.select(key, "sized"), key).select(key, "model", "path", F.when(F.col("sized") == 1, F.col("tokens")).alias("tokens"), "price")
    return texts.unionByName(seen).select(key, "model", "path", "tokens", F.round(F.col("tokens") * F.col("price") / 1e6, 10).alias("usd"))


def cheapest(costs: DataFrame, key: str = "doc_id") -> DataFrame:
    """path kind (text, vision), documents that have it, and the sum of each document's cheapest model."""
    kind = F.when(F.col("path") == "text", "text").otherwise("vision")
    least = costs.groupBy(key, kind.alias("kind")).agg(F.min("usd").alias("usd"))
    return least.groupBy("kind").agg(F.count("usd").alias("documents"), F.round(F.sum(F.col("usd").cast("decimal(28,10)")), 6).cast("double").alias("usd"))


def architectures(costs: DataFrame, sources: DataFrame, key: str = "doc_id", volume: int = 1000) -> DataFrame:
    """model, architecture (text_layer, text_ocr, vision): served documents, usd, per 1000 and a year of `volume` a month.

    text_ocr counts every document with text, text_layer only those with a native layer. sources: key, native (boolean).
    """
    rows = costs.join(sources, key)
    text, high = F.col("path") == "text", F.col("path") == "vision_high"
    kinds = F.array_compact(F.array(F.when(text & F.col("native"), F.lit("text_layer")), F.when(text, F.lit("text_ocr")), F.when(high, F.lit("vision"))))
    each = rows.where(F.col("usd").isNotNull()).select(key, "model", "usd", F.explode(kinds).alias("architecture"))
    mean = F.avg(F.col("usd").cast("decimal(28,10)")).cast("double")
    return each.groupBy("model", "architecture").agg(F.count("*").alias("served"), F.round(F.sum(F.col("usd").cast("decimal(28,10)")), 6).cast("double").alias("usd"), F.round(mean * 1000, 6).alias("usd_per_1000"), F.round(mean * volume * 12, 4).alias("usd_a_year"))


def routes(pages: DataFrame, vision: bool = True) -> DataFrame:
    """pages with route and reason. pages: text, text_source; optional image_share, text_share, complex_table, dpi.

    A readable page goes as text unless its text is not text, a ruled table loses its structure, or the text is a
    caption of a picture; others go to a vision model, or to OCR where vision is off.
    """
    r = fixed.ROUTING
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in pages.columns else F.lit(d)
    text = tx.empty_as(F.col("text"))
    readable = F.col("text_source").isin("native", "loader") & (F.length(F.trim(text)) >= r["min_characters"])
    picture = has("image_share", 0.0) * 100 >= r["picture_share_pct"]
    caption = picture & (has("text_share", 1.0) * 100 < r["min_text_coverage_pct"])
    rules = [("unmapped characters", tx.control_share(text) * 100 > r["max_control_char_pct"]), ("not words", tx.sensible_share(text) * 100 < r["min_wordlike_pct"]), ("complex table", has("complex_table", False)), ("caption", caption)]
    other = F.lit("vision" if vision else "ocr")
    reason = F.when(~readable, F.when(picture, "scan").otherwise("no usable text"))
    if vision:
        for name, holds in rules:
            reason = reason.when(holds, name)
    reason = reason.otherwise("text layer")
    return pages.withColumn("reason", reason).withColumn("route", F.when(F.col("reason") == "text layer", "text").otherwise(other))


def route_summary(routed: DataFrame, key: str = "doc_id") -> DataFrame:
    """route, pages on it, documents whose dearest route it is."""
    rank = F.when(F.col("route") == "text", 1).when(F.col("route") == "ocr", 2).otherwise(3)
    pages = routed.groupBy("route").agg(F.count("*").alias("pages"))
    dearest = routed.groupBy(key).agg(F.max(rank).alias("r")).groupBy("r").agg(F.count("*").alias("documents"))
    dearest = dearest.select(F.when(F.col("r") == 1, "text").when(F.col("r") == 2, "ocr").otherwise("vision").alias("route"), "documents")
    return pages.join(dearest, "route", "full").select("route", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("documents", F.lit(0)).alias("documents"))
