"""Roll-ups of a whole audit: the folder in one row, counts by kind, timings, routed cost, formats, stage warnings.

Every function takes tables with a row per document, page, finding or stage item and is one or two grouped aggregates;
what is not grouped is a single row and combined on the way. Sums of money and seconds are taken as decimals, so that
they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import costs, readiness

#: Sizes of a folder for which its seconds are projected.
PROJECTED = (100, 1_000, 10_000, 100_000)
#: Garbled characters per 1,000 from which text is poor, and tokens that embedding models read of a text.
GARBLED = 5.0
EMBEDDING_LIMITS = {"text-embedding-3-small": 8191, "text-embedding-3-large": 8191, "text-embedding-ada-002": 8191}


def _exact(c: Column) -> Column:
    return c.cast("decimal(28,6)")


def folder(documents: DataFrame) -> DataFrame:
    """One row for documents (doc_id, pages, unreadable, score, identifiers, findings): totals, means and bands.

    Null counts are 0; documents without a score count in no mean and no band. No documents: zeros and a null mean.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    label = readiness.band(F.col("score"))
    bands = [F.count(F.when(label == k, 1)).alias(k.replace(" ", "_")) for k in ("ready", "workable", "needs work", "not ready")]
    return documents.agg(
        F.count("*").alias("documents"), n("pages").alias("pages"), n("unreadable").alias("unreadable"), F.bround(F.avg(_exact(F.col("score"))).cast("double"), 1).alias("mean_score"), *bands,
        n("identifiers").alias("identifiers"), F.count(F.when(F.col("identifiers") > 0, 1)).alias("with_identifiers"), n("findings").alias("findings"), F.count(F.when(F.col("findings") > 0, 1)).alias("with_findings"),
    )


def tally(found: DataFrame, *kinds: str, key: str = "doc_id") -> DataFrame:
    """kinds, findings, documents: how many findings of each combination, and in how many documents; nulls are a kind."""
    return found.groupBy(*kinds).agg(F.count("*").alias("findings"), F.countDistinct(key).alias("documents"))


def content_matrix(found: DataFrame, rows: str = "instruction", columns: str = "visibility", values: tuple[str, ...] = ("visible", "hidden", "smuggled")) -> DataFrame:
    """rows, and a column of counts for each of values: findings by instruction and visibility."""
    return found.groupBy(rows).agg(*[F.count(F.when(F.col(columns) == v, 1)).alias(v) for v in values])


def timings(rows: DataFrame, key: str = "doc_id", seconds: str = "seconds", pages: str = "pages") -> DataFrame:
    """One row for rows (document, seconds, pages): totals, seconds per document and page, hours per 1,000 documents.

    Rows without seconds were not measured and count in no mean; pages count all the same.
    """
    total, n = F.sum(_exact(F.col(seconds))).cast("double"), F.count(seconds)
    out = rows.agg(total.alias("total"), n.alias("measured"), F.sum(pages).alias("pages"))
    mean = F.try_divide(F.col("total"), F.col("measured"))
    return out.select(
        "measured", F.bround("total", 3).alias("total_seconds"), F.bround(mean, 3).alias("seconds_per_document"),
        F.bround(F.try_divide(F.col("total"), F.col("pages")), 3).alias("seconds_per_page"), F.bround(mean * 1000 / 3600, 2).alias("hours_per_1000"), mean.alias("mean"),
    )


def projected(summary: DataFrame, sizes: tuple[int, ...] = PROJECTED) -> DataFrame:
    """(documents, seconds): what folders of these sizes would take at the mean of timings()."""
    return summary.select(F.explode(F.array(*map(F.lit, sizes))).alias("documents"), "mean").select("documents", F.bround(F.col("mean") * F.col("documents"), 1).alias("seconds"))


def extractor_totals(readings: DataFrame) -> DataFrame:
    """Per document and extractor of readings (doc_id, extractor, chars, seconds, coverage, similarity, reordered): sums,
    the mean coverage, the least similarity, and whether all pages were reordered."""
    return readings.groupBy("doc_id", "extractor").agg(
        F.sum("chars").alias("chars"), F.bround(F.sum(_exact(F.col("seconds"))).cast("double"), 3).alias("seconds"), F.bround(F.avg(_exact(F.col("coverage"))).cast("double"), 4).alias("coverage"),
        F.min("similarity").alias("similarity"), F.bool_and("reordered").alias("reordered"),
    )


def routed_costs(routed: DataFrame, model: costs.Model, resolution: str = "high", key: str = "doc_id") -> DataFrame:
    """(key, usd): what each document costs if every page takes its route; null where a page for a vision model cannot be priced.

    routed: key, text, width, height, route, a row per page. A page read as text bears its share, by characters, of the
    tokens of its whole document; a page read by a vision model those of its picture.
    """
    w, h = costs.rendered(F.col("width"), F.col("height"), costs.RESOLUTIONS[resolution])
    seen = F.when((w > 0) & (h > 0), costs.vision_tokens(F.lit(model.formula).cast("string"), w, h))
    chars = F.length(tx.empty_as(F.col("text")))
    page = routed.select(key, chars.alias("chars"), (F.col("route") == "vision").alias("vision"), seen.cast("double").alias("seen"))
    out = page.groupBy(key).agg(
        F.sum("chars").alias("chars"), F.sum(F.when(~F.col("vision"), F.col("chars"))).alias("read"), F.sum(F.when(F.col("vision"), F.col("seen"))).alias("seen"),
        F.count(F.when(F.col("vision") & F.col("seen").isNull(), 1)).alias("unpriced"),
    )
    tokens = F.bround(F.bround(F.col("chars") / 4.0) * model.ratio)
    read = F.coalesce(tokens * F.try_divide(F.coalesce("read", F.lit(0)), F.col("chars")), F.lit(0.0))
    return out.select(key, F.when(F.col("unpriced") == 0, F.round((read + F.coalesce("seen", F.lit(0.0))) * model.price / 1e6, 10)).alias("usd"))


def by_format(readings: DataFrame) -> DataFrame:
    """Documents, pages, characters and mean similarity by format and loader, and by loader over all formats.

    Rows over all formats have all_formats true and a null format; a null format of its own has it false.

    readings: format, loader, doc_id, pages, chars, similarity, a row per document and loader.
    """
    return readings.cube("format", "loader").agg(
        F.grouping("format").alias("_f"), F.grouping("loader").alias("_l"), F.countDistinct("doc_id").alias("documents"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"),
        F.bround(F.avg(_exact(F.col("similarity"))).cast("double"), 4).alias("similarity"),
    ).where("_l = 0").withColumn("all_formats", F.col("_f") == 1).drop("_f", "_l")


def stage_identifiers(found: DataFrame) -> DataFrame:
    """(stage, fingerprint, occurrences, items): how often an identifier occurs at a stage, and in how many of its items."""
    return found.groupBy("stage", "fingerprint").agg(F.count("*").alias("occurrences"), F.countDistinct("item").alias("items"))


def load_warnings(items: DataFrame) -> DataFrame:
    """(source, warning, n) of what a loading stage passed on: items (source, n, text), in order of n.

    empty_document: no item of the source has text; empty_pages: n items of several have none; garbled: its text as a
    whole has GARBLED characters per 1,000 that are not text. Nulls count as empty text; a null source is one source.
    """
    text = tx.empty_as(F.col("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n")
    by = items.groupBy("source").agg(F.count("*").alias("items"), F.count(F.when(F.trim(text) == "", 1)).alias("empty"), whole.alias("text"))
    rate = readiness.garbled(F.col("text"))
    some = F.col("empty") < F.col("items")
    kinds = F.array_compact(F.array(
        F.when(~some, F.struct(F.lit("empty_document").alias("warning"), F.lit(1).cast("long").alias("n"))), F.when(some & (F.col("empty") > 0), F.struct(F.lit("empty_pages").alias("warning"), F.col("empty").alias("n"))),
        F.when(rate >= GARBLED, F.struct(F.lit("garbled").alias("warning"), F.lit(1).cast("long").alias("n"))),
    ))
    return by.select("source", F.explode(kinds).alias("w")).select("source", "w.*")


def chunk_warnings(flagged: DataFrame) -> DataFrame:
    """(warning, chunks, documents) of chunks as inspected() flags them; a flag that no chunk has gives no row."""
    kinds = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f"{f}_chunks")) for f in ("tiny", "oversized", "duplicate")]))
    return flagged.select("doc_id", F.explode(kinds).alias("warning")).groupBy("warning").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def sent_warnings(items: DataFrame, model: str | None = None) -> DataFrame:
    """(warning, texts, documents) of texts (source, text) sent to be embedded: empty ones, and those over the model's limit."""
    text = tx.empty_as(F.col("text"))
    limit = EMBEDDING_LIMITS.get(model or "")
    over = tx.estimated_tokens(text) > limit if limit else F.lit(False)
    kinds = F.array_compact(F.array(F.when(F.trim(text) == "", F.lit("empty_texts")), F.when(over, F.lit("over_token_limit"))))
    return items.select("source", F.explode(kinds).alias("warning")).groupBy("warning").agg(F.count("*").alias("texts"), F.countDistinct("source").alias("documents"))


def embedding_costs(items: DataFrame, prices: dict[str, float], local: tuple[str, ...] = ()) -> DataFrame:
    """(model, tokens, usd) of items (model, text): tokens by price per million; local models cost 0, unknown ones null."""
    per = F.create_map(*[F.lit(x) for kv in (prices | dict.fromkeys(local, 0.0)).items() for x in kv])
    total = items.groupBy("model").agg(F.sum(tx.estimated_tokens(tx.empty_as(F.col("text")))).alias("tokens"))
    return total.select("model", "tokens", F.round(F.col("tokens") * F.element_at(per, F.col("model")) / 1e6, 10).alias("usd"))


def vector_shapes(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, dims, vectors): how many vectors of each length; null vectors have null dims."""
    return rows.groupBy(key, F.when(F.col(vector).isNotNull(), F.size(vector)).alias("dims")).agg(F.count("*").alias("vectors"))


def verdicts(documents: DataFrame) -> DataFrame:
    """documents (identifiers, high, hidden, unread) with verdict: unread, stop, careful or ready.

    Hidden text or an identifier of high severity stops a document whatever it says; one that could not be read and shows
    nothing is unread. Null counts are 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    unread = F.coalesce("unread", F.lit(False)) & (n("hidden") == 0) & (n("identifiers") == 0)
    verdict = F.when(unread, "unread").when((n("hidden") > 0) | (n("high") > 0), "stop").when(n("identifiers") > 0, "careful").otherwise("ready")
    return documents.withColumn("verdict", verdict)


def search(docs: DataFrame, asked: str, key: str = "doc_id", text_col: str = "text", before: int = 80, after: int = 160) -> DataFrame:
    """(key, snippet) of the texts that hold every word asked for, and what stands around the first word."""
    words = asked.lower().split()
    if not words:
        raise ValueError("there is nothing to look for")
    low = F.lower(text_col)
    hit = docs.where(F.forall(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
    at = F.locate(words[0], low) - 1
    start = F.greatest(at - before, F.lit(0))
    return hit.select(key, F.substring(F.col(text_col), start + 1, at + after - start).alias("snippet"))


def page_of(rows: DataFrame, *order: Column | str, page: int = 1, size: int = 50) -> DataFrame:
    """Page `page` (from 1) of rows in that order: Spark takes the first page * size rows of each task, then of those."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def newest(rows: DataFrame, group: str, at: str, n: int, *ties: str) -> DataFrame:
    """The n newest rows of each group; ties go by the columns named."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), *ties))).where(F.col("_rank") <= n).drop("_rank")


def stale(rows: DataFrame, verified: str, today: Column, most: int = 90) -> DataFrame:
    """rows with days since they were verified, and whether that is over `most`; never verified: null days, stale."""
    days = F.datediff(today, F.col(verified))
    return rows.withColumns({"days": days, "stale": F.coalesce(days > most, F.lit(True))})


def origins(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """texts (item, text) with source: that of the earliest stage that saw the same text; null where none did.

    seen: stage, source, text. Texts meet by digest; each digest is one row, the least stage and then source.
    """
    first = seen.where("text is not null").groupBy(F.sha2("text", 256).alias("_d")).agg(F.min(F.struct("stage", "source")).alias("_o"))
    return texts.withColumn("_d", F.sha2("text", 256)).join(first, "_d", "left").withColumn("source", F.col("_o.source")).drop("_d", "_o")


def untouched(found: DataFrame, reported: DataFrame, key: str = "doc_id", cell: int = 256) -> DataFrame:
    """The finds (key, start, end) that no reported span of their document overlaps.

    Spans meet by the cells of `cell` characters that they touch, an equality join; each find and span is in as many cells
    as it is long. Null keys are one document.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest("end", F.col("start") + 1) - 1) / cell))).alias("_c")
    x = found.select(key, "start", "end").distinct().select(key, "start", "end", cells).alias("x")
    y = reported.select(key, "start", "end").distinct().select(key, "start", "end", cells).alias("y")
    meets = F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & (F.col("x._c") == F.col("y._c")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    hit = x.join(y, meets, "left_semi").select(key, "start", "end").distinct().alias("h")
    f = found.alias("f")
    return f.join(hit, F.col(f"f.{key}").eqNullSafe(F.col(f"h.{key}")) & (F.col("f.start") == F.col("h.start")) & (F.col("f.end") == F.col("h.end")), "left_anti")


#: Outcomes of a page held against an independent reading.
STATUSES = ("agrees", "disagrees", "filled", "failed", "not_rendered")


def verification(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of pages held against an independent reading (doc_id, status, usd) of documents (doc_id, pages): documents,
    pages_total, pages_checked, a count per status, usd.

    Pages that could not be sent are not checked. usd is null where no page has a price. Without verified pages: no row.
    """
    verified = pages.select("doc_id").distinct()
    total = documents.join(verified, "doc_id", "left_semi").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_total"))
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"pages_{s}") for s in STATUSES]
    usd = F.round(F.sum(F.col("usd").cast("decimal(28,8)")), 6).cast("double").alias("usd")
    out = pages.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.when(F.col("status") != "not_rendered", 1)).alias("pages_checked"), *counts, usd)
    return out.where("documents > 0").crossJoin(total)
