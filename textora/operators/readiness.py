"""Readiness: signals per document, their ratings, scores, bands, and roll-ups over folders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import text as tx

LEAST_CHARS, LEAST_WORDS, LEAST_DATES, LEAST_PAGES = 200, 100, 3, 3
SIGNAL = ("signal", "value", "status")

#: Signals that a user adds: name -> DataFrame of documents -> (doc_id, value), null where it does not apply.
REGISTERED: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_signal(name: str, measure: Callable[[DataFrame], DataFrame]) -> None:
    REGISTERED[name] = measure


def garbled(text: Column) -> Column:
    """Replacement characters, ligatures and run-together words per 1,000 characters; null below 200 characters."""
    n = tx.count_of(text, r"\x{FFFD}") + tx.count_of(text, r"[\x{FB00}-\x{FB06}]") + tx.run_together(text)
    return F.when(F.length(text) >= LEAST_CHARS, tx.rate(n, F.length(text)))


def unmapped(text: Column) -> Column:
    n = tx.count_of(text, r"\(cid:\d+\)") + tx.count_of(text, r"[\x{E000}-\x{F8FF}]") + tx.count_of(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    return F.when(F.length(text) >= LEAST_CHARS, tx.rate(n, F.length(text)))


def hyphenated(text: Column) -> Column:
    n = tx.count_of(text, r"[\p{L}\p{N}_]+")
    return F.when(n >= LEAST_WORDS, tx.rate(tx.count_of(text, r"[a-z]{2,}-[ \t]*\n[ \t]*[a-z]{2,}"), n))


def date_consistency(text: Column) -> Column:
    counts = [tx.count_of(text, p) for _, p in fixed.DATE_FAMILIES]
    total = reduce(lambda a, b: a + b, counts)
    return F.when(total >= LEAST_DATES, F.bround(F.greatest(*counts) / total * 100, 2))


def text_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, signal, value, status) of the signals that a document's text alone decides; nulls count as empty text.

    keep: columns of docs that go with each row, so that nothing need be joined back; not with registered signals.
    """
    text = tx.empty_as(F.col(text_col))
    measured = {
        "text_layer_present": F.when(F.trim(text) != "", 1.0).otherwise(0.0), "garbled_char_rate": garbled(text), "unmapped_glyphs": unmapped(text),
        "hyphenated_line_breaks": hyphenated(text), "date_format_consistency": date_consistency(text), "table_count": tables_in(text).cast("double"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("value")) for k, v in measured.items()]))
    out = docs.select(F.col(id_col).alias("doc_id"), *keep, rows.alias("s")).select("doc_id", *keep, "s.*")
    for name, measure in ({} if keep else REGISTERED).items():
        out = out.unionByName(measure(docs).select("doc_id", F.lit(name).alias("signal"), F.col("value").cast("double")))
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_applicable").otherwise("measured"))


def tables_in(text: Column) -> Column:
    """Pipe tables: a header row followed by a rule row."""
    lines = F.split(text, "\n")
    rule = lambda x: x.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$")
    return F.size(F.filter(lines, lambda x, i: rule(x) & (i > 0) & F.coalesce(F.get(lines, i - 1).contains("|"), F.lit(False))))


def repeated_lines(pages: DataFrame, id_col: str = "conv_id", page_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(id, repeated_pct): share of text in lines that half of the pages (two at least) repeat; null below three pages."""
    full = pages.select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), tx.empty_as(F.col(text_col)).alias("text")).where(F.trim("text") != "")
    count = full.groupBy("id").agg(F.countDistinct("page").alias("pages"))
    lines = full.select("id", "page", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= 3)
    lines = lines.select("id", "page", tx.line_key(F.col("line")).alias("key"), F.length(tx.squeezed(F.col("line"))).alias("chars"))
    keyed = lines.groupBy("id", "key").agg(F.countDistinct("page").alias("seen"), F.sum("chars").alias("chars"))
    both = keyed.join(count, "id")
    repeated = F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.5))
    share = F.bround(F.sum(F.when(repeated, F.col("chars")).otherwise(0)) / F.sum("chars") * 100, 2)
    return count.join(both.groupBy("id").agg(share.alias("share")), "id", "left").select("id", F.when(F.col("pages") >= LEAST_PAGES, F.coalesce("share", F.lit(0.0))).alias("repeated_pct"))


def language_counts(docs: DataFrame, group: str = "source", lang: str = "lang", least_share: float = 0.02) -> DataFrame:
    """(group, languages): the main language, and others on at least two documents or 2 % of them."""
    n = docs.groupBy(group, lang).agg(F.count("*").alias("n"))
    by = Window.partitionBy(group)
    top = F.row_number().over(by.orderBy(F.desc("n"), F.asc(lang)))
    kept = n.withColumns({"top": top, "total": F.sum("n").over(by)}).where((F.col("top") == 1) | (F.col("n") >= 2) | (F.col("n") / F.col("total") >= least_share))
    return kept.groupBy(group).agg(F.count("*").alias("languages"))


def _holds(value: Column, op: str, bound: float) -> Column:
    return {"lt": value < bound, "lte": value <= bound, "gt": value > bound, "gte": value >= bound, "eq": value == bound}[op]


def rating(signal: Column, value: Column) -> Column:
    """good, fair or poor: the first bound that holds, by the signal; null without a value or for an unknown signal."""
    def one(bounds):
        c = F.when(F.lit(False), "")
        for name, op, bound in bounds:
            c = c.when(_holds(value, op, bound), name)
        return c

    c = F.when(F.lit(False), "")
    for name, _, bounds in fixed.SIGNALS:
        c = c.when(signal == name, one(bounds))
    return F.when(value.isNotNull(), c)


def weight(signal: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for n, w, _ in fixed.SIGNALS for x in (n, float(w))])[signal], F.lit(0.0))


def rated(signals: DataFrame) -> DataFrame:
    return signals.withColumns({"rating": rating(F.col("signal"), F.col("value")), "weight": weight(F.col("signal"))})


def band(score: Column) -> Column:
    return F.when(score >= 75, "ready").when(score >= 50, "workable").when(score >= 25, "needs work").when(score.isNotNull(), "not ready")


def scores(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, score, label, counted, excluded, low_confidence from rated signal rows; no row counted: no score.

    Signals that the input cannot give have no row and are excluded like those that do not apply: the score is of low
    confidence where less than half of all signals count.
    """
    total = len({name for name, *_ in fixed.SIGNALS} | set(REGISTERED))
    points = F.create_map(*[F.lit(x) for kv in fixed.RATING_POINTS.items() for x in kv])[F.col("rating")]
    counts = F.col("rating").isNotNull() & (F.col("weight") > 0)
    w = F.when(counts, F.col("weight").cast("decimal(10,4)"))
    out = rows.groupBy(*keys).agg(
        F.sum(w * points.cast("decimal(4,2)")).alias("_p"), F.sum(w).alias("_w"), F.count(F.when(counts, 1)).alias("counted")
    )
    score = F.bround(F.col("_p").cast("double") / F.col("_w").cast("double") * 100, 1)
    return out.select(*keys, score.alias("score"), band(score).alias("label"), "counted", (F.lit(total).cast("long") - F.col("counted")).alias("excluded"), (F.col("counted") < total / 2).alias("low_confidence"))


def distribution(rows: DataFrame) -> DataFrame:
    """signal, and documents per good, fair, poor and not_applicable."""
    bucket = F.coalesce("rating", "status")
    count = lambda k: F.count(F.when(bucket == k, 1)).alias(k)
    return rows.groupBy("signal").agg(*map(count, ("good", "fair", "poor", "not_applicable")))


def cost_path(pages: DataFrame, key: str, source: str = "text_source") -> DataFrame:
    """(key, cost_score): 100 for a native page, 60 for a recognised one, 0 for a blank one, averaged."""
    s = F.col(source)
    points = F.when(s.isin("native", "loader"), 100.0).when(s == "ocr", float(fixed.OVERALL["recognised_page_score"])).otherwise(0.0)
    return pages.groupBy(key).agg(F.bround(F.avg(points), 1).alias("cost_score"))


def overall(content: DataFrame, cost: DataFrame, exposed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, overall, label: content, cost path and exposure, weighted over the parts that were measured."""
    both = content.join(cost, key, "left").join(exposed, key, "left")
    parts = {"score": "content_weight", "cost_score": "cost_weight", "exposure_score": "exposure_weight"}
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * fixed.OVERALL[w], F.lit(0.0)) for c, w in parts.items()))
    over = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), fixed.OVERALL[w]).otherwise(0.0) for c, w in parts.items()))
    value = F.bround(F.try_divide(total, over), 1)
    return both.select(key, value.alias("overall"), band(value).alias("label"))
