"""An audit's result as twelve named tables, each a DataFrame with fixed columns, and as views of a session.

What an audit of texts alone can fill is computed from the texts; tables about loaders, facts and metadata are filled where
their inputs are given, and are empty tables of the same columns where not. All tables name documents as strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import text as tx
from textora.operators import compare, findings, governance, identifiers, passages, readiness

#: The columns of each table.
COLUMNS = {
    "documents": "document string, format string, pages long, page_count_known boolean, readiness_score double, readiness_label string, global_score double, identifiers long, hidden_passages long, hidden_high long, visibility_checked boolean, load_warnings long, seconds double",
    "pages": "document string, page long, source string, characters long, truncated boolean, text string",
    "identifiers": "document string, page long, line long, category string, label string, severity string, evidence string, value string, confidence double",
    "signals": "document string, signal string, name string, status string, value double, display string, rating string, weight double, reason string",
    "hidden": "document string, page long, visibility string, instruction string, severity string, hidden_reasons string, instruction_reasons string, excerpt string, score double, in_loader_output boolean",
    "metadata": "document string, key string, category string, label string, severity string, evidence string, value string, significant boolean",
    "limitations": "area string, severity string, statement string, affected long",
    "quick_wins": "id string, title string, actor string, documents long, effect string, saving_usd_per_1000 double",
    "loaders": "loader string, tags string, baseline boolean, documents long, pages long, characters long, seconds double, network_allowed boolean, network_attempts long, error string, metadata_keys long, identifiers_in_text long, identifiers_in_metadata long, readiness_score double, global_score double, failed_files long, cached_files long, facts_found long, parser_usd double",
    "loader_formats": "format string, files long, loader string, given long, documents long, pages long, characters long, seconds double, similarity double, failed_files long, facts_found long, recommended boolean",
    "differences": "document string, category string, severity string, evidence string, location string, keys string, value string, found_by string, missed_by string",
    "facts": "fact string, document string, loader string, found string, score double, page long, matched_document string",
}


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """rows with the columns of a table, in order and of its types; what they lack is null."""
    want = [c.split() for c in COLUMNS[table].split(", ")]
    return rows.select(*(F.col(f"`{n}`").cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in want))


def _stated(summary: DataFrame) -> DataFrame:
    """Limitations of an audit of texts: what could not be read, scored or measured, with how many documents it concerns."""
    rules = [
        ("content", "unreadable", "high", "documents have no text that could be read"), ("content", "unsure", "medium", "documents are scored on fewer than half of the signals"),
        ("exposure", "unproven", "low", "documents have identifiers that only their form tells"), ("hidden", "unmeasured", "medium", "documents have text whose visibility was not measured"),
    ]
    each = [F.struct(F.lit(area).alias("area"), F.lit(severity).alias("severity"), F.lit(words).alias("statement"), F.col(c).alias("affected")) for area, c, severity, words in rules]
    return summary.select(F.explode(F.array(*each)).alias("l")).select("l.*").where("affected > 0")


def tables(pages: DataFrame, readings: DataFrame | None = None, facts: DataFrame | None = None, metadata: DataFrame | None = None) -> dict[str, DataFrame]:
    """The twelve tables of pages (document, page, text, and format if known).

    readings: loader, document, page, text, and format if known; facts: fact, loader, document, found, score, page; metadata:
    document, key, value. A null document is a document like others, named "" here. Null texts are pages that cannot be
    read. Each table is a plan of its own: nothing is collected.
    """
    text = tx.empty_as(F.col("text"))
    kind = F.col("format") if "format" in pages.columns else F.lit("text")
    base = pages.select(F.coalesce(F.col("document").cast("string"), F.lit("")).alias("document"), F.col("page").cast("long").alias("page"), kind.alias("format"), F.col("text"))
    whole = base.groupBy("document").agg(F.first("format", ignorenulls=True).alias("format"), F.count("*").alias("pages"), F.max((F.trim(text) == "").cast("int")).alias("blank"), F.min((F.trim(text) == "").cast("int")).alias("unread"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    docs = whole.select(F.col("document").alias("doc_id"), "text")
    ratings = readiness.rated(readiness.text_signals(docs))
    scores = readiness.scores(ratings, "doc_id")
    found = identifiers.scan(base.select("document", "page", "text"), keys=("document", "page"))
    exposed = identifiers.exposure(found.withColumnRenamed("document", "doc_id"), ("doc_id",))
    exposed = docs.select("doc_id").join(exposed, "doc_id", "left").select("doc_id", F.coalesce("exposure_score", F.lit(100.0)).alias("exposure_score"))
    cost = readiness.cost_path(base.select(F.col("document").alias("doc_id"), F.when(F.trim(text) == "", "none").otherwise("native").alias("text_source")), "doc_id")
    overall = readiness.overall(scores, cost, exposed)
    checked = passages.content_check(base.select(F.concat_ws("\x00", "document", F.col("page").cast("string")).alias("doc_id"), "text"))
    place = F.split("doc_id", "\x00")
    hidden = checked.withColumns({"document": place[0], "page": F.get(place, 1).cast("long")})
    per = lambda rows, *counts: rows.groupBy(F.col("document").alias("doc_id")).agg(*counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = whole.withColumnRenamed("document", "doc_id").join(scores, "doc_id", "left").join(overall.select("doc_id", F.col("overall").alias("global_score")), "doc_id", "left")
    counted = counted.join(per(found, F.count("*").alias("identifiers"), F.max((F.col("evidence") == "pattern").cast("int")).alias("unproven")), "doc_id", "left")
    counted = counted.join(per(hidden, F.count("*").alias("hidden_passages"), F.count(F.when(F.col("severity") == "high", 1)).alias("hidden_high")), "doc_id", "left")
    documents = counted.select(F.col("doc_id").alias("document"), "format", "pages", F.lit(False).alias("page_count_known"), F.col("score").alias("readiness_score"), F.col("label").alias("readiness_label"), "global_score", zero("identifiers"), zero("hidden_passages"), zero("hidden_high"), F.lit(False).alias("visibility_checked"))
    summary = counted.agg(F.count(F.when(F.col("unread") == 1, 1)).alias("unreadable"), F.count(F.when(F.col("low_confidence"), 1)).alias("unsure"), F.count(F.when(F.col("unproven") == 1, 1)).alias("unproven"), F.count(F.when(F.col("unread") == 0, 1)).alias("unmeasured"))
    named = ratings.withColumns({"document": F.col("doc_id"), "name": F.initcap(F.replace("signal", F.lit("_"), F.lit(" "))), "display": F.col("value").cast("string"), "weight": readiness.weight(F.col("signal"))})
    wins = governance.quick_wins(scores, ratings, found.withColumnRenamed("document", "doc_id"), hidden.drop("doc_id").withColumnRenamed("document", "doc_id"))
    out = {
        "documents": documents, "pages": base.select("document", "page", F.when(F.trim(text) == "", "none").otherwise("native").alias("source"), F.length(text).alias("characters"), F.lit(False).alias("truncated"), "text"),
        "identifiers": found.withColumns({"value": F.col("masked"), "label": F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))}), "signals": named,
        "hidden": hidden.withColumns({"hidden_reasons": F.when(F.col("kind") != "instruction", F.array_join("reasons", "; ")), "instruction_reasons": F.when(F.col("kind") == "instruction", F.array_join("reasons", "; "))}),
        "limitations": _stated(summary), "quick_wins": wins.select(F.col("action").alias("id"), F.initcap("action").alias("title"), "documents"),
    }
    if metadata is not None:
        values = metadata.select(F.coalesce(F.col("document").cast("string"), F.lit("")).alias("document"), "key", F.col("value").cast("string").alias("text")).distinct()
        told = identifiers.scan(values, keys=("document", "key"))
        out["metadata"] = told.withColumns({"value": F.col("masked"), "label": F.initcap(F.replace("category", F.lit("_"), F.lit(" "))), "significant": findings.significant(F.col("severity"), F.col("evidence"))})
    if readings is not None:
        out |= _of_loaders(readings)
    if facts is not None:
        out["facts"] = facts
    spark = pages.sparkSession
    return {name: shaped(out.get(name, spark.createDataFrame([], columns)), name) for name, columns in COLUMNS.items()}


def _of_loaders(readings: DataFrame) -> dict[str, DataFrame]:
    """Tables of what each loader read: sums, sums by format, and identifiers that only some of them show."""
    kind = F.col("format") if "format" in readings.columns else F.lit("text")
    rows = readings.select("loader", F.coalesce(F.col("document").cast("string"), F.lit("")).alias("document"), F.col("page").cast("long").alias("page"), kind.alias("format"), F.col("text"))
    sums = lambda *keys: rows.groupBy(*keys).agg(F.countDistinct("document").alias("documents"), F.count("*").alias("pages"), F.sum(F.length(tx.empty_as(F.col("text")))).alias("characters"))
    found = identifiers.scan(rows, keys=("loader", "document", "page"))
    n = found.groupBy("loader").agg(F.count("*").alias("identifiers_in_text"))
    files = rows.groupBy("format").agg(F.countDistinct("document").alias("files"))
    both = compare.presence(found.select("loader", F.col("document").alias("doc_id"), "category", "masked"), rows.select("loader", F.col("document").alias("doc_id")).distinct())
    severity = F.create_map(*[F.lit(x) for c in fixed.CATEGORIES for x in (c[0], c[1])])
    differences = both.select(F.col("doc_id").alias("document"), "category", severity[F.col("category")].alias("severity"), F.lit("text").alias("location"), F.col("masked").alias("value"), F.array_join("found_by", ", ").alias("found_by"), F.array_join("missed_by", ", ").alias("missed_by"))
    return {"loaders": sums("loader").join(n, "loader", "left").withColumn("identifiers_in_text", F.coalesce("identifiers_in_text", F.lit(0))), "loader_formats": sums("format", "loader").join(files, "format"), "differences": differences}


def views(made: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Registers each table as a temporary view of its name, and returns the names."""
    for name, df in made.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in made]


def reports_differ(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(area, document, subject, change, before, after) over two audits: documents, scores, ratings, identifiers, hidden
    passages, facts, limitations, loaders, differences, metadata and quick wins.

    Rows of an area are known by document and subject; what only one audit has is added or removed, values that differ are
    changed. Counts tell rows that repeat. Nulls are values.
    """
    areas = {
        "documents": ("documents", "document", F.col("format"), F.col("pages")), "scores": ("documents", "document", F.lit("readiness"), F.col("readiness_score")), "global": ("documents", "document", F.lit("global"), F.col("global_score")),
        "ratings": ("signals", "document", F.col("signal"), F.col("rating")), "identifiers": ("identifiers", "document", F.concat_ws(" ", "category", "value"), F.lit(None)), "hidden": ("hidden", "document", F.col("excerpt"), F.col("severity")),
        "metadata": ("metadata", "document", F.concat_ws(" ", "key", "category", "value"), F.lit(None)), "facts": ("facts", "document", F.concat_ws(" ", "loader", "fact"), F.col("found")), "limitations": ("limitations", None, F.col("statement"), F.col("affected")),
        "loaders": ("loaders", None, F.col("loader"), F.col("documents")), "differences": ("differences", "document", F.concat_ws(" ", "category", "value"), F.col("missed_by")), "quick_wins": ("quick_wins", None, F.col("id"), F.col("documents")),
    }

    def side(report: dict[str, DataFrame], n: int) -> DataFrame:
        each = [
            report[table].select(F.lit(area).alias("area"), (F.col(doc) if doc else F.lit(None)).cast("string").alias("document"), subject.cast("string").alias("subject"), F.lit(n).alias("side"), value.cast("string").alias("value"))
            for area, (table, doc, subject, value) in areas.items()
        ]
        return reduce(DataFrame.unionByName, each)

    grouped = side(before, 0).unionByName(side(after, 1)).groupBy("area", "document", "subject").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("value")))).alias(c) for n, c in ((0, "b"), (1, "a"))))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x["value"], F.lit(""))), ", ")
    change = F.when(F.size("b") == 0, "added").when(F.size("a") == 0, "removed").otherwise("changed")
    return grouped.where(~F.col("a").eqNullSafe(F.col("b"))).select("area", "document", "subject", change.alias("change"), F.when(F.size("b") > 0, shown(F.col("b"))).alias("before"), F.when(F.size("a") > 0, shown(F.col("a"))).alias("after"))
