"""The four passes over a text for content that addresses a model, with places: smuggled, by pattern, hidden, by classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import hidden, rollups, spans

#: Letters that a passage needs, and characters of a paragraph that a classifier gets at a time.
LETTERS, PARAGRAPH = 12, 2000
SHAPE = ("doc_id", "kind", "visibility", "instruction", "severity", "start", "end", "reasons", "score", "excerpt", "fingerprint")
SENTENCE = r"(?s).+?(?:[.!?](?:\s+|$)|\n|$)"
BLOCK = r"(?s).+?(?:\n[^\S\n]*\n\s*|$)"


def pieces(docs: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, start, end, passage): what a pattern that takes up a whole text cuts it into, blanks at the ends left out."""
    cut = F.regexp_extract_all(tx.empty_as(F.col("text")), F.lit(pattern), 0)
    lay = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    starts = F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lay)["out"]
    each = docs.select(key, F.explode(F.arrays_zip(cut.alias("t"), starts.alias("at"))).alias("p")).select(key, "p.*")
    lead = F.length("t") - F.length(F.regexp_replace("t", r"^\s+", ""))
    passage = F.regexp_replace(F.regexp_replace("t", r"^\s+", ""), r"\s+$", "")
    return each.select(key, (F.col("at") + lead).alias("start"), (F.col("at") + lead + F.length(passage)).alias("end"), passage.alias("passage")).where("passage <> ''")


def instructed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, passage, groups): sentences that match patterns of instructions, each once, with the groups."""
    said = tx.strip_invisible(F.col("passage"))
    return pieces(docs, SENTENCE, key).where(hidden.has_instruction(said)).withColumn("groups", hidden.instruction_groups(said))


def scored(docs: DataFrame, covered: DataFrame, name: str, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, start, end, passage, score): paragraphs that no covered stretch (key, start, end) overlaps, of LETTERS letters at
    least, that a registered classifier scores at the threshold or above. Long paragraphs are cut into windows."""
    blocks = pieces(docs, BLOCK, key)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length("passage") - 1) / PARAGRAPH).cast("int")), lambda i: F.struct((F.col("start") + i * PARAGRAPH).alias("start"), F.substring(F.col("passage"), i * PARAGRAPH + 1, F.lit(PARAGRAPH)).alias("passage")))
    each = blocks.select(key, F.explode(windows).alias("w")).select(key, "w.start", (F.col("w.start") + F.length("w.passage")).alias("end"), "w.passage")
    each = each.where(tx.count_of(F.col("passage"), r"\p{L}") >= LETTERS)
    left = rollups.untouched(each, covered.select(key, "start", "end"), key)
    return left.withColumn("score", F.pandas_udf(hidden._CLASSIFIERS[name], "double")("passage")).where(F.col("score") >= threshold).select(key, "start", "end", "passage", "score")


def content_check(docs: DataFrame, classifier: str | None = None, threshold: float = 0.8) -> DataFrame:
    """Findings of texts (doc_id, text): smuggled characters, sentences by pattern, and what the classifier makes of the rest.

    Columns: SHAPE. Smuggled finds have no place. Null texts have none; rows that repeat an id are each looked at.
    """
    none, words = F.lit(None), F.array().cast("array<string>")
    smuggled = docs.select("doc_id", F.explode(tx.smuggled(tx.empty_as(F.col("text")))).alias("s")).select("doc_id", F.col("s.kind").alias("kind"), F.lit("confirmed").alias("visibility"), F.when(hidden.has_instruction(F.col("s.payload")), "pattern").otherwise("none").alias("instruction"), none.cast("long").alias("start"), none.cast("long").alias("end"), F.array(F.concat(F.lit("smuggled "), F.col("s.kind"))).alias("reasons"), none.cast("double").alias("score"), F.col("s.payload").alias("passage"))
    by_pattern = instructed(docs)
    told = by_pattern.select("doc_id", F.lit("instruction").alias("kind"), F.lit("visible").alias("visibility"), F.lit("pattern").alias("instruction"), "start", "end", F.col("groups").alias("reasons"), none.cast("double").alias("score"), "passage")
    out = smuggled.unionByName(told)
    if classifier:
        more = scored(docs, by_pattern, classifier, threshold)
        out = out.unionByName(more.select("doc_id", F.lit("model").alias("kind"), F.lit("visible").alias("visibility"), F.lit("model").alias("instruction"), "start", "end", words.alias("reasons"), "score", "passage"))
    out = out.withColumns({"severity": hidden.severity(F.col("visibility"), F.col("instruction")), "excerpt": tx.excerpt(F.col("passage")), "fingerprint": tx.passage_fingerprint(F.col("passage"))})
    return out.select(*SHAPE)


def hidden_runs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Findings of what the markup of pages hides, whether it instructs a model or not; comments only where they do."""
    runs = hidden.parse_html(pages, (key,), html).select(F.col(key).alias("doc_id"), F.explode("hidden").alias("h")).select("doc_id", "h.reason", F.col("h.passage").alias("passage"))
    said = hidden.has_instruction(tx.strip_invisible(F.col("passage")))
    kept = runs.where(said | (F.col("reason") != "comment")).withColumn("instruction", F.when(said, "pattern").otherwise("none"))
    none = F.lit(None)
    kept = kept.withColumns({"kind": F.lit("format"), "visibility": F.lit("confirmed"), "start": none.cast("long"), "end": none.cast("long"), "reasons": F.array("reason"), "score": none.cast("double"), "severity": hidden.severity(F.lit("confirmed"), F.col("instruction")), "excerpt": tx.excerpt(F.col("passage")), "fingerprint": tx.passage_fingerprint(F.col("passage"))})
    return kept.select(*SHAPE)
