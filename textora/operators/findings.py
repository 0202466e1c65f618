"""What is told of findings and readings: what counts, in which order, what a reading lacks, what carries over, what a stage changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import facts, rollups
from textora.operators.identifiers import SEVERITY

#: Words after a label within which its value stands, and the share of a passage that a masked page must still show.
REACH, SHOWN = 12, 0.5


def significant(severity: Column, evidence: Column) -> Column:
    """All findings but those of low severity that only a model made; nulls are not such."""
    return ~F.coalesce((severity == "low") & (evidence == "model"), F.lit(False))


def enabled(rows: DataFrame, column: str, on: dict[str, bool]) -> DataFrame:
    """rows whose kind is not switched off; kinds that are not listed are on."""
    off = [k for k, v in on.items() if not v]
    return rows.where(~F.coalesce(F.col(column).isin(*off), F.lit(False))) if off else rows


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[severity], F.lit(0))


def in_reading_order(found: DataFrame, *keys: str) -> DataFrame:
    """Finds by keys, then page, line and column."""
    return found.orderBy(*keys, "page", "line", "column")


def worst_first(found: DataFrame, *keys: str) -> DataFrame:
    """Finds by severity, worst first, then by keys."""
    return found.orderBy(severity_rank(F.col("severity")).desc(), *keys)


def missing_words(pages: DataFrame, key: str = "doc_id", kept: str = "kept", other: str = "other") -> DataFrame:
    """(key, words, found, coverage, longest_missing): what of `other` a kept reading has, word by word.

    Words are compared lower-cased, each as often as it occurs: the i-th time a word stands in `other` it is found if the
    kept reading has it i times. longest_missing is the longest run of words in order that are not. A page whose other
    reading has no word has null coverage. Rows that repeat a key are one page.
    """
    listed = lambda c: F.regexp_extract_all(F.lower(tx.empty_as(F.col(c))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    have = pages.select(key, F.explode(listed(kept)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    asked = pages.select(key, F.posexplode(listed(other)).alias("pos", "word"))
    asked = asked.withColumn("i", F.row_number().over(Window.partitionBy(key, "word").orderBy("pos")))
    marked = asked.join(have, [key, "word"], "left").withColumn("gone", F.col("i") > F.coalesce("n", F.lit(0)))
    by = Window.partitionBy(key).orderBy("pos")
    runs = marked.withColumn("run", F.sum((~F.col("gone")).cast("int")).over(by)).groupBy(key, "run").agg(F.count("*").alias("words"), F.count(F.when(F.col("gone"), 1)).alias("missing"))
    out = runs.groupBy(key).agg(F.sum("words").alias("words"), (F.sum("words") - F.sum("missing")).alias("found"), F.max("missing").alias("longest_missing"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return pages.select(key).distinct().join(out, key, "left").select(key, n("words").alias("words"), n("found").alias("found"), F.bround(F.col("found") / F.col("words"), 4).alias("coverage"), n("longest_missing").alias("longest_missing"))


def carried(readings: DataFrame, values: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), text_col: str = "text") -> DataFrame:
    """readings with every value that any reading of the same page was found to hold masked, longer values first.

    values: keys, value. What a page was found to hold is bounded by the page; null values are left out, null keys are keys
    like others.
    """
    held = values.where("value is not null and value <> ''").groupBy(*keys).agg(F.collect_set("value").alias("_v"))
    longest = F.array_sort("_v", lambda a, b: F.length(b) - F.length(a))
    lay = lambda t, v: F.replace(t, v, F.regexp_replace(v, r"\S", tx.MASK))
    same = reduce(lambda x, y: x & y, (F.col(f"r.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys))
    text = F.col(f"r.`{text_col}`")
    masked = F.when(F.col("_v").isNull(), text).otherwise(F.aggregate(longest, text, lay)).alias(text_col)
    return readings.alias("r").join(held.alias("h"), same, "left").select(*(masked if c == text_col else F.col(f"r.`{c}`") for c in readings.columns))


def values_by_label(pages: DataFrame, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fact, key, found): exact where a value (fact, value, label) stands within REACH words after its label, else fuzzy.

    Pages and values meet by what numbers can be read as; only those pages are looked at for the label, which must begin
    a word. A null label is met by the value anywhere.
    """
    met = facts.values_found(pages, asked, key).join(asked, "fact").join(pages.select(key, facts.plain(tx.empty_as(F.col("text"))).alias("body")), key)
    after = F.split(F.col("body"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), facts.plain(F.col("label")), F.lit(r"\E")), -1)
    reach = F.transform(F.slice(after, F.lit(2), F.size(after)), lambda x: F.array_join(F.slice(F.split(F.trim(x), " "), 1, REACH), " "))
    flat = lambda c: F.flatten(F.transform(facts.numbers_in(c), lambda t: t["values"]))
    wanted = F.get(facts.numbers_in(F.col("value")), 0)["values"]
    beside = F.col("label").isNull() | F.exists(reach, lambda x: F.arrays_overlap(flat(x), wanted))
    return met.groupBy("fact", key).agg(F.max(beside).alias("b")).select("fact", key, F.when(F.col("b"), "exact").otherwise("fuzzy").alias("found"))


def under_masks(pages: DataFrame, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fact, key): facts (fact, text) that stand on a page with some characters masked and half of them shown at least.

    The facts are a stated set of questions; they are held against every page that has a mask, by a pattern in which each
    character may be a mask.
    """
    each = F.transform(F.split(F.col("what"), ""), lambda c: F.concat(F.lit("["), F.when(c.rlike(r"[\\\[\]^&-]"), F.concat(F.lit("\\"), c)).otherwise(c), F.lit(f"{tx.MASK}]")))
    want = asked.select("fact", facts.plain(F.col("text")).alias("what")).where("what <> ''").select("fact", F.concat(F.lit("(?=("), F.array_join(each, ""), F.lit("))")).alias("pattern"))
    body = pages.select(key, facts.plain(tx.empty_as(F.col("text"))).alias("body")).where(F.col("body").contains(tx.MASK))
    shown = lambda w: F.length(F.replace(w, F.lit(tx.MASK), F.lit("")))
    hit = lambda w: w.contains(tx.MASK) & (shown(w) >= SHOWN * F.length(w))
    return body.join(F.broadcast(want) if want.count() <= 10_000 else want, F.lit(True)).where(F.exists(F.regexp_extract_all("body", F.col("pattern"), F.lit(1)), hit)).select("fact", key).distinct()


def markdown_hidden(text: Column) -> Column:
    """array<struct<kind, text>> of what Markdown does not show: comments, and link references used as comments; code is left out."""
    shown = F.regexp_replace(F.regexp_replace(text, r"(?ms)^(```|~~~).*?^\1[ \t]*$", " "), r"`[^`\n]*`", " ")
    all_ = lambda pattern, kind: F.transform(F.regexp_extract_all(shown, F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), tx.squeezed(x).alias("text")))
    found = F.concat(all_(r"(?s)<!--(.*?)-->", "comment"), all_(r"(?m)^[ ]{0,3}\[[^\]\n]*\]:[ \t]*(?:#|<>)[ \t]*[(\"'](.*?)[)\"'][ \t]*$", "reference"))
    return F.filter(found, lambda x: x["text"] != "")


def metadata_text(value: Column) -> Column:
    """A nested metadata value as one JSON text."""
    return F.to_json(value)


def hosts(text: Column) -> Column:
    """Hosts of the URLs in a text, lower-cased, once each, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bhttps?://([^/?#\s\"'<>)]+)"), 1), F.lower)))


def stage_changes(before: DataFrame, after: DataFrame, key: str = "item") -> DataFrame:
    """(key, change, tokens_before, tokens_after, hosts_added) of the items of a stage: added, dropped, changed or same."""
    side = lambda d, n: d.select(key, F.lit(True).alias(f"in_{n}"), tx.empty_as(F.col("text")).alias(f"text_{n}"))
    both = side(before, "a").join(side(after, "b"), key, "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "dropped").when(F.col("text_a") == F.col("text_b"), "same").otherwise("changed")
    tokens = lambda n: F.when(F.col(f"in_{n}"), tx.estimated_tokens(F.col(f"text_{n}"))).alias("tokens_before" if n == "a" else "tokens_after")
    new = F.array_except(hosts(tx.empty_as(F.col("text_b"))), hosts(tx.empty_as(F.col("text_a"))))
    return both.select(key, change.alias("change"), tokens("a"), tokens("b"), new.alias("hosts_added"))


def distinct_counts(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """group, and how many different values of each column, nulls apart."""
    return rows.groupBy(group).agg(*[F.countDistinct(c).alias(c) for c in columns])


def limitations(summary: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(limitation, said, n) of a one-row summary: each rule (id, column, words) whose column is above 0."""
    each = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(name).alias("limitation"), F.lit(words).alias("said"), F.col(c).cast("long").alias("n"))) for name, c, words in rules]))
    return summary.select(F.explode(each).alias("l")).select("l.*")


def previews(rows: DataFrame, group: str, order: str, text_col: str, n: int = 3, chars: int = 80) -> DataFrame:
    """(group, previews): the first n texts of each group in order, cut to `chars` characters."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n)
    cut = F.substring(tx.squeezed(tx.empty_as(F.col(text_col))), 1, chars)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", cut.alias("t")))), lambda x: x["t"]).alias("previews"))


def unions(*found: DataFrame) -> DataFrame:
    """Findings of several passes, by name; columns that a pass lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def silent_kept(found: DataFrame, silent: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """found without the finds of silent categories that a find of another category overlaps."""
    quiet = F.col("category").isin(*silent)
    told = found.where(~quiet)
    return told.unionByName(rollups.untouched(found.where(quiet), told, key).select(found.columns))


def as_sarif(failures: DataFrame) -> DataFrame:
    """(result): each failure (rule, level, subject, detail) as a JSON result in the form that code scanners read."""
    where = F.array(F.struct(F.struct(F.struct(F.col("subject").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    words = F.struct(F.concat_ws(": ", "subject", "detail").alias("text"))
    return failures.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", words.alias("message"), where.alias("locations"))).alias("result"))


def as_markdown(failures: DataFrame) -> DataFrame:
    """(rule, text): a heading and a list of failures for each rule, in order of subject."""
    line = F.concat(F.lit("- "), F.concat_ws(": ", "subject", "detail"))
    rows = failures.groupBy("rule", "level").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("*").alias("n"))
    head = F.concat(F.lit("## "), F.col("rule"), F.lit(" ("), F.col("level"), F.lit(", "), F.col("n").cast("string"), F.lit(")"))
    return rows.select("rule", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("text"))
