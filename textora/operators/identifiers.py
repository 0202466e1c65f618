"""Identifiers in text: pattern matches by Python, and all that judges a match in Catalyst.

An Arrow batch function turns pages into rows of matches, each with its value, its place and the sixty characters on either
side. Whether a term stands beside a match, whether it goes on as a longer number, its checks, vetoes, overlaps, evidence
and mask are Column expressions on those rows; the pages themselves are not joined back.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import checks, text as tx

WINDOW = 60
CONTEXT_CONFIDENCE = 0.8
SEVERITY = {"high": 3, "medium": 2, "low": 1}
EVIDENCE = {"confirmed": 1.0, "corroborated": 0.8, "pattern": 0.5, "model": 0.4}

PHONES = ("phone_number", "international_phone", "us_phone")

#: Categories with a pattern that can match where there is no digit; the others are not tried on pages without one.
DIGITLESS = ("email_address", "person_name", "organisation_name", "eu_vat_number", "api_key", "access_token", "private_key", "password")
#: Categories whose veto looks at the whole line.
ON_LINE = ("card_number", "phone_number")

MATCH = {"category": "string", "sure": "boolean", "start": "int", "end": "int", "line_no": "int", "column_no": "int", "value": "string", "label": "string", "reach": "string", "after": "string", "before": "string", "line": "string"}
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
FOUND = ("category", "start", "end", "line_no", "column_no", "value", "confidence", "context_term", "label_near", "before", "line")
WORD_EDGE = r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])"
EDGE = "\x01"


def _matches(page: str, patterns) -> Iterator[tuple]:
    """(category, sure, start, end, label) of all matches of a page; sure: found by a pattern that needs no term."""
    lowered, numbers = page.lower(), re.search(r"\d", page) is not None
    for category, plain, context, terms in patterns:
        if not numbers and category not in DIGITLESS:
            continue
        tried = plain + (context if any(t in lowered for t in terms) else [])
        for i, p in enumerate(tried):
            for m in p.finditer(page):
                group = "value" if "value" in p.groupindex else 0
                if m.end(group) > m.start(group) >= 0:
                    yield category, i < len(plain), m.start(group), m.end(group), m["label"] if "label" in p.groupindex else None


def _find(categories, carried: list[str]):
    """Matches of a batch of pages; `carried` columns go with each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(c[0], [re.compile(p, re.I) for p in c[5]], [re.compile(p, re.I) for p in c[6]], [t.lower().strip() for t in c[4]]) for c in categories]
        for b in batches:
            owner, rows = [], []
            for i, page in enumerate(b.column("_text").to_pylist()):
                breaks = [m.end() for m in re.finditer("\n", page)]
                for category, sure, start, end, label in _matches(page, made):
                    n = bisect_right(breaks, start)
                    head = breaks[n - 1] if n else 0
                    word = max(page.rfind(c, head, start) for c in " \t") + 1  # an address with a user name can be long
                    line = page[head : breaks[n] - 1 if n < len(breaks) else len(page)] if category in ON_LINE else None
                    before = page[max(head, min(start - 2 * WINDOW, word)) : start]
                    rows.append((category, sure, start, end, n + 1, start - head + 1, page[start:end], label, page[max(0, start - WINDOW) : start], page[end : end + WINDOW], before, line))
                    owner.append(i)
            held = {k: b.column(k).take(pa.array(owner, pa.int64())) for k in carried}
            yield pa.RecordBatch.from_pydict(held | {n: pa.array([r[j] for r in rows], ARROW[t]) for j, (n, t) in enumerate(MATCH.items())})

    return find


def _marked(c: Column) -> Column:
    """c with a mark at every edge of a word, so that plain containment of marked texts respects words."""
    return F.regexp_replace(c, WORD_EDGE, EDGE)


def nearby_term(categories) -> Column:
    """The first term of a match's category within reach: on its line, or also on the line above where none of the words
    before the match on its own line has two letters."""
    here, both = F.substring_index("reach", "\n", -1), F.substring_index("reach", "\n", -2)
    left = F.when(here.rlike(r"\p{L}{2}"), here).otherwise(F.translate(both, "\n", " "))
    around = _marked(F.lower(F.concat_ws(" ", left, F.substring_index("after", "\n", 1))))
    edges = lambda t: re.sub(r"(?<=[^\W_])(?![^\W_])|(?<![^\W_])(?=[^\W_])", EDGE, t.lower().strip())
    each = lambda c: F.array(*[F.struct(F.lit(edges(t)).alias("marked"), F.lit(t).alias("term")) for t in c[4]])
    terms = F.create_map(*[x for c in categories if c[4] for x in (F.lit(c[0]), each(c))])[F.col("category")]
    return F.transform(F.array(around), lambda a: F.get(F.filter(terms, lambda t: a.contains(t["marked"])), 0)["term"])[0]


def _part_of_more() -> Column:
    """Whether the digits at an end of a match are part of a longer number, or follow a slash."""
    first, last = F.concat(F.right("reach", F.lit(2)), F.left("value", F.lit(1))), F.concat(F.right("value", F.lit(1)), F.left("after", F.lit(2)))
    return first.rlike(r"^(?:\d[.,]|[\p{L}\p{N}]/)\d$") | last.rlike(r"^\d[.,]\d$")


def candidates(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", categories=fixed.CATEGORIES) -> DataFrame:
    """keys, _page (a number for each row of pages) and one row per match that stands by itself or beside a term.

    Pages without text give none. Rows that repeat their keys, or have none, are pages of their own.
    """
    source = pages.select(*keys, F.monotonically_increasing_id().alias("_page"), F.col(text_col).alias("_text")).where(F.trim("_text") != "")
    kinds = ", ".join(f"`{k}` {dict(source.dtypes)[k]}" for k in (*keys, "_page"))
    found = source.mapInArrow(_find(categories, [*keys, "_page"]), f"{kinds}, {', '.join(f'{n} {t}' for n, t in MATCH.items())}")
    found = found.where(~_part_of_more()).withColumn("term", nearby_term(categories)).where("sure or term is not null")
    label = F.lower(F.trim("label"))
    found = found.withColumns({"confidence": F.when(F.col("sure"), 1.0).otherwise(CONTEXT_CONFIDENCE), "context_term": F.when(F.col("sure"), label).otherwise(F.col("term")), "label_near": F.col("label").isNotNull() | F.col("term").isNotNull()})
    return found.select(*keys, "_page", *FOUND)


def _by_category(pairs: dict[str, Column], default: Column) -> Column:
    return reduce(lambda c, kv: c.when(F.col("category") == kv[0], kv[1]), list(pairs.items())[1:], F.when(F.col("category") == next(iter(pairs)), next(iter(pairs.values())))).otherwise(default)


def checked(found: DataFrame, categories=fixed.CATEGORIES) -> DataFrame:
    """Candidates that pass their category's checks and are not another field's value.

    A bare run of digits is a card, or a national phone number, only on a line that speaks of one. A value straight after
    the label of another field is that field's, except IBANs, addresses and cards in groups, which nothing else looks like.
    """
    ok = _by_category({c[0]: checks.passes(F.col("value"), c[3]) for c in categories if c[3]}, F.lit(True))
    category, line = F.col("category"), F.coalesce("line", F.lit(""))
    card, bare = category == "card_number", F.col("value").rlike(r"^\d+$")
    unnamed = (card & bare & ~line.rlike(fixed.CARD_WORDS)) | ((category == "phone_number") & F.col("value").rlike(r"^0\d{9,10}$") & ~line.rlike(fixed.PHONE_WORDS))
    plain = category.isin("iban", "email_address") | (card & ~bare)
    label = F.regexp_extract("before", fixed.OTHER_FIELD, 0)
    labelled = (label != "") & ~(category.isin(*PHONES) & label.rlike(fixed.PHONE_WORDS))
    judged = category.isin(*{*fixed.EXCLUSIVE, *(c[0] for c in categories if c[3])})
    in_url = (category == "email_address") & F.col("before").rlike(r"://[^\s:/@]{1,64}:[^\s@/]*$")
    return found.where(ok & ~(judged & (unnamed | (labelled & ~plain))) & ~in_url)


def resolved(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of overlapping finds of exclusive categories the longest stays, then one beside its label, then the surer one.

    Finds of a page fall into stretches that do not touch; the choice is a fold over the finds of one stretch.
    """
    order = {c[0]: i for i, c in enumerate(fixed.CATEGORIES)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("category")]
    marked = found.withColumn("_inside", F.col("category").isin(*fixed.EXCLUSIVE))
    upto = Window.partitionBy("_page", "_inside").orderBy("start", "end")
    reached = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    stretches = marked.withColumn("new", (~F.col("_inside") | (F.col("start") >= F.coalesce(reached, F.lit(0)))).cast("int"))  # other finds are stretches of their own
    stretches = stretches.withColumn("stretch", F.sum("new").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    find = F.struct((F.col("start") - F.col("end")).alias("size"), F.col("context_term").isNull().alias("alone"), (-F.col("confidence")).alias("doubt"), place.alias("place"), *FOUND)
    grouped = stretches.groupBy(*keys, "_page", "_inside", "stretch").agg(F.array_sort(F.collect_list(find)).alias("finds"))
    clash = lambda taken, x: F.exists(taken, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    none = F.filter("finds", lambda _: F.lit(False))
    kept = F.aggregate("finds", none, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    kept = F.when(F.size("finds") == 1, F.col("finds")).otherwise(kept)
    return grouped.select(*keys, "_page", F.explode(kept).alias("f")).select(*keys, "_page", *(f"f.{c}" for c in FOUND))


def evidence(category: Column, near: Column) -> Column:
    sure = [c[0] for c in fixed.CATEGORIES if any(x not in fixed.FORMAT_ONLY for x in c[3])]
    return F.when(category.isin(*sure), "confirmed").when(near, "corroborated").otherwise("pattern")


def scan(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", categories=fixed.CATEGORIES) -> DataFrame:
    """Identifiers: keys, category, severity, start, end, line, column, length, masked, evidence, confidence, context_term, fingerprint."""
    found = resolved(checked(candidates(pages, keys, text_col, categories), categories), keys)
    severity = F.create_map(*[F.lit(x) for c in categories for x in (c[0], c[1])])[F.col("category")]
    return found.select(
        *keys, "category", severity.alias("severity"), "start", "end", F.col("line_no").alias("line"), F.col("column_no").alias("column"),
        F.length("value").alias("length"), tx.mask_value(F.col("value")).alias("masked"), evidence(F.col("category"), F.col("label_near")).alias("evidence"), "confidence", "context_term",
        tx.identifier_fingerprint(F.col("category"), F.col("value")).alias("fingerprint"),
    )


def mask_text(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", categories=fixed.CATEGORIES) -> DataFrame:
    """pages with every identifier in the text masked; where finds overlap the one with the better evidence is laid first."""
    known = pages.withColumn("_key", F.xxhash64(text_col))
    held = (*keys, "_key")
    found = resolved(checked(candidates(known, held, text_col, categories), categories), held)
    strength = F.when(evidence(F.col("category"), F.col("label_near")) == "confirmed", 0).when(F.col("label_near"), 1).otherwise(2)
    spans = found.groupBy(*held).agg(F.array_sort(F.collect_set(F.struct(strength.alias("s"), "start", "end"))).alias("_spans")).alias("s")
    lay = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.regexp_replace(F.substring(t, s["start"] + 1, s["end"] - s["start"]), r"[^\s]", tx.MASK), F.substring(t, s["end"] + 1, F.length(t)))
    same = reduce(lambda x, y: x & y, (F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in held))
    both = known.alias("p").join(spans, same, "left")
    text = F.col(f"p.{text_col}")
    masked = F.when(F.col("_spans").isNull(), text).otherwise(F.aggregate("_spans", text, lay)).alias(text_col)
    return both.select(*(masked if c == text_col else F.col(f"p.`{c}`") for c in pages.columns))


def overlaid(categories=fixed.CATEGORIES, severity: dict[str, str] | None = None, off: tuple[str, ...] = ()) -> tuple:
    """categories with other severities, less those switched off; a name that no category has is an error."""
    known = {c[0] for c in categories}
    if unknown := {*(severity or {}), *off} - known:
        raise ValueError(f"no such categories: {', '.join(sorted(unknown))}")
    return tuple((c[0], (severity or {}).get(c[0], c[1]), *c[2:]) for c in categories if c[0] not in off)


def exposure(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), points: float = fixed.OVERALL["points_per_exposure"]) -> DataFrame:
    """keys, exposure (severity times evidence) and exposure_score, 100 less `points` for each."""
    weigh = lambda table, c: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]
    total = F.sum(F.coalesce(weigh({k: float(v) for k, v in SEVERITY.items()}, F.col("severity")), F.lit(1.0)) * F.coalesce(weigh(EVIDENCE, F.col("evidence")), F.lit(0.5)))
    return found.groupBy(*keys).agg(F.round(total, 4).alias("exposure")).withColumn("exposure_score", F.bround(F.greatest(F.lit(0.0), 100.0 - F.col("exposure") * points), 1))
