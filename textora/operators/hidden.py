"""Hidden and injected content: smuggled characters, instruction passages, hidden runs of HTML, and their severity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import text as tx

#: HTML elements that end by themselves, and those whose content is not shown.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
UNSEEN = ("script", "style", "template", "noscript", "head", "title")
BLOCK = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre", "hr", "dt", "dd", "dl", "form", "figure", "main")

_CLASSIFIERS: dict[str, Callable] = {}


def register_classifier(name: str, score: Callable) -> None:
    """A function of a pandas series of paragraphs that returns scores from 0 to 1."""
    _CLASSIFIERS[name] = score


def java(pattern: str) -> str:
    """A pattern of the fixed list for Catalyst: Unicode classes and word edges, any case."""
    return f"(?iU){pattern}"


def has_instruction(text: Column, group: str | None = None) -> Column:
    """Whether a passage addresses a language model, by the patterns of one group or of all."""
    hit = F.lit(False)
    for name, patterns in fixed.INSTRUCTIONS:
        if group in (None, name):
            for p in patterns:
                hit = hit | text.rlike(java(p))
    return F.coalesce(hit, F.lit(False))


def instruction_groups(text: Column) -> Column:
    """Groups whose patterns a text matches."""
    return F.array_compact(F.array(*[F.when(has_instruction(text, g), F.lit(g)) for g, _ in fixed.INSTRUCTIONS]))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, sentence): pieces that end at a line feed, or at a full stop, exclamation or question mark and a blank."""
    cut = F.split(F.regexp_replace(tx.empty_as(F.col(text_col)), r"(?<=[.!?])\s+", "\n"), "\n")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("n", "sentence")).where(F.trim("sentence") != "")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, visibility, instruction, severity, excerpt, fingerprint): smuggled characters, and sentences that instruct."""
    d = docs.select(F.col(id_col).alias("doc_id"), tx.empty_as(F.col(text_col)).alias("text"))
    secret = d.select("doc_id", F.explode(tx.smuggled(F.col("text"))).alias("s")).select("doc_id", F.col("s.kind").alias("kind"), F.lit("confirmed").alias("visibility"), F.when(has_instruction(F.col("s.payload")), "pattern").otherwise("none").alias("instruction"), F.col("s.payload").alias("passage"))
    said = sentences(d).where(has_instruction(tx.strip_invisible(F.col("sentence")))).select("doc_id", F.lit("instruction").alias("kind"), F.lit("visible").alias("visibility"), F.lit("pattern").alias("instruction"), F.col("sentence").alias("passage"))
    both = secret.unionByName(said)
    return both.select("doc_id", "kind", "visibility", "instruction", severity(F.col("visibility"), F.col("instruction")).alias("severity"), tx.excerpt(F.col("passage")).alias("excerpt"), tx.passage_fingerprint(F.col("passage")).alias("fingerprint"))


def classified(docs: DataFrame, name: str, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs that a registered classifier scores at the threshold or above."""
    score = F.pandas_udf(_CLASSIFIERS[name], "double")
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(tx.paragraphs(tx.empty_as(F.col(text_col)))).alias("paragraph"))
    return each.withColumn("score", score("paragraph")).where(F.col("score") >= threshold)


def severity(visibility: Column, instruction: Column) -> Column:
    """high for hidden instructions; medium for what is hidden, or confirmed; low otherwise."""
    hidden = visibility.isin("suspected", "confirmed")
    model = F.when(visibility == "confirmed", "high").otherwise("medium")
    return F.when(hidden & instruction.isin("pattern", "confirmed"), "high").when(hidden & (instruction == "model"), model).when(hidden, "medium").when(instruction == "confirmed", "medium").otherwise("low")


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose text has no sentence that instructs a model, and no invisible characters."""
    cut = F.split(F.regexp_replace(tx.strip_invisible(F.col(text_col)), r"(?<=[.!?])\s+", "\n"), "\n")
    return docs.withColumn(text_col, F.array_join(F.filter(cut, lambda s: ~has_instruction(s)), "\n"))


def comments(html: Column) -> Column:
    """HTML comments that are not empty."""
    found = F.regexp_extract_all(tx.empty_as(html), F.lit(r"(?s)<!--(.*?)-->"), 1)
    return F.filter(F.transform(found, tx.squeezed), lambda c: c != "")


class _Page(HTMLParser):
    """Text as shown, table shapes, and runs of text that a style hides."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.hidden: list[tuple[str, str]] = []
        self.tables: list[list[list[int]]] = []
        self.open: list[tuple[str, str]] = []
        self.rules: dict[str, str] = {}
        self.css: list[str] | None = None

    def _why(self, tag: str, attrs: dict) -> str:
        keys = [tag, *(f".{c}" for c in (attrs.get("class") or "").split()), *([f"#{attrs['id']}"] if attrs.get("id") else [])]
        style = ";".join([*(self.rules.get(k, "") for k in keys), attrs.get("style") or ""]).lower()
        style = re.sub(r"\s*!important|\s+(?=[:;])|(?<=[:;])\s+", "", style)
        if "hidden" in attrs or re.search(r"(?:^|;)(?:display:none|visibility:(?:hidden|collapse))", style):
            return "not displayed"
        if re.search(r"(?:^|;)opacity:0*\.?0*(?:;|$)", style):
            return "transparent"
        if m := re.search(r"(?:^|;)font-size:([\d.]+)(pt|px)?", style):
            if float(m[1]) * (0.75 if m[2] != "pt" else 1) < 1.0:
                return "too small"
        if re.search(r"(?:^|;)color:(?:white|#fff(?:fff)?|rgb\(255,\s*255,\s*255\))(?:;|$)", style) and not re.search(r"background", style):
            return "white text"
        if re.search(r"(?:^|;)(?:left|top|text-indent|margin-left):-\d{3,}", style) or re.search(r"(?:^|;)(?:width|height):0(?:px)?(?:;|$)", style):
            return "off the page"
        return ""

    def handle_starttag(self, tag, attrs) -> None:
        attrs = dict(attrs)
        if tag == "style":
            self.css = []
        if tag in ("p", "li", "tr", "td", "th", "option"):  # these end where the next of their kind begins
            while self.open and self.open[-1][0] == tag:
                self.open.pop()
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            span = lambda k: int(attrs[k]) if (attrs.get(k) or "").isdigit() else 1
            self.tables[-1][-1].append(span("colspan") * span("rowspan"))
            self.text.append("\t")
        if tag in BLOCK:
            self.text.append("\n")
        if tag not in VOID:
            above = self.open[-1][1] if self.open else ""
            self.open.append((tag, above or ("unseen" if tag in UNSEEN else self._why(tag, attrs))))

    def handle_endtag(self, tag) -> None:
        if tag == "style" and self.css is not None:
            for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", "".join(self.css))):
                for s in selectors.split(","):
                    self.rules[s.strip()] = f"{self.rules.get(s.strip(), '')};{body}"
            self.css = None
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCK:
            self.text.append("\n")

    def handle_data(self, data) -> None:
        why = self.open[-1][1] if self.open else ""
        if self.css is not None:
            self.css.append(data)
        elif not why:
            self.text.append(data)
        elif why != "unseen" and data.strip():
            self.hidden.append((why, " ".join(data.split())))

    def handle_comment(self, data) -> None:
        if data.strip():
            self.hidden.append(("comment", " ".join(data.split())))


PARSED = "text string, hidden array<struct<reason:string,passage:string>>, tables array<struct<rows:int,columns:int,merged:int>>"


def parse_html(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """keys, the text shown, hidden runs with their reason, and the tables of two rows and columns at least."""
    source = pages.select(*keys, F.col(html).alias("_html"))
    kinds = ", ".join(f"{k} {dict(source.dtypes)[k]}" for k in keys)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"text": [], "hidden": [], "tables": []}
            for html in b.column("_html").to_pylist():
                p = _Page()
                p.feed(html or "")
                p.close()
                lines = (re.sub(r"[^\S\t]+", " ", x).strip(" \t") for x in "".join(p.text).split("\n"))
                out["text"].append("\n".join(x for x in lines if x))
                out["hidden"].append([{"reason": w, "passage": t} for w, t in p.hidden])
                shapes = [(len(t), max(map(len, t), default=0), sum(c - 1 for r in t for c in r)) for t in p.tables]
                out["tables"].append([{"rows": r, "columns": c, "merged": m} for r, c, m in shapes if r >= 2 and c >= 2])
            types = (pa.string(), pa.list_(pa.struct([("reason", pa.string()), ("passage", pa.string())])), pa.list_(pa.struct([("rows", pa.int32()), ("columns", pa.int32()), ("merged", pa.int32())])))
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keys} | {n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    return source.mapInArrow(parse, f"{kinds}, {PARSED}")


def html_findings(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """Hidden runs that also read as instructions."""
    runs = parse_html(pages, keys, html).select(*keys, F.explode("hidden").alias("h")).select(*keys, "h.reason", "h.passage")
    return runs.where(has_instruction(F.col("passage"))).withColumn("severity", severity(F.lit("confirmed"), F.lit("pattern")))
