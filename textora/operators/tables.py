"""Tables as rows of cells, out of pipe lines and HTML, and whether their rows survive in a reading.

A table is a set of rows (key, table, row, column, rowspan, colspan, header, text). Pipe tables are islands of lines; HTML
cells are laid on a grid where a spanning cell occupies places of later rows. A grid row is intact in a reading where one
line holds the words of its cells in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import spans
from textora.operators.hidden import _Page

#: A line that is a row of a pipe table, and one that is the rule under its head.
ROW = r"^\s*\|.*\|\s*$"
RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"
CELLS = "array<struct<table:int,row:int,column:int,rowspan:int,colspan:int,header:boolean,text:string>>"


def pipe_cells(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of the pipe tables of each text: a head, a rule under it, and the rows that follow without a break.

    Of a run of rows the table begins with the first that has a rule under it. Blank cells are cells with empty text.
    """
    by, line = Window.partitionBy(key).orderBy("line"), F.col("text")
    lines = spans.line_spans(docs, key).select(key, "line", "text", line.rlike(ROW).alias("_row"), line.rlike(RULE).alias("_rule"))
    lines = lines.withColumn("_head", F.col("_row") & F.coalesce(F.lead("_rule").over(by), F.lit(False)))
    runs = lines.where(F.col("_row") | F.col("_rule")).withColumn("_run", F.col("line") - F.row_number().over(by))
    inside = Window.partitionBy(key, "_run").orderBy("line")
    marked = runs.withColumn("_first", F.min(F.when(F.col("_head"), F.col("line"))).over(Window.partitionBy(key, "_run")))
    marked = marked.where(F.col("line") >= F.col("_first")).withColumn("_broken", F.max(F.when((F.col("line") > F.col("_first") + 1) & ~F.col("_row"), 1).otherwise(0)).over(inside))
    kept = marked.where((F.col("_broken") == 0) & (F.col("line") != F.col("_first") + 1))
    kept = kept.withColumn("row", F.row_number().over(inside) - 1)
    tables = kept.select(key, "_first").distinct().withColumn("table", F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1)
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\|+|\|+$", ""), r"\|", -1), lambda x: F.trim(x))
    each = kept.join(tables, [key, "_first"]).select(key, "table", "row", F.posexplode(cells).alias("column", "text"))
    return each.select(key, "table", "row", "column", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), (F.col("row") == 0).alias("header"), "text")


class _Tables(_Page):
    """Cells of every table, each on the first free place of its row."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[dict] = []
        self.stack: list[dict] = []
        self.count = 0

    def handle_starttag(self, tag, attrs) -> None:
        super().handle_starttag(tag, attrs)
        at = dict(attrs)
        span = lambda k: min(1000, max(1, int(at[k]))) if (at.get(k) or "").isdigit() else 1
        top = self.stack[-1] if self.stack else None
        if tag == "table":
            self.stack.append({"table": self.count, "row": -1, "taken": {}, "cell": None, "head": False})
            self.count += 1
        elif top and tag in ("thead", "tbody", "tfoot"):
            top["head"], top["cell"] = tag == "thead", None
        elif top and tag == "tr":
            top["row"] += 1
            top["cell"] = None
            top["taken"] = {c: n - 1 for c, n in top["taken"].items() if n > 1}
            top["column"] = 0
        elif top and tag in ("td", "th") and top["row"] >= 0:
            while top["column"] in top["taken"]:
                top["column"] += 1
            down, right = span("rowspan"), span("colspan")
            top["cell"] = {"table": top["table"], "row": top["row"], "column": top["column"], "rowspan": down, "colspan": right, "header": tag == "th" or top["head"], "text": ""}
            self.cells.append(top["cell"])
            top["taken"] |= {c: down for c in range(top["column"], top["column"] + right)}
            top["column"] += right
            # places below stay taken for the rows that the cell spans, its own row included

    def handle_endtag(self, tag) -> None:
        super().handle_endtag(tag)
        if self.stack and tag == "table":
            self.stack.pop()
        elif self.stack and tag == "thead":
            self.stack[-1]["head"] = False
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1]["cell"] = None

    def handle_data(self, data) -> None:
        super().handle_data(data)
        if self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"]["text"] += data


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of the tables of each page, tables within cells numbered on their own; null html has none."""
    source = pages.select(key, F.col(html).alias("_html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("table", pa.int32()), ("row", pa.int32()), ("column", pa.int32()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("header", pa.bool_()), ("text", pa.string())]))
        for b in batches:
            made = []
            for page in b.column("_html").to_pylist():
                p = _Tables()
                p.feed(page or "")
                p.close()
                made.append([c | {"text": " ".join(c["text"].split())} for c in p.cells])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, kind)], [key, "cells"])

    return source.mapInArrow(parse, f"`{key}` {dict(source.dtypes)[key]}, cells {CELLS}").select(key, F.explode("cells").alias("c")).select(key, "c.*")


def shapes(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table, rows, columns, header_depth, merged) of tables of two rows and two columns at least.

    header_depth: rows from the top whose cells are all heads, one at least; merged: places that spanning cells take
    besides their own.
    """
    rows = cells.groupBy(key, "table", "row").agg(F.bool_and("header").alias("head"), F.max(F.col("column") + F.col("colspan")).alias("columns"), F.sum(F.col("rowspan") * F.col("colspan") - 1).alias("merged"))
    out = rows.groupBy(key, "table").agg((F.max("row") + 1).alias("rows"), F.max("columns").alias("columns"), F.min(F.when(~F.col("head"), F.col("row"))).alias("body"), F.sum("merged").alias("merged"))
    depth = F.greatest(F.lit(1), F.coalesce("body", "rows"))
    return out.where("rows >= 2 and columns >= 2").select(key, "table", "rows", "columns", depth.alias("header_depth"), F.col("merged").cast("long").alias("merged"))


def _words(c: Column) -> Column:
    return F.array_join(tx.tokens(tx.compatible(c)), " ")


def fidelity(cells: DataFrame, readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table, intact, compared): of the rows with two cells of text at least, those that a line of the reading
    (key, text) holds, cell after cell, as whole words.

    Rows meet lines by the first word of their first cell, so only lines with that word are looked at. Cells that stack as
    many lines as all others of their row are rows of their own. Documents without a reading compare nothing.
    """
    each = cells.where(F.trim("text") != "").withColumn("_l", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    row = Window.partitionBy(key, "table", "row")
    depth = F.when((F.min(F.size("_l")).over(row) == F.max(F.size("_l")).over(row)) & (F.count("*").over(row) >= 2), F.size("_l")).otherwise(1)
    parts = each.withColumn("_d", depth).select(key, "table", "row", "column", F.posexplode(F.when(F.col("_d") > 1, F.col("_l")).otherwise(F.array("text"))).alias("_i", "_t")).withColumn("_t", _words(F.col("_t"))).where("_t <> ''")
    grid = parts.groupBy(key, "table", "row", "_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "_t"))), lambda x: x["_t"]).alias("_c")).where(F.size("_c") >= 2)
    lines = spans.line_spans(readings.select(key, F.regexp_replace("text", r"[\r\f\v]+", "\n").alias("text")), key).select(key, _words(F.col("text")).alias("_w")).where("_w <> ''").distinct()
    met = lines.withColumn("_first", F.explode(F.array_distinct(F.split("_w", " ")))).join(grid.withColumn("_first", F.split(F.col("_c")[0], " ")[0]), [key, "_first"])
    line = F.concat(F.lit(" "), F.col("_w"), F.lit(" "))
    whole = met.where(_in_order(line, F.col("_c"))).select(key, "table", "row", "_i").distinct().withColumn("_intact", F.lit(1))
    known = readings.where(F.trim(tx.empty_as(F.col("text"))) != "").select(key).distinct()
    return grid.join(known, key).join(whole, [key, "table", "row", "_i"], "left").groupBy(key, "table").agg(F.sum(F.coalesce("_intact", F.lit(0))).alias("intact"), F.count("*").alias("compared"))


def _in_order(line: Column, cells: Column) -> Column:
    """Whether a line holds the cells one after another as whole words; what has been passed is cut off step by step."""
    after = lambda rest, c: F.when(rest.contains(F.concat(F.lit(" "), c, F.lit(" "))), F.concat(F.lit(" "), F.substring(rest, F.position(F.concat(F.lit(" "), c, F.lit(" ")), rest) + F.length(c) + 2, F.length(rest)))).otherwise(F.lit(None))
    return F.aggregate(cells, line, after).isNotNull()
