"""Tables out of pipe lines and HTML, and whether their rows survive in readings."""

from textora.operators import layout, tables


def test_pipe_tables_are_islands_of_lines(spark):
    text = "intro\n| a | b |\n|---|:---:|\n| 1 | |\n| 2 | x\\y |\nend\n| no | rule |\n\n| h |\n| --- |\n| only |\n---\n| c | d | e |\n| --- | --- | --- |"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "| a | b |")], "doc_id long, text string")
    cells = tables.pipe_cells(docs)
    got = {}
    for r in cells.orderBy("table", "row", "column").collect():
        got.setdefault((r.doc_id, r.table), {}).setdefault(r.row, []).append(r.text)
    assert got[1, 0] == {0: ["a", "b"], 1: ["1", ""], 2: ["2", "x\\y"]} and got[1, 1] == {0: ["h"], 1: ["only"]}
    assert [tuple(r) for r in tables.shapes(cells).collect()] == [(1, 0, 3, 2, 1, 0)]


def test_spanning_cells_take_places_below(spark):
    html = """<table><thead><tr><th rowspan=2>Name</th><th colspan=2>Year</th></tr><tr><th>one</th><th>two</th></tr></thead>
      <tr><td>Ann<td>1<td>2</tr><tr><td>Bob</td><td colspan="x">3</td><td>4 <table><tr><td>in</td></tr></table></td></tr></table><table><tr><td>x</td></tr></table>"""
    cells = tables.html_cells(spark.createDataFrame([(1, html), (2, None), (3, "<td>stray")], "page_id long, html string"))
    grid = {(r.table, r.row, r.column): (r.text, r.rowspan, r.colspan) for r in cells.collect()}
    assert grid[0, 0, 0] == ("Name", 2, 1) and grid[0, 0, 1] == ("Year", 1, 2) and grid[0, 1, 1][0] == "one" and grid[0, 1, 2][0] == "two"
    assert grid[0, 3, 2][0] == "4" and grid[1, 0, 0][0] == "in" and grid[2, 0, 0][0] == "x"
    assert [tuple(r) for r in tables.shapes(cells, "page_id").collect()] == [(1, 0, 4, 3, 2, 2)]


def test_rows_survive_or_break(spark):
    """The cases of a grid against readings: intact, a cell a line, a cell inside another word, order, stacked cells."""
    grid = {0: ["Supplier", "Rating"], 1: ["Acme Ltd", "B"], 2: ["alone", ""], 3: ["p\nq", "1\n2"], 4: ["Ｆull", "width"]}
    rows = [(d, 0, r, c, t) for d in (1, 2, 3, 4, 5) for r, line in grid.items() for c, t in enumerate(line)]
    cells = spark.createDataFrame(rows, "doc_id long, table int, row int, column int, text string")
    readings = [
        (1, "supplier   RATING\n| Acme Ltd | B |\nalone\np 1\nq 2\nfull width"), (2, "Supplier\nRating\nAcme Ltd\nB\np\n1\nq\n2"), (3, "Rating Supplier\nAcme Ltd Bank\np 2\nq 1"), (4, None),
        (6, "Supplier Rating"),
    ]
    got = {r.doc_id: (r.intact, r.compared) for r in tables.fidelity(cells, spark.createDataFrame(readings, "doc_id long, text string")).collect()}
    assert got == {1: (5, 5), 2: (0, 5), 3: (0, 5)}
    signals = layout.table_signals(spark.createDataFrame([(1, 5, 5, 2, 3), (1, 0, 5, 1, 0)], "doc_id long, intact long, compared long, header_depth int, merged int")).collect()
    assert {r.signal: r.value for r in signals} == {"table_fidelity": 50.0, "table_max_header_depth": 2.0, "table_merged_cells": 3.0}
