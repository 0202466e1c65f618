"""Span trees, as-of values, sketches, stretches of text, areas and readings against brute force, with odd rows."""

import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textora import fixed
from textora.functions import align
from textora.operators import asof, chunks, facts, findings, identifiers, layout, rollups, sketches, spans, trace
from textora.plans import catalog


def test_chains_end_in_log_rounds(spark):
    """A chain of 10,000, a tree, a parent that is not there; a cycle is an error."""
    rows = [(k, k - 1 if k else None) for k in range(10_000)] + [(20_000 + k, 20_000 + (k - 1) // 2 if k else 19_999) for k in range(100)]
    got = {r.span: (r.root, r.depth) for r in trace.depths(spark.createDataFrame(rows, "span long, parent long").repartition(4)).collect()}
    parent, want = dict(rows), {}
    for k in sorted(parent):
        want[k] = (want[parent[k]][0], want[parent[k]][1] + 1) if parent[k] in parent else (k, 0)
    assert got == want
    assert trace.depths(spark.createDataFrame([], "span long, parent long")).count() == 0


def test_ancestors_and_cycles(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.randrange(k) if k and rng.random() < 0.95 else None) for k in range(300)] + [(999, 12345)]
    parent, want = dict(rows), set()
    for k in parent:
        up, d = parent[k], 1
        while up in parent:
            want.add((k, up, d))
            up, d = parent[up], d + 1
    frame = spark.createDataFrame(rows, "span long, parent long")
    assert {tuple(r) for r in trace.ancestors(frame).collect()} == want
    monkeypatch.setattr(trace, "ROUNDS", 6)
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 2)], "span long, parent long")
    for f in (trace.depths, trace.ancestors):
        with pytest.raises(ValueError, match="own ancestors"):
            f(ring).collect()


def test_as_of_over_ranges(spark):
    """One hot key over many ranges, ties, nulls on both sides, rows before any fact."""
    rng = random.Random(5)
    prices = [("hot", rng.randrange(1000), float(k)) for k in range(400)] + [("b", 10, 1.0), ("b", 10, 2.0), (None, 5, 9.0), ("c", None, 3.0)]
    rows = [(k, "hot" if k % 3 else "b", rng.randrange(-50, 1000), "old") for k in range(600)] + [(900, None, 5, "x"), (901, "c", 7, None), (902, "hot", None, None)]
    left, right = spark.createDataFrame(rows, "n long, k string, t int, price string").repartition(3), spark.createDataFrame(prices, "k string, t int, price double")
    got = {r.n: r.price for r in asof.as_of(left, right, "k", "t", ("price",)).collect()}
    want = {n: max(((pt, p) for pk, pt, p in prices if None not in (k, t, pk, pt) and pk == k and pt <= t), default=(0, None))[1] for n, k, t, _ in rows}
    assert got == want and len(got) == len(rows)


def test_sketches_merge(spark):
    rows = spark.range(40_000).select((F.col("id") % 4).alias("day"), (F.col("id") % 7_000).alias("who"), (F.col("id") % 1000).cast("double").alias("size"))
    daily = sketches.sketched(rows, "day", distinct="who", number="size")
    one = sketches.read_off(sketches.merged(daily.withColumn("all", F.lit(1)), "all"), "all").first()
    assert one.n == 40_000 and abs(one.distinct - 7000) < 0.05 * 7000 and abs(one.q50 - 500) < 25 and abs(one.q95 - 950) < 25
    empty = sketches.read_off(sketches.sketched(rows.limit(0), "day", distinct="who", number="size"), "day")
    assert empty.count() == 0


def test_unions_and_complements_of_stretches(spark):
    rng = random.Random(9)
    texts = [(k, "x" * n) for k, n in enumerate((0, 1, 40, 100, 100))] + [(7, None), (8, "y" * 30)]
    found = [(k, a, a + rng.randrange(0, 12)) for k in (2, 3, 4, 5) for a in (rng.randrange(0, 100) for _ in range(15))] + [(3, None, 5), (None, 1, 3), (None, 2, 6)]
    cover = {}
    for k, a, b in found:
        cover.setdefault(k, set()).update(range(a, b) if a is not None else ())
    runs = lambda places: [(a, b) for a, b in zip([p for p in sorted(places) if p - 1 not in places], [p + 1 for p in sorted(places) if p + 1 not in places], strict=True)]
    made = spark.createDataFrame(found, "doc_id int, start int, end int")
    assert sorted(((r.doc_id or -1), r.start, r.end) for r in spans.merged(made, "doc_id").collect()) == sorted((k or -1, a, b) for k, p in cover.items() for a, b in runs(p))
    left = spans.uncovered(spark.createDataFrame(texts, "doc_id int, text string"), made).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in left) == sorted((k, a, b) for k, t in texts if t for a, b in runs(set(range(len(t))) - cover.get(k, set())))


def test_lines_sentences_and_paragraphs(spark):
    docs = spark.createDataFrame([(1, "né\n\nab 1\n"), (2, ""), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, spans.line_spans(docs).collect())) == [(1, 0, 0, 2, "né"), (1, 1, 3, 3, ""), (1, 2, 4, 8, "ab 1"), (1, 3, 9, 9, ""), (2, 0, 0, 0, "")]
    cases = {"One. Two is here! Three": ("Two", "Two is here!"), "no end here": ("end", "no end here"), "line\nnext one\nlast": ("next", "next one"), "a" * 300 + " mid " + "b" * 300: ("mid", None)}
    rows = spark.createDataFrame([(t, t.index(w), t.index(w) + len(w)) for t, (w, _) in cases.items()], "text string, a int, b int")
    for r in rows.select("text", "a", "b", spans.sentence_around(F.col("text"), F.col("a"), F.col("b")).alias("s")).collect():
        want = cases[r.text][1]
        assert r.text[r.s.start : r.s.end] == want if want else (r.s.end - r.s.start == 240 and r.s.start == r.a - 80)
    left = spans.paragraphs_left(docs, spark.createDataFrame([(1, 0, 4)], "doc_id int, start int, end int"))
    assert [tuple(r) for r in left.collect()] == [(1, 4, 9, "ab 1\n")]


def test_area_of_boxes(spark):
    """Boxes on a grid against cells; empty, null and touching ones; null pages."""
    rng = random.Random(11)
    boxes = [(p, *(rng.randrange(0, 20) for _ in range(4))) for p in (1, 2, None) for _ in range(25)] + [(3, 0, 0, 0, 5), (4, None, 0, 5, 5), (5, 0, 0, 10, 10), (5, 10, 0, 20, 10), (5, 0, 0, 10, 10)]
    want = {}
    for p, x0, y0, x1, y1 in boxes:
        if x0 is not None and x0 < x1 and y0 < y1:
            want.setdefault(p, set()).update((x, y) for x in range(x0, x1) for y in range(y0, y1))
    got = layout.covered_area(spark.createDataFrame(boxes, "page int, x0 int, y0 int, x1 int, y1 int"), "page").collect()
    assert {r.page: r.area for r in got} == {p: float(len(c)) for p, c in want.items()}


def test_readings_are_aligned(monkeypatch):
    """Short readings as difflib has them; long ones by anchors, never more than WHOLE words of each at a time."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(3000)}" for _ in range(6000)]
    lost = [w for i, w in enumerate(words) if i % 10]
    assert align.similarity(words[:900], lost[:800]) == round(SequenceMatcher(None, words[:900], lost[:800], autojunk=False).ratio(), 4)
    sizes, real = [], SequenceMatcher
    monkeypatch.setattr(align, "SequenceMatcher", lambda x, a, b, autojunk: sizes.append(len(a) + len(b)) or real(x, a, b, autojunk=autojunk))
    assert align.similarity(words, lost) == round(2 * len(lost) / (len(words) + len(lost)), 4)
    assert align.similarity(["a", "b"] * 5000, ["b", "a"] * 5000) == round(2 * 9999 / 20000, 4)
    assert align.matched(words, [f"v{i}" for i in range(6000)]) == 0
    assert max(sizes, default=0) <= 2 * align.WHOLE
    assert (align.similarity([], []), align.similarity(["a"], []), align.similarity(["a"], ["a"])) == (1.0, 0.0, 1.0)
    assert align.rising([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def test_null_keys_are_keys(spark):
    pages = spark.createDataFrame([("x secret y", None, 1), ("x secret y", 2, None), ("x secret", 3, 1)], "text string, doc_id long, page int")
    values = spark.createDataFrame([(None, 1, "secret"), (2, None, "secret"), (3, 1, None)], "doc_id long, page int, value string")
    assert sorted(r.text for r in findings.carried(pages, values).collect()) == ["x secret", "x •••••• y", "x •••••• y"]
    asked = spark.createDataFrame([(1, "text"), (2, "absent")], "fact int, kind string")
    found = spark.createDataFrame([(1, None), (2, "a")], "fact int, reader string")
    got = {(r.fact, r.reader): r.passed for r in facts.results(asked, found, found.select("reader")).collect()}
    assert got == {(1, None): True, (1, "a"): False, (2, None): True, (2, "a"): False}
    rows = spark.createDataFrame([(None, "l", 1, 1, 10, 1.0), ("pdf", "l", 2, 1, 10, 0.5)], "format string, loader string, doc_id int, pages int, chars int, similarity double")
    assert {(r.format, r.all_formats): r.documents for r in rollups.by_format(rows).collect()} == {(None, False): 1, ("pdf", False): 1, (None, True): 2}
    made = spark.createDataFrame([(None, 0, "the same text"), (1, 0, "the same text"), (None, 1, "Other words"), (None, 1, "and lower")], "doc_id long, chunk int, text string")
    flags = {(r.doc_id, r.text): r.duplicate for r in chunks.inspected(made).collect()}
    assert flags[(1, "the same text")] is False and flags[(None, "the same text")] is True


def test_identifiers_read_pages_once(spark):
    plan = identifiers.scan(spark.createDataFrame([(1, "mail bob@example.org")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_verified_pages_are_counted(spark):
    pages = spark.createDataFrame([(1, "agrees", 0.1), (1, "disagrees", 0.2), (1, "not_rendered", None), (2, "filled", None), (2, "odd", 0.0), (2, None, None)], "doc_id long, status string, usd double")
    documents = spark.createDataFrame([(1, 4), (2, 3), (9, 100)], "doc_id long, pages int")
    got = rollups.verification(pages, documents).collect()
    assert [(r.documents, r.pages_total, r.pages_checked, r.pages_agrees, r.pages_disagrees, r.pages_filled, r.pages_failed, r.pages_not_rendered, r.usd) for r in got] == [(2, 7, 4, 1, 1, 1, 0, 1, 0.3)]
    assert rollups.verification(pages.limit(0), documents).count() == 0


def test_values_beyond_a_million_are_found(spark, tmp_path):
    spark.createDataFrame([(9, 1_200_000), (10, 1200)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(400_000,), (400,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(catalog.queries()["value_places"](spark, str(tmp_path)).collect()) == [(400, 10), (400_000, 9)]


@pytest.mark.parametrize("block", [1, 1 << 17])
def test_bm25_in_blocks_equals_a_sum_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(chunks, "BLOCK", block)
    texts = [(i, i % 3, " ".join(("tea", "milk", "jam", "salt")[(i * j) % 4] for j in range(1 + i % 5))) for i in range(40)] + [(40, 0, None), (None, 1, "jam tea")]
    asked = [("a", "tea or jam, jam"), ("b", "salt"), ("c", "nothing"), (None, "milk tea")]
    words = [(d, c, (t or "").split()) for d, c, t in texts]
    mean, want = sum(len(w) for *_, w in words) / len(words), {}
    for q, text in asked:
        for d, c, w in words:
            for term in {*text.replace(",", "").split()} & {*w}:
                df = sum(term in x for *_, x in words)
                norm = w.count(term) + 1.5 * (0.25 + 0.75 * len(w) / mean)
                want[q, d, c] = want.get((q, d, c), 0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * w.count(term) * 2.5 / norm
    docs, questions = spark.createDataFrame(texts, "doc_id long, chunk int, text string"), spark.createDataFrame(asked, "question string, query string")
    scores = chunks.bm25(docs, questions)
    assert {(r.question, r.doc_id, r.chunk): r.score for r in scores.collect()} == pytest.approx(want, abs=1e-9)
    best = [chunks.ranked(x).collect() for x in (scores, chunks.bm25(docs, questions, top=5))]
    assert sorted(best[0], key=str) == sorted(best[1], key=str)
    assert "hashpartitioning" not in scores._jdf.queryExecution().executedPlan().toString()  # scores are added up in a chunk's row


def test_categories_that_need_a_digit_are_not_tried_without_one():
    tried = []

    class Pattern:
        groupindex: dict = {}

        def finditer(self, page):
            tried.append(page)
            return iter(())

    list(identifiers._matches("an address in a street", [("street_address", [Pattern()], [], ["address"])]))
    assert not tried
    found = identifiers._matches("at 12 High Street", [(c[0], [re.compile(p, re.I) for p in c[5]], [], []) for c in fixed.CATEGORIES if c[0] == "street_address"])
    assert [m[0] for m in found] == ["street_address"]
