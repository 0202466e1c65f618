"""Registered queries of roll-ups, layout signals, facts and listings, and their SQL; bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textora.functions import text as tx
from textora.operators import chunks, costs, facts, findings, layout, rollups
from textora.plans.catalog import _LINES, _SIGNALS, _chunks, _page_rows, _scores, query

_ADDRESS = r"[a-zA-Z0-9._]+@[a-zA-Z0-9.]+"


@query(rf"""WITH {_SIGNALS}, t AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END AS unreadable, len(regexp_extract_all(coalesce(text, ''), '{_ADDRESS}')) AS identifiers, len(regexp_extract_all(coalesce(text, ''), 'http')) AS findings FROM documents)
SELECT count(*) AS documents, count(*) AS pages, sum(unreadable)::BIGINT AS unreadable, round_even(avg(score::DECIMAL(28,6))::DOUBLE, 1) AS mean_score, count(CASE WHEN score >= 75 THEN 1 END) AS ready, count(CASE WHEN score >= 50 AND score < 75 THEN 1 END) AS workable,
count(CASE WHEN score >= 25 AND score < 50 THEN 1 END) AS needs_work, count(CASE WHEN score < 25 THEN 1 END) AS not_ready, sum(identifiers)::BIGINT AS identifiers, count(CASE WHEN identifiers > 0 THEN 1 END) AS with_identifiers,
sum(findings)::BIGINT AS findings, count(CASE WHEN findings > 0 THEN 1 END) AS with_findings FROM scores JOIN t USING (doc_id)""")
def folder_summary(read):
    text = tx.empty_as(F.col("text"))
    rows = read("documents").select("doc_id", F.lit(1).alias("pages"), (F.trim(text) == "").cast("int").alias("unreadable"), tx.count_of(text, _ADDRESS).alias("identifiers"), tx.count_of(text, "http").alias("findings"))
    return rollups.folder(_scores(read).select("doc_id", "score").join(rows, "doc_id"))


@query("SELECT event_type AS category, CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS severity, count(*) AS findings, count(DISTINCT user_id) AS documents FROM events GROUP BY ALL")
def findings_tally(read):
    found = read("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("category"), F.when(F.col("value") > 300, "high").when(F.col("value") > 100, "medium").otherwise("low").alias("severity"))
    return rollups.tally(found, "category", "severity")


@query("""SELECT event_type AS instruction, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS visible, count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS hidden, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS smuggled FROM events GROUP BY event_type""")
def content_matrix(read):
    kind = F.element_at(F.array(*map(F.lit, ("visible", "hidden", "smuggled"))), (F.col("event_id") % 3 + 1).cast("int"))
    return rollups.content_matrix(read("events").select(F.col("event_type").alias("instruction"), kind.alias("visibility")))


_TIMES = "t AS (SELECT sum(value::DECIMAL(28,6))::DOUBLE AS total, count(value) AS measured, sum(user_id % 7) AS pages FROM events WHERE value IS NOT NULL OR true)"


@query(f"""WITH {_TIMES} SELECT measured, round_even(total, 3) AS total_seconds, round_even(total / measured, 3) AS seconds_per_document, round_even(total / pages, 3) AS seconds_per_page, round_even(total / measured * 1000 / 3600, 2) AS hours_per_1000 FROM t""")
def audit_timings(read):
    return rollups.timings(read("events").select("event_id", F.col("value").alias("seconds"), (F.col("user_id") % 7).alias("pages"))).drop("mean")


@query(f"""WITH {_TIMES} SELECT n AS documents, round_even(total / measured * n, 1) AS seconds FROM t, (VALUES (100), (1000), (10000), (100000)) v(n)""")
def projected_seconds(read):
    return rollups.projected(rollups.timings(read("events").select("event_id", F.col("value").alias("seconds"), (F.col("user_id") % 7).alias("pages"))))


@query("""SELECT conv_id AS doc_id, role AS extractor, sum(length(coalesce(text, '')))::BIGINT AS chars, round_even(sum((turn / 8.0)::DECIMAL(28,6))::DOUBLE, 3) AS seconds, round_even(avg(((turn % 4) / 4.0)::DECIMAL(28,6))::DOUBLE, 4) AS coverage,
min((conv_id % 8) / 8.0::DOUBLE) AS similarity, bool_and(turn % 2 = 0) AS reordered FROM conversations GROUP BY ALL""")
def extractor_totals(read):
    eighth = lambda c, n: (c / F.lit(float(n)))
    rows = read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("extractor"), F.length(tx.empty_as(F.col("text"))).alias("chars"), eighth(F.col("turn"), 8).alias("seconds"), eighth(F.col("turn") % 4, 4).alias("coverage"), eighth(F.col("conv_id") % 8, 8).alias("similarity"), (F.col("turn") % 2 == 0).alias("reordered"))
    return rollups.extractor_totals(rows)


@query("""
WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, turn % 3 = 0 AS vision, CASE WHEN turn % 6 = 0 THEN 842.0 ELSE 595.0 END::DOUBLE AS w FROM conversations),
s AS (SELECT *, round_even(w / 842.0 * 2048, 0) AS px FROM p), v AS (SELECT *, round_even(least(px * 2048 / 750.0, 1600.0), 0) AS seen FROM s),
d AS (SELECT conv_id, sum(chars) AS chars, coalesce(sum(CASE WHEN NOT vision THEN chars END), 0) AS read, coalesce(sum(CASE WHEN vision THEN seen END), 0.0) AS seen FROM v GROUP BY conv_id)
SELECT conv_id AS doc_id, round((coalesce(round_even(round_even(chars / 4.0::DOUBLE, 0) * 1.0::DOUBLE, 0) * (CASE WHEN chars > 0 THEN read::DOUBLE / chars END), 0.0) + seen) * 3.0::DOUBLE / 1e6, 10) AS usd FROM d""")
def routed_costs(read):
    pages = read("conversations").select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("turn") % 6 == 0, 842.0).otherwise(595.0).alias("width"), F.lit(842.0).alias("height"), F.when(F.col("turn") % 3 == 0, "vision").otherwise("text").alias("route"))
    return rollups.routed_costs(pages, costs.EXAMPLE_MODELS[1])


@query("""
SELECT lang AS format, source AS loader, count(DISTINCT doc_id) AS documents, sum(doc_id % 5)::BIGINT AS pages, sum(n_chars)::BIGINT AS chars, round_even(avg(((doc_id % 4) / 4.0)::DECIMAL(28,6))::DOUBLE, 4) AS similarity FROM documents GROUP BY GROUPING SETS ((lang, source), (source))""")
def formats_by_loader(read):
    rows = read("documents").select(F.col("lang").alias("format"), F.col("source").alias("loader"), "doc_id", (F.col("doc_id") % 5).alias("pages"), F.col("n_chars").alias("chars"), ((F.col("doc_id") % 4) / 4.0).alias("similarity"))
    return rollups.by_format(rows).drop("all_formats")


@query("SELECT role AS stage, conv_id % 4 AS fingerprint, count(*) AS occurrences, count(DISTINCT conv_id) AS items FROM conversations GROUP BY ALL")
def stage_identifiers(read):
    return rollups.stage_identifiers(read("conversations").select(F.col("role").alias("stage"), (F.col("conv_id") % 4).alias("fingerprint"), F.col("conv_id").alias("item")))


@query(r"""
WITH i AS (SELECT conv_id AS source, turn AS n, CASE WHEN conv_id % 5 = 0 OR (conv_id % 3 = 0 AND turn % 2 = 1) THEN '' WHEN conv_id % 7 = 1 THEN repeat('�', 40) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM conversations),
g AS (SELECT source, count(*) AS items, count(CASE WHEN trim(text) = '' THEN 1 END) AS empty, string_agg(text, chr(10) ORDER BY n) AS t FROM i GROUP BY source),
r AS (SELECT *, CASE WHEN length(t) >= 200 THEN round_even((len(regexp_extract_all(t, '\x{FFFD}')) + len(regexp_extract_all(t, '[\x{FB00}-\x{FB06}]')) + len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) >= 15 AND regexp_matches(w, '\p{L}')
  AND (len(regexp_extract_all(w, '\p{Ll}\p{Lu}')) >= 2 OR (length(w) >= 25 AND regexp_full_match(w, '\p{L}+')))))) / length(t) * 1000, 2) END AS rate FROM g)
SELECT source, 'empty_document' AS warning, 1::BIGINT AS n FROM r WHERE empty = items UNION ALL SELECT source, 'empty_pages', empty FROM r WHERE empty > 0 AND empty < items UNION ALL SELECT source, 'garbled', 1 FROM r WHERE rate >= 5""")
def load_warnings(read):
    text = F.when((F.col("conv_id") % 5 == 0) | ((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 1)), "").when(F.col("conv_id") % 7 == 1, F.concat(F.lit("�" * 40), tx.empty_as(F.col("text")))).otherwise(tx.empty_as(F.col("text")))
    return rollups.load_warnings(read("conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("n"), text.alias("text")))


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, tokens < 20 AS tiny, tokens > 512 AS oversized FROM chunks)
SELECT 'tiny_chunks' AS warning, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM f WHERE tiny HAVING count(*) > 0 UNION ALL SELECT 'oversized_chunks', count(*), count(DISTINCT doc_id) FROM f WHERE oversized HAVING count(*) > 0""")
def chunk_warnings(read):
    tokens = tx.estimated_tokens(F.col("text"))
    return rollups.chunk_warnings(_chunks(read).select("doc_id", (tokens < 20).alias("tiny"), (tokens > 512).alias("oversized"), F.lit(False).alias("duplicate")))


@query("""WITH i AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END AS t FROM documents)
SELECT 'empty_texts' AS warning, count(*) AS texts, count(DISTINCT source) AS documents FROM i WHERE trim(t) = '' HAVING count(*) > 0
UNION ALL SELECT 'over_token_limit', count(*), count(DISTINCT source) FROM i WHERE round_even(length(t) / 4.0::DOUBLE, 0) > 8191 HAVING count(*) > 0""")
def sent_warnings(read):
    return rollups.sent_warnings(read("documents").select("source", F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("").alias("text")), "text-embedding-3-small")


@query("""WITH t AS (SELECT lang AS model, sum(round_even(length(coalesce(text, '')) / 4.0::DOUBLE, 0)::BIGINT)::BIGINT AS tokens FROM documents GROUP BY lang)
SELECT model, tokens, round(tokens * CASE model WHEN 'en' THEN 0.02 WHEN 'de' THEN 0.13 WHEN 'fr' THEN 0.0 END::DOUBLE / 1e6, 10) AS usd FROM t""")
def embedding_costs(read):
    return rollups.embedding_costs(read("documents").select(F.col("lang").alias("model"), "text"), {"en": 0.02, "de": 0.13}, local=("fr",))


@query("SELECT label, len(embedding)::INTEGER AS dims, count(*) AS vectors FROM embeddings GROUP BY ALL")
def vector_shapes(read):
    return rollups.vector_shapes(read("embeddings"), "label")


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' AND doc_id % 4 > 0 AND doc_id % 6 > 0 THEN 'unread' WHEN doc_id % 6 = 0 OR doc_id % 8 = 0 THEN 'stop' WHEN doc_id % 4 = 0 THEN 'careful' ELSE 'ready' END AS verdict FROM documents""")
def document_verdicts(read):
    n = lambda k: (F.col("doc_id") % k == 0).cast("int")
    return rollups.verdicts(read("documents").select("doc_id", n(4).alias("identifiers"), n(8).alias("high"), n(6).alias("hidden"), (F.trim(tx.empty_as(F.col("text"))) == "").alias("unread"))).select("doc_id", "verdict")


@query("""SELECT doc_id, substr(text, greatest(strpos(lower(text), 'the') - 81, 0) + 1, strpos(lower(text), 'the') - 1 + 160 - greatest(strpos(lower(text), 'the') - 81, 0)) AS snippet FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')""")
def word_search(read):
    return rollups.search(read("documents"), "The and")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def second_page(read):
    return rollups.page_of(read("documents").select("doc_id", "n_chars"), F.desc("n_chars"), "doc_id", page=2)


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3")
def newest_events(read):
    return rollups.newest(read("events"), "event_type", "ts", 3, "event_id").select("event_id", "event_type")


@query("SELECT event_id, date_diff('day', ts::DATE, DATE '2024-06-01')::INTEGER AS days, date_diff('day', ts::DATE, DATE '2024-06-01') > 90 AS stale FROM events")
def stale_prices(read):
    return rollups.stale(read("events").select("event_id", F.col("ts").cast("date").alias("day")), "day", F.lit("2024-06-01").cast("date")).select("event_id", "days", "stale")


@query("""WITH s AS (SELECT text, min(source) AS source FROM (SELECT text, source FROM documents WHERE doc_id % 2 = 0 AND lang = (SELECT min(lang) FROM documents d WHERE d.text = documents.text AND d.doc_id % 2 = 0)) GROUP BY text)
SELECT doc_id AS item, s.source FROM documents LEFT JOIN s USING (text)""")
def text_origins(read):
    docs = read("documents")
    return rollups.origins(docs.select(F.col("doc_id").alias("item"), "text"), docs.where("doc_id % 2 = 0").select(F.col("lang").alias("stage"), "source", "text")).select("item", "source")


_SPANS = "f AS (SELECT l_orderkey AS doc_id, l_linenumber, (l_partkey % 900)::BIGINT AS s, (l_partkey % 900 + l_suppkey % 40)::BIGINT AS e FROM lineitem WHERE l_linenumber % 2 = 1), r AS (SELECT l_orderkey AS doc_id, (l_suppkey * 13 % 900)::BIGINT AS s, (l_suppkey * 13 % 900 + 300)::BIGINT AS e FROM lineitem WHERE l_linenumber % 2 = 0)"


@query(f"WITH {_SPANS} SELECT doc_id, s AS start, e AS end_ FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND f.s < r.e AND r.s < f.e)")
def silent_finds(read):
    lines = read("lineitem")
    found = lines.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 900).alias("start"), (F.col("l_partkey") % 900 + F.col("l_suppkey") % 40).alias("end"))
    reported = lines.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") * 13 % 900).alias("start"), (F.col("l_suppkey") * 13 % 900 + 300).alias("end"))
    return rollups.untouched(found, reported).select("doc_id", "start", F.col("end").alias("end_"))


def _signal_sql(measured: dict[str, str], source: str) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS signal, ({v})::DOUBLE AS value FROM g" for k, v in measured.items())
    return f"WITH {source}, u AS ({each}) SELECT *, CASE WHEN value IS NULL THEN 'not_applicable' ELSE 'measured' END AS status FROM u"


@query(_signal_sql(
    {"text_layer_coverage_pct": "round_even(avg(text::DECIMAL(18,6))::DOUBLE * 100, 2)", "image_area_ratio_pct": "round_even(avg(image::DECIMAL(18,6))::DOUBLE * 100, 2)", "page_rotation": "max(abs(rotation) % 360)", "ocr_confidence": "round_even(min(confidence) * 100, 2)", "scan_dpi": "min(CASE WHEN image >= 0.5 THEN dpi END)", "page_size_variance": "count(DISTINCT w)"},
    "g AS (SELECT conv_id AS doc_id, (turn % 5) / 4.0::DOUBLE AS text, (turn % 3) / 2.0::DOUBLE AS image, (turn * 90) % 450 AS rotation, CASE WHEN conv_id % 2 = 0 THEN (turn % 8) / 8.0::DOUBLE END AS confidence, 72 + turn * 10 AS dpi, turn % 2 AS w FROM conversations)",
).replace(" FROM g", " FROM g GROUP BY doc_id"))
def page_layout_signals(read):
    t, doc = F.col("turn"), F.col("conv_id")
    pages = read("conversations").select(doc.alias("doc_id"), (595.2 + t % 2).alias("width"), F.lit(842.0).alias("height"), ((t * 90) % 450).alias("rotation"), ((t % 5) / 4.0).alias("text_share"), ((t % 3) / 2.0).alias("image_share"), F.when(doc % 2 == 0, (t % 8) / 8.0).alias("confidence"), (72 + t * 10).alias("dpi"))
    return layout.page_signals(pages)


@query(_signal_sql({"table_fidelity": "round_even(sum(intact) / sum(compared)::DOUBLE * 100, 2)", "table_max_header_depth": "max(depth)", "table_merged_cells": "sum(merged)"}, "g AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS intact, CASE WHEN l_linenumber % 4 > 0 THEN 4 END AS compared, l_suppkey % 4 AS depth, l_partkey % 3 AS merged FROM lineitem)").replace(" FROM g", " FROM g GROUP BY doc_id"))
def ruled_table_signals(read):
    n = F.col("l_linenumber")
    return layout.table_signals(read("lineitem").select(F.col("l_orderkey").alias("doc_id"), (n % 3).alias("intact"), F.when(n % 4 > 0, 4).alias("compared"), (F.col("l_suppkey") % 4).alias("header_depth"), (F.col("l_partkey") % 3).alias("merged")))


@query(_signal_sql({"font_count": "count(DISTINCT font)", "fonts_embedded": "CASE WHEN count(embedded) > 0 THEN bool_and(embedded)::INTEGER END"}, "g AS (SELECT l_orderkey AS doc_id, l_suppkey % 9 AS font, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 5 > 0 END AS embedded FROM lineitem)").replace(" FROM g", " FROM g GROUP BY doc_id"))
def font_signals(read):
    return layout.font_signals(read("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 9).alias("font"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey") % 5 > 0).alias("embedded")))


@query(_signal_sql({"encrypted": "encrypted::INTEGER", "acroform_fields": "fields"}, "g AS (SELECT doc_id, doc_id % 7 = 0 AS encrypted, CASE WHEN doc_id % 3 > 0 THEN doc_id % 11 END AS fields FROM documents)"))
def file_signals(read):
    doc = F.col("doc_id")
    return layout.file_signals(read("documents").select("doc_id", (doc % 7 == 0).alias("encrypted"), F.when(doc % 3 > 0, doc % 11).alias("form_fields")))


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN round_even(p_partkey / (p_size / 72.0::DOUBLE), 0) END AS dpi FROM part")
def picture_dpi(read):
    return read("part").select("p_partkey", layout.estimated_dpi(F.col("p_partkey"), F.col("p_size")).alias("dpi"))


_PLAIN_VALUES = r"""n AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b(\d+)\b')) AS t FROM (SELECT o_orderkey AS doc_id, 'total ' || o_custkey || ' of ' || o_orderkey AS text FROM orders))"""


@query(f"WITH {_PLAIN_VALUES} SELECT DISTINCT p_partkey AS fact, doc_id FROM n JOIN part ON t::BIGINT = p_partkey * 3")
def value_places(read):
    pages = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("total "), F.col("o_custkey"), F.lit(" of "), F.col("o_orderkey")).alias("text"))
    value = F.col("p_partkey") * 3
    grouped = F.translate(F.format_number(value, 0), ",", "'")
    return facts.values_found(pages, read("part").select(F.col("p_partkey").alias("fact"), F.concat(F.lit("EUR "), grouped).alias("value")))


_RESULTS = """WITH f AS (SELECT item_id AS fact, CASE item_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'value' ELSE 'absent' END AS kind FROM benchmark), r AS (SELECT DISTINCT lang AS reader FROM documents),
h AS (SELECT DISTINCT doc_id % 40 AS fact, lang AS reader FROM documents WHERE doc_id % 5 = 0),
res AS (SELECT f.fact, r.reader, kind, (h.fact IS NOT NULL) <> (kind = 'absent') AS passed FROM f CROSS JOIN r LEFT JOIN h ON h.fact = f.fact AND h.reader = r.reader)"""


@query(f"{_RESULTS} SELECT * FROM res")
def fact_results(read):
    kind = F.when(F.col("item_id") % 3 == 0, "text").when(F.col("item_id") % 3 == 1, "value").otherwise("absent")
    docs = read("documents")
    return facts.results(read("benchmark").select(F.col("item_id").alias("fact"), kind.alias("kind")), docs.where("doc_id % 5 = 0").select((F.col("doc_id") % 40).alias("fact"), F.col("lang").alias("reader")), docs.select(F.col("lang").alias("reader")))


@query(f"{_RESULTS} SELECT reader, kind, count(CASE WHEN passed THEN 1 END) AS passed, count(*) AS facts, round_even(count(CASE WHEN passed THEN 1 END) / count(*), 4) AS share FROM res GROUP BY reader, kind")
def fact_scores(read):
    return facts.scores(fact_results(read))


@query()
def near_facts(read):
    return facts.near_texts(read("documents"), read("benchmark").select(F.col("item_id").alias("fact"), "text"))


@query(f"""WITH {_LINES}, whole AS (SELECT doc_id, 0 AS chunk, text, round_even(length(text) / 4.0::DOUBLE, 0)::BIGINT AS tokens FROM documents WHERE trim(coalesce(text, '')) <> ''),
u AS (SELECT 'lines' AS chunker, doc_id, chunk, text, tokens FROM chunks UNION ALL SELECT 'whole', doc_id, chunk, text, tokens FROM whole),
p AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM u), d AS (SELECT *, row_number() OVER (PARTITION BY chunker, plain ORDER BY doc_id, chunk) AS r FROM p)
SELECT chunker, count(*) AS chunks, count(CASE WHEN tokens < 20 THEN 1 END) AS tiny, count(CASE WHEN tokens > 512 THEN 1 END) AS oversized, count(CASE WHEN r > 1 AND plain <> '' THEN 1 END) AS duplicate FROM d GROUP BY chunker""")
def chunker_comparison(read):
    whole = read("documents").where(F.trim(tx.empty_as(F.col("text"))) != "").select("doc_id", F.lit(0).alias("chunk"), "text")
    return chunks.compared({"lines": _chunks(read), "whole": whole}).select("chunker", "chunks", "tiny", "oversized", "duplicate")


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {'chunk': i - 1, 'text': x, 'start': coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i - 1], lambda y: length(y) + 1)), 0)}) AS a FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(a) AS c FROM l) SELECT doc_id, c.chunk::INTEGER AS chunk, c.start::BIGINT AS line_start FROM x WHERE trim(c.text) <> ''""")
def line_starts(read):
    docs = read("documents").where("text is not null")
    before = F.aggregate(F.slice(F.split("text", "\n"), F.lit(1), F.col("chunk")), F.lit(0).cast("long"), lambda a, y: a + F.length(y) + 1)
    return _chunks(read).select("doc_id", "chunk").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "chunk", before.alias("line_start"))


@query(r"""
WITH p AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) FILTER (turn % 2 = 0) AS kept, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS other FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(coalesce(kept, '')), '[\p{L}\p{N}_]+')) AS word FROM p) GROUP BY ALL),
w AS (SELECT conv_id, regexp_extract_all(lower(coalesce(other, '')), '[\p{L}\p{N}_]+') AS w FROM p),
a AS (SELECT conv_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, word ORDER BY pos) AS i FROM a),
m AS (SELECT i.conv_id, pos, i > coalesce(n, 0) AS gone FROM i LEFT JOIN h ON h.conv_id = i.conv_id AND h.word = i.word),
r AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM m),
g AS (SELECT conv_id, run, count(*) AS words, count(CASE WHEN gone THEN 1 END) AS missing FROM r GROUP BY ALL),
s AS (SELECT conv_id, sum(words) AS words, sum(words) - sum(missing) AS found, max(missing) AS longest FROM g GROUP BY conv_id)
SELECT p.conv_id AS doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(found, 0)::BIGINT AS found, round_even(found / words, 4) AS coverage, coalesce(longest, 0)::BIGINT AS longest_missing FROM p LEFT JOIN s USING (conv_id)""")
def missing_words(read):
    rows = read("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", tx.empty_as(F.col("text")).alias("t")))).alias("turns"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " ")
    return findings.missing_words(rows.select("doc_id", joined(F.filter("turns", lambda x: x["turn"] % 2 == 0)).alias("kept"), joined(F.col("turns")).alias("other")))


@query("""SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND NOT (value < 100 AND event_id % 2 = 0)""")
def significant_findings(read):
    rows = read("events").select("event_id", "event_type", F.when(F.col("value") < 100, "low").otherwise("high").alias("severity"), F.when(F.col("event_id") % 2 == 0, "model").otherwise("pattern").alias("evidence"))
    return findings.enabled(rows, "event_type", {"error": False}).where(findings.significant(F.col("severity"), F.col("evidence"))).select("event_id", "event_type")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN value > 300 THEN 3 WHEN value > 100 THEN 2 ELSE 1 END DESC, user_id, event_id) AS place FROM events QUALIFY place <= 100")
def worst_findings(read):
    rows = read("events").select("event_id", "user_id", F.when(F.col("value") > 300, "high").when(F.col("value") > 100, "medium").otherwise("low").alias("severity"))
    top = findings.worst_first(rows, "user_id", "event_id").limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(findings.severity_rank(F.col("severity")).desc(), "user_id", "event_id")).alias("place"))


@query("""SELECT doc_id, replace(text, ' and ', ' ••• ') AS text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 > 0 OR text IS NULL""")
def carried_masks(read):
    docs = read("documents").select("doc_id", F.lit(1).alias("page"), "text")
    return findings.carried(docs, docs.where("doc_id % 3 = 0").select("doc_id", "page", F.lit(" and ").alias("value"))).select("doc_id", "text")


@query(r"""
WITH a AS (SELECT conv_id * 100 + turn AS item, coalesce(text, '') AS t FROM conversations WHERE turn % 3 > 0), b AS (SELECT conv_id * 100 + turn AS item, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || ' see HTTPS://Example.org/x' ELSE coalesce(text, '') END AS t FROM conversations WHERE turn % 5 > 0)
SELECT coalesce(a.item, b.item) AS item, CASE WHEN a.item IS NULL THEN 'added' WHEN b.item IS NULL THEN 'dropped' WHEN a.t = b.t THEN 'same' ELSE 'changed' END AS change, round_even(length(a.t) / 4.0::DOUBLE, 0)::BIGINT AS tokens_before, round_even(length(b.t) / 4.0::DOUBLE, 0)::BIGINT AS tokens_after,
coalesce(contains(b.t, 'HTTPS://Example.org'), false)::INTEGER AS hosts_added FROM a FULL JOIN b ON a.item = b.item""")
def stage_changes(read):
    rows = read("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), "turn", tx.empty_as(F.col("text")).alias("text"))
    seen = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" see HTTPS://Example.org/x"))).otherwise(F.col("text"))
    out = findings.stage_changes(rows.where("turn % 3 > 0"), rows.where("turn % 5 > 0").withColumn("text", seen))
    return out.withColumn("hosts_added", F.size("hosts_added"))


@query("SELECT lang, count(DISTINCT source) AS source, count(DISTINCT n_chars) AS n_chars FROM documents GROUP BY lang")
def distinct_counts(read):
    return findings.distinct_counts(read("documents"), "lang", "source", "n_chars")


@query(r"""SELECT page_id, len(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<!--(.*?)-->', 1), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> ''))::INTEGER AS n FROM (SELECT page_id, replace(html, '`', '') AS html FROM pages)""")
def markdown_comments(read):
    plain = F.replace(tx.empty_as(F.col("html")), F.lit("`"), F.lit(""))
    return read("pages").select("page_id", F.size(F.filter(findings.markdown_hidden(plain), lambda x: x["kind"] == "comment")).alias("n"))


@query("""SELECT event_type, list_transform(list_sort(list({'e': event_id, 'p': props})), lambda x: x.p[1:8])[1] AS first FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 3 GROUP BY event_type""")
def first_previews(read):
    return findings.previews(read("events"), "event_type", "event_id", "props", chars=8).select("event_type", F.get("previews", 0).alias("first"))
