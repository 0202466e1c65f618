"""All registered queries of the engine's own operators, and their SQL.

A query is bound to the driver's tables: documents are one-page documents, conversations many-page ones, pages HTML,
benchmark the expected facts, labels the labelled corpus, events the trace of runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textora import fixed
from textora.functions.shared import checkpointed
from textora.functions import checks, text as tx
from textora.operators import chunks, compare, costs, governance, hidden, identifiers, readiness
from textora.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader as a query, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _n(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_DATES = [_n(p) for _, p in fixed.DATE_FAMILIES]
_DATE_SUM = " + ".join(_DATES)
_RUN_TOGETHER = r"""len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) >= 15 AND regexp_matches(w, '\p{L}')
  AND (len(regexp_extract_all(w, '\p{Ll}\p{Lu}')) >= 2 OR (length(w) >= 25 AND regexp_full_match(w, '\p{L}+')))))"""
_RULE_LINE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"


def _ratings() -> str:
    ops = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "eq": "="}
    each = (f"WHEN signal = '{name}' THEN CASE {' '.join(f"WHEN value {ops[op]} {bound} THEN '{label}'" for label, op, bound in bounds)} END" for name, _, bounds in fixed.SIGNALS)
    return f"CASE {' '.join(each)} END"


def _weights() -> str:
    return f"CASE {' '.join(f"WHEN signal = '{name}' THEN {w}" for name, w, _ in fixed.SIGNALS)} ELSE 0 END"


_SIGNALS = rf"""
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, source, unnest([
  {{'signal': 'text_layer_present', 'value': CASE WHEN trim(t) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE}},
  {{'signal': 'garbled_char_rate', 'value': CASE WHEN length(t) >= 200 THEN round_even(({_n(chr(92) + 'x{FFFD}')} + {_n('[' + chr(92) + 'x{FB00}-' + chr(92) + 'x{FB06}]')} + {_RUN_TOGETHER}) / length(t) * 1000, 2) END}},
  {{'signal': 'unmapped_glyphs', 'value': CASE WHEN length(t) >= 200 THEN round_even(({_n(r'\(cid:\d+\)')} + {_n(r'[\x{E000}-\x{F8FF}]')} + {_n(r'[\x00-\x08\x0b\x0c\x0e-\x1f]')}) / length(t) * 1000, 2) END}},
  {{'signal': 'hyphenated_line_breaks', 'value': CASE WHEN {_n(r'[\p{L}\p{N}_]+')} >= 100 THEN round_even({_n(r'[a-z]{2,}-[ \t]*\n[ \t]*[a-z]{2,}')} / {_n(r'[\p{L}\p{N}_]+')} * 1000, 2) END}},
  {{'signal': 'date_format_consistency', 'value': CASE WHEN {_DATE_SUM} >= 3 THEN round_even(greatest({', '.join(_DATES)}) / ({_DATE_SUM}) * 100, 2) END}},
  {{'signal': 'table_count', 'value': len(list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '{_RULE_LINE}') AND contains(l[i - 1], '|')))::DOUBLE}}]) AS s FROM d),
signals AS (SELECT doc_id, source, s.signal AS signal, s.value AS value FROM raw),
rated AS (SELECT *, CASE WHEN value IS NOT NULL THEN {_ratings()} END AS rating, {_weights()} AS weight FROM signals),
scores AS (SELECT doc_id, source, round_even(CAST(sum(CASE WHEN rating IS NOT NULL AND weight > 0 THEN weight::DECIMAL(10,4) * CASE rating WHEN 'good' THEN 1.0 WHEN 'fair' THEN 0.5 ELSE 0.0 END END) AS DOUBLE)
  / CAST(sum(CASE WHEN rating IS NOT NULL AND weight > 0 THEN weight::DECIMAL(10,4) END) AS DOUBLE) * 100, 1) AS score,
  count(CASE WHEN rating IS NOT NULL AND weight > 0 THEN 1 END) AS counted, count(*) AS n FROM rated GROUP BY doc_id, source)"""
_BAND = "CASE WHEN score >= 75 THEN 'ready' WHEN score >= 50 THEN 'workable' WHEN score >= 25 THEN 'needs work' WHEN score IS NOT NULL THEN 'not ready' END"


def _scores(read) -> DataFrame:
    return readiness.scores(readiness.rated(readiness.text_signals(read("documents"))), "doc_id")


@query(f"WITH {_SIGNALS} SELECT source, count(*) AS documents, round(avg(score::DECIMAL(10,1)), 4)::DOUBLE AS score, count(CASE WHEN score >= 75 THEN 1 END) AS ready, count(CASE WHEN counted < {len(fixed.SIGNALS)} / 2 THEN 1 END) AS unsure FROM scores GROUP BY source")
def readiness_by_source(read):
    signals = readiness.rated(readiness.text_signals(read("documents"), keep=("source",)))
    both = readiness.scores(signals, "doc_id", "source")
    mean = F.round(F.avg(F.col("score").cast("decimal(10,1)")), 4).cast("double")
    return both.groupBy("source").agg(F.count("*").alias("documents"), mean.alias("score"), F.count(F.when(F.col("label") == "ready", 1)).alias("ready"), F.count(F.when(F.col("low_confidence"), 1)).alias("unsure"))


@query(f"WITH {_SIGNALS} SELECT doc_id, score, {_BAND} AS label, counted, {len(fixed.SIGNALS)} - counted AS excluded, counted < {len(fixed.SIGNALS)} / 2 AS low_confidence FROM scores")
def document_scores(read):
    return _scores(read)


@query(f"WITH {_SIGNALS} SELECT doc_id, signal, value, CASE WHEN value IS NULL THEN 'not_applicable' ELSE 'measured' END AS status FROM signals")
def text_signals(read):
    return readiness.text_signals(read("documents"))


@query(f"""WITH {_SIGNALS} SELECT signal, count(CASE WHEN rating = 'good' THEN 1 END) AS good, count(CASE WHEN rating = 'fair' THEN 1 END) AS fair, count(CASE WHEN rating = 'poor' THEN 1 END) AS poor,
count(CASE WHEN rating IS NULL AND value IS NULL THEN 1 END) AS not_applicable FROM rated GROUP BY signal""")
def signal_distribution(read):
    return readiness.distribution(readiness.rated(readiness.text_signals(read("documents"))))


@query(r"""
WITH f AS (SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
p AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM f GROUP BY conv_id),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM f),
k AS (SELECT conv_id, turn, lower(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\d', '#', 'g')) AS key, length(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS chars FROM l WHERE length(trim(line)) >= 3),
g AS (SELECT conv_id, key, count(DISTINCT turn) AS seen, sum(chars) AS chars FROM k GROUP BY conv_id, key),
s AS (SELECT conv_id, round_even(sum(CASE WHEN seen >= greatest(2, ceil(pages * 0.5)) THEN chars ELSE 0 END) / sum(chars) * 100, 2) AS share FROM g JOIN p USING (conv_id) GROUP BY conv_id)
SELECT p.conv_id AS id, CASE WHEN pages >= 3 THEN coalesce(share, 0.0) END AS repeated_pct FROM p LEFT JOIN s USING (conv_id)""")
def repeated_lines(read):
    return readiness.repeated_lines(read("conversations"))


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS top, sum(n) OVER (PARTITION BY source) AS total FROM n)
SELECT source, count(*) AS languages FROM w WHERE top = 1 OR n >= 2 OR n / total >= 0.02 GROUP BY source""")
def languages_by_source(read):
    return readiness.language_counts(read("documents"))


def _page_rows(read) -> DataFrame:
    return read("documents").select("doc_id", "text", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.when(F.col("lang") == "fr", "ocr").otherwise("native").alias("text_source"))


_CUBE = f"""
m(model, price, formula, ratio) AS (VALUES {', '.join(f"('{m.name}', {m.price}, {f"'{m.formula}'" if m.formula else 'NULL'}, {m.ratio})" for m in costs.EXAMPLE_MODELS)}),
e(resolution, h) AS (VALUES {', '.join(f"('{r}', {e}.0::DOUBLE)" for r, e in costs.RESOLUTIONS.items())}),
px AS (SELECT resolution, h, round_even(595.0::DOUBLE / 842.0::DOUBLE * h, 0) AS w FROM e),
fit AS (SELECT *, least(1.0::DOUBLE, 2000.0 / greatest(w, h), 768.0 / least(w, h)) AS k FROM px),
cube AS (SELECT doc_id, model, 'text' AS path, CASE WHEN trim(coalesce(text, '')) <> '' THEN round_even(round_even(length(text) / 4.0::DOUBLE, 0) * ratio, 0)::BIGINT END AS tokens, price FROM documents, m
  UNION ALL SELECT doc_id, model, 'vision_' || resolution, CASE formula WHEN 'area' THEN round_even(least(w * h / 750.0, 1600.0), 0) WHEN 'tiled' THEN 85 + ceil(w * k / 512) * ceil(h * k / 512) * 170
    WHEN 'flat' THEN CASE WHEN w <= 384 AND h <= 384 THEN 258 ELSE ceil(w / 384) * ceil(h / 384) * 258 END END::BIGINT, price FROM documents, m, fit WHERE formula IS NOT NULL),
costs AS (SELECT doc_id, model, path, tokens, round(tokens * price::DOUBLE / 1e6, 10) AS usd FROM cube)"""


@query(f"WITH {_CUBE} SELECT * FROM costs")
def cost_cube(read):
    return costs.cube(_page_rows(read))


@query(f"""WITH {_CUBE}, least AS (SELECT doc_id, CASE WHEN path = 'text' THEN 'text' ELSE 'vision' END AS kind, min(usd) AS usd FROM costs GROUP BY ALL)
SELECT kind, count(usd) AS documents, round(sum(usd::DECIMAL(28,10)), 6)::DOUBLE AS usd FROM least GROUP BY kind""")
def cheapest_paths(read):
    return costs.cheapest(costs.cube(_page_rows(read)))


@query(f"""WITH {_CUBE}, r AS (SELECT c.*, lang <> 'fr' AS native FROM costs c JOIN documents USING (doc_id) WHERE usd IS NOT NULL),
a AS (SELECT *, 'text_ocr' AS architecture FROM r WHERE path = 'text' UNION ALL SELECT *, 'text_layer' FROM r WHERE path = 'text' AND native UNION ALL SELECT *, 'vision' FROM r WHERE path = 'vision_high')
SELECT model, architecture, count(*) AS served, round(sum(usd::DECIMAL(28,10)), 6)::DOUBLE AS usd FROM a GROUP BY ALL""")
def architecture_costs(read):
    sources = read("documents").select("doc_id", (F.col("lang") != "fr").alias("native"))
    return costs.architectures(costs.cube(_page_rows(read)), sources).select("model", "architecture", "served", "usd")


@query(r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\[\]"'']+|[.,;:!?()\[\]"'']+$', '', 'g')), lambda x: x <> '') AS k FROM d),
r AS (SELECT doc_id, CASE WHEN lang = 'fr' OR length(trim(t)) < 40 THEN 'vision'
  WHEN len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{FFFD}\x{E000}-\x{F8FF}]')) / greatest(1, length(t)) * 100 > 2 THEN 'vision'
  WHEN len(list_filter(k, lambda x: regexp_matches(x, '^\d[\d.,:/%\-]*$') OR (length(x) >= 2 AND len(regexp_extract_all(x, '[\p{L}\p{M}\p{N}]')) / length(x) >= 0.8))) / greatest(1, len(k)) * 100 < 50 THEN 'vision'
  ELSE 'text' END AS route FROM w)
SELECT route, count(*) AS pages, count(DISTINCT doc_id) AS documents FROM r GROUP BY route""")
def route_counts(read):
    return costs.route_summary(costs.routes(_page_rows(read)))


def _keys(read) -> DataFrame:
    return read("orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 1).cast("string"), 9, "1").alias("v"))


_KEYS = "k AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + 1)::VARCHAR, 9, '1') AS v FROM orders), g AS (SELECT *, list_transform(string_split(v, ''), lambda x: x::INTEGER) AS d FROM k)"


@query(f"""WITH {_KEYS} SELECT o_orderkey, list_sum(list_transform(list_reverse(d), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END)) % 10 = 0 AS luhn,
(3 * (d[1] + d[4] + d[7]) + 7 * (d[2] + d[5] + d[8]) + d[3] + d[6] + d[9]) % 10 = 0 AS aba_sum FROM g""")
def checksums_on_keys(read):
    v = F.col("v")
    return _keys(read).select("o_orderkey", checks.luhn_holds(v).alias("luhn"), (checks.weighted(v, (3, 7, 1, 3, 7, 1, 3, 7, 1)) % 10 == 0).alias("aba_sum"))


@query(f"""WITH {_KEYS} SELECT o_orderkey, '•••••' || right(v, 4) AS masked, 'id-' || substr(sha256('textora' || chr(0) || 'identifier' || chr(0) || 'account' || chr(0) || v), 1, 16) AS fingerprint FROM k""")
def masked_keys(read):
    spaced = F.concat_ws("-", F.substring("v", 1, 4), F.substring("v", 5, 5))
    return _keys(read).select("o_orderkey", tx.mask_value(F.col("v")).alias("masked"), tx.identifier_fingerprint(F.lit("account"), spaced).alias("fingerprint"))


@query()
def identifier_scan(read):
    return identifiers.scan(read("documents"))


@query()
def masked_documents(read):
    return identifiers.mask_text(read("documents").select("doc_id", "text"))


@query()
def overall_readiness(read):
    docs = read("documents")
    exposed = docs.select("doc_id").join(identifiers.exposure(identifiers.scan(docs)), "doc_id", "left").select("doc_id", F.coalesce("exposure_score", F.lit(100.0)).alias("exposure_score"))
    return readiness.overall(_scores(read), readiness.cost_path(_page_rows(read), "doc_id"), exposed)


@query()
def instruction_findings(read):
    return hidden.findings(read("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"))


@query(r"""SELECT page_id, len(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<!--(.*?)-->', 1), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> '')) AS n_comments FROM pages""")
def html_comments(read):
    return read("pages").select("page_id", F.size(hidden.comments(F.col("html"))).cast("long").alias("n_comments"))


@query()
def html_text(read):
    return hidden.parse_html(read("pages")).select("page_id", "text", F.size("hidden").alias("n_hidden"), F.size("tables").alias("n_tables"))


_LINES = r"""
l AS (SELECT doc_id, lang, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'chunk': i - 1, 'text': x}) AS a FROM documents),
x AS (SELECT doc_id, lang, unnest(a) AS c FROM l),
chunks AS (SELECT doc_id, lang, c.chunk AS chunk, c.text AS text, round_even(length(c.text) / 4.0::DOUBLE, 0)::BIGINT AS tokens FROM x WHERE trim(c.text) <> '')"""
_ENDS, _TABLE = tx.SENTENCE_END.replace("'", "''"), tx.TABLE_LINE


def _chunks(read) -> DataFrame:
    return chunks.split_lines(read("documents"))


@query(f"""WITH {_LINES},
n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk) AS nxt, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM chunks),
f AS (SELECT doc_id, tokens < 20 AS tiny, tokens > 512 AS oversized,
  coalesce(NOT regexp_matches(rtrim(text), '{_ENDS}') AND regexp_matches(ltrim(nxt), '^\\p{{Ll}}'), false) AS split_sentence,
  coalesce(regexp_matches(trim(text), '{_TABLE}') AND regexp_matches(nxt, '{_TABLE}'), false) AS split_table,
  plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, chunk) > 1 AS duplicate FROM n)
SELECT doc_id, count(*) AS chunks, count(CASE WHEN tiny THEN 1 END) AS tiny, count(CASE WHEN oversized THEN 1 END) AS oversized, count(CASE WHEN split_sentence THEN 1 END) AS split_sentence,
count(CASE WHEN split_table THEN 1 END) AS split_table, count(CASE WHEN duplicate THEN 1 END) AS duplicate FROM f GROUP BY doc_id""")
def chunk_flags(read):
    counts = chunks.flag_counts(chunks.inspected(_chunks(read)), "doc_id")
    return counts.select("doc_id", "chunks", "tiny", "oversized", "split_sentence", "split_table", "duplicate")


@query(f"""WITH {_LINES}, r AS (SELECT lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY tokens) AS r, count(*) OVER (PARTITION BY lang) AS n FROM chunks)
SELECT lang, count(*) AS chunks, sum(tokens)::BIGINT AS tokens_total, min(tokens) AS tokens_min, median(tokens) AS tokens_median,
max(CASE WHEN r = round_even((n - 1) * 0.95::DOUBLE, 0) + 1 THEN tokens END) AS tokens_p95, max(tokens) AS tokens_max FROM r GROUP BY lang""")
def chunk_stats(read):
    rows = _chunks(read).select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens")).join(read("documents").select("doc_id", "lang"), "doc_id")
    return chunks.stats(rows, "lang")


@query()
def chunks_by_budget(read):
    return chunks.flag_counts(chunks.inspected(chunks.split_budget(read("documents"))), "doc_id")


@query()
def repeated_identifiers(read):
    return chunks.repeated_identifiers(identifiers.scan(_chunks(read), keys=("doc_id", "chunk")))


def _questions(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("query"), F.col("text").alias("answer"))


@query(rf"""WITH {_LINES},
w AS (SELECT doc_id, chunk, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM chunks),
z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT DISTINCT item_id AS question, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:8], ' ')), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
e AS (SELECT doc_id, chunk, len(w) AS size, unnest(w) AS term FROM w),
tf AS (SELECT term, doc_id, chunk, size, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT question, doc_id, chunk, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, doc_id, chunk) AS rank FROM s)
SELECT question, rank, doc_id, chunk, round(score, 4) AS score FROM r WHERE rank <= 5""")
def bm25_top5(read):
    # Its SQL defines the questions of this query as the first eight words of the items.
    asked = _questions(read).withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 8), " "))
    best = chunks.ranked(chunks.bm25(_chunks(read), asked, top=5))
    return best.select("question", "rank", "doc_id", "chunk", F.round("score", 4).alias("score"))


@query(r"""
WITH f AS (SELECT item_id AS fact, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS what FROM benchmark),
d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body FROM documents)
SELECT fact, doc_id FROM f JOIN d ON contains(body, what) WHERE what <> ''""")
def fact_places(read):
    return chunks.fact_places(read("documents"), read("benchmark").select(F.col("item_id").alias("fact"), "text"))


@query()
def question_results(read):
    return chunks.question_results(read("documents"), _chunks(read), _questions(read))


def _loaders(read) -> tuple[DataFrame, DataFrame]:
    docs = read("documents")
    readings = reduce(DataFrame.unionByName, (docs.where(c).select(F.lit(n).alias("loader"), "doc_id") for n, c in (("all", "true"), ("long", "n_chars >= 500"), ("plain", "source <> 'src0'"))))
    found = reduce(DataFrame.unionByName, (docs.where(c).select(F.lit(n).alias("loader"), "doc_id", F.col("lang").alias("category"), F.col("source").alias("masked")) for n, c in (("all", "true"), ("long", "n_chars >= 2000"), ("plain", "source <> 'src0' and lang = 'en'"))))
    return found, readings


@query("""
WITH r AS (SELECT doc_id, 'all' AS loader FROM documents UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars >= 500 UNION ALL SELECT doc_id, 'plain' FROM documents WHERE source <> 'src0'),
f AS (SELECT doc_id, lang AS category, source AS masked, 'all' AS loader FROM documents UNION ALL SELECT doc_id, lang, source, 'long' FROM documents WHERE n_chars >= 2000
  UNION ALL SELECT doc_id, lang, source, 'plain' FROM documents WHERE source <> 'src0' AND lang = 'en'),
h AS (SELECT doc_id, category, masked, list_sort(list(DISTINCT loader)) AS found FROM f GROUP BY ALL),
a AS (SELECT doc_id, list_sort(list(DISTINCT loader)) AS loaders FROM r GROUP BY doc_id),
m AS (SELECT h.*, list_filter(loaders, lambda x: NOT list_contains(found, x)) AS missed FROM h JOIN a USING (doc_id))
SELECT doc_id, category, masked, array_to_string(found, ',') AS found_by, array_to_string(missed, ',') AS missed_by FROM m WHERE len(missed) > 0""")
def loader_presence(read):
    out = compare.presence(*_loaders(read))
    return out.select("doc_id", "category", "masked", F.array_join("found_by", ",").alias("found_by"), F.array_join("missed_by", ",").alias("missed_by"))


@query("""
WITH a AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars < 2000 GROUP BY ALL), b AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars >= 1000 GROUP BY ALL)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.source = b.source AND a.lang = b.lang WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def corpus_diff(read):
    docs = read("documents")
    return compare.counted(docs.where("n_chars < 2000"), docs.where("n_chars >= 1000"), "source", "lang")


@query("""SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'removed' ELSE 'added' END AS change FROM documents WHERE n_chars < 1000 OR n_chars >= 2000""")
def documents_changed(read):
    docs = read("documents")
    return compare.documents_changed(docs.where("n_chars < 2000"), docs.where("n_chars >= 1000"))


@query("""
SELECT count(CASE WHEN p AND y THEN 1 END) AS tp, count(CASE WHEN p AND NOT y THEN 1 END) AS fp, count(CASE WHEN NOT p AND y THEN 1 END) AS fn, count(CASE WHEN NOT p AND NOT y THEN 1 END) AS tn
FROM (SELECT coalesce(n_chars >= 500, false) AS p, quality = 1 AS y FROM labels LEFT JOIN documents USING (doc_id))""")
def label_confusion(read):
    flagged = read("documents").select("doc_id", (F.col("n_chars") >= 500).alias("flag"))
    return compare.confusion(flagged, read("labels"), label="quality")


@query()
def reading_similarity(read):
    docs = read("documents").select("doc_id", F.lit(1).alias("page"), "text")
    return compare.similarity(docs, docs.withColumn("text", F.lower("text")))


@query(f"""WITH {_SIGNALS} SELECT 'readiness_at_least' AS rule, 'error' AS level, doc_id::VARCHAR AS subject, score::VARCHAR AS detail FROM scores WHERE score < 99.0""")
def policy_failures(read):
    return governance.check_policy({"scores": _scores(read)}, [("readiness_at_least", {"score": 99.0}, "error")])


@query(r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS fingerprint, url AS path FROM pages),
r(rule, g) AS (VALUES (1, '*/es/1*'), (2, '*feed*'), (3, '*/de/*')), hit AS (SELECT page_id, min(rule) AS ignored_by FROM f JOIN r ON path GLOB g GROUP BY page_id)
SELECT page_id, ignored_by FROM f LEFT JOIN hit USING (page_id)""")
def ignored_findings(read):
    found = read("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("fingerprint"), F.col("url").alias("path"))
    globs = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(g).alias("glob"), F.lit(u).cast("date").alias("until")) for n, g, u in ((1, "*/es/1*", None), (2, "*feed*", "2099-01-01"), (3, "*/de/*", None), (0, "*", "2001-01-01"))])
    rules = found.select("fingerprint").distinct().select("fingerprint", F.explode(globs).alias("g")).select("fingerprint", "g.*")
    return governance.apply_ignores(found, rules, F.lit("2024-06-01").cast("date")).select("page_id", "ignored_by")


def _stages(read) -> DataFrame:
    return read("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), F.lit(None).cast("long").alias("parent"), F.col("event_type").alias("kind"), F.col("event_type").alias("component"), F.lit("call").alias("method"), F.lit("").alias("store"), F.lit(1).alias("held"))


@query("""
WITH s AS (SELECT user_id AS run, event_id AS n, event_type AS kind, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events),
t AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY n) AS step FROM s)
SELECT run, step::BIGINT AS step, min(kind) AS kind, min(kind) AS component, count(*) AS calls, count(*)::BIGINT AS held FROM t GROUP BY run, step""")
def trace_collapse(read):
    return governance.collapsed(_stages(read))


_HALF = "TIMESTAMP '2024-01-15'"


@query(f"""
WITH a AS (SELECT event_type, sum(value::DECIMAL(18,4)) AS s FROM events WHERE ts < {_HALF} GROUP BY 1), b AS (SELECT event_type, sum(value::DECIMAL(18,4)) AS s FROM events WHERE ts >= {_HALF} GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS component, a.s::DOUBLE AS before, b.s::DOUBLE AS after,
CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'gone' WHEN b.s::DOUBLE / a.s::DOUBLE BETWEEN 0.95 AND 1.05 THEN 'about the same' WHEN b.s < a.s THEN 'faster' ELSE 'slower' END AS change
FROM a FULL JOIN b ON a.event_type = b.event_type""")
def run_compare(read):
    rows = read("events").select(F.col("event_type").alias("component"), F.col("value").cast("decimal(18,4)").alias("seconds"), "ts")
    half = F.lit("2024-01-15").cast("timestamp")
    out = compare_runs(rows.where(F.col("ts") < half), rows.where(F.col("ts") >= half))
    return out.withColumns({"before": F.col("before").cast("double"), "after": F.col("after").cast("double")})


compare_runs = governance.compare_runs


@query("""
SELECT event_type AS stage, count(*) AS calls, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS seconds, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS outermost FROM events GROUP BY event_type""")
def stage_table(read):
    third = F.col("event_id") % 3
    spans = read("events").select(F.col("event_id").alias("span"), F.when(third != 0, F.col("event_id") - third).alias("parent"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,4)").alias("seconds"), F.col("ts").alias("started"))
    return governance.stage_table(spans).select("stage", "calls", F.col("seconds").cast("double").alias("seconds"), "outermost")


@query("""
SELECT role AS stage, (conv_id % 10)::VARCHAR AS source, count(*) AS items, sum(length(coalesce(text, '')))::BIGINT AS characters, count(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 END) AS empty FROM conversations GROUP BY ALL""")
def stage_documents(read):
    return governance.stage_documents(read("conversations").select(F.col("role").alias("stage"), (F.col("conv_id") % 10).cast("string").alias("source"), "text"))


@query("SELECT event_id AS run, event_type AS name, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events")
def previous_runs(read):
    rows = read("events").select(F.col("event_id").alias("run"), F.col("event_type").alias("name"), F.col("ts").alias("started"))
    return governance.previous_runs(rows).select("run", "name", "previous")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 450)")
def value_trail(read):
    seen = read("events").select("event_id", "user_id", F.col("user_id").alias("fingerprint"), F.col("ts").alias("started"), "value")
    return governance.trail(seen, seen.where("value > 450")).select("event_id", "user_id")


@query()
def stratified_sample(read):
    return governance.stratified_sample(read("documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query()
def quick_wins(read):
    docs = read("documents")
    ratings = checkpointed(readiness.rated(readiness.text_signals(docs)))  # read twice: as they are and for the scores
    # categories that neither are of high severity nor can take the place of one that is change nothing here
    telling = tuple(c for c in fixed.CATEGORIES if c[1] == "high" or c[0] in fixed.EXCLUSIVE)
    return governance.quick_wins(readiness.scores(ratings, "doc_id"), ratings, identifiers.scan(docs, categories=telling), hidden.findings(docs))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS seconds FROM events GROUP BY ALL")
def events_by_hour(read):
    return streaming.windowed(read("events"))


@query("SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def totals_by_language(read):
    return read("documents").rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def queries() -> dict[str, Query]:
    from textora.plans import rollup_queries, trace_queries  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
