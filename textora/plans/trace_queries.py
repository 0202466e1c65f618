"""Registered queries of traces, streams' tables, spans, set pages and as-of values, and their SQL; bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textora.operators import asof, compare, layout, sketches, spans, tables, trace
from textora.plans.catalog import query
from textora.streaming import events as streaming


def _calls(read):
    """The events of a user as calls, each made by the one before it."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read("events").select(F.col("event_id").alias("span"), before.alias("parent"), F.col("value").cast("decimal(18,4)").alias("seconds"))


@query("""
WITH RECURSIVE c AS (SELECT event_id AS span, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
t AS (SELECT span, span AS root, 0 AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.span, t.root, t.depth + 1 FROM t JOIN c ON c.parent = t.span)
SELECT span, root, depth::BIGINT AS depth FROM t""")
def span_depths(read):
    return trace.depths(_calls(read))


@query("""
WITH RECURSIVE f AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS span, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM f),
t AS (SELECT span, parent AS ancestor, 1 AS distance FROM c WHERE parent IS NOT NULL UNION ALL SELECT t.span, c.parent, t.distance + 1 FROM t JOIN c ON c.span = t.ancestor WHERE c.parent IS NOT NULL)
SELECT span, ancestor, distance::BIGINT AS distance FROM t""")
def span_ancestors(read):
    bought = read("events").where("event_type = 'purchase'")
    return trace.ancestors(_calls(lambda _: bought))


@query("""
WITH c AS (SELECT event_id AS span, value::DECIMAL(18,4) AS seconds, coalesce(lead(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS inside FROM events)
SELECT span, seconds::DOUBLE AS seconds, inside::DOUBLE AS inside, (seconds - inside)::DOUBLE AS own FROM c""")
def span_own_time(read):
    return trace.own_time(_calls(read)).select("span", *(F.col(c).cast("double").alias(c) for c in ("seconds", "inside", "own")))


@query("""
WITH p AS (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, e.user_id, p.price FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def price_in_force(read):
    rows = read("events")
    prices = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return asof.as_of(rows.select("event_id", "user_id", "ts"), prices, "user_id", "ts", ("price",)).select("event_id", "user_id", "price")


@query("""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(read):
    return streaming.sessions(read("events"), "user_id")


@query("""
WITH b AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS hour FROM events)
SELECT hour, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS seconds FROM b GROUP BY ALL""")
def events_by_sliding_hours(read):
    return streaming.windowed(read("events"), width="2 hours", slide="1 hour")


@query("""
WITH e AS (SELECT date_trunc('day', ts)::DATE AS day, user_id FROM events) SELECT day, count(*) AS n, true AS near FROM e GROUP BY day UNION ALL SELECT NULL, count(*), true FROM e""")
def users_by_sketch(read):
    """Distinct users a day, and over all days from the days' sketches alone, held against exact counts: within 5 %."""
    rows = read("events").select(F.to_date("ts").alias("day"), "user_id", "value")
    daily = sketches.sketched(rows, "day", distinct="user_id", number="value")
    whole = sketches.merged(daily).select(F.lit(None).cast("date").alias("day"), "n", "people", "sizes")
    read_off = sketches.read_off(daily.select(*whole.columns).unionByName(whole), "day")
    exact = rows.rollup("day").agg(F.grouping("day").alias("g"), F.countDistinct("user_id").alias("exact")).where("g = 1 or day is not null").select(F.col("day").alias("d"), "exact")
    return read_off.join(exact, F.col("day").eqNullSafe(F.col("d"))).select("day", "n", (F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))).alias("near"))


_SPANS = r"""
l AS (SELECT doc_id, length(text) AS size, list_transform(string_split(text, chr(10)), lambda x, i: {'text': x, 'a': coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i - 1], lambda y: length(y) + 1)), 0)}) AS a FROM documents WHERE text <> ''),
x AS (SELECT doc_id, size, unnest(a) AS c FROM l), s AS (SELECT doc_id, size, c.a::BIGINT AS a, (c.a + length(c.text))::BIGINT AS b FROM x WHERE regexp_matches(c.text, '\d') UNION ALL SELECT doc_id, length(text), length(text), length(text) FROM documents WHERE text <> '')"""


@query(rf"""WITH {_SPANS}, g AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS "start", a AS "end" FROM s) SELECT doc_id, "start", "end" FROM g WHERE "start" < "end" """)
def text_without_numbers(read):
    docs = read("documents").select("doc_id", "text")
    return spans.uncovered(docs, spans.line_spans(docs).where(F.col("text").rlike(r"\d")))


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 't': x})) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, l.i // 60 AS page, CASE WHEN trim(l.t) <> '' THEN (least(612, length(rtrim(l.t)) * 6) - least(612, length(regexp_extract(l.t, '^(\s*)', 1)) * 6)) * 12.0 ELSE 0 END AS area FROM l),
p AS (SELECT doc_id, page, (sum(area::DOUBLE) / (612.0 * 720.0))::DECIMAL(18,6) AS share FROM c GROUP BY ALL)
SELECT doc_id, 'text_layer_coverage_pct' AS signal, round_even((round(sum(share)::DOUBLE / count(*), 10) * 100)::DECIMAL(18,8), 2)::DOUBLE AS value FROM p GROUP BY doc_id""")
def set_text_coverage(read):
    rows = layout.page_signals(layout.set_pages(read("documents").select("doc_id", "text")))
    return rows.where("signal = 'text_layer_coverage_pct'").select("doc_id", "signal", "value")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, len(w) AS n, len(w) - len(w) // 3 AS k FROM w)
SELECT doc_id, CASE WHEN n = k THEN 1.0 ELSE round_even(2 * k / (n + k), 4) END AS similarity FROM n""")
def tail_similarity(read):
    """Readings that lost the first third of their words: all that is left is matched, in order."""
    docs = read("documents").select("doc_id", F.lit(1).alias("page"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    lost = F.floor(F.size("w") / 3).cast("int")
    tail = F.array_join(F.slice("w", lost + 1, F.size("w")), " ")
    both = compare.similarity(docs.select("doc_id", "page", F.array_join("w", " ").alias("text")), docs.select("doc_id", "page", tail.alias("text")))
    return both.select("doc_id", "similarity")


_PIPES = r"""
d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, l, list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '^\s*\|.*\|\s*$') AND regexp_matches(l[i + 1], '^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$')) AS h FROM d),
r AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM h WHERE len(h) > 0),
m AS (SELECT *, regexp_matches(l[i], '^\s*\|.*\|\s*$') AS row, regexp_matches(l[i], '^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$') AS rule FROM r),
n AS (SELECT *, row AND coalesce(lead(rule) OVER (PARTITION BY doc_id ORDER BY i), false) AS head, sum(CASE WHEN row OR rule THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
f AS (SELECT *, min(CASE WHEN head THEN i END) OVER (PARTITION BY doc_id, run) AS first FROM n WHERE row OR rule),
k AS (SELECT *, max(CASE WHEN i > first + 1 AND NOT row THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY i) AS broken FROM f WHERE i >= first),
t AS (SELECT doc_id, first, i, len(string_split(regexp_replace(trim(l[i]), '^\|+|\|+$', '', 'g'), '|')) AS cells FROM k WHERE broken = 0 AND i <> first + 1)"""


@query(rf"""WITH {_PIPES}, s AS (SELECT doc_id, first, count(*) AS rows, max(cells) AS columns FROM t GROUP BY doc_id, first)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS "table", rows, columns, 1 AS header_depth, 0 AS merged FROM s QUALIFY rows >= 2 AND columns >= 2""")
def pipe_tables(read):
    return tables.shapes(tables.pipe_cells(read("documents")))
