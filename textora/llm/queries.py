"""The training-data operators as registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textora.llm import decontaminate, exact_dedup, infill, line_dedup, mixing, ngram_join, quality, secret_scan, substring_dedup, token_shards, url_filter, vector_codes, warc
from textora.llm._common import new_path, read

Query = Callable[[SparkSession, str], DataFrame]

#: Host, path prefix, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents towards the cycling weights; rows, nulls and ties as mix() says."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), mixing.cycling_weights((1.0, 2.0, 3.0)), limit=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the shares found; nulls and short items as contained() says."""
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_shingles", "n_found", "containment").distinct()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays for it; nulls, repeats and ties as dedup() says."""
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, of lines left out, and a digest of what stays; null text: no lines (null), no text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    left = line_dedup.dedup_lines(docs, lost="n_removed")
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of four-word shingles and its component; nulls and repeats as ngram_classes() says."""
    return ngram_join.ngram_classes(read(spark, sf_dir, "documents"), n=4, threshold=(17, 20)).drop("text_key")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed, and a digest of the rest; nulls and repeats as dedup_substrings() says."""
    return substring_dedup.dedup_substrings(read(spark, sf_dir, "documents")).drop("kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts per base kind and all spans; null text has none."""
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = tuple(r.kind for r in secret_scan.BASE_RULES)
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.spans_text(F.col("secret_spans"), kinds)
    return found.select("doc_id", *map(count, kinds), F.sha2(base, 256).alias("base_sha256"), secret_scan.spans_text(F.col("secret_spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; null and empty texts are scored like others."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives written; nulls and ties as write_warc() says."""
    uri = new_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), uri, least=0)
    return warc.read_warc(spark, uri, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict; nulls and repeats as url_verdicts() says."""
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES).drop("component")


def op11_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back by its key from the token shards written; nulls and repeats as write_tokens() says."""
    import public_tokenizers

    docs, uri = read(spark, sf_dir, "documents"), new_path(spark, "tokens")
    token_shards.write_tokens(docs, uri, public_tokenizers.path("byte_bpe_50k.json"))
    token_shards.build_index(spark, uri)
    return token_shards.fetch(docs.select("doc_id"), uri)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cut and digests of the output and of the text restored from it; nulls as fill_in_middle() says."""
    made = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector kept with its code, errors and the digest of the codebooks; nulls and ties as product_codes() says."""
    return vector_codes.product_codes(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    named = (op1_entropy_mix, op2_decontaminate, op3_exact_dedup, op4_line_dedup, op5_ngram_join, op6_substring_dedup, op7_secret_scan, op8_quality, op9_warc, op10_url_filter, op11_token_shards, op12_fill_in_middle, op13_vector_codes)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "pem": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
}


def _secrets_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS j, "
        f"regexp_split_to_array(t, '{pattern}') AS p, {least} AS least FROM d"
        for i, (kind, (pattern, group, least)) in enumerate(_KINDS.items())
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT doc_id, k, kind, least, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
  'a': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT),
  'w': length(m[i]), 'j': length(j[i])}})) AS s FROM found),
kept AS (SELECT doc_id, k, kind, s.a AS a, kind || ':' || s.a || ':' || (s.a + s.w) AS piece FROM each WHERE s.j >= least)
SELECT d.doc_id,
  count(k.piece) FILTER (kind = 'assign') AS n_assign, count(k.piece) FILTER (kind = 'access') AS n_access, count(k.piece) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(piece, ',' ORDER BY a, k) FILTER (k <= 2), '')) AS base_sha256,
  coalesce(string_agg(piece, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds as one chain of tables; distances of so small integers are exact in doubles."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
a{k} AS MATERIALIZED (SELECT p.r, p.part, p.x, min((p.q + c.q - 2 * list_inner_product(p.d, c.d)) * 1024 + c.entry) AS best FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.r, p.part, p.x),"""
        if k < rounds:
            steps += f"""
m{k} AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (SELECT part, best % 1024 AS entry, pos, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m
  FROM (SELECT part, CAST(best AS BIGINT) AS best, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM a{k}) GROUP BY part, best % 1024, pos) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, x, CAST(x AS DOUBLE[]) AS d, list_inner_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) AS q
  FROM (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)),"""
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, CAST(x AS DOUBLE[]) AS d, list_inner_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) AS q
  FROM (SELECT r, vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM k, range(4) t(part))),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x, d, q FROM p WHERE r IN (SELECT r FROM k ORDER BY vec_id LIMIT 256)),{steps}
e AS (SELECT r, string_agg(printf('%02x', CAST(best AS BIGINT) % 1024), '' ORDER BY part) AS code, CAST(sum(CAST(best AS BIGINT) // 1024) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, label, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN e USING (r)"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    plain = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    sql = {
        "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {plain} AS w FROM documents), i AS (SELECT item_id, {plain} AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id),
hit AS (SELECT r, doc_id, item_id, count(*) AS n_found FROM ds JOIN its USING (s) GROUP BY ALL)
SELECT DISTINCT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM hit JOIN n USING (item_id) WHERE n_found * 5 >= n_shingles * 4
UNION SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN i ON len(i.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')""",
        "op9_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((((strpos('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(h, 5 * i // 4 + 2, 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, url FROM g""",
        "op3_exact_dedup": f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (g ORDER BY doc_id) = 1 AS kept, sha256({_NORMAL}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {_NORMAL})""",
        "op7_secret_scan": _secrets_sql(),
        "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(l) AS n, [CAST(('0x' || substr(h, 8 * k + 1, 8)) AS BIGINT) for k in range(4)] AS draw FROM d),
f AS (SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= 100 THEN 'plain' WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a+1:b], '') AS m, array_to_string(l[b+1:n], '') AS q FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s""",
        "op13_vector_codes": _codes_sql(),
        # The tables hold no canonical link and no refresh redirect, so no URL has an alias whose verdict could reach it.
        "op10_url_filter": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES {rules}),
hit AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)""",
    }
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
