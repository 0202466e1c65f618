"""URL filter whose block decisions reach the aliases of a URL (redirects and canonical links).

Only DataFrame functions. Rules name a host (and all its subdomains) and a path prefix; the longest rule that fits a URL
wins. A URL that no rule fits takes the verdict of its component over redirect and canonical-link edges: blocked where a
rule blocks any member, allowed otherwise. An explicit allow always keeps its own URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm._common import lower_ascii, save, small
from textora.llm.components import connected_components

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
META_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _resolved(base: Column, href: Column) -> Column:
    """An absolute URL for a link target; relative paths hang on the host of the page."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    return (
        F.when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href != "", F.concat(root, F.regexp_extract(path_of(base), r"(?s)^(.*/)?", 1), href))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the URL of a page, and where its canonical link or its refresh redirect leads, fragments cut."""
    page = pages.select(F.col(url).alias("base"), F.coalesce(F.col(html), F.lit("")).alias("body")).where(F.col("base").isNotNull())
    page = page.where(F.lower("body").contains("canonical") | F.lower("body").contains("refresh"))
    tags = F.concat(
        F.transform(F.regexp_extract_all("body", F.lit(LINK_TAG), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("body", F.lit(META_TAG), 0), lambda t: F.regexp_extract(t, REFRESH, 1)),
    )
    hops = page.select("base", F.explode(tags).alias("href")).select("base", _resolved(F.col("base"), F.col("href")).alias("to"))
    cut = lambda c: F.regexp_replace(c, r"(?s)#.*$", "")
    return hops.where(F.col("to").isNotNull()).select(cut(F.col("base")).alias("src"), cut(F.col("to")).alias("dst")).where("src <> dst").distinct()


def rule_for(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """urls (url, distinct) with rule and rule_verdict of the longest rule that fits, null where none does.

    Each host meets the rules by its own suffixes (a.b.org: a.b.org, b.org, org), an equality join whatever the number
    of rules, whose table is broadcast if it is small.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(h.lower(), p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    table = small(table)
    labels = F.split(host_of(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = (
        urls.where(host_of(F.col("url")) != "")
        .select("url", path_of(F.col("url")).alias("path"), F.explode(suffixes).alias("rule_host"))
        .join(table, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
    )
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), rule.alias("rule"))).alias("b"))
    best = best.select("url", F.col("b.rule").alias("rule"), F.when(F.col("b.allow"), "allow").otherwise("block").alias("rule_verdict"))
    return urls.join(best, "url", "left")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, component (smallest alias, null without aliases).

    Rules look at URLs as given; fragments are cut only to tell aliases. A null URL, or one without "://", has empty host and path, fits no rule, and is allowed. Null html has no links.
    Repeated rows are judged each on its own and alike; other columns of pages are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(url), F.lit("")).alias("given"))
    edges = save(alias_edges(pages, url, html), "aliases")
    linked = edges.limit(1).count() > 0
    urls = rows.select(F.col("given").alias("url"))
    if linked:
        urls = urls.union(edges.select("src")).union(edges.select("dst"))
    ruled = rule_for(urls.distinct(), rules).withColumn("alias", F.regexp_replace("url", r"(?s)#.*$", ""))
    if linked:
        parts = save(connected_components(edges), "url-components")
        ruled = save(ruled.join(parts.select(F.col("node").alias("alias"), "component"), "alias", "left"), "url-rules")
        blocked = ruled.where("component is not null and rule_verdict = 'block'").select("component").distinct()
        ruled = ruled.join(small(save(blocked, "url-blocked")).withColumn("reached", F.lit(True)), "component", "left")
    else:
        ruled = ruled.withColumns({"component": F.lit(None).cast("string"), "reached": F.lit(False)})
    verdict = F.coalesce("rule_verdict", F.when(F.col("reached"), "block").otherwise("allow"))
    judged = ruled.select(F.col("url").alias("given"), "rule", verdict.alias("verdict"), "component")
    return rows.join(judged, "given").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", "verdict", "component")
