"""Secret scan behind a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: an AND of clauses, each an OR of trigram
sets that any match must hold. The inverted index has postings from each trigram that some query names to the texts that
hold it. A set's postings are intersected by counting, per text, how many of its trigrams are there; texts that meet every
clause of a rule are its candidates, and only these are verified by the expression itself. A rule without a mandatory
trigram (a run of hex digits) scans every text. Only DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, let, save, small

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind; pattern, valid in Python and Java alike; group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values. The base rules, then those that this method adds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


def _strings(node) -> set[str] | None:
    """All strings that a piece of a parsed expression matches, lower-cased, if they are few; else None."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MOST_STRINGS:
        return {chr(c).lower() for _, c in arg}
    if op == "SUBPATTERN":
        return _all(arg[-1])
    if op == "BRANCH":
        found = [_all(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != re._parser.MAXREPEAT and arg[1] <= 3 and (one := _all(arg[2])) is not None:
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(sorted(one), repeat=n)}
    return None


def _all(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        if (more := _strings(node)) is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """Clauses that a text must all meet, each by all trigrams of one of its sets; empty: no mandatory trigram.

    A string is covered by every third trigram and its last; sets that hold another set of their clause add nothing.
    """
    clauses, run = [], {""}

    def close() -> None:
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in (*range(0, len(s) - 3, 3), len(s) - 3)) for s in run}
            clauses.append({x for x in sets if not any(y < x for y in sets)})

    for node in re._parser.parse(pattern):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        run = more if more is not None else {""}
    close()
    return clauses


def _trigram_scan(trigrams: list[str]) -> str:
    """An expression that finds, at every place of a text, the trigram that starts there, if it is one of these."""
    heads: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        heads.setdefault(t[0], []).append(t[1:])
    either = lambda c: re.escape(c) if c.lower() == c.upper() else f"[{c.lower()}{c.upper()}]"
    return "(?=(" + "|".join(either(h) + "(?:" + "|".join("".join(map(either, x)) for x in tails) + ")" for h, tails in heads.items()) + "))"


def text_key(text: Column) -> Column:
    """Names a text in the index. Two texts of one key share their candidates, which verification then tells apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def index(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """(trigram, key): postings of the trigrams, lower-cased, to the texts that hold them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_trigram_scan(trigrams)), 1), F.lower))
    return docs.select(text_key(F.col(text_col)).alias("key"), F.explode(held).alias("trigram")).select("trigram", "key").distinct()


def candidates(postings: DataFrame, queries: dict[str, list[set[frozenset[str]]]]) -> DataFrame:
    """(key, kinds): the texts that meet the query of some rule, and of which rules; postings are intersected by counts."""
    wanted = [(t, kind, c, s, len(x)) for kind, q in queries.items() for c, sets in enumerate(q) for s, x in enumerate(sorted(sets, key=sorted)) for t in sorted(x)]
    table = postings.sparkSession.createDataFrame(wanted, "trigram string, kind string, clause int, one int, size int")  # as long as the rules
    met = postings.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clause", "one").agg(F.count("*").alias("n"), F.min("size").alias("size")).where("n = size")
    clauses = met.groupBy("key", "kind", "clause").agg(F.lit(1).alias("met")).groupBy("key", "kind").agg(F.count("*").alias("n"))
    asked = F.create_map(*[F.lit(x) for kind, q in queries.items() for x in (kind, len(q))])[F.col("kind")]
    return clauses.where(F.col("n") == asked).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of a rule's matches, leftmost and non-overlapping, short ones dropped; code points.

    The pieces between matches (split) and the matches have alternating lengths, whose running sum is the offsets.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def step(acc, x):
        start = acc["at"] + x["piece"]
        end = start + x["width"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), (x["judged"] >= rule.least).alias("ok")))).alias("out"))

    def located(matches):
        pieces = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
        judged = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else matches
        rows = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m"), judged.alias("j")), lambda x: F.struct(F.length(x["p"]).alias("piece"), F.length(x["m"]).alias("width"), F.length(x["j"]).alias("judged")))
        found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), lambda m: F.when(F.size(m) == 0, none).otherwise(located(m)))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """docs with a column `into`: array<struct<kind,start,end>>, sorted by start, then by the order of rules.

    Offsets are in code points, end exclusive. Null text counts as empty and has an empty array. All rows and all other
    columns stay as they are; a column named like `into` is replaced. Repeated texts have one entry in the index.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    order = {r.kind: i for i, r in enumerate(rules)}
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    rows = docs.alias("d")
    if indexed:
        postings = save(index(docs, sorted({t for q in indexed.values() for c in q for s in c for t in s}), text_col), "trigrams")
        found = save(candidates(postings, indexed), "secret-candidates")
        drop_saved(postings)
        rows = rows.join(small(found).alias("c"), text_key(F.col(f"d.{text_col}")) == F.col("c.key"), "left")
    of = lambda r: F.when(F.array_contains("c.kinds", r.kind), _spans(text, r)).otherwise(none) if r.kind in indexed else _spans(text, r)

    def earlier(a, b):
        place = lambda x: F.array_position(F.array(*[F.lit(k) for k in order]), x["kind"])
        return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)

    spans = F.array_sort(F.concat(*map(of, rules)), earlier) if rules else none
    return rows.select(*(F.col(f"d.`{c}`") for c in docs.columns if c != into), spans.alias(into))


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of the spans of the kinds given."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
