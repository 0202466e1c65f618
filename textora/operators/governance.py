"""What is done with findings: ignore rules, policies, quick wins, lineage of a value, run and step comparison, sampling."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textora.functions.shared import checkpointed

from textora.operators.identifiers import SEVERITY

TIERS = {"confirmed": 3, "corroborated": 2, "pattern": 1, "model": 0}


def glob_pattern(glob: Column) -> Column:
    """A path glob as a regular expression: * and ? within a path."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def apply_ignores(found: DataFrame, rules: DataFrame, as_of: Column | None = None) -> DataFrame:
    """found with `ignored_by`, the number of the first rule that fits and has not expired.

    found: fingerprint, path. rules: rule (number), fingerprint, glob (null: any path), until (null: never ends).
    """
    day = F.current_date() if as_of is None else as_of
    live = rules.where(F.col("until").isNull() | (F.col("until") >= day)).select("rule", "fingerprint", F.when(F.col("glob").isNotNull(), glob_pattern(F.col("glob"))).alias("_glob"))
    fits = F.col("_glob").isNull() | F.expr("path rlike _glob")
    hits = found.select("fingerprint", "path").distinct().join(live, "fingerprint").where(fits).groupBy("fingerprint", "path").agg(F.min("rule").alias("ignored_by"))
    return found.join(hits, ["fingerprint", "path"], "left")


def idle_ignores(found: DataFrame, rules: DataFrame, as_of: Column | None = None) -> DataFrame:
    """rule, state: expired, or unused by any finding."""
    day = F.current_date() if as_of is None else as_of
    used = apply_ignores(found, rules, day).where("ignored_by is not null").select(F.col("ignored_by").alias("rule")).distinct().withColumn("used", F.lit(True))
    state = F.when(F.col("until") < day, "expired").when(F.col("used").isNull(), "unused")
    return rules.join(used, "rule", "left").select("rule", state.alias("state")).where("state is not null")


def at_least(column: Column, order: dict[str, int], floor: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[column], F.lit(0)) >= order[floor]


#: Rules of a policy: name -> (tables, parameters) -> failures (subject, detail). Tables are DataFrames by name.
RULES: dict[str, Callable[..., DataFrame]] = {}


def rule(f):
    RULES[f.__name__] = f
    return f


def _fails(df: DataFrame, subject: str, detail: Column) -> DataFrame:
    return df.select(F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


@rule
def no_identifiers(tables, severity: str = "low", evidence: str = "model") -> DataFrame:
    f = tables["identifiers"].where(at_least(F.col("severity"), SEVERITY, severity) & at_least(F.col("evidence"), TIERS, evidence))
    return _fails(f.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", F.concat(F.col("n").cast("string"), F.lit(" identifiers")))


@rule
def no_hidden(tables, severity: str = "medium") -> DataFrame:
    return _fails(tables["hidden"].where(at_least(F.col("severity"), SEVERITY, severity)), "doc_id", F.col("kind"))


@rule
def readiness_at_least(tables, score: float = 50.0) -> DataFrame:
    return _fails(tables["scores"].where(F.col("score") < score), "doc_id", F.col("score"))


@rule
def global_score_at_least(tables, score: float = 50.0) -> DataFrame:
    return _fails(tables["scores"].agg(F.bround(F.avg("score"), 1).alias("s")).withColumn("all", F.lit("all")).where(F.col("s") < score), "all", F.col("s"))


@rule
def facts_found(tables) -> DataFrame:
    return _fails(tables["facts"].where("status <> 'whole'"), "fact", F.col("status"))


@rule
def only_hosts(tables, hosts: tuple[str, ...] = ()) -> DataFrame:
    return _fails(tables["stages"].where(F.col("host").isNotNull() & ~F.col("host").isin(*hosts)), "stage", F.col("host"))


@rule
def no_network(tables) -> DataFrame:
    return only_hosts(tables, ())


@rule
def no_identifiers_sent(tables, evidence: str = "model") -> DataFrame:
    return _fails(tables["stages"].where(F.col("host").isNotNull() & (F.col("identifiers") > 0)), "stage", F.col("identifiers"))


@rule
def no_failures(tables) -> DataFrame:
    return _fails(tables["skipped"], "path", F.col("reason"))


@rule
def all_categories_scanned(tables) -> DataFrame:
    return _fails(tables["unscanned"], "category", F.col("reason"))


@rule
def no_regressions(tables) -> DataFrame:
    return _fails(tables["changes"].where("direction = 'worse'"), "doc_id", F.col("after"))


def check_policy(tables: dict[str, DataFrame], policy: list[tuple[str, dict, str]]) -> DataFrame:
    """rule, level, subject, detail: a row per failure. policy: (rule, parameters, level). A rule that lacks its table, or
    that does not exist, is a failure of its own."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, options, level in policy:
        try:
            rows = RULES[name](tables, **options)
        except (KeyError, TypeError) as e:
            rows = spark.createDataFrame([("policy", f"cannot be run: {e}")], "subject string, detail string")
        out.append(rows.select(F.lit(name).alias("rule"), F.lit(level).alias("level"), "subject", "detail"))
    return reduce(DataFrame.unionByName, out)


def quick_wins(scores: DataFrame, ratings: DataFrame, identifiers: DataFrame, hidden: DataFrame) -> DataFrame:
    """action, documents: what to do first, by how many documents it helps, then by name."""
    acts = [
        ratings.where("rating = 'poor'").select(F.concat(F.lit("fix "), F.col("signal")).alias("action"), "doc_id"),
        scores.where("score < 25").select(F.lit("read again with another reader").alias("action"), "doc_id"),
        identifiers.where("severity = 'high'").select(F.lit("mask identifiers of high severity").alias("action"), "doc_id"),
        hidden.where("severity = 'high'").select(F.lit("remove hidden instructions").alias("action"), "doc_id"),
    ]
    each = reduce(DataFrame.unionByName, (a.withColumn("doc_id", F.col("doc_id").cast("string")) for a in acts))
    return each.groupBy("action").agg(F.countDistinct("doc_id").alias("documents")).orderBy(F.desc("documents"), "action")


def collapsed(stages: DataFrame) -> DataFrame:
    """run, step, kind, component, calls, held: adjacent equal top-level calls as one step.

    stages: run, n, parent, kind, component, method, store, held.
    """
    by = Window.partitionBy("run").orderBy("n")
    same = F.struct("kind", "component", "method", "store")
    top = stages.where("parent is null").withColumn("_new", F.when(same.eqNullSafe(F.lag(same).over(by)), 0).otherwise(1))
    steps = top.withColumn("step", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.groupBy("run", "step").agg(F.min_by("kind", "n").alias("kind"), F.min_by("component", "n").alias("component"), F.count("*").alias("calls"), F.sum("held").alias("held"))


def trail(sightings: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """sightings of the values asked for, newest first. sightings: fingerprint, run, started, ...; Spark picks the join."""
    return sightings.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi").orderBy(F.desc("started"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """runs (run, name, started) with the run before of the same name; ties by run, null names are one name.

    Runs are sorted by name and time over all tasks. A run's predecessor stands before it in its range, or is the last run
    of its name in the ranges before; those last runs, one a range and name, are carried over.
    """
    ranged = checkpointed(runs.repartitionByRange("name", "started", "run").withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range", "name").agg(F.max(F.struct("started", "run")).alias("_end"))
    carried = ends.withColumn("_last", F.lag("_end").over(Window.partitionBy("name").orderBy("_range"))["run"])
    inside = F.lag("run").over(Window.partitionBy("_range", "name").orderBy("started", "run"))
    both = ranged.withColumn("_inside", inside).alias("r").join(carried.alias("c"), (F.col("r._range") == F.col("c._range")) & F.col("r.name").eqNullSafe(F.col("c.name")))
    return both.select(*(f"r.{c}" for c in runs.columns), F.coalesce("r._inside", "c._last").alias("previous"))


def compare_runs(before: DataFrame, after: DataFrame, key: str = "component", seconds: str = "seconds") -> DataFrame:
    """key, before, after, change: faster, slower, about the same (within 5 %), new or gone."""
    both = before.select(key, F.col(seconds).alias("before"), F.lit(None).cast(dict(after.dtypes)[seconds]).alias("after")).unionByName(after.select(key, F.lit(None).cast(dict(before.dtypes)[seconds]).alias("before"), F.col(seconds).alias("after")))
    summed = both.groupBy(key).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    ratio = F.try_divide(F.col("after"), F.col("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(ratio.between(0.95, 1.05), "about the same").when(ratio < 0.95, "faster").otherwise("slower")
    return summed.select(key, "before", "after", change.alias("change"))


def stage_table(spans: DataFrame) -> DataFrame:
    """stage, calls, seconds, started, outermost: roll-up of spans whose parent is not in the table. spans: span, parent, stage, seconds, started."""
    parents = spans.select(F.col("span").alias("parent")).distinct().withColumn("_inner", F.lit(True))
    marked = spans.join(parents, "parent", "left").withColumn("_outer", F.col("_inner").isNull())
    return marked.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("seconds"), 4).alias("seconds"), F.min("started").alias("started"), F.count(F.when(F.col("_outer"), 1)).alias("outermost"))


def stage_documents(items: DataFrame) -> DataFrame:
    """stage, source, items, characters, empty."""
    text = F.coalesce("text", F.lit(""))
    return items.groupBy("stage", "source").agg(F.count("*").alias("items"), F.sum(F.length(text)).alias("characters"), F.count(F.when(F.trim(text) == "", 1)).alias("empty"))


def stratified_sample(rows: DataFrame, stratum: str, order: str, limit: int) -> DataFrame:
    """At most `limit` rows, by largest remainders per stratum (one each where the limit allows), evenly spaced in order.

    A null stratum is a stratum of its own. The sizes of the strata go to the driver, one number each. Rows are numbered
    within their stratum by range: the table is sorted by stratum and order over all tasks, and a row's number is the
    count of its stratum in the ranges before plus its place in its own, so a large stratum is no one task's work.
    """
    sizes = {r[stratum]: r["count"] for r in rows.groupBy(stratum).count().collect()}
    take = allocate(sizes, limit)
    if not take:
        return rows.limit(0)
    spark, kind = rows.sparkSession, dict(rows.dtypes)[stratum]
    ranged = checkpointed(rows.repartitionByRange(stratum, order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", stratum).count().collect()  # a row a range and stratum
    before, seen = [], {}
    for r in sorted(counts, key=lambda r: r["_range"]):
        before.append((r["_range"], r[stratum], seen.get(r[stratum], 0)))
        seen[r[stratum]] = seen.get(r[stratum], 0) + r["count"]
    starts = spark.createDataFrame(before, f"_range int, _s {kind}, _before long")
    table = spark.createDataFrame([(k, t, sizes[k]) for k, t in take.items()], f"_s {kind}, _take long, _n long")
    own = F.row_number().over(Window.partitionBy("_range", stratum).orderBy(order)) - 1
    numbered = ranged.withColumn("_own", own).alias("r").join(F.broadcast(table).alias("t"), F.col(f"r.{stratum}").eqNullSafe(F.col("t._s")))
    numbered = numbered.join(F.broadcast(starts).alias("b"), (F.col("r._range") == F.col("b._range")) & F.col(f"r.{stratum}").eqNullSafe(F.col("b._s")))
    # row r is the i-th pick when r = floor(i * n / take) for some i
    at = F.col("_own") + F.col("_before")
    i = F.ceil(at * F.col("_take") / F.col("_n"))
    return numbered.where((i < F.col("_take")) & (F.floor(i * F.col("_n") / F.col("_take")) == at)).select(*(f"r.{c}" for c in rows.columns))


def allocate(sizes: dict, limit: int) -> dict:
    """Largest-remainder shares of `limit`; every stratum gets one if there are no more strata than that."""
    total = sum(sizes.values())
    if limit >= total:
        return dict(sizes)
    quota = {k: limit * n / total for k, n in sizes.items()}
    take = {k: int(q) for k, q in quota.items()}
    if limit >= len(sizes):
        take = {k: max(1, t) for k, t in take.items()}
    ranked = sorted(sizes, key=lambda k: (-(quota[k] - int(quota[k])), str(k)))
    while sum(take.values()) < limit:
        for k in ranked:
            if sum(take.values()) < limit and take[k] < sizes[k]:
                take[k] += 1
    while sum(take.values()) > limit:
        k = max((k for k in take if take[k] > 1), key=lambda k: (take[k] - quota[k], str(k)))
        take[k] -= 1
    return {k: t for k, t in take.items() if t}


def masked_paths(text: Column) -> Column:
    """A metadata value whose absolute path is cut to its last part."""
    return F.when(text.rlike(r"^(?:/[^/\s]+){2,}|^[A-Za-z]:[\\/]|^~[/\\]"), F.element_at(F.split(text, r"[\\/]"), -1)).otherwise(text)


def host_of(url: str) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else ""
