import pytest

from textora.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(same, name):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() >= 0


def test_sample_takes_what_is_asked(spark, sf_dir):
    assert catalog.queries()["stratified_sample"](spark, sf_dir).count() == 100


def test_policy_and_wins_bind_on_rows(spark):
    """Non-empty bindings: a score below the bound fails its rule, and documents with findings are named by quick wins."""
    scores = spark.createDataFrame([(1, 40.0), (2, 100.0)], "doc_id long, score double")
    got = catalog.governance.check_policy({"scores": scores}, [("readiness_at_least", {"score": 99.0}, "error")]).collect()
    assert [(r.rule, r.level, r.subject) for r in got] == [("readiness_at_least", "error", "1")]
    calls = [(1, 1, None, "load", "a"), (1, 2, None, "load", "a"), (1, 3, 2, "split", "b"), (1, 4, None, "split", "b"), (2, 1, None, "load", "a")]
    stages = spark.createDataFrame(calls, "run long, n long, parent long, kind string, component string").selectExpr("*", "'call' AS method", "'' AS store", "1 AS held")
    assert sorted((r.run, r.kind, r.calls) for r in catalog.governance.collapsed(stages).collect()) == [(1, "load", 2), (1, "split", 1), (2, "load", 1)]
