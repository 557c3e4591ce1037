"""What reaches the driver: sides of joins are broadcast by their rows, not by the bytes of stored tables."""

import pytest

from loomscribe.plans import runs
from loomscribe.sources import scratch

KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def joins(df):
    """The kind of the one join of a query that has run."""
    counted = df.groupBy().count()
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return {kind for kind in ("BroadcastHashJoin", "SortMergeJoin") if kind in plan}


@pytest.fixture
def planned(monkeypatch):
    """The plans of all steps of runs, as they are before they run, and the names of the steps."""
    found, whole = {}, runs.Stages.step

    def step(run, name, build):
        def seen():
            df = build()
            found[name] = df._jdf.queryExecution().executedPlan().toString()
            return df

        return whole(run, name, seen)

    monkeypatch.setattr(runs.Stages, "step", step)
    return found


def corpus(spark, n=12):
    files = [("r", f"p/m{i}.py", f"import p.m{i + i % 2}\n\ndef f{i}():\n    return {i}\n") for i in range(n)]
    return spark.createDataFrame(files, "repo_id string, rel_path string, content string")


def test_many_rows_of_few_stored_bytes_are_not_broadcast(spark, tmp_path):
    def pages(n):
        rows = spark.range(0, n, 1, 1).selectExpr("concat('r', id div 100) repo_id", "concat('Component ', id % 100) title", "'Documentation for a component.' purpose")
        rows.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    many, few = pages(30_000), pages(100)
    spark.conf.set(KEYS[0], "1m")
    before = [spark.conf.get(k, None) for k in KEYS]
    assert joins(many.join(many.select("repo_id", "title"), ["repo_id", "title"])) == {"BroadcastHashJoin"}
    with scratch.measured_joins(spark):
        assert joins(many.join(many.select("repo_id", "title"), ["repo_id", "title"])) == {"SortMergeJoin"}
        assert joins(many.join(few.select("repo_id", "title"), ["repo_id", "title"])) == {"BroadcastHashJoin"}
    assert [spark.conf.get(k, None) for k in KEYS] == before
    spark.conf.unset(KEYS[0])


def test_no_step_of_a_whole_run_is_planned_with_a_broadcast(spark, planned):
    before = [spark.conf.get(k, None) for k in KEYS]
    texts = runs.run_full(corpus(spark)).collect()
    assert {"clusters", "page_files", "pages", "prompts", "texts"} <= set(planned) and texts
    assert [name for name, plan in planned.items() if "BroadcastHashJoin" in plan] == []
    assert [spark.conf.get(k, None) for k in KEYS] == before


def test_neither_a_stopped_run_nor_the_one_that_takes_it_up_is_planned_with_a_broadcast(spark, planned):
    def broken(batches):
        for _ in batches:
            raise RuntimeError("stopped")
        yield from ()

    files, before = corpus(spark, 4), [spark.conf.get(k, None) for k in KEYS]
    with pytest.raises(Exception, match="stopped"):
        runs.run_full(files, generator=broken, label="driver")
    assert [spark.conf.get(k, None) for k in KEYS] == before
    stopped = dict(planned)
    planned.clear()
    assert {r.slug for r in runs.run_full(files, label="driver").collect()} == {"overview", "component-1", "component-2", "component-3"}
    assert set(planned) == {"texts"} and "texts" in stopped
    assert [name for plans in (stopped, planned) for name, plan in plans.items() if "BroadcastHashJoin" in plan] == []
    assert [spark.conf.get(k, None) for k in KEYS] == before
