"""Every registered query runs on the smallest tables; SQL-checked ones
match their DuckDB oracle there (the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SLOW = {"select_k", "elbow_curve", "cluster_stability", "fit_gbt", "fit_stacking", "forecast_report",
        "dbscan_grid", "stack_best_models", "fit_random_forest", "feature_importance", "kmeans_cluster", "cluster_centers",
        "cluster_report"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 5 and "mae" in df.columns


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E.LLM)))
def test_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(ocols, res.fetchall())


CORE = set(E.queries()) - set(E.LLM)       # tests/llm holds the tests of the others


@pytest.mark.parametrize("name", sorted(CORE - set(E.oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    df = E.queries()[name](spark, SMALL)
    assert df.count() > 0


PLAN_SKIP = SLOW | {"fit_linear", "fit_ridge", "ward_cluster", "ward_merges"}


@pytest.mark.parametrize("name", sorted(CORE - PLAN_SKIP))
def test_plan_has_no_single_task_window_or_cross_product(spark, name):
    """Scale guard: no window over the whole input in one task, no cartesian
    product, no nested-loop join in any registered query."""
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        assert "CartesianProduct" not in line and "BroadcastNestedLoopJoin" not in line, line
        if "Window [" in line:
            # the first exchange below the window decides which rows its tasks hold
            below = next((x for x in lines[i + 1:] if "Exchange" in x), "")
            assert "SinglePartition" not in below, line
