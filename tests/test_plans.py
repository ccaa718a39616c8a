"""What the plans must look like to hold on large tables."""

import re

import pytest

from obsmill.functions.values import exact_sum
from obsmill.operators.measures import weighted_yield
from obsmill.operators.ranking import shares_and_ranks
from obsmill.plans import queries, reports
from obsmill.sources import release
from obsmill.tables import PreparedTables
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def lineitem_scans(plan):
    return len(re.findall(r"FileScan parquet \[l_", plan))


ONE_PASS = [
    "weighted_yield_by_year", "trade_balance", "annual_prices", "world_ranking", "rank_all_years", "shares_and_ranks",
    "production_share", "top_n_share", "map_values", "availability", "country_comparison", "crop_comparison",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_facts_are_scanned_once(spark, name):
    assert lineitem_scans(executed(queries.registry()[name](spark, FOLDER))) == 1


def test_key_figures_scan_crops_and_prices_once_each(spark):
    assert lineitem_scans(executed(queries.registry()["kpi_summary"](spark, FOLDER))) == 2


def test_key_figures_over_a_release_scan_it_twice(spark, tmp_path):
    registry = queries.registry()
    store = release.ReleaseStore(spark, str(tmp_path))
    rows = registry["domain_union"](spark, FOLDER)
    store.publish(rows, rows.groupBy("Domain").count())
    tables = PreparedTables(store)
    figures = reports.kpi_summary(
        tables.rows("QCL"), tables.rows("PP"), queries._countries(spark, FOLDER),
        [queries.KPI_AREA], [queries.KPI_ITEM], queries.PERIOD,
    )
    assert len(re.findall(r"FileScan parquet \[Area", executed(figures))) == 2


WITH_YEARS = [
    "select_observations", "annual_prices", "world_ranking", "scope_ranking", "history_series", "kpi_summary",
    "kpi_summary_scope",
]


@pytest.mark.parametrize("name", WITH_YEARS)
def test_years_reach_the_scan_of_the_lines(spark, name):
    plan = queries.registry()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet [l_" in line]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in s and "LessThan(l_shipdate" in s for s in scans)


@pytest.mark.parametrize("name", sorted(queries.registry()))
def test_no_cross_joins(spark, name):
    plan = queries.registry()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = queries.registry()["total_by_year"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    (columns,) = re.findall(r"FileScan parquet \[(l_[^\]]*)\]", plan)
    names = {c.split("#")[0] for c in columns.split(",")}
    assert names == {"l_partkey", "l_suppkey", "l_quantity", "l_shipdate"}


def test_selection_reaches_the_parquet_scan(spark, sample, tmp_path):
    sample.write.parquet(str(tmp_path / "o"))
    rows = weighted_yield(spark.read.parquet(str(tmp_path / "o")).where("Area = 'A'"), ["Year"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Area,A)" in plan and "In(Element" in plan


def test_sums_combine_before_the_shuffle(spark, sample):
    plan = sample.groupBy("Area").agg(exact_sum(F.col("Value")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_no_window_runs_over_a_whole_group(spark, sample):
    """Rows meet per value bucket; only the counted buckets meet per group."""
    plan = shares_and_ranks(sample, ["Year"])._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[([a-z]+)\(.*?\], \[([^\]]*)\], \[", plan)
    partitions = {re.sub(r"#\d+L?", "", keys) for kind, keys in windows if kind == "rank"}
    assert partitions == {"_group, _coarse"}
    assert {re.sub(r"#\d+L?", "", keys) for kind, keys in windows if kind == "sum"} == {
        "_group", "_group, _coarse", "_group, _coarse, _fine",
    }
