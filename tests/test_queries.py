"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHOICE = [
    "Q17_foreign_keys", "P05_promo_id_long", "J02_lookup_join", "J10_interval_join", "A08_group_quantiles",
    "A26_side_by_side", "T06_rolling", "T13_flag_periods", "T20_cumulative_share", "T31_autocorrelation",
    "L08_spaced_top", "D02_best_month_per_year", "D14_all_anomaly_days", "D27_pareto", "D41_cohort_retention",
    "D57_discount_response", "D68_revenue_decomposition", "D84_overstock", "D92_return_rate",
    "D109c_installments_monthly", "D118_region_mix", "F04_seasonal_baseline", "IO01_csv_round_trip",
]
# queries over distributed orderings
ORDERED = ["T18_event_number", "T20_cumulative_share", "T21_percentile_rank", "A08_group_quantiles", "D27_pareto", "S12_equal_count_bins"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def compare(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", CHOICE)
def test_query(spark, db, name):
    compare(spark, db, name)


@pytest.mark.parametrize("name", ORDERED)
def test_distributed_ordering(spark, db, name):
    compare(spark, db, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_line_level_cartesian_or_single_task_window(spark):
    for name in ("D22_group_revenue", "D60_order_level", "J05_star_flatten", "A02_distinct_counts", "T17_inter_event_gap", "D92_return_rate"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan
        for spec in re.findall(r"windowspecdefinition\(([^,]*)", plan):  # the first is a partition column
            assert "NULLS" not in spec and "specifiedwindowframe" not in spec, name
