"""Queries over the stored tables (ingest once: day-partitioned reports, block index, dimensions)
equal the same queries computed from the raw driver tables."""

import pytest

from reportlake import sinks
from reportlake.plans.catalog import QUERIES
from reportlake.plans.context import Inputs

SF = "/root/testdata/sf0.001"
NAMES = ["safe_block_filter", "safe_timestamp", "power_of_aggr", "activity_series", "activity_series_30d",
         "query_series", "reporter_series", "agreement_series", "value_series", "overlay_series", "stats_counts",
         "unique_query_ids_30d", "questionable_stats", "queries_24h", "value_stats", "search_reports",
         "search_stats", "power_distribution_overall", "absent_reporters", "reporters_summary", "reports_page_last",
         "active_power", "recent_activity", "reporters_page"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    sinks.ingest_all(Inputs(spark, SF), path)
    return path


@pytest.mark.parametrize("name", NAMES)
def test_stored_equals_raw(spark, stored, name):
    a = QUERIES[name](Inputs(spark, SF, store=stored))
    b = QUERIES[name](Inputs(spark, SF))
    cols = [c for c in b.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a.select(*cols).collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_fixed_schema_not_mutated(spark, stored):
    from reportlake.schema import REPORT_COLUMNS, REPORT_SCHEMA

    Inputs(spark, SF, store=stored).reports
    assert REPORT_SCHEMA.fieldNames() == REPORT_COLUMNS + ["source_file"]
