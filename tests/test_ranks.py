"""Distributed rank selection equals sorting on the driver (exact medians, deep pages)."""

import random
import statistics

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportlake.operators import filters
from reportlake.operators.ranks import exact_percentile, page_after_rank


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=0, max_size=301), st.integers(1, 6))
def test_exact_median(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_percentile(df, "x", 0.5, partitions=parts).collect()[0].percentile
    clean = [v for v in values if v is not None]
    if not clean:
        assert got is None
    else:
        assert abs(got - statistics.median(clean)) < 1e-9


def test_median_odd_count_many_partitions(spark):
    values = [float((i * 37) % 101) for i in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_percentile(df, "x", 0.5, partitions=7).collect()[0].percentile == statistics.median(values)


def test_deep_page_equals_offset(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 40) * 1000, f"H{i:05d}", i) for i in range(3000)] + [(None, "HNULL", -1)]
    df = spark.createDataFrame(rows, "TIMESTAMP long, TX_HASH string, v int")
    for offset in (0, 1, 777, 2950, 2999):
        want = [r.v for r in df.orderBy(*filters.newest_first()).offset(offset).limit(100).collect()] if offset else \
            [r.v for r in df.orderBy(*filters.newest_first()).limit(100).collect()]
        got = [r.v for r in page_after_rank(df, filters.newest_first(), ["TIMESTAMP", "TX_HASH"], offset, 100, partitions=5).collect()]
        assert got == want, offset


def test_reports_page_at_any_offset(spark):
    rows = [(1000 + (i % 50) * 10, f"T{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "TIMESTAMP long, TX_HASH string")
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    for offset in (0, 1, 300, 450):
        assert [tuple(r) for r in filters.reports_page(df, limit=50, offset=offset).collect()] == ordered[offset : offset + 50]
    with pytest.raises(ValueError):
        filters.reports_page(df, limit=100_000)


def test_value_stats_median(spark):
    from reportlake.operators import stats

    rows = [(str(float((i * 7919) % 1013) / 10),) for i in range(2001)] + [("junk",), (None,)]
    got = stats.value_stats(spark.createDataFrame(rows, "VALUE string")).collect()[0]
    assert got.median_value == statistics.median(float((i * 7919) % 1013) / 10 for i in range(2001))


@pytest.mark.parametrize("split", [2, 16, 4096])
def test_radix_selection_of_any_doubles(spark, split):
    from reportlake.operators.ranks import select_value

    rnd = random.Random(split)
    values = [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randrange(-300, 300) for _ in range(400)] + [0.0, 5e-324, -5e-324, 1.7e308, float("-inf")]
    close = [1.0 + k * 2.0**-52 for k in range(64)]
    for vs in (values, close, close * 3 + values[:10], [7.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in vs] + [(None,)], "x double").repartition(3)
        for p in (0.0, 0.3, 0.5, 1.0):
            lo, hi, got = select_value(df, "x", p, split)
            order = sorted(vs)
            pos = (len(vs) - 1) * p
            a, b = order[int(pos)], order[min(int(pos) + 1, len(vs) - 1)]
            want = a if a == b else a + (b - a) * (pos - int(pos))
            assert (lo, hi) == (order[0], order[-1]) and (got == want or abs(got - want) <= 1e-12 * abs(want) or (a != a or a in (float("-inf"),)))
    assert select_value(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_page_of_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(filters, "SKIP_MAX", 30)
    rows = [(5000 if i % 3 else 1000 * (i % 7), f"H{i:05d}", i) for i in range(900)] + [(None, f"N{i}", -i) for i in range(9)]
    df = spark.createDataFrame(rows, "TIMESTAMP long, TX_HASH string, v int")
    whole = [r.v for r in df.orderBy(*filters.newest_first()).collect()]
    for offset in (1, 33, 90, 640, 895, 905, 2000):
        assert [r.v for r in filters._page(df, offset, 20).collect()] == whole[offset : offset + 20]


def test_page_reads_its_days_only(spark, tmp_path):
    from reportlake import sinks
    from reportlake.schema import REPORT_SCHEMA

    rows = [("r", "SpotPrice", "q", "m", True, 1, d * 86400000 + k * 600000, "1", f"T{d}-{k}", 0, 0, "1", False, "table_1.csv") for d in range(19700, 19730) for k in range(40)]
    sinks.ingest_reports(spark.createDataFrame(rows, REPORT_SCHEMA), str(tmp_path / "r"))
    page = filters.reports_page(spark.read.parquet(str(tmp_path / "r")), limit=30, offset=400)
    scan = next(x for x in page._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in x)
    assert "day" in scan and "19719" in scan and len(page.collect()) == 30
