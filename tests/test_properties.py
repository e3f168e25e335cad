"""Property tests: metric formulas against plain Python, dedupe independent of input order,
carried-forward network power against a sequential loop, throttle batch = stream."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


from reportlake.functions import metrics
from reportlake.functions.buckets import bucket_spec
from reportlake.operators import dedupe, series, snapshots
from reportlake.operators.registry import placeholder_reporters, unknown_reporters

finite = st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False), st.sampled_from([0.0, 1.0, -1.0]))


def py_agreement(v, t):
    if v is None or t is None:
        return None
    if v == t:
        return 100.0
    if t != 0:
        return max(0.0, (1 - abs((v - t) / t)) * 100)
    return None


def py_deviation(v, t):
    if v is None or t is None or t == 0:
        return None
    return abs((v - t) / t) * 100


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(finite, finite), min_size=1, max_size=30))
def test_agreement_and_deviation(spark, pairs):
    df = spark.createDataFrame(pairs, "V double, T double")
    got = df.select("V", "T", metrics.agreement_pct().alias("a"), metrics.deviation_pct().alias("d")).collect()
    for r in got:
        for mine, ref in ((r.a, py_agreement(r.V, r.T)), (r.d, py_deviation(r.V, r.T))):
            assert mine == ref or (mine is not None and ref is not None and abs(mine - ref) <= 1e-9 * max(1.0, abs(ref)))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 3), st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=60),
       st.integers(1, 7))
def test_first_writer_wins_is_order_free(spark, rows, parts):
    data = [(f"h{h}", f"table_{f}.csv", line, str(v)) for h, f, line, v in rows]
    want = {}
    for h, f, line, v in sorted(data, key=lambda r: (int(r[1][6:-4]), r[2], r[3])):
        want.setdefault(h, v)
    shuffled = data[:]
    random.Random(parts).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "TX_HASH string, source_file string, line_no long, VALUE string").repartition(parts)
    got = {r.TX_HASH: r.VALUE for r in dedupe.dedupe_reports(df).collect()}
    assert got == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 47), st.integers(0, 1799999), st.one_of(st.none(), st.integers(0, 10**6))), max_size=40))
def test_network_power_carried_forward(spark, snaps):
    spec = bucket_spec("24h", 1706659200000)
    rows = [(i, spec.start_ms + b * spec.interval_ms + off, p) for i, (b, off, p) in enumerate(snaps)]
    df = spark.createDataFrame(rows, "height long, timestamp_ms long, maximal_power long")
    got = [r.maximal_power_network for r in series.network_power_series(df, spec).orderBy("bucket_id").collect()]
    last_in_bucket = {}
    for h, ts, p in sorted(rows, key=lambda r: (r[1], r[0])):
        last_in_bucket[(ts - spec.start_ms) // spec.interval_ms] = p or 0
    want, cur = [], 0
    for b in range(spec.n):
        cur = last_in_bucket.get(b, cur)
        want.append(cur)
    assert got == want


def test_series_fill_gaps(spark):
    spec = bucket_spec("24h", 1706659200000)
    rows = [("r1", "q1", spec.start_ms + 5 * spec.interval_ms, 1, "a"), ("r2", "q1", spec.start_ms + 5 * spec.interval_ms, 2, "b"),
            ("r1", "q2", spec.start_ms + 40 * spec.interval_ms, 3, "c"), ("r1", "q2", spec.now_ms - 1, 4, "d")]
    df = spark.createDataFrame(rows, "REPORTER string, QUERY_ID string, TIMESTAMP long, POWER int, TX_HASH string")
    hist = {r.bucket_id: r["count"] for r in series.reports_histogram(df, spec).collect()}
    assert len(hist) == 48 and hist[5] == 2 and hist[40] == 1 and hist[47] == 1 and hist[0] == 0
    act = {r.bucket_id: r for r in series.activity_series(df, spec).collect()}
    assert act[5].active_reporters == 2 and act[5].representative_power_of_aggr == 3.0
    assert act[47].total_reports == 0  # newest block excluded by the safe filter
    assert act[0].total_reports == 0 and act[0].representative_power_of_aggr == 0.0


def test_unknown_and_placeholder_reporters(spark):
    reports = spark.createDataFrame([("unknown1",), ("unknown2",), ("known1",), ("",), (None,)], "REPORTER string")
    reg = spark.createDataFrame(
        [("known1", "k", "0", False, None, None, 0, 5, 1, 1)],
        "address string, moniker string, commission_rate string, jailed boolean, jailed_until long, last_updated long, "
        "min_tokens_required long, power int, fetched_at long, updated_at long",
    )
    assert {r.address for r in unknown_reporters(reports, reg).collect()} == {"unknown1", "unknown2"}
    full = placeholder_reporters(reports, reg, 9).collect()
    assert len(full) == 3 and sum("Unknown" in r.moniker for r in full) == 2


def test_throttle_keeps_hourly(spark):
    hour = 3600000
    ts = [0, 10, hour, hour + 1, 2 * hour + 5, 5 * hour]
    df = spark.createDataFrame([(i, t, 1, "realtime") for i, t in enumerate(ts)] + [(99, 20, 1, "historical")],
                               "height long, timestamp_ms long, maximal_power long, sample_type string")
    kept = sorted(r.timestamp_ms for r in snapshots.snapshot_throttle(df).collect())
    assert kept == [0, hour + 1, 2 * hour + 5, 5 * hour]
