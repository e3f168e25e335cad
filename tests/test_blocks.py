"""Safe-block rules (D5/D6) at their edges, and block power with NULL timestamps."""

from reportlake.operators import blocks

SCHEMA = "TIMESTAMP long, POWER int, REPORTER string, TX_HASH string"


def _df(spark, ts):
    return spark.createDataFrame([(t, 10, f"r{i}", f"h{i}") for i, t in enumerate(ts)], SCHEMA)


def test_safe_filter_edges(spark):
    cases = {
        (): [],
        (5,): [5],
        (5, 5): [5, 5],
        (5, 7): [5],
        (5, 7, 7, 9): [5, 7, 7],
        (None, 5): [None, 5],  # one distinct block: everything stays
        (None, 5, 6): [5],  # two blocks: NULL timestamps go with the newest block
    }
    for ts, want in cases.items():
        got = [r.TIMESTAMP for r in blocks.safe_block_filter(_df(spark, list(ts))).collect()]
        assert sorted(got, key=lambda x: (x is not None, x)) == sorted(want, key=lambda x: (x is not None, x)), ts


def test_safe_timestamp_edges(spark):
    for ts, want in {(): None, (5,): 5, (5, 5): 5, (5, 7): 5, (5, 7, 9): 7, (None, 4, 8): 4}.items():
        assert blocks.safe_timestamp(_df(spark, list(ts))).collect()[0].safe_timestamp == want, ts


def test_power_of_aggr_null_block(spark):
    df = spark.createDataFrame([(1, 5, "a", "h1"), (1, 7, "b", "h2"), (None, 3, "c", "h3"), (2, None, "d", "h4")], SCHEMA)
    got = {r.TX_HASH: r.POWER_OF_AGGR for r in blocks.power_of_aggr(df).collect()}
    assert got == {"h1": 12, "h2": 12, "h3": None, "h4": None}
    recent = {r.TX_HASH for r in blocks.power_of_aggr_recent(df, 1).collect()}
    assert recent == {"h4"}
