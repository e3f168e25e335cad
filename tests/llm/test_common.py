"""Bounded batches for Python workers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportlake.llm import common

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_and_the_setting_returns(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "m"])

    before = spark.conf.get(KEY, None)
    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 200).alias("t"))
    got = common.stored(rows.mapInArrow(sizes, "n long, m long"), "sizes").collect()
    assert spark.conf.get(KEY, None) == before
    assert sum(r.n for r in got) == 9000 and len(got) > 1
    assert max(r.m for r in got) < common.ARROW_BYTES + (1 << 16)


def test_the_setting_returns_after_a_failure(spark):
    spark.conf.set(KEY, 1 << 25)
    try:
        with pytest.raises(ZeroDivisionError), common.small_batches(spark):
            assert int(spark.conf.get(KEY).rstrip("b")) == common.ARROW_BYTES
            raise ZeroDivisionError
        assert int(spark.conf.get(KEY).rstrip("b")) == 1 << 25
    finally:
        spark.conf.unset(KEY)
