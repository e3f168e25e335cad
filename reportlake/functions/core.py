"""Small Column helpers shared by all operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: str | Column, b: int | Column) -> Column:
    """Integer division (SQL ``div``), exact on longs; truncates toward zero."""
    return F.call_function("div", col_(a), b if isinstance(b, Column) else F.lit(b))


def exact_mean(x: str | Column, scale: int = 6) -> Column:
    """Aggregate: the mean of ``x`` as a double, NULL when there are no values.

    Groups whose values all have a magnitude of 0 or ``1e-3 .. 1e15`` are summed as DECIMAL(38,10) and the mean is
    rounded half-up to ``scale`` decimals: that doesn't depend on the order in which partial aggregates are merged.
    Other groups (18-decimal integers, ``1e30``, ``1e-12``) get the plain double mean, which keeps every finite double.
    """
    v = col_(x).cast("double")
    d = F.when(F.abs(v) < 1e15, v).try_cast("decimal(38,10)")
    n = F.count(v)
    plain = (F.max(F.abs(v)) < 1e15) & F.coalesce(F.min(F.when(v != 0, F.abs(v))) >= 1e-3, F.lit(True))
    return F.when(n == 0, None).when(plain, F.round(F.try_sum(d) / n, scale).cast("double")).otherwise(F.avg(v))
