"""Tolerant casts for dirty text cells (report VALUE / TRUSTED_VALUE, registry numbers).

A bad cell becomes NULL, never an error, whatever the session's ANSI setting (``try_cast``).
Rules:
  * to double: Java-style type suffixes (``1.0d``, ``2f``) are not numbers; non-finite -> NULL
  * to int/long: integral text directly, otherwise a decimal/exponent text rounded half away from
    zero, NULL when out of range
  * to boolean: ``true/false/yes/no/1/0`` in any case
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.core import col_

_INT_RANGE = {"int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1)}


def to_double(c: str | Column) -> Column:
    """``try_cast(c as double)`` with suffix text and NaN/Infinity mapped to NULL."""
    c = col_(c)
    d = F.when(~c.rlike(r"[dDfF]\s*$"), c.try_cast("double"))
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def to_integral(c: str | Column, kind: str = "int") -> Column:
    """Integral cast that also accepts ``'1.5'`` / ``'1e3'`` (rounded), NULL when out of range."""
    c = col_(c)
    lo, hi = _INT_RANGE[kind]
    d = F.round(to_double(c))
    # hi + 1 is a power of two, so exact as a double; hi itself isn't for long
    via_double = F.when((d >= F.lit(float(lo))) & (d < F.lit(float(hi + 1))), d.cast(kind))
    return F.coalesce(c.try_cast(kind), via_double)


def to_bool(c: str | Column) -> Column:
    return col_(c).try_cast("boolean")


def numeric_values(df, value: str = "VALUE", trusted: str = "TRUSTED_VALUE"):
    """Add ``V`` and ``T``, the numeric forms of the reported and the trusted value."""
    return df.withColumn("V", to_double(value)).withColumn("T", to_double(trusted))
