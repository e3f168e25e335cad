"""Per-row metrics on reports and registry rows (all built-in Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.core import col_


def agreement_pct(v: str | Column = "V", t: str | Column = "T", zero_is_null: bool = False) -> Column:
    """D8 (and D9 with ``zero_is_null``): agreement of reported ``v`` with trusted ``t`` in percent.

    ``v = t`` -> 100; ``t != 0`` -> ``max(0, (1 - |(v - t) / t|) * 100)``; otherwise NULL.
    The UI form (D9) gives NULL whenever ``t = 0``, even when ``v = t``.
    """
    v, t = col_(v), col_(t)
    both = v.isNotNull() & t.isNotNull()
    ratio = F.greatest(F.lit(0.0), (F.lit(1.0) - F.abs((v - t) / t)) * 100.0)
    if zero_is_null:
        return F.when(both & (t != 0), F.when(v == t, F.lit(100.0)).otherwise(ratio))
    return F.when(both & (v == t), F.lit(100.0)).when(both & (t != 0), ratio)


def agreement_class(v: str | Column = "V", t: str | Column = "T") -> Column:
    """Perfect / good / moderate / poor by the UI agreement, ``n/a`` without one."""
    pct = agreement_pct(v, t, zero_is_null=True)
    out = F.when(pct.isNull(), F.lit("n/a"))
    for bound, name in K.AGREEMENT_CLASSES:
        out = out.when(pct >= bound, F.lit(name))
    return out.otherwise(F.lit("poor"))


def symmetric_agreement(v: str | Column = "V", t: str | Column = "T") -> Column:
    """``max(0, 100 * (1 - |v - t| / ((|v| + |t|) / 2)))``; equal values -> 100."""
    v, t = col_(v), col_(t)
    avg = (F.abs(v) + F.abs(t)) / 2.0
    both = v.isNotNull() & t.isNotNull()
    return (
        F.when(both & (v == t), F.lit(100.0))
        .when(both & (avg == 0), F.lit(0.0))
        .when(both, F.greatest(F.lit(0.0), 100.0 * (1.0 - F.abs(v - t) / avg)))
    )


def symmetric_class(v: str | Column = "V", t: str | Column = "T") -> Column:
    pct = symmetric_agreement(v, t)
    out = F.when(pct.isNull(), F.lit("n/a"))
    for bound, name in K.SYMMETRIC_CLASSES:
        out = out.when(pct >= bound, F.lit(name))
    return out.otherwise(F.lit("poor"))


def deviation_pct(v: str | Column = "V", t: str | Column = "T") -> Column:
    """``|(v - t) / t| * 100``; NULL when ``t`` is NULL/0 or ``v`` is NULL."""
    v, t = col_(v), col_(t)
    return F.when(v.isNotNull() & t.isNotNull() & (t != 0), F.abs((v - t) / t) * 100.0)


def exact_match(v: str | Column = "V", t: str | Column = "T") -> Column:
    """D13 row term: 1.0 when both numeric and equal, else 0.0 (average it for the rate)."""
    v, t = col_(v), col_(t)
    return F.when(v.isNotNull() & t.isNotNull() & (v == t), F.lit(1.0)).otherwise(F.lit(0.0))


def shorten_query_id(qid: str | Column) -> Column:
    """D14 fallback: first 12 characters + ``...`` when longer than 15, else the id."""
    qid = col_(qid)
    return F.when(
        F.length(qid) > K.QUERY_NAME_MAX, F.concat(F.substring(qid, 1, K.QUERY_NAME_KEEP), F.lit("..."))
    ).otherwise(qid)


def query_display_name(qid: str | Column, mapped_name: str | Column) -> Column:
    """Mapped name, else the shortened id."""
    return F.coalesce(col_(mapped_name), shorten_query_id(qid))


def reporter_display_name(address: str | Column, moniker: str | Column) -> Column:
    """Non-empty moniker, else ``first8...last6`` of long addresses, else the address."""
    address, moniker = col_(address), col_(moniker)
    short = F.when(
        F.length(address) > K.REPORTER_NAME_MAX,
        F.concat(
            F.substring(address, 1, K.REPORTER_HEAD),
            F.lit("..."),
            F.substring(address, -K.REPORTER_TAIL, K.REPORTER_TAIL),
        ),
    ).otherwise(address)
    return F.coalesce(F.nullif(moniker, F.lit("")), short)


def questionable(now_ms: int, window_ms: int = K.QUESTIONABLE_WINDOW_MS) -> Column:
    """Disputable and younger than ``window_ms`` at ``now_ms`` (urgent: 48 h window)."""
    return F.coalesce(F.col("DISPUTABLE"), F.lit(False)) & ((F.lit(now_ms) - F.col("TIMESTAMP")) < window_ms)


def commission_pct(rate: str | Column = "commission_rate") -> Column:
    """An 18-decimal fixed-point rate text in percent, one decimal."""
    return F.round(col_(rate).try_cast("double") / (K.FIXED_POINT_SCALE / 100), 1)


def reporter_status(jailed: str | Column = "jailed", power: str | Column = "power") -> Column:
    """``Jailed`` when jailed or without power, ``Free`` otherwise."""
    jailed, power = col_(jailed), col_(power)
    return F.when(F.coalesce(jailed, F.lit(False)), F.lit("Jailed")).when(power > 0, F.lit("Free")).otherwise(
        F.lit("Jailed")
    )


def share_pct(part: str | Column, total: Column, digits: int = 1) -> Column:
    """``part / total * 100`` rounded; 0 when the total is 0 or NULL."""
    part = col_(part)
    return F.when(total > 0, F.round(part.cast("double") / total * 100.0, digits)).otherwise(F.lit(0.0))
