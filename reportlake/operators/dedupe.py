"""Insert-or-ignore semantics on ``TX_HASH`` (K1, K3, K6).

First writer wins: among rows with the same key the one with the smallest ``(file number, line
order)`` is kept; all remaining columns break exact ties, so the result never depends on how the
input was partitioned.

Scale: the winner is chosen with ``min(struct(order..., columns...))`` grouped by key, an aggregate
with map-side partial aggregation. A key duplicated into a third of all rows is collapsed to one row
per map task before the shuffle, where a ``row_number`` window would pull the whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.constants import REPORT_FILE_PATTERN

KEY = "TX_HASH"


def file_number(source_file: str | Column = "source_file") -> Column:
    """Number of a ``table_<n>.csv`` file name (S1), NULL for other names."""
    c = F.col(source_file) if isinstance(source_file, str) else source_file
    return F.regexp_extract(c, REPORT_FILE_PATTERN, 1).try_cast("long")


def dedupe_first_writer(
    df: DataFrame,
    key: str = KEY,
    order: Sequence[Column | str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Keep one row per non-NULL ``key``: the minimum by ``order`` then all columns."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    order_names = [f"__o{i}" for i in range(len(order_cols))]
    value_cols = [c for c in df.columns if c != key]
    keyed = df.where(F.col(key).isNotNull()).select(
        F.col(key), *[c.alias(n) for c, n in zip(order_cols, order_names)], *[F.col(c) for c in value_cols]
    )
    winner = F.min(F.struct(*order_names, *value_cols)).alias("__w")
    out = keyed.groupBy(key).agg(winner)
    keep = set(value_cols) - set(drop)
    return out.select(*[F.col(key) if c == key else F.col(f"__w.{c}").alias(c) for c in df.columns if c == key or c in keep])


def dedupe_reports(raw: DataFrame, line_cols: Sequence[str] = ("line_block", "line_no")) -> DataFrame:
    """K1: first writer wins on ``TX_HASH`` ordered by (file number, line order); NULL keys are left out.

    ``line_cols`` give the order of a row within its file (those present are used, then dropped).
    """
    present = [c for c in line_cols if c in raw.columns]
    order = [file_number("source_file"), *[F.col(c) for c in present]]
    return dedupe_first_writer(raw, KEY, order=order, drop=present)


def null_key_reports(raw: DataFrame) -> DataFrame:
    """Quarantine output of K1: rows without a ``TX_HASH`` (the original rejects their whole file)."""
    return raw.where(F.col(KEY).isNull())


def append_new_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """K3: rows of ``incoming`` whose key is not stored yet (deduplicated among themselves first).

    Re-reading the two newest files and anti-joining on the key replaces the original's
    "rows beyond the stored count" rule, which has no meaning on an unordered distributed read.
    """
    fresh = dedupe_reports(incoming)
    return fresh.join(stored.select(KEY), on=KEY, how="left_anti")


def skip_existing(requested: DataFrame, stored: DataFrame, key: str = "height") -> DataFrame:
    """K6: requested keys that are not stored yet."""
    return requested.join(stored.select(key), on=key, how="left_anti")
