"""Fixed values that must equal the original dashboard's behaviour for right results."""

from __future__ import annotations

# --- fixed values: time units (milliseconds) -------------------------------------------------
MINUTE_MS = 60 * 1000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# --- fixed values: bucket specifications, timeframe -> resolution -> (interval_ms, n_buckets) ---
# "fine" is the desktop resolution, "medium" the mobile one, "coarse" the cellular one.
BUCKET_SPECS: dict[str, dict[str, tuple[int, int]]] = {
    "24h": {"fine": (30 * MINUTE_MS, 48), "medium": (1 * HOUR_MS, 24), "coarse": (2 * HOUR_MS, 12)},
    "7d": {"fine": (4 * HOUR_MS, 42), "medium": (4 * HOUR_MS, 42), "coarse": (4 * HOUR_MS, 42)},
    "30d": {"fine": (1 * DAY_MS, 30), "medium": (2 * DAY_MS, 15), "coarse": (5 * DAY_MS, 6)},
}

# --- fixed values: bucket label formats (UTC), per timeframe ---------------------------------
LABEL_FORMATS = {"24h": "HH:mm", "7d": "MM/dd HH:mm", "30d": "MM/dd"}

# --- fixed values: windows relative to now / data max -----------------------------------------
QUESTIONABLE_WINDOW_MS = 72 * HOUR_MS  # disputable reports younger than this are questionable
URGENT_WINDOW_MS = 48 * HOUR_MS  # ... and urgent when younger than this
ACTIVE_WINDOW_MS = 24 * HOUR_MS  # reporter counts as active when it reported within this
RECENT_ACTIVITY_MS = 1 * HOUR_MS  # "recent activity" and absent-reporter look-back
UNIQUE_IDS_WINDOW_MS = 30 * DAY_MS  # unique query ids window

# --- fixed values: top-k sizes -----------------------------------------------------------------
TOP_REPORTERS = 50
TOP_QUERY_IDS = 50
TOP_SERIES_QUERIES = 50
TOP_SERIES_REPORTERS = 15
TOP_VALUE_QUERIES = 20
TOP_QUERIES_24H = 20
TOP_POWER = 10
TOP_COMMISSION = 10
RECENT_BLOCKS = 10  # power_of_aggr_recent recomputes only this many newest blocks

# --- fixed values: paging ----------------------------------------------------------------------
PAGE_DEFAULT = 100
PAGE_MAX = 1000

# --- fixed values: agreement classes -----------------------------------------------------------
# asymmetric agreement (percent of trusted value): perfect >= 99, good >= 95, moderate >= 90, else poor
AGREEMENT_CLASSES = ((99.0, "perfect"), (95.0, "good"), (90.0, "moderate"))
# symmetric agreement (search page): perfect >= 95, good >= 80, moderate >= 60, else poor
SYMMETRIC_CLASSES = ((95.0, "perfect"), (80.0, "good"), (60.0, "moderate"))

# --- fixed values: text rules ------------------------------------------------------------------
QUERY_NAME_MAX = 15  # ids longer than this are shortened to the first 12 characters + "..."
QUERY_NAME_KEEP = 12
REPORTER_NAME_MAX = 20  # addresses longer than this become first 8 + "..." + last 6
REPORTER_HEAD = 8
REPORTER_TAIL = 6
PLACEHOLDER_PREFIX = 12  # placeholder moniker "Unknown (<first 12>...)"
FIXED_POINT_SCALE = 10**18  # commission_rate is an 18-decimal fixed-point integer

# --- fixed values: file rules ------------------------------------------------------------------
REPORT_FILE_PATTERN = r"^table_(\d+)\.csv$"
HISTORICAL_KEEP = 100
HISTORICAL_MAX_BYTES = 500 * 1024 * 1024
ACTIVE_WARN_BYTES = 1024 * 1024 * 1024

# --- fixed values: chain block timing ----------------------------------------------------------
BLOCKS_PER_DAY = 14400  # 6 second blocks
HEIGHT_STEP = 10000
ESTIMATE_STEP_BLOCKS = 5000
ESTIMATE_BLOCK_SECONDS = 6
ESTIMATE_POINTS = 20
SNAPSHOT_THROTTLE_MS = HOUR_MS  # a realtime snapshot is kept only if none exists within this

# Reference point for fixtures and checks: 2024-01-31T00:00:00Z.
FIXTURE_NOW_MS = 1706659200000
