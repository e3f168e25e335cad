"""SQL twins of the registered queries, for DuckDB over the driver's tables (pre-registered views).

Each string recomputes the same result from the raw tables: the report adapter, first-writer-wins
dedupe and then the operator, written as plain SQL (the way the original dashboard phrases it).
"""

from __future__ import annotations

from reportlake import constants as K
from reportlake.constants import FIXTURE_NOW_MS as NOW

SQL: dict[str, str] = {}

RAW = r"""
raw AS (
  SELECT
    'reporter1' || lpad(CAST(user_id AS VARCHAR), 24, '0') AS REPORTER,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'SpotPrice' ELSE 'Other' END AS QUERY_TYPE,
    md5(event_type || '-' || CAST(event_id % 13 AS VARCHAR)) AS QUERY_ID,
    'weighted-median' AS AGGREGATE_METHOD,
    event_id % 2 = 0 AS CYCLELIST,
    CAST(1 + (user_id * 37) % 1200 AS INTEGER) AS POWER,
    ms // 600000 * 600000 AS "TIMESTAMP",
    CASE WHEN event_id % 103 = 0 THEN NULL
         ELSE CAST(tc // 100 AS VARCHAR) || '.' || lpad(CAST(tc % 100 AS VARCHAR), 2, '0') END AS TRUSTED_VALUE,
    upper(md5(CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR))) AS TX_HASH,
    ms + 5000 + event_id % 7000 AS "CURRENT_TIME",
    CAST(ms + 5000 + event_id % 7000 - ms // 600000 * 600000 AS INTEGER) AS TIME_DIFF,
    CASE WHEN event_id % 97 = 0 THEN '0xdead' WHEN event_id % 89 = 0 THEN NULL
         ELSE CAST(vc // 100 AS VARCHAR) || '.' || lpad(CAST(vc % 100 AS VARCHAR), 2, '0') END AS "VALUE",
    event_id % 40 = 0 AS DISPUTABLE,
    'table_' || CAST(ms // 86400000 * 86400 AS VARCHAR) || '.csv' AS source_file,
    event_id AS line_no
  FROM (
    SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms,
           CAST(round(value * 100) AS BIGINT) AS vc,
           greatest(CAST(round(value * 100) AS BIGINT) + event_id % 21 - 10, 0) AS tc
    FROM events
  ) e
)"""

REPORTS = r"""
reports AS (
  SELECT * EXCLUDE (rn, line_no) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY TX_HASH
      ORDER BY TRY_CAST(regexp_extract(source_file, '^table_(\d+)\.csv$', 1) AS BIGINT), line_no) AS rn
    FROM raw WHERE TX_HASH IS NOT NULL) d
  WHERE rn = 1
)"""

# D5 as SQL: with two or more distinct blocks, drop the newest one
BOUNDS = """
bounds AS (SELECT min("TIMESTAMP") AS mn, max("TIMESTAMP") AS mx FROM reports)"""
SAFE = """(SELECT mx FROM bounds) IS NULL OR (SELECT mn FROM bounds) = (SELECT mx FROM bounds)
     OR "TIMESTAMP" < (SELECT mx FROM bounds)"""

POA = """
bp AS (SELECT "TIMESTAMP", CAST(SUM(POWER) AS BIGINT) AS POWER_OF_AGGR FROM reports
       WHERE "TIMESTAMP" IS NOT NULL GROUP BY "TIMESTAMP"),
with_power AS (SELECT r.*, bp.POWER_OF_AGGR FROM reports r LEFT JOIN bp USING ("TIMESTAMP"))"""

SNAPSHOTS = """
snapshots AS (
  SELECT "TIMESTAMP" // 6000 AS height, "TIMESTAMP" AS timestamp_ms,
         CAST(SUM(POWER) AS BIGINT) AS maximal_power, max("CURRENT_TIME") AS created_at,
         CASE WHEN ("TIMESTAMP" // 600000) % 6 = 5 THEN 'realtime' ELSE 'historical' END AS sample_type
  FROM raw WHERE "TIMESTAMP" IS NOT NULL GROUP BY "TIMESTAMP"
)"""

MAPPINGS = """
mappings AS (
  SELECT DISTINCT md5(event_type || '-' || CAST(event_id % 13 AS VARCHAR)) AS query_id,
         upper(event_type) || '/' || CAST(event_id % 13 AS VARCHAR) AS name
  FROM events
)"""

REGISTRY = f"""
registry AS (
  SELECT
    'reporter1' || lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS address,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS moniker,
    CAST(c_nationkey + 1 AS VARCHAR) || '0000000000000000' AS commission_rate,
    (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0) AS jailed,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 THEN {NOW} + (c_custkey % 5) * 86400000 END
      AS jailed_until,
    {NOW} - (c_custkey % 720) * 3600000 AS last_updated,
    CAST(1000000 AS BIGINT) AS min_tokens_required,
    CAST(floor(greatest(c_acctbal, 0.0)) AS INTEGER) AS power,
    CAST({NOW} AS BIGINT) AS fetched_at,
    CAST({NOW} AS BIGINT) AS updated_at
  FROM customer
)"""

# numeric forms of VALUE / TRUSTED_VALUE (D7): suffix text and non-finite numbers are NULL
def num(col: str) -> str:
    x = f"TRY_CAST({col} AS DOUBLE)"
    return f"(CASE WHEN NOT regexp_matches({col}, '[dDfF]\\s*$') AND isfinite({x}) THEN {x} END)"


def exact_mean(x: str) -> str:
    """Mean rounded half-up at 6 decimals from integer ten-billionths where all magnitudes are 0 or 1e-3 .. 1e15, else
    the plain double mean."""
    v = f"CAST({x} AS DOUBLE)"
    total = f"SUM(CASE WHEN abs({v}) < 1e15 THEN CAST(CAST({v} AS DECIMAL(38,10)) * 10000000000 AS HUGEINT) END)"
    n = f"COUNT({v})"
    q = f"(sign({total}) * ((2 * abs({total}) + {n} * 10000) // (2 * {n} * 10000)))"
    plain = f"MAX(abs({v})) < 1e15 AND COALESCE(MIN(CASE WHEN {v} <> 0 THEN abs({v}) END) >= 1e-3, TRUE)"
    return f"(CASE WHEN {n} = 0 THEN NULL WHEN {plain} THEN CAST({q} AS DOUBLE) / 1000000.0 ELSE AVG({v}) END)"


V = num('"VALUE"')
T = num("TRUSTED_VALUE")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def short_name(qid: str = "QUERY_ID", name: str = "name") -> str:
    return (
        f"COALESCE({name}, CASE WHEN length({qid}) > {K.QUERY_NAME_MAX} "
        f"THEN substr({qid}, 1, {K.QUERY_NAME_KEEP}) || '...' ELSE {qid} END)"
    )


def display_name(addr: str = "REPORTER", moniker: str = "moniker") -> str:
    return (
        f"COALESCE(NULLIF({moniker}, ''), CASE WHEN length({addr}) > {K.REPORTER_NAME_MAX} "
        f"THEN substr({addr}, 1, {K.REPORTER_HEAD}) || '...' || right({addr}, {K.REPORTER_TAIL}) ELSE {addr} END)"
    )


def spec(tf: str, res: str = "fine") -> tuple[int, int, int]:
    interval, n = K.BUCKET_SPECS[tf][res]
    return NOW - n * interval, interval, n


def label(tf: str, start: int, interval: int, b: str = "bucket_id") -> str:
    fmt = {"24h": "%H:%M", "7d": "%m/%d %H:%M", "30d": "%m/%d"}[tf]
    return f"strftime(epoch_ms({start} + {b} * {interval}), '{fmt}')"


# ---------------------------------------------------------------- dedupe and block logic

SQL["dedupe_reports"] = f"{with_(RAW, REPORTS)} SELECT * FROM reports"

SQL["power_of_aggr"] = f"{with_(RAW, REPORTS, POA)} SELECT * FROM with_power"

SQL["power_of_aggr_recent"] = f"""{with_(RAW, REPORTS)},
recent AS (SELECT DISTINCT "TIMESTAMP" FROM reports WHERE "TIMESTAMP" IS NOT NULL ORDER BY "TIMESTAMP" DESC LIMIT {K.RECENT_BLOCKS}),
rr AS (SELECT * FROM reports WHERE "TIMESTAMP" IN (SELECT "TIMESTAMP" FROM recent)),
bp AS (SELECT "TIMESTAMP", CAST(SUM(POWER) AS BIGINT) AS POWER_OF_AGGR FROM rr GROUP BY "TIMESTAMP")
SELECT rr.*, bp.POWER_OF_AGGR FROM rr LEFT JOIN bp USING ("TIMESTAMP")"""

SQL["power_of_aggr_file"] = f"""{with_(RAW, REPORTS, POA)}
SELECT * FROM with_power
WHERE source_file = (SELECT arg_max(source_file, CAST(regexp_extract(source_file, '(\\d+)', 1) AS BIGINT)) FROM reports)"""

SQL["power_stats"] = f"""{with_(RAW, REPORTS, POA)}
SELECT COUNT(DISTINCT "TIMESTAMP") AS unique_timestamps, COUNT(*) AS total_rows,
       MIN(POWER_OF_AGGR) AS min_power_of_aggr, MAX(POWER_OF_AGGR) AS max_power_of_aggr
FROM with_power WHERE POWER_OF_AGGR IS NOT NULL"""

SQL["safe_block_filter"] = f"{with_(RAW, REPORTS, BOUNDS)} SELECT * FROM reports WHERE {SAFE}"

SQL["safe_timestamp"] = f"""{with_(RAW, REPORTS)}
SELECT COALESCE((SELECT max("TIMESTAMP") FROM reports WHERE "TIMESTAMP" < (SELECT max("TIMESTAMP") FROM reports)),
                (SELECT max("TIMESTAMP") FROM reports)) AS safe_timestamp"""

SQL["block_consistency"] = f"""{with_(RAW, REPORTS, POA)}
SELECT "TIMESTAMP", COUNT(*) AS row_count, CAST(SUM(POWER) AS BIGINT) AS total_power,
       MIN(POWER_OF_AGGR) AS min_power_of_aggr, MAX(POWER_OF_AGGR) AS max_power_of_aggr,
       CASE WHEN MIN(POWER_OF_AGGR) = MAX(POWER_OF_AGGR) THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS consistency,
       CASE WHEN SUM(POWER) = MIN(POWER_OF_AGGR) THEN 'CORRECT' ELSE 'INCORRECT' END AS verification
FROM with_power GROUP BY "TIMESTAMP" """

SQL["first_n_per_block"] = f"""{with_(RAW, REPORTS, POA)}
SELECT "TIMESTAMP", REPORTER, POWER, POWER_OF_AGGR, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY "TIMESTAMP" ORDER BY REPORTER ASC NULLS LAST, TX_HASH) AS rn
  FROM with_power) x
WHERE rn <= 3"""


# ---------------------------------------------------------------- series


def _activity(tf: str) -> str:
    start, interval, n = spec(tf)
    return f"""{with_(RAW, REPORTS, BOUNDS, POA, SNAPSHOTS)},
rows_ AS (SELECT * FROM with_power WHERE "TIMESTAMP" >= {start} AND "TIMESTAMP" < {NOW} AND ({SAFE})),
tb AS (
  SELECT ("TIMESTAMP" - {start}) // {interval} AS bucket_id,
         COUNT(DISTINCT REPORTER) AS active_reporters, COUNT(*) AS total_reports,
         PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY COALESCE(POWER_OF_AGGR, 0)) AS representative_power_of_aggr
  FROM rows_ GROUP BY 1),
sb AS (
  SELECT bucket_id, p FROM (
    SELECT (timestamp_ms - {start}) // {interval} AS bucket_id, COALESCE(maximal_power, 0) AS p,
           row_number() OVER (PARTITION BY (timestamp_ms - {start}) // {interval}
                              ORDER BY timestamp_ms DESC, height DESC) AS rn
    FROM snapshots WHERE timestamp_ms >= {start} AND timestamp_ms <= {NOW}) s
  WHERE rn = 1 AND bucket_id >= 0 AND bucket_id < {n}),
bs AS (SELECT range AS bucket_id FROM range(0, {n})),
net AS (
  SELECT bs.bucket_id,
         COALESCE(last_value(sb.p IGNORE NULLS) OVER (ORDER BY bs.bucket_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS maximal_power_network
  FROM bs LEFT JOIN sb USING (bucket_id))
SELECT bs.bucket_id, {label(tf, start, interval, 'bs.bucket_id')} AS time_label,
       COALESCE(tb.active_reporters, 0) AS active_reporters,
       COALESCE(tb.total_reports, 0) AS total_reports,
       COALESCE(tb.representative_power_of_aggr, 0.0) AS representative_power_of_aggr,
       CAST(net.maximal_power_network AS BIGINT) AS maximal_power_network,
       (max(net.maximal_power_network) OVER ()) > 0 AS has_maximal_power_data
FROM bs LEFT JOIN tb USING (bucket_id) LEFT JOIN net USING (bucket_id)"""


def _histogram(tf: str, res: str = "fine") -> str:
    start, interval, n = spec(tf, res)
    return f"""{with_(RAW, REPORTS)},
tb AS (SELECT ("TIMESTAMP" - {start}) // {interval} AS bucket_id, COUNT(*) AS c FROM reports
       WHERE "TIMESTAMP" >= {start} AND "TIMESTAMP" < {NOW} GROUP BY 1),
bs AS (SELECT range AS bucket_id FROM range(0, {n}))
SELECT bs.bucket_id, {start} + bs.bucket_id * {interval} AS bucket_start_ms,
       {label(tf, start, interval, 'bs.bucket_id')} AS time_label, COALESCE(tb.c, 0) AS "count"
FROM bs LEFT JOIN tb USING (bucket_id)"""


def _keyed(tf: str, key: str, top_n: int, rank_where: str, series_where: str, aggs: str, fills: str,
           extra_ctes: str = "", extra_join: str = "", extra_cols: str = "", safe_series: bool = True) -> str:
    """Generic SQL twin of ``series.keyed_series``."""
    start, interval, n = spec(tf)
    win = f'"TIMESTAMP" >= {start} AND "TIMESTAMP" < {NOW}'
    s_safe = f"AND ({SAFE})" if safe_series else ""
    return f"""{with_(RAW, REPORTS, BOUNDS, MAPPINGS, REGISTRY)}{extra_ctes},
top AS (SELECT {key}, COUNT(*) AS total_count FROM reports
        WHERE {win} AND ({SAFE}) AND {key} IS NOT NULL AND ({rank_where})
        GROUP BY {key} ORDER BY total_count DESC, {key} ASC LIMIT {top_n}),
pb AS (SELECT {key}, ("TIMESTAMP" - {start}) // {interval} AS bucket_id, {aggs}
       FROM reports WHERE {win} {s_safe} AND ({series_where}) AND {key} IN (SELECT {key} FROM top)
       GROUP BY 1, 2),
grid AS (SELECT top.*, range AS bucket_id FROM top, range(0, {n}))
SELECT grid.{key}, grid.total_count, grid.bucket_id, {label(tf, start, interval, 'grid.bucket_id')} AS time_label,
       {fills}{extra_cols}
FROM grid LEFT JOIN pb USING ({key}, bucket_id) {extra_join}"""


def _query_series(tf: str) -> str:
    return _keyed(
        tf, "QUERY_ID", K.TOP_SERIES_QUERIES, "TRUE", "TRUE", 'COUNT(*) AS c', 'COALESCE(pb.c, 0) AS "count"',
        extra_join="LEFT JOIN mappings m ON m.query_id = grid.QUERY_ID",
        extra_cols=f", {short_name('grid.QUERY_ID', 'm.name')} AS short_name",
    )


for _tf in ("24h", "7d", "30d"):
    _sfx = "" if _tf == "24h" else f"_{_tf}"
    SQL[f"activity_series{_sfx}"] = _activity(_tf)
    SQL[f"reports_histogram{_sfx}"] = _histogram(_tf)
    SQL[f"query_series{_sfx}"] = _query_series(_tf)

SQL["reports_histogram_24h_medium"] = _histogram("24h", "medium")
SQL["reports_histogram_30d_coarse"] = _histogram("30d", "coarse")

SQL["reporter_series"] = _keyed(
    "7d", "REPORTER", K.TOP_SERIES_REPORTERS, "TRUE", "TRUE", "COUNT(*) AS c", 'COALESCE(pb.c, 0) AS "count"',
    extra_join="LEFT JOIN registry g ON g.address = grid.REPORTER",
    extra_cols=f", {display_name('grid.REPORTER', 'g.moniker')} AS display_name",
    safe_series=False,
)

SQL["agreement_series"] = _keyed(
    "7d", "QUERY_ID", K.TOP_SERIES_QUERIES, f"{T} IS NOT NULL AND {T} != 0", "TRUE",
    f"AVG(CASE WHEN {T} IS NOT NULL AND {T} != 0 AND {V} IS NOT NULL THEN abs(({V} - {T}) / {T}) * 100 END) AS d",
    "round(pb.d, 6) AS avg_deviation",
    extra_join="LEFT JOIN mappings m ON m.query_id = grid.QUERY_ID",
    extra_cols=f", {short_name('grid.QUERY_ID', 'm.name')} AS short_name",
)


def _latest_cte(name: str, expr: str) -> str:
    return f""",
{name} AS (
  SELECT QUERY_ID, arg_max(x, ("TIMESTAMP", TX_HASH)) AS {name} FROM (
    SELECT QUERY_ID, "TIMESTAMP", TX_HASH, {expr} AS x FROM reports
    WHERE QUERY_TYPE = 'SpotPrice' AND ({SAFE})) s
  WHERE x IS NOT NULL GROUP BY QUERY_ID)"""


def _value(tf: str, expr: str) -> str:
    return _keyed(
        tf, "QUERY_ID", K.TOP_VALUE_QUERIES, "QUERY_TYPE = 'SpotPrice'", f"QUERY_TYPE = 'SpotPrice' AND {expr} IS NOT NULL",
        f"{exact_mean(expr)} AS a", "pb.a AS avg_value",
        extra_ctes=_latest_cte("most_recent_value", expr),
        extra_join="LEFT JOIN most_recent_value lv USING (QUERY_ID) LEFT JOIN mappings m ON m.query_id = grid.QUERY_ID",
        extra_cols=f", lv.most_recent_value, {short_name('grid.QUERY_ID', 'm.name')} AS short_name",
    )


SQL["value_series"] = _value("7d", V)
SQL["trusted_value_series"] = _value("7d", T)

SQL["overlay_series"] = _keyed(
    "30d", "QUERY_ID", K.TOP_VALUE_QUERIES, "QUERY_TYPE = 'SpotPrice'", "QUERY_TYPE = 'SpotPrice'",
    f"{exact_mean(V)} AS a, {exact_mean(T)} AS b", "pb.a AS avg_value, pb.b AS avg_trusted_value",
    extra_ctes=_latest_cte("most_recent_value", V) + _latest_cte("most_recent_trusted_value", T),
    extra_join=(
        "LEFT JOIN most_recent_value lv USING (QUERY_ID) LEFT JOIN most_recent_trusted_value lt USING (QUERY_ID) "
        "LEFT JOIN mappings m ON m.query_id = grid.QUERY_ID"
    ),
    extra_cols=f", lv.most_recent_value, lt.most_recent_trusted_value, {short_name('grid.QUERY_ID', 'm.name')} AS short_name",
)


def _locf(tf: str) -> str:
    start, interval, n = spec(tf)
    return f"""{with_(RAW, SNAPSHOTS)},
sb AS (
  SELECT bucket_id, p FROM (
    SELECT (timestamp_ms - {start}) // {interval} AS bucket_id, COALESCE(maximal_power, 0) AS p,
           row_number() OVER (PARTITION BY (timestamp_ms - {start}) // {interval}
                              ORDER BY timestamp_ms DESC, height DESC) AS rn
    FROM snapshots WHERE timestamp_ms >= {start} AND timestamp_ms <= {NOW}) s
  WHERE rn = 1 AND bucket_id >= 0 AND bucket_id < {n}),
bs AS (SELECT range AS bucket_id FROM range(0, {n}))
SELECT bs.bucket_id,
       CAST(COALESCE(last_value(sb.p IGNORE NULLS) OVER (ORDER BY bs.bucket_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS maximal_power_network
FROM bs LEFT JOIN sb USING (bucket_id)"""


SQL["locf_series"] = _locf("24h")


# ---------------------------------------------------------------- statistics

BASE = with_(RAW, REPORTS, BOUNDS)
SAFE_ROWS = f"(SELECT * FROM reports WHERE {SAFE})"

SQL["stats_counts"] = f"""{BASE}
SELECT COUNT(*) AS total_rows, COUNT(DISTINCT REPORTER) AS unique_reporters,
       COUNT(DISTINCT QUERY_TYPE) AS unique_query_types FROM {SAFE_ROWS} s"""

SQL["unique_query_ids_30d"] = f"""{BASE}
SELECT COUNT(DISTINCT QUERY_ID) AS unique_query_ids_30d FROM {SAFE_ROWS} s
WHERE "TIMESTAMP" >= {NOW - K.UNIQUE_IDS_WINDOW_MS}"""

SQL["average_agreement"] = f"""{BASE},
casted AS (SELECT {V} AS V, {T} AS T FROM reports)
SELECT round(AVG(CASE WHEN V = T THEN 100.0
                      WHEN T IS NOT NULL AND T != 0 THEN greatest(0.0, (1 - abs((V - T) / T)) * 100) END), 2)
       AS average_agreement
FROM casted WHERE V IS NOT NULL AND T IS NOT NULL"""

SQL["value_stats"] = f"""{BASE},
casted AS (SELECT {V} AS V FROM reports)
SELECT MIN(V) AS min_value, MAX(V) AS max_value, MEDIAN(V) AS median_value FROM casted"""

SQL["recent_activity"] = f"""{BASE}
SELECT COUNT(*) AS recent_activity FROM reports
WHERE "CURRENT_TIME" > (SELECT MAX("CURRENT_TIME") - {K.RECENT_ACTIVITY_MS} FROM reports)"""

SQL["questionable_stats"] = f"""{BASE},
q AS (SELECT COUNT(*) AS total, COUNT(CASE WHEN ({NOW} - "TIMESTAMP") < {K.URGENT_WINDOW_MS} THEN 1 END) AS urgent
      FROM reports WHERE DISPUTABLE = true AND ({NOW} - "TIMESTAMP") < {K.QUESTIONABLE_WINDOW_MS})
SELECT total, urgent, urgent > 0 AS has_urgent FROM q"""


def _top(key: str, k: int | None) -> str:
    lim = f"LIMIT {k}" if k else ""
    return f"""{BASE}
SELECT {key}, COUNT(*) AS "count" FROM reports GROUP BY {key} ORDER BY "count" DESC, {key} ASC NULLS LAST {lim}"""


SQL["top_reporters"] = _top("REPORTER", K.TOP_REPORTERS)
SQL["top_query_ids"] = _top("QUERY_ID", K.TOP_QUERY_IDS)
SQL["query_type_distribution"] = _top("QUERY_TYPE", None)

SQL["queries_24h"] = f"""{with_(RAW, REPORTS, MAPPINGS)},
t AS (SELECT QUERY_ID, COUNT(*) AS report_count, COUNT(DISTINCT REPORTER) AS unique_reporters FROM reports
      WHERE "TIMESTAMP" >= {NOW - K.ACTIVE_WINDOW_MS} GROUP BY QUERY_ID
      ORDER BY report_count DESC, QUERY_ID ASC NULLS LAST LIMIT {K.TOP_QUERIES_24H})
SELECT t.*, {short_name('t.QUERY_ID', 'm.name')} AS short_name FROM t LEFT JOIN mappings m ON m.query_id = t.QUERY_ID"""

LATEST = """
latest AS (
  SELECT r.* FROM reports r
  JOIN (SELECT QUERY_ID, max("TIMESTAMP") AS mt FROM reports
        WHERE QUERY_ID IS NOT NULL AND "TIMESTAMP" IS NOT NULL GROUP BY QUERY_ID) n
    ON r.QUERY_ID = n.QUERY_ID AND r."TIMESTAMP" = n.mt)"""

SQL["power_distribution_query"] = f"""{with_(RAW, REPORTS, REGISTRY, LATEST)}
SELECT l.QUERY_ID, l."TIMESTAMP", l.REPORTER, l.POWER, l."VALUE", l.TRUSTED_VALUE,
       {display_name('l.REPORTER', 'g.moniker')} AS short_name
FROM latest l LEFT JOIN registry g ON g.address = l.REPORTER"""

SQL["query_block_info"] = f"""{with_(RAW, REPORTS, LATEST)}
SELECT QUERY_ID, "TIMESTAMP", QUERY_TYPE, COUNT(*) AS total_reports, COUNT(DISTINCT REPORTER) AS unique_reporters,
       {exact_mean(V)} AS avg_value, MIN({V}) AS min_value, MAX({V}) AS max_value
FROM latest GROUP BY QUERY_ID, "TIMESTAMP", QUERY_TYPE"""

SAFE_TS = """(SELECT COALESCE((SELECT max("TIMESTAMP") FROM reports WHERE "TIMESTAMP" < (SELECT max("TIMESTAMP") FROM reports)),
                 (SELECT max("TIMESTAMP") FROM reports)))"""

SQL["power_distribution_overall"] = f"""{with_(RAW, REPORTS, REGISTRY)},
b AS (SELECT "TIMESTAMP", REPORTER, POWER, TX_HASH FROM reports WHERE "TIMESTAMP" = {SAFE_TS}),
tot AS (SELECT CAST(SUM(POWER) AS BIGINT) AS total_power FROM b)
SELECT b.*, tot.total_power,
       CASE WHEN tot.total_power > 0 THEN round(CAST(b.POWER AS DOUBLE) / tot.total_power * 100.0, 1) ELSE 0.0 END
         AS power_share,
       {display_name('b.REPORTER', 'g.moniker')} AS short_name
FROM b CROSS JOIN tot LEFT JOIN registry g ON g.address = b.REPORTER"""

SQL["absent_reporters"] = f"""{with_(RAW, REPORTS, REGISTRY)},
recent AS (SELECT DISTINCT REPORTER FROM reports WHERE "CURRENT_TIME" >= {NOW - K.RECENT_ACTIVITY_MS}),
absent AS (SELECT REPORTER FROM recent
           WHERE REPORTER NOT IN (SELECT REPORTER FROM reports WHERE "TIMESTAMP" = {SAFE_TS} AND REPORTER IS NOT NULL)),
last AS (SELECT REPORTER, arg_max(POWER, ("CURRENT_TIME", TX_HASH)) AS last_power,
                max("CURRENT_TIME") AS last_report_time
         FROM reports WHERE REPORTER IN (SELECT REPORTER FROM absent) GROUP BY REPORTER)
SELECT last.*, {display_name('last.REPORTER', 'g.moniker')} AS short_name
FROM last LEFT JOIN registry g ON g.address = last.REPORTER"""

SQL["reporter_tx_stats"] = f"""{BASE}
SELECT REPORTER, COUNT(*) AS total_transactions, COUNT(DISTINCT QUERY_ID) AS unique_queries,
       {exact_mean(V)} AS avg_value, MIN("TIMESTAMP") AS first_transaction, MAX("TIMESTAMP") AS last_transaction
FROM reports GROUP BY REPORTER"""


# ---------------------------------------------------------------- registry

REG = with_(RAW, REPORTS, REGISTRY)
ACTIVE = f"""
active AS (SELECT DISTINCT REPORTER AS address FROM reports
           WHERE "CURRENT_TIME" > (SELECT MAX("CURRENT_TIME") - {K.ACTIVE_WINDOW_MS} FROM reports)),
flagged AS (SELECT r.*, (a.address IS NOT NULL) AS active_24h FROM registry r LEFT JOIN active a USING (address))"""

SQL["active_power"] = f"""{REG}
SELECT COUNT(DISTINCT address) AS active_reporter_count, CAST(COALESCE(SUM(power), 0) AS BIGINT) AS total_active_power
FROM registry WHERE address IN (SELECT REPORTER FROM reports WHERE "CURRENT_TIME" >= {NOW - K.ACTIVE_WINDOW_MS})"""

UNKNOWN = """
unknown AS (SELECT DISTINCT REPORTER AS address FROM reports
            WHERE REPORTER IS NOT NULL AND REPORTER != ''
              AND REPORTER NOT IN (SELECT address FROM registry))"""

SUPPLIERS = """FROM (SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal,
        'MACHINERY' AS c_mktsegment FROM supplier)"""
REG_S = REG.replace("FROM customer", SUPPLIERS)

SQL["unknown_reporters"] = f"{REG_S},{UNKNOWN} SELECT address FROM unknown"

SQL["placeholder_reporters"] = f"""{REG_S},{UNKNOWN}
SELECT * FROM registry
UNION ALL
SELECT address, 'Unknown (' || substr(address, 1, {K.PLACEHOLDER_PREFIX}) || '...)' AS moniker, '0' AS commission_rate,
       false AS jailed, CAST(NULL AS BIGINT) AS jailed_until, CAST(NULL AS BIGINT) AS last_updated,
       CAST(0 AS BIGINT) AS min_tokens_required, CAST(0 AS INTEGER) AS power,
       CAST({NOW} AS BIGINT) AS fetched_at, CAST({NOW} AS BIGINT) AS updated_at
FROM unknown"""

SQL["upsert_registry"] = f"""{REG},
later AS (
  SELECT g.address, g.moniker || ' v2' AS moniker, g.commission_rate, g.jailed, g.jailed_until, g.last_updated,
         g.min_tokens_required, g.power + 7 AS power, g.fetched_at + 60000 AS fetched_at, g.updated_at + 60000 AS updated_at
  FROM registry g JOIN customer c ON g.address = 'reporter1' || lpad(CAST(c.c_custkey AS VARCHAR), 24, '0')
  WHERE c.c_mktsegment = 'BUILDING'),
both_ AS (SELECT * FROM registry UNION ALL SELECT * FROM later)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY fetched_at DESC, updated_at DESC, moniker DESC) AS rn
  FROM both_) x WHERE rn = 1"""


def _reporters_page(where: str, order: str, limit: int, offset: int) -> str:
    return f"""{REG},{ACTIVE}
SELECT * FROM flagged WHERE {where} ORDER BY {order}, address ASC LIMIT {limit} OFFSET {offset}"""


SQL["reporters_page"] = _reporters_page("TRUE", "power DESC NULLS LAST", 100, 0)
SQL["reporters_page_search"] = _reporters_page(
    "(contains(moniker, '00001') OR contains(address, '00001'))",
    "TRY_CAST(commission_rate AS DECIMAL(38,0)) ASC NULLS LAST", 50, 10)
SQL["reporters_page_jailed"] = _reporters_page("jailed = true", "last_updated ASC NULLS LAST", 1000, 0)

SQL["reporter_detail"] = f"""{REG},
strongest AS (SELECT address FROM registry ORDER BY power DESC, address LIMIT 1),
tx AS (SELECT REPORTER AS address, COUNT(*) AS total_transactions, COUNT(DISTINCT QUERY_ID) AS unique_queries,
              {exact_mean(V)} AS avg_value, MIN("TIMESTAMP") AS first_transaction, MAX("TIMESTAMP") AS last_transaction
       FROM reports WHERE REPORTER = (SELECT address FROM strongest) GROUP BY REPORTER)
SELECT g.*, tx.total_transactions, tx.unique_queries, tx.avg_value, tx.first_transaction, tx.last_transaction
FROM registry g LEFT JOIN tx USING (address) WHERE g.address = (SELECT address FROM strongest)"""

SQL["reporters_summary"] = f"""{REG},{ACTIVE}
SELECT COUNT(*) AS total_reporters, COUNT(CASE WHEN jailed = true THEN 1 END) AS jailed_reporters,
       COUNT(CASE WHEN active_24h THEN 1 END) AS active_reporters, COALESCE({exact_mean('power')}, 0.0) AS avg_power,
       COALESCE(MAX(power), 0) AS max_power, CAST(COALESCE(SUM(power), 0) AS BIGINT) AS total_power
FROM flagged"""

SQL["top_power"] = f"""{REG}
SELECT moniker, address, power FROM registry WHERE power > 0 ORDER BY power DESC, address ASC LIMIT {K.TOP_POWER}"""

SQL["commission_distribution"] = f"""{REG}
SELECT commission_rate, COUNT(*) AS "count" FROM registry GROUP BY commission_rate
ORDER BY "count" DESC, commission_rate ASC NULLS LAST LIMIT {K.TOP_COMMISSION}"""

SQL["power_utilization"] = f"""{REG},
act AS (SELECT CAST(COALESCE(SUM(power), 0) AS BIGINT) AS total_active_power FROM registry
        WHERE address IN (SELECT REPORTER FROM reports WHERE "CURRENT_TIME" >= {NOW - K.ACTIVE_WINDOW_MS})),
tot AS (SELECT CAST(SUM(power) AS BIGINT) AS total_power FROM registry)
SELECT act.total_active_power, tot.total_power,
       CASE WHEN act.total_active_power > 0 AND tot.total_power > 0
            THEN round(act.total_active_power / tot.total_power * 100.0, 1) END AS power_utilization
FROM act, tot"""

SQL["registry_view"] = f"""{REG},{ACTIVE},
m AS (SELECT MAX(power) AS mx, CAST(SUM(power) AS BIGINT) AS tot FROM registry)
SELECT address,
       round(TRY_CAST(commission_rate AS DOUBLE) / {K.FIXED_POINT_SCALE // 100}, 1) AS commission_pct,
       CASE WHEN COALESCE(jailed, false) THEN 'Jailed' WHEN power > 0 THEN 'Free' ELSE 'Jailed' END AS status,
       CASE WHEN active_24h THEN 'Active' ELSE 'Inactive' END AS activity,
       CASE WHEN m.mx > 0 THEN round(CAST(power AS DOUBLE) / m.mx * 100.0, 1) ELSE 0.0 END AS power_bar,
       CASE WHEN m.tot > 0 THEN round(CAST(power AS DOUBLE) / m.tot * 100.0, 1) ELSE 0.0 END AS power_share
FROM flagged, m"""


# ---------------------------------------------------------------- filters, pages, search

SEARCH = "12"
FILTERED = f"""
filtered AS (
  SELECT * FROM reports
  WHERE contains(REPORTER, '0001') AND QUERY_TYPE = 'SpotPrice' AND {V} >= 10.0 AND {V} <= 50.0 AND ({SAFE}))"""

SQL["filter_reports"] = f"{BASE},{FILTERED} SELECT * FROM filtered"

SQL["filter_questionable"] = f"""{BASE}
SELECT * FROM reports WHERE COALESCE(DISPUTABLE, false) AND ({NOW} - "TIMESTAMP") < {K.QUESTIONABLE_WINDOW_MS} AND ({SAFE})"""

SQL["reports_page"] = f"""{BASE},{FILTERED}
SELECT * FROM filtered ORDER BY "TIMESTAMP" DESC NULLS LAST, TX_HASH ASC
LIMIT 100 OFFSET (SELECT least(200, greatest(0, COUNT(*) - 100)) FROM filtered)"""

SQL["reports_page_last"] = f"""{BASE},
s AS (SELECT *, row_number() OVER (ORDER BY "TIMESTAMP" DESC NULLS LAST, TX_HASH ASC) AS rn,
             COUNT(*) OVER () AS total FROM reports WHERE {SAFE})
SELECT COALESCE(REPORTER, '') AS REPORTER, COALESCE(QUERY_TYPE, '') AS QUERY_TYPE, COALESCE(QUERY_ID, '') AS QUERY_ID,
       COALESCE(AGGREGATE_METHOD, '') AS AGGREGATE_METHOD, COALESCE(CYCLELIST, false) AS CYCLELIST,
       COALESCE(POWER, 0) AS POWER, COALESCE("TIMESTAMP", 0) AS "TIMESTAMP", COALESCE(TRUSTED_VALUE, '') AS TRUSTED_VALUE,
       COALESCE(TX_HASH, '') AS TX_HASH, COALESCE("CURRENT_TIME", 0) AS "CURRENT_TIME", COALESCE(TIME_DIFF, 0) AS TIME_DIFF,
       COALESCE("VALUE", '') AS "VALUE", COALESCE(DISPUTABLE, false) AS DISPUTABLE, COALESCE(source_file, '') AS source_file
FROM s WHERE rn > least(1000000000, greatest(0, total - 250)) AND rn <= least(1000000000, greatest(0, total - 250)) + 250"""

MATCHES = f"""
matches AS (
  SELECT * FROM reports
  WHERE (contains(REPORTER, '{SEARCH}') OR contains(QUERY_ID, '{SEARCH}') OR contains(TX_HASH, '{SEARCH}')
         OR contains("VALUE", '{SEARCH}')) AND ({SAFE}))"""

SQL["search_reports"] = f"""{BASE},{MATCHES}
SELECT * FROM matches ORDER BY "TIMESTAMP" DESC NULLS LAST, TX_HASH ASC LIMIT 100 OFFSET 50"""

SQL["search_count"] = f"""{BASE},{MATCHES}
SELECT COUNT(*) AS total, 150 < COUNT(*) AS has_more FROM matches"""

SQL["search_stats"] = f"""{BASE},{MATCHES},
casted AS (SELECT {V} AS V, {T} AS T, REPORTER, QUERY_ID, "TIMESTAMP", POWER FROM matches)
SELECT COUNT(*) AS total_matches, COUNT(DISTINCT REPORTER) AS unique_reporters, COUNT(DISTINCT QUERY_ID) AS unique_query_ids,
       MIN(V) AS min_value, MAX(V) AS max_value,
       {exact_mean('(CASE WHEN V IS NOT NULL AND T IS NOT NULL AND V = T THEN 1.0 ELSE 0.0 END)')} AS avg_agreement,
       MIN("TIMESTAMP") AS oldest_timestamp, MAX("TIMESTAMP") AS newest_timestamp, CAST(SUM(POWER) AS BIGINT) AS total_power
FROM casted"""

SQL["search_top_reporter"] = f"""{BASE},{MATCHES}
SELECT REPORTER, COUNT(*) AS "count" FROM matches GROUP BY REPORTER ORDER BY "count" DESC, REPORTER ASC NULLS LAST LIMIT 1"""

SQL["search_top_query"] = f"""{BASE},{MATCHES}
SELECT QUERY_ID, COUNT(*) AS "count" FROM matches GROUP BY QUERY_ID ORDER BY "count" DESC, QUERY_ID ASC NULLS LAST LIMIT 1"""


def _sym(v: str, t: str) -> str:
    avg = f"((abs({v}) + abs({t})) / 2.0)"
    return (f"(CASE WHEN {v} IS NULL OR {t} IS NULL THEN NULL WHEN {v} = {t} THEN 100.0 WHEN {avg} = 0 THEN 0.0 "
            f"ELSE greatest(0.0, 100.0 * (1.0 - abs({v} - {t}) / {avg})) END)")


def _classes(pct: str, classes) -> str:
    whens = " ".join(f"WHEN {pct} >= {b} THEN '{n}'" for b, n in classes)
    return f"(CASE WHEN {pct} IS NULL THEN 'n/a' {whens} ELSE 'poor' END)"


VT = """
vt AS (SELECT TX_HASH, {V} AS V, {T} AS T FROM reports)""".replace("{V}", V).replace("{T}", T)

SQL["report_detail"] = f"""{BASE},
d AS (SELECT *, {V} AS V, {T} AS T FROM reports)
SELECT TX_HASH, REPORTER, QUERY_TYPE, QUERY_ID, "VALUE", TRUSTED_VALUE, POWER, "TIMESTAMP",
       CASE WHEN CYCLELIST THEN 'Yes' ELSE 'No' END AS cyclelist_text,
       CASE WHEN DISPUTABLE THEN 'Yes' ELSE 'No' END AS disputable_text,
       round({_sym('V', 'T')}, 6) AS agreement, {_classes(_sym('V', 'T'), K.SYMMETRIC_CLASSES)} AS agreement_class
FROM d"""


# ---------------------------------------------------------------- per-row metrics

AGREE = "(CASE WHEN V IS NOT NULL AND T IS NOT NULL AND V = T THEN 100.0 WHEN V IS NOT NULL AND T IS NOT NULL AND T != 0 THEN greatest(0.0, (1 - abs((V - T) / T)) * 100) END)"
AGREE_UI = "(CASE WHEN V IS NOT NULL AND T IS NOT NULL AND T != 0 THEN (CASE WHEN V = T THEN 100.0 ELSE greatest(0.0, (1 - abs((V - T) / T)) * 100) END) END)"

SQL["numeric_values"] = f"{BASE},{VT} SELECT * FROM vt"
SQL["agreement_pct"] = f"{BASE},{VT} SELECT TX_HASH, round({AGREE}, 6) AS agreement_pct, round({AGREE_UI}, 6) AS agreement_pct_ui FROM vt"
SQL["agreement_class"] = f"{BASE},{VT} SELECT TX_HASH, {_classes(AGREE_UI, K.AGREEMENT_CLASSES)} AS agreement_class FROM vt"
SQL["symmetric_agreement"] = f"""{BASE},{VT}
SELECT TX_HASH, round({_sym('V', 'T')}, 6) AS symmetric_agreement, {_classes(_sym('V', 'T'), K.SYMMETRIC_CLASSES)} AS symmetric_class FROM vt"""
SQL["deviation_pct"] = f"""{BASE},{VT}
SELECT TX_HASH, round(CASE WHEN V IS NOT NULL AND T IS NOT NULL AND T != 0 THEN abs((V - T) / T) * 100 END, 6) AS deviation_pct FROM vt"""
SQL["exact_match_rate"] = f"""{BASE},{VT}
SELECT {exact_mean('(CASE WHEN V IS NOT NULL AND T IS NOT NULL AND V = T THEN 1.0 ELSE 0.0 END)')} AS exact_match_rate FROM vt"""

SQL["query_display_name"] = f"""{with_(RAW, REPORTS, MAPPINGS)}
SELECT i.QUERY_ID, {short_name('i.QUERY_ID', 'm.name')} AS short_name
FROM (SELECT DISTINCT QUERY_ID FROM reports) i LEFT JOIN mappings m ON m.query_id = i.QUERY_ID"""

SQL["reporter_display_name"] = f"""{REG}
SELECT i.REPORTER, {display_name('i.REPORTER', 'g.moniker')} AS display_name
FROM (SELECT DISTINCT REPORTER FROM reports) i LEFT JOIN registry g ON g.address = i.REPORTER"""

SQL["questionable"] = f"""{BASE}
SELECT TX_HASH, "TIMESTAMP", (COALESCE(DISPUTABLE, false) AND ({NOW} - "TIMESTAMP") < {K.URGENT_WINDOW_MS}) AS urgent
FROM reports WHERE COALESCE(DISPUTABLE, false) AND ({NOW} - "TIMESTAMP") < {K.QUESTIONABLE_WINDOW_MS}"""


# ---------------------------------------------------------------- sources, sinks

FILES = """
files AS (SELECT DISTINCT source_file AS filename,
                 CAST(regexp_extract(source_file, '^table_(\\d+)\\.csv$', 1) AS BIGINT) AS file_number FROM raw)"""

SQL["csv_roundtrip"] = SQL["dedupe_reports"]
SQL["stream_dedupe"] = SQL["dedupe_reports"]

SQL["load_inventory"] = f"""{with_(RAW, REPORTS, FILES)},
counts AS (SELECT source_file, COUNT(*) AS n FROM reports GROUP BY source_file)
SELECT f.filename, COALESCE(c.n, 0) AS "rows", f.file_number AS "timestamp",
       CASE WHEN f.file_number = (SELECT max(file_number) FROM files) THEN 'active' ELSE 'historical' END AS type
FROM files f LEFT JOIN counts c ON c.source_file = f.filename"""

SQL["instance_scan"] = f"""{with_(RAW)}
SELECT CASE WHEN QUERY_TYPE = 'SpotPrice' THEN 'main' ELSE 'test' END AS instance, COUNT(*) AS "rows",
       COUNT(DISTINCT TX_HASH) AS hashes, CAST(SUM(POWER) AS BIGINT) AS power FROM raw GROUP BY 1"""

SQL["malformed_rows"] = f"""{with_(RAW)}
SELECT TX_HASH, POWER, "VALUE", CASE WHEN line_no % 3 <> 0 THEN DISPUTABLE END AS DISPUTABLE, 'table_1.csv' AS source_file FROM raw"""

SQL["load_totals"] = f"""{with_(RAW, REPORTS, FILES)}
SELECT (SELECT COUNT(*) FROM reports) AS total_rows, COUNT(*) AS files, COUNT(*) - 1 AS historical_files,
       arg_max(filename, file_number) AS active_filename, max(file_number) AS active_timestamp FROM files"""

SQL["parse_block_header"] = f"""{with_(RAW, SNAPSHOTS)}
SELECT height, height AS parsed_height, timestamp_ms // 1000 * 1000 AS time_ms FROM snapshots"""

SQL["loaded_files"] = f"{with_(RAW, REPORTS)} SELECT DISTINCT source_file FROM reports"

SQL["classify_files"] = f"""{with_(RAW, FILES)},
ranked AS (SELECT *, row_number() OVER (ORDER BY file_number DESC) AS rk FROM files)
SELECT filename, file_number, CASE WHEN rk = 1 THEN 'active' ELSE 'historical' END AS type,
       NOT (rk = 1 OR rk <= 21) AS skipped
FROM ranked"""

FILE_NO = "TRY_CAST(regexp_extract(source_file, '^table_(\\d+)\\.csv$', 1) AS BIGINT)"

SQL["append_new_rows"] = f"""{with_(RAW)},
mx AS (SELECT max({FILE_NO}) AS newest FROM raw),
sc AS (SELECT max({FILE_NO}) AS second FROM raw WHERE {FILE_NO} < (SELECT newest FROM mx)),
stored AS (SELECT DISTINCT TX_HASH FROM raw WHERE {FILE_NO} < (SELECT newest FROM mx) AND TX_HASH IS NOT NULL),
incoming AS (
  SELECT * EXCLUDE (rn, line_no) FROM (
    SELECT *, row_number() OVER (PARTITION BY TX_HASH ORDER BY {FILE_NO}, line_no) AS rn
    FROM raw WHERE {FILE_NO} >= (SELECT second FROM sc) AND TX_HASH IS NOT NULL) d WHERE rn = 1)
SELECT * FROM incoming WHERE TX_HASH NOT IN (SELECT TX_HASH FROM stored)"""

SQL["append_to_store"] = f"""{with_(RAW)},
newest AS (SELECT max("TIMESTAMP") AS t FROM raw),
ordered AS (SELECT *, "TIMESTAMP" = (SELECT t FROM newest) AND line_no % 2 = 1 AS late FROM raw WHERE TX_HASH IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY TX_HASH ORDER BY late, {FILE_NO}, line_no) AS rn FROM ordered)
SELECT * EXCLUDE (rn, late, line_no), "TIMESTAMP" // 86400000 AS day FROM ranked WHERE rn = 1"""

SQL["power_of_aggr_after_append"] = f"""{with_(RAW, REPORTS)}
SELECT "TIMESTAMP", CAST(SUM(POWER) AS BIGINT) AS POWER_OF_AGGR, COUNT(*) AS "rows" FROM reports
WHERE "TIMESTAMP" IS NOT NULL GROUP BY "TIMESTAMP" """

SQL["replace_file_partition"] = f"""{with_(RAW, REPORTS, POA)},
newest AS (SELECT arg_max(source_file, {FILE_NO}) AS f FROM reports)
SELECT * EXCLUDE (POWER_OF_AGGR),
       CASE WHEN source_file = (SELECT f FROM newest) THEN POWER_OF_AGGR END AS POWER_OF_AGGR
FROM with_power"""


# ---------------------------------------------------------------- snapshots

SNAP = with_(RAW, SNAPSHOTS)

SQL["network_power_at_height"] = f"""{with_(RAW)}
SELECT "TIMESTAMP" // 6000 AS height, CAST(COALESCE(SUM(POWER), 0) AS BIGINT) AS maximal_power
FROM raw WHERE "TIMESTAMP" IS NOT NULL GROUP BY 1"""


def _grid(interval: int) -> str:
    return f"""
grid AS (
  SELECT DISTINCT h AS height FROM (
    SELECT (SELECT max(height) FROM snapshots) AS h
    UNION ALL
    SELECT range AS h FROM range(
      ((greatest(0, (SELECT max(height) FROM snapshots) - {30 * K.BLOCKS_PER_DAY}) + {interval - 1}) // {interval}) * {interval},
      ((SELECT max(height) FROM snapshots) // {interval}) * {interval} + 1, {interval})) g)"""


SQL["height_grid"] = f"{SNAP},{_grid(K.HEIGHT_STEP)} SELECT height FROM grid"
SQL["skip_existing_heights"] = f"{SNAP},{_grid(100)} SELECT height FROM grid WHERE height NOT IN (SELECT height FROM snapshots)"

SQL["estimate_height_time"] = f"""{SNAP},
newest AS (SELECT arg_max(height, height) AS h, arg_max(timestamp_ms, height) AS t FROM snapshots)
SELECT range AS i, h - range * {K.ESTIMATE_STEP_BLOCKS} AS height,
       CAST(t / 1000.0 - range * {K.ESTIMATE_STEP_BLOCKS * K.ESTIMATE_BLOCK_SECONDS} AS DOUBLE) AS "timestamp"
FROM newest, range(0, {K.ESTIMATE_POINTS}) WHERE h - range * {K.ESTIMATE_STEP_BLOCKS} > 0"""

SQL["recent_snapshots"] = f"{SNAP} SELECT * FROM snapshots WHERE timestamp_ms >= {NOW - 24 * K.HOUR_MS}"
SQL["all_snapshots"] = f"{SNAP} SELECT * FROM snapshots"

SUMMARY_AGGS = f"""COUNT(*) AS points, MIN(maximal_power) AS min_power, MAX(maximal_power) AS max_power,
       {exact_mean('maximal_power')} AS avg_power, COUNT(CASE WHEN maximal_power > 0 THEN 1 END) AS positive_points"""
SQL["snapshot_summary"] = f"""{SNAP},
s AS (SELECT sample_type, {SUMMARY_AGGS} FROM snapshots GROUP BY sample_type
      UNION ALL SELECT 'all' AS sample_type, {SUMMARY_AGGS} FROM snapshots)
SELECT *, points > 5 AS enough FROM s"""

SQL["upsert_snapshot"] = f"""{SNAP},
later AS (SELECT height, timestamp_ms, maximal_power + 1 AS maximal_power, created_at + 1000 AS created_at, sample_type
          FROM snapshots WHERE sample_type = 'realtime'),
both_ AS (SELECT * FROM snapshots UNION ALL SELECT * FROM later)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY height ORDER BY created_at DESC, timestamp_ms DESC, maximal_power DESC) AS rn
  FROM both_) x WHERE rn = 1"""

SQL["snapshot_throttle"] = f"""WITH RECURSIVE {RAW.strip()},{SNAPSHOTS},
rt AS (SELECT height, timestamp_ms, maximal_power, row_number() OVER (ORDER BY timestamp_ms, height) AS rn
       FROM snapshots WHERE sample_type = 'realtime'),
g(rn, last_kept, kept) AS (
  SELECT rn, timestamp_ms, true FROM rt WHERE rn = 1
  UNION ALL
  SELECT rt.rn,
         CASE WHEN rt.timestamp_ms - g.last_kept > {K.SNAPSHOT_THROTTLE_MS} THEN rt.timestamp_ms ELSE g.last_kept END,
         rt.timestamp_ms - g.last_kept > {K.SNAPSHOT_THROTTLE_MS}
  FROM g JOIN rt ON rt.rn = g.rn + 1)
SELECT 'default' AS instance, rt.height, rt.timestamp_ms, rt.maximal_power FROM rt JOIN g USING (rn) WHERE g.kept"""


# ---------------------------------------------------------------- streams (computed in batch)

SQL["stream_growing_file"] = f"SELECT * EXCLUDE (source_file) FROM ({SQL['dedupe_reports']})"
SQL["late_block_power"] = f"""{with_(RAW, REPORTS)}
SELECT TIMESTAMP, count(*) AS rows, CAST(sum(POWER) AS BIGINT) AS POWER_OF_AGGR FROM reports WHERE TIMESTAMP IS NOT NULL GROUP BY TIMESTAMP"""
SQL["complete_blocks"] = f"""{with_(RAW, REPORTS)}
SELECT "TIMESTAMP", COUNT(*) AS "rows", CAST(SUM(POWER) AS BIGINT) AS POWER_OF_AGGR FROM reports
WHERE "TIMESTAMP" < (SELECT max("TIMESTAMP") FROM reports) GROUP BY "TIMESTAMP" """

SQL["stream_histogram"] = f"""{with_(RAW, REPORTS)},
w AS (SELECT ("TIMESTAMP" // 1800000) * 1800000 AS window_start_ms FROM reports)
SELECT window_start_ms, window_start_ms + 1800000 AS window_end_ms, COUNT(*) AS "count" FROM w
WHERE window_start_ms + 1800000 < (SELECT max("TIMESTAMP") FROM reports) GROUP BY window_start_ms"""

SQL["stream_questionable"] = f"""{with_(RAW, REPORTS)}
SELECT TX_HASH, "TIMESTAMP", REPORTER, QUERY_ID, ({NOW} - "TIMESTAMP") < {K.URGENT_WINDOW_MS} AS urgent
FROM reports WHERE COALESCE(DISPUTABLE, false) AND ({NOW} - "TIMESTAMP") < {K.QUESTIONABLE_WINDOW_MS}"""

SQL["stream_active_reporters"] = f"""{with_(RAW, REPORTS)},
w AS (SELECT ("TIMESTAMP" // 1800000) * 1800000 AS window_start_ms, REPORTER FROM reports)
SELECT window_start_ms, COUNT(DISTINCT REPORTER) AS active_reporters FROM w
WHERE window_start_ms + 1800000 < (SELECT max("TIMESTAMP") FROM reports) GROUP BY window_start_ms"""

SQL["stream_bucket_activity"] = f"""{with_(RAW, REPORTS)},
b AS (SELECT "TIMESTAMP", COUNT(*) AS n, SUM(POWER) AS poa FROM reports
      WHERE "TIMESTAMP" < (SELECT max("TIMESTAMP") FROM reports) GROUP BY "TIMESTAMP"),
w AS (SELECT ("TIMESTAMP" // 1800000) * 1800000 AS window_start_ms, n, COALESCE(poa, 0) AS poa FROM b),
x AS (SELECT window_start_ms, poa FROM w, range(0, w.n))
SELECT window_start_ms, COUNT(*) AS total_reports,
       PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY poa) AS representative_power_of_aggr
FROM x WHERE window_start_ms + 1800000 < (SELECT max("TIMESTAMP") FROM reports) GROUP BY window_start_ms"""

# the same with the default delay: what ends within two days of the newest block is still open
for _name in ("complete_blocks", "stream_histogram", "stream_bucket_activity", "stream_active_reporters"):
    SQL[f"{_name}_delayed"] = SQL[_name].replace("< (SELECT max(\"TIMESTAMP\") FROM reports)", "<= (SELECT max(\"TIMESTAMP\") - 172800000 FROM reports)")


# ---------------------------------------------------------------- document sources

SQL["read_query_mappings"] = f"{with_(MAPPINGS)} SELECT query_id, name FROM mappings"
SQL["read_registry_dump"] = f"{with_(REGISTRY)} SELECT * FROM registry"
SQL["read_registry_yaml"] = SQL["read_registry_dump"]
SQL["read_power_snapshots"] = f"""{SNAP}
SELECT height, timestamp_ms, maximal_power, timestamp_ms AS created_at, 'historical' AS sample_type FROM snapshots"""

SQL["export_search_csv"] = f"""{BASE},{MATCHES},
page AS (SELECT * FROM matches ORDER BY "TIMESTAMP" DESC NULLS LAST, TX_HASH ASC LIMIT 1000),
d AS (SELECT *, {V} AS V, {T} AS T FROM page)
SELECT QUERY_ID AS "Query ID", "VALUE" AS "Reported Value", TRUSTED_VALUE AS "Trusted Value",
       CASE WHEN V = T THEN '100%' ELSE COALESCE(printf('%.1f', {_sym('V', 'T')}) || '%', 'N/A') END AS Agreement, REPORTER AS Reporter, POWER AS Power,
       strftime(epoch_ms("TIMESTAMP"), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST("TIMESTAMP" % 1000 AS VARCHAR), 3, '0') || 'Z'
         AS "Timestamp",
       CASE WHEN DISPUTABLE THEN 'Yes' ELSE 'No' END AS Disputable
FROM d"""

SQL["stream_dedupe_watermark"] = f"{with_(RAW)} SELECT DISTINCT TX_HASH FROM raw WHERE TX_HASH IS NOT NULL"
SQL["registry_refresh"] = SQL["read_registry_dump"]

SQL["registry_refresh_later_dump"] = f"""{with_(REGISTRY)}
SELECT * REPLACE (CASE WHEN jailed THEN moniker ELSE moniker || ' II' END AS moniker,
                  CASE WHEN jailed THEN fetched_at ELSE fetched_at + 1 END AS fetched_at,
                  CASE WHEN jailed THEN updated_at ELSE updated_at + 1 END AS updated_at)
FROM registry"""

SQL["commission_pct"] = f"""{with_(REGISTRY)}
SELECT address, commission_rate, round(TRY_CAST(commission_rate AS DOUBLE) / {K.FIXED_POINT_SCALE // 100}, 1) AS commission_pct
FROM registry"""

SQL["reporter_status"] = f"""{REG},{ACTIVE}
SELECT address, CASE WHEN COALESCE(jailed, false) THEN 'Jailed' WHEN power > 0 THEN 'Free' ELSE 'Jailed' END AS status,
       CASE WHEN active_24h THEN 'Active' ELSE 'Inactive' END AS activity
FROM flagged"""

SQL["power_share"] = f"""{with_(REGISTRY)},
m AS (SELECT MAX(power) AS mx, CAST(SUM(power) AS BIGINT) AS tot FROM registry)
SELECT address,
       CASE WHEN m.tot > 0 THEN round(CAST(power AS DOUBLE) / m.tot * 100.0, 1) ELSE 0.0 END AS power_share,
       CASE WHEN m.mx > 0 THEN round(CAST(power AS DOUBLE) / m.mx * 100.0, 1) ELSE 0.0 END AS power_bar
FROM registry, m"""

SQL["reporters_page_total"] = f"""{with_(REGISTRY)}
SELECT COUNT(*) AS total FROM registry WHERE contains(moniker, '00001') OR contains(address, '00001')"""
