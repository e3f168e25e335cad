"""Operator 2: URL filters as a temporal list join. DataFrame operations only.

A list is a log of dated entries (kind, key, state, day): from its day an entry sets a key of a kind to ``deny`` or
``allow``, or takes it off the list (``remove``). Of several entries of a key on one day the strictest counts (deny,
allow, remove). Each state lasts until the key's next entry: a validity interval [valid_from, valid_to).

A capture (url, day) is looked up under its keys: ``path`` (host and leading path segments), ``host``, ``domain``
(every suffix of whole labels) and ``word`` (the host's parts between dots and hyphens). The as-of join finds the one
interval of a key that holds on the capture's day: intervals are cut at months, so it is an equi-join on (kind, key,
month) in which a key meets at most the entries of one month, and a hot key is a join that adaptive execution splits.
The most specific hit decides: path before host before domain before word, then the longer key, then deny.

Defined results: a null or hostless url, and a null day, match nothing; entries with a null field or unknown state
are ignored; captures equal in page_id, url and day share one verdict and keep their rows; empty tables give an empty
result, an empty list the verdict ``none`` everywhere. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import held, stored

KINDS = ("word", "domain", "host", "path")  # ascending by how specific they are
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, state, valid_from, valid_to (null: still valid)."""
    rank = F.when(F.col("state") == "deny", 2).when(F.col("state") == "allow", 1).when(F.col("state") == "remove", 0)
    e = entries.select("kind", "key", "day", rank.alias("rank")).where("kind is not null and key is not null and day is not null and rank is not null")
    e = e.groupBy("kind", "key", "day").agg(F.max("rank").alias("rank"))
    later = Window.partitionBy("kind", "key").orderBy("day")
    e = e.withColumn("valid_to", F.lead("day").over(later)).where("rank > 0")
    return e.select("kind", "key", F.when(F.col("rank") == 2, "deny").otherwise("allow").alias("state"), F.col("day").alias("valid_from"), "valid_to")


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def _keys(url: Column, depth: int) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, _HOST, 1)
    labels, segments = F.split(host, r"\."), F.slice(F.filter(F.split(F.regexp_extract(low, _PATH, 1), "/"), lambda s: s != ""), F.lit(1), F.lit(max(depth, 1)))

    def pair(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.array_distinct(F.filter(F.split(host, "[.-]"), lambda w: w != "")), lambda w: pair("word", w))
    paths = F.transform(segments, lambda _, i: pair("path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))))
    return F.when(host != "", F.concat(F.array(pair("host", host)), domains, words, paths if depth else F.array().cast("array<struct<kind:string,key:string>>")))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of ``captures`` (page_id, url, day): those columns, verdict (deny, allow, none), and kind, key
    and valid_from of the deciding interval."""
    captures = captures.select("page_id", "url", "day")
    valid = stored(intervals(entries), "intervals")
    low, high = captures.agg(F.min("day"), F.max("day")).first()
    depth = valid.where("kind = 'path'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    last = F.coalesce(F.date_sub("valid_to", 1), F.lit(high).cast("date"))
    start, end = F.greatest("valid_from", F.lit(low).cast("date")), F.least(last, F.lit(high).cast("date"))
    cut = valid.withColumn("_a", _month(start)).withColumn("_b", _month(end)).where(start <= end)
    cut = cut.select("kind", "key", "state", "valid_from", "valid_to", F.explode(F.sequence("_a", "_b")).alias("month"))
    looked = held(captures.where("day is not null").distinct(), _keys(F.col("url"), int(depth)), "_keys")
    looked = looked.select("page_id", "url", "day", _month(F.col("day")).alias("month"), F.inline("_keys"))
    hits = looked.join(cut, ["kind", "key", "month"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.max(F.struct(rank.alias("r"), F.length("key").alias("n"), (F.col("state") == "deny").cast("int").alias("deny"), "key", "kind", "state", "valid_from"))
    verdict = hits.groupBy("page_id", "url", "day").agg(best.alias("b"))
    verdict = verdict.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("day").alias("_d"), "b")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("day") == F.col("_d"))
    out = captures.join(verdict, same, "left")
    return out.select("page_id", "url", "day", F.coalesce("b.state", F.lit("none")).alias("verdict"), F.col("b.kind").alias("rule_kind"), F.col("b.key").alias("rule_key"), F.col("b.valid_from").alias("valid_from"))


# The registered query's inputs, derived from all of ``pages``: one capture an hour in page_id order, and a
# list that grew and shrank meanwhile: hosts denied some days after they were first seen, taken off and put back;
# domains of two labels allowed from their 10th to their 40th day; words of hyphenated hosts denied once seen; the
# first path segment of every host allowed for two weeks.
EPOCH = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    day = F.expr(f"date_add(date'{EPOCH}', cast(floor(page_id / 24) as int))")
    return pages.select("page_id", "url", day.alias("day"))


def page_entries(captures: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("url", F.lit("")))
    c = captures.where("day is not null").select("day", F.regexp_extract(low, _HOST, 1).alias("host"), F.regexp_extract(low, _PATH, 1).alias("path")).where("host <> ''")
    hosts = c.groupBy("host").agg(F.min("day").alias("seen"))

    def log(first: DataFrame, kind: str, *steps: tuple[str, Column]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(s).alias("state"), F.date_add("seen", n.cast("int")).alias("day")) for s, n in steps])
        return first.select(F.lit(kind).alias("kind"), "key", F.inline(rows))

    wait = F.length("key") % 7
    out = log(hosts.withColumnRenamed("host", "key"), "host", ("deny", wait), ("remove", wait + 20), ("deny", wait + 45))
    domain = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("key"), "seen").where("key <> ''")
    out = out.unionByName(log(domain.groupBy("key").agg(F.min("seen").alias("seen")), "domain", ("allow", F.lit(10)), ("remove", F.lit(40))))
    words = hosts.where(F.col("host").contains("-")).select(F.explode(F.split(F.regexp_extract("host", r"([^.]*-[^.]*)", 1), "-")).alias("key"), "seen").where("key <> ''")
    out = out.unionByName(log(words.groupBy("key").agg(F.min("seen").alias("seen")), "word", ("deny", F.lit(0))))
    paths = c.select(F.concat("host", F.lit("/"), F.regexp_extract("path", "^/([^/]+)", 1)).alias("key"), "day").where(~F.col("key").endswith("/"))
    return out.unionByName(log(paths.groupBy("key").agg(F.min("day").alias("seen")), "path", ("allow", F.lit(3)), ("remove", F.lit(17))))


SQL = f"""
WITH cap AS (SELECT page_id, url, CAST(date '{EPOCH}' + CAST(floor(page_id / 24) AS INTEGER) AS DATE) AS day, lower(coalesce(url, '')) AS low FROM pages),
c AS (SELECT *, regexp_extract(low, '{_HOST}', 1) AS host, regexp_extract(low, '{_PATH}', 1) AS path FROM cap),
hosts AS (SELECT host, min(day) AS seen FROM c WHERE day IS NOT NULL AND host <> '' GROUP BY host),
firsts AS (
  SELECT 'host' AS kind, host AS key, seen FROM hosts
  UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS key, min(seen) FROM hosts GROUP BY 2
  UNION ALL SELECT 'word', w, min(seen) FROM (SELECT unnest(string_split(regexp_extract(host, '([^.]*-[^.]*)', 1), '-')) AS w, seen FROM hosts WHERE contains(host, '-')) GROUP BY w
  UNION ALL SELECT 'path', host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS key, min(day) FROM c WHERE host <> '' GROUP BY 2
), log AS (
  SELECT kind, key, s.state, seen + CAST(s.n AS INTEGER) AS day
  FROM (SELECT *, unnest(CASE kind
    WHEN 'host' THEN [{{'state': 2, 'n': length(key) % 7}}, {{'state': 0, 'n': length(key) % 7 + 20}}, {{'state': 2, 'n': length(key) % 7 + 45}}]
    WHEN 'domain' THEN [{{'state': 1, 'n': 10}}, {{'state': 0, 'n': 40}}]
    WHEN 'word' THEN [{{'state': 2, 'n': 0}}]
    ELSE [{{'state': 1, 'n': 3}}, {{'state': 0, 'n': 17}}] END) AS s FROM firsts WHERE key <> '' AND NOT ends_with(key, '/'))
), valid AS (
  SELECT kind, key, state, day AS valid_from, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS valid_to
  FROM (SELECT kind, key, day, max(state) AS state FROM log GROUP BY ALL)
), labels AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM c WHERE host <> ''),
keys AS (
  SELECT page_id, url, day, 3 AS r, 'host' AS kind, host AS key FROM labels
  UNION SELECT page_id, url, day, 2, 'domain', unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i : len(l)], '.'))) FROM labels
  UNION SELECT page_id, url, day, 1, 'word', unnest(list_filter(regexp_split_to_array(host, '[.-]'), lambda x: x <> '')) FROM labels
  UNION SELECT page_id, url, day, 4, 'path', unnest(list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1 : i], '/'))) FROM labels
), hits AS (
  SELECT k.*, v.state, v.valid_from,
    row_number() OVER (PARTITION BY page_id, url, day ORDER BY r DESC, length(k.key) DESC, state DESC, k.key DESC) AS o
  FROM keys k JOIN valid v ON k.kind = v.kind AND k.key = v.key AND v.state > 0
    AND v.valid_from <= day AND (v.valid_to IS NULL OR day < v.valid_to)
)
SELECT c.page_id, c.url, c.day, CASE h.state WHEN 2 THEN 'deny' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
  h.kind AS rule_kind, h.key AS rule_key, h.valid_from
FROM c LEFT JOIN hits h ON h.o = 1 AND c.page_id IS NOT DISTINCT FROM h.page_id AND c.url IS NOT DISTINCT FROM h.url AND c.day = h.day
"""
