"""Operator 5: line dedup by a deletion-neighbourhood join. DataFrame operations only.

A line is what newlines divide; its words are what spaces, tabs, returns, form feeds and vertical tabs divide. A line
is dropped if an earlier line (by doc_id, text hash, line number) has the same words, or, where the longer of the two
has ``MIN_WORDS`` words or more, words at an edit distance of one (a word substituted, inserted or deleted). Blank lines
stay. The document keeps its other lines in order.

1. Equal lines become one row with the earliest place (hashes and places only).
2. Two lines one edit apart share the words before or the words after the middle. A line that shares neither half with
   another line has no partner and leaves here; this bounds what the neighbourhood costs, and loses no pair.
3. Each remaining line emits the hash of every variant with one word deleted, where its halves leave the edit open: with
   its place (equal variants of one length and place: a substitution), and without it against whole lines one word
   shorter (an insertion or deletion).
   The variants of a line cost one sum of word hashes each: a variant's hash is the sum of hash(word, place) with the
   places after the gap moved up by one, taken from prefix sums.
4. Per variant hash only the earliest line survives as partner, so a group of near copies is one aggregation, not all
   its pairs; the partner found is verified word by word.

Defined results: null and empty texts hold one blank line (null stays null, empty stays empty); rows equal in doc_id and
text are one document, whose copies are all kept with the same lines; a null doc_id sorts first; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import held, stored

MIN_WORDS = 5
_CHUNK = 256


def _norm(line: Column) -> Column:
    squeezed = F.regexp_replace(line, "[ \\t\\r\\x0B\\f]+", " ")
    odd = line.contains("  ")
    for c in "\t\r\x0b\f":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, squeezed).otherwise(line))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _halves(w: Column, n: Column) -> Column:
    """(key, own, front) of the halves: for partners as long or longer (own), and for partners one word shorter."""

    def half(m: Column, own: bool) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        first = F.xxhash64(F.lit("first"), m, _text(F.slice(w, F.lit(1), h)))
        last = F.xxhash64(F.lit("last"), m, _text(F.slice(w, n - (m - h) + 1, m - h)))
        return [F.struct(k.alias("key"), F.lit(own).alias("own"), F.lit(f).alias("front")) for k, f in ((first, True), (last, False))]

    own = F.array(*half(n, True))
    return F.when(n >= MIN_WORDS, F.concat(own, F.array(*half(n - 1, False)))).when(n >= MIN_WORDS - 1, own)


def _candidates(distinct: DataFrame) -> DataFrame:
    """(h, first, back, front, ...) of lines that share a half with another line, and what the halves leave open: a
    substitution (sub_) or a missing word (gap_) behind the first half (back) or before the last one (front), or being
    the shorter line (short)."""
    keys = distinct.where("halves is not null").select("h", F.inline("halves"))
    met = keys.groupBy("key").agg(F.count_if("own").alias("o"), F.count_if(~F.col("own")).alias("l")).where("o > 0 and o + l > 1")
    k = keys.join(met, "key")
    own, front = F.col("own"), F.col("front")
    flags = {
        "sub_back": own & front & (F.col("o") > 1),
        "sub_front": own & ~front & (F.col("o") > 1),
        "gap_back": ~own & front,
        "gap_front": ~own & ~front,
        "short": own & (F.col("l") > 0),
    }
    k = k.groupBy("h").agg(*[F.max(v).alias(n) for n, v in flags.items()])
    return k.join(distinct.select("h", "first"), "h")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), line_no, norm of every line that isn't blank."""
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return d.select("doc_id", "tk", "line_no", _norm(F.col("line")).alias("norm")).where("norm <> ''")


def _variants(lines: DataFrame) -> DataFrame:
    """(h, first, kind, key) of candidate lines (h, first, w, n and what their halves leave open): kind 0 a substitution's
    variant, 1 an insertion's (a line without one word), 2 the line itself for kind 1."""
    w = F.col("w")

    def h(x: Column, i: Column) -> Column:
        return F.shiftright(F.xxhash64(x, i), 22)  # 42 bits: sums over millions of words don't overflow

    x = held(lines, F.transform(w, lambda t, i: h(t, i)), "here")
    x = held(x, F.transform(w, lambda t, i: h(t, i - 1)), "up")
    zero = F.lit(0).cast("long")
    x = held(x, F.zip_with("here", "up", lambda a, b: a - b), "step")
    add = lambda a, b: a + b
    # prefix sums in two levels: of chunks, and inside a chunk
    chunks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _CHUNK).cast("int"))
    running = lambda arr: F.aggregate(arr, F.array(zero), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    x = held(x, running(F.transform(chunks, lambda c: F.aggregate(F.slice("step", c * _CHUNK + 1, F.lit(_CHUNK)), zero, add))), "base")
    prefix = F.flatten(F.transform(chunks, lambda c: F.transform(F.slice(running(F.slice("step", c * _CHUNK + 1, F.lit(_CHUNK - 1))), F.lit(1), F.least(F.lit(_CHUNK), F.col("n") - c * _CHUNK)), lambda v: v + F.get("base", c))))
    x = held(x, F.struct(F.aggregate("here", zero, add).alias("whole"), F.aggregate("up", zero, add).alias("moved")), "sum")
    x = held(x, F.zip_with(prefix, "up", lambda p, u: p + F.col("sum.moved") - u), "gaps")
    n = F.col("n")

    def left(i: Column, kind: str, m: Column, slack: int) -> Column:
        """Whether the gap i lies in a part that the halves of m words leave open."""
        h = F.floor(m / 2).cast("int")
        return (F.col(f"{kind}_back") & (i >= h)) | (F.col(f"{kind}_front") & (i < h + slack))

    places = F.sequence(F.lit(0), n - 1)
    sub = F.transform(F.filter(places, lambda i: left(i, "sub", n, 0)), lambda i: F.struct(F.lit(0).alias("kind"), F.xxhash64(F.lit("s"), n, i, F.get("gaps", i)).alias("key")))
    gap = F.transform(F.filter(places, lambda i: left(i, "gap", n - 1, 1)), lambda i: F.struct(F.lit(1).alias("kind"), F.xxhash64(F.lit("d"), n - 1, F.get("gaps", i)).alias("key")))
    itself = F.array(F.struct(F.lit(2).alias("kind"), F.xxhash64(F.lit("d"), n, F.col("sum.whole")).alias("key")))
    itself = F.when(F.col("short"), itself).otherwise(F.slice(itself, F.lit(1), F.lit(0)))
    rows = F.when(n >= MIN_WORDS, F.concat(sub, F.array_distinct(gap), itself)).otherwise(itself)
    return x.select("h", "first", F.explode(rows).alias("v")).select("h", "first", "v.kind", "v.key")


def _one_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays are one substitution, insertion or deletion apart."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, v: s + v) <= 1
    short, long = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
    # equal words from the front up to the first difference, and the rest shifted by one
    at = F.aggregate(short, F.struct(F.lit(0).alias("i"), F.lit(True).alias("go")), lambda s, x: F.struct(F.when(s.go & (x == F.get(long, s.i)), s.i + 1).otherwise(s.i).alias("i"), (s.go & (x == F.get(long, s.i))).alias("go")), lambda s: s.i)
    moved = F.concat(F.slice(long, F.lit(1), at), F.slice(long, at + 2, F.size(long))) == short
    return F.when(F.size(a) == F.size(b), same).otherwise((F.size(long) - F.size(short) == 1) & moved)


def near_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences: doc_id, tk, line_no, h; lines to drop or to keep once: h, first, near)."""
    lines = _lines(docs)
    w = F.split("norm", " ")
    rows = lines.select("doc_id", "tk", "line_no", F.unhex(F.md5("norm")).alias("h"), "norm")
    rows = held(rows, w, "w").select("doc_id", "tk", "line_no", "h", F.size("w").alias("n"), _halves(F.col("w"), F.size("w")).alias("halves"))
    rows = stored(rows, "lines")
    place = F.struct("doc_id", "tk", "line_no")
    distinct = rows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    distinct = stored(distinct, "distinct-lines")
    cand = stored(_candidates(distinct), "candidate-lines")
    # the words of the candidates, from the places where they stand first
    at = cand.groupBy(F.col("first.doc_id").alias("_d"), F.col("first.tk").alias("_k")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("i"), "h")).alias("_at"))
    at = stored(at, "candidate-places")
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk")).where("text is not null")
    d = d.join(at, (F.col("tk") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    d = d.groupBy("doc_id", "tk").agg(F.first("text").alias("text"), F.first("_at").alias("_at"))
    d = held(d, F.split("text", "\n", -1), "_l").select("_l", "_at", "doc_id", "tk")
    found = d.select(F.explode(F.transform("_at", lambda x: F.struct(x.h.alias("h"), x.i.alias("i"), F.get("_l", x.i).alias("line")))).alias("x"), "doc_id", "tk")
    found = found.select("x.h", F.struct("doc_id", "tk", F.col("x.i").alias("line_no")).alias("first"), F.split(_norm(F.col("x.line")), " ").alias("w"))
    found = stored(found.withColumn("n", F.size("w")), "candidate-words")
    open_ = cand.drop("first")
    v = stored(_variants(found.join(open_, "h")), "variants")
    earliest = F.struct("first", "h")
    best = v.groupBy("key", F.expr("kind = 0").alias("sub")).agg(
        F.min(F.when(F.col("kind") < 2, earliest)).alias("longest"),
        F.min(F.when(F.col("kind") == 2, earliest)).alias("itself"),
        F.count("*").alias("c"),
    )
    best = best.where("c > 1").drop("c")
    met = v.join(best.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("sub") == (F.col("kind") == 0)))
    partner = F.when(F.col("kind") == 1, F.col("itself")).otherwise(F.col("longest"))
    met = met.select("h", "first", partner.alias("p")).where("p is not null and p.first < first")
    met = met.groupBy("h").agg(F.collect_set("p.h").alias("ps"))  # one for each gap of the line at most
    pairs = met.select("h", F.explode("ps").alias("ph"))
    words = found.select("h", "w")
    pairs = pairs.join(words, "h").join(words.select(F.col("h").alias("ph"), F.col("w").alias("pw")), "ph")
    near = stored(pairs.where(_one_apart(F.col("w"), F.col("pw"))).select("h").distinct(), "near-lines")
    out = distinct.join(near.withColumn("near", F.lit(True)), "h", "left").where("copies > 1 or near")
    return rows.select("doc_id", "tk", "line_no", "h"), out.select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the kept lines), n_lines, n_dropped."""
    docs = docs.select("doc_id", "text")
    rows, lines = near_lines(docs)
    drop = rows.join(stored(lines, "repeated-lines"), "h")
    drop = drop.where(F.col("near") | (F.struct("doc_id", "tk", "line_no") > F.col("first")))
    drop = drop.groupBy(F.col("doc_id").alias("_d"), F.col("tk").alias("_k")).agg(F.collect_set("line_no").alias("_drop"))
    drop = stored(drop, "dropped-lines")
    d = docs.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    d = d.join(drop, (F.col("_t") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "text", "_drop")
    d = held(d, F.split(F.coalesce("text", F.lit("")), "\n", -1), "_l")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.coalesce("_drop", F.array().cast("array<int>")))
    text = F.array_join(F.transform(kept, lambda i: F.get("_l", i)), "\n")
    return d.select("doc_id", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(text).alias("text"), F.size("_l").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
placed AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM split),
lines AS (SELECT doc_id, line_no, line, trim(regexp_replace(line, '[ \\t\\r\\x0B\\f]+', ' ', 'g')) AS norm FROM placed),
firsts AS (SELECT norm, min({{'d': doc_id, 'l': line_no}}) AS first, string_split(norm, ' ') AS w FROM lines WHERE norm <> '' GROUP BY norm),
sized AS (SELECT *, len(w) AS n FROM firsts),
gaps AS (SELECT norm, first, n, unnest(range(0, n)) AS i, w FROM sized WHERE n >= {MIN_WORDS}),
cut AS (SELECT norm, first, n, i, array_to_string(list_concat(w[1 : i], w[i + 2 : n]), ' ') AS v FROM gaps),
subst AS (SELECT norm FROM (SELECT norm, first, min(first) OVER (PARTITION BY n, i, v) AS best FROM cut) WHERE best < first),
pairs AS (SELECT DISTINCT c.norm AS longer, c.first AS lf, s.norm AS shorter, s.first AS sf FROM cut c JOIN sized s ON c.v = s.norm),
near AS (
  SELECT norm FROM subst UNION SELECT longer FROM pairs WHERE sf < lf UNION SELECT shorter FROM pairs WHERE lf < sf
), marked AS (
  SELECT l.doc_id, l.line_no, l.line,
    l.norm <> '' AND (l.norm IN (SELECT norm FROM near) OR f.first.d <> l.doc_id OR f.first.l <> l.line_no) AS gone
  FROM lines l LEFT JOIN firsts f ON l.norm = f.norm
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, sum(gone::INT) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT k.doc_id, CASE WHEN n_dropped = 0 THEN d.text ELSE coalesce(k.text, '') END AS text, n_lines, CAST(n_dropped AS BIGINT) AS n_dropped
FROM kept k JOIN documents d USING (doc_id)
"""
