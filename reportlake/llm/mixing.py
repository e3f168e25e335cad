"""Operator 9: mixing sources to target weights by temperature.

A source of T tokens (white-space separated words) gets the weight T^a / sum T^a. The exponent a in [0, 1] is bisected:
it is the largest that reaches ``min_entropy`` (a share of the greatest entropy, that of equal weights), or, if that
repeats some source more than ``max_repeats`` times, the smallest that doesn't. Weights times the budget give each
source's tokens. Without a budget it is the smallest that takes every document at least once, so nothing is dropped.

A source's budget is realised as whole epochs and one partial epoch over random blocks: its documents are dealt into
blocks of about ``BLOCK_TOKENS`` tokens by hash, each epoch permutes the blocks by hash, and the partial epoch takes
documents in permuted block order (by hash inside a block) while their start lies below what is left of the budget.
Positions are sums over a source's blocks (``MAX_BLOCKS`` rows at most) and inside a block, so a source with a third
of all rows is many groups.

Defined results: a null source is a source of its own; null and empty texts hold 0 tokens and go with their source's
whole epochs, and with the partial epoch where their place lies below the rest; if no text has a token each row is
taken once; repeated rows count each; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import stored

BLOCK_TOKENS = 1 << 16
MAX_BLOCKS = 1 << 16
STEPS = 24


@dataclass(frozen=True)
class Target:
    min_entropy: float = 0.95
    max_repeats: float = 4.0
    budget_tokens: int | None = None
    seed: str = "mix"


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != ""))


def _hash(*cols: Column | str) -> Column:
    """The first 60 bits of an md5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def _exponent(sources: DataFrame, target: Target) -> float:
    """Bisects over one aggregation of the source table for each step; the result is rounded to six digits."""
    n, total = sources.agg(F.count("*"), F.sum("total")).first()
    if n < 2:
        return 1.0

    def at(a: float) -> tuple[float, float]:
        """(entropy share, most repeats) at exponent a."""
        x = F.pow(F.col("total") / F.lit(float(total)), F.lit(a))
        each = x / F.col("total")
        z, e, high, low = sources.agg(F.sum(x), F.sum(x * F.log(x)), F.max(each), F.min(each)).first()
        entropy = math.log(z) - e / z
        budget = float(target.budget_tokens) if target.budget_tokens else z / low
        return entropy / math.log(n), high / z * budget

    def turn(lo: float, hi: float, ok: Callable[[float], bool]) -> float:
        """Where ``ok``, true at lo and false at hi, turns; the true side."""
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    # entropy and repeats both fall as the exponent grows
    a = 1.0 if at(1.0)[0] >= target.min_entropy else turn(0.0, 1.0, lambda m: at(m)[0] >= target.min_entropy)
    if at(a)[1] > target.max_repeats:
        a = turn(1.0, a, lambda m: at(m)[1] <= target.max_repeats)
    return round(a, 6)


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))


def plan(docs: DataFrame, tokens: Column, target: Target = Target()) -> DataFrame:
    """(src, total, blocks, budget, epochs, rest) of each source."""
    sources = docs.select(_source().alias("src"), tokens.cast("long").alias("n")).groupBy("src").agg(F.sum("n").alias("total"))
    sources = stored(sources, "sources")
    a = _exponent(sources.where("total > 0"), target)
    x = F.pow(F.col("total").cast("double"), F.lit(a))
    z, least = sources.where("total > 0").agg(F.sum(x), F.min(x / F.col("total"))).first()
    budget = float(target.budget_tokens) if target.budget_tokens else (z or 0.0) / (least or 1.0)
    out = sources.withColumn("budget", F.floor(x / F.lit(z or 1.0) * F.lit(budget) + 0.5).cast("long"))
    out = out.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("int"))
    out = out.withColumn("rest", F.when(F.col("total") > 0, F.col("budget") - F.col("epochs") * F.col("total")).otherwise(F.lit(0)))
    blocks = F.least(F.greatest(F.ceil(F.col("total") / BLOCK_TOKENS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("int")
    return out.withColumn("blocks", blocks)


def mix(docs: DataFrame, tokens: Column, target: Target = Target()) -> DataFrame:
    """``docs`` (doc_id, source and others), each row once for every epoch that takes it, with the columns mix_epoch
    (from 0), mix_block and mix_order_key: an epoch's blocks ascend by mix_order_key. Columns of these names in ``docs``
    are replaced. ``tokens`` is the token count of a row."""
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_order_key")]
    p = stored(plan(docs, tokens, target), "mix-plan")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.select(F.struct(*own).alias("doc"), _source().alias("src"), key.alias("id"), tokens.cast("long").alias("n"))
    d = d.join(p.select("src", "blocks"), "src")
    d = d.withColumn("block", F.pmod(_hash(F.lit(target.seed), "src", "id"), F.col("blocks")).cast("int")).drop("blocks")
    per_block = d.groupBy("src", "block").agg(F.sum("n").alias("n")).join(p.select("src", "epochs", "rest"), "src")
    order = _hash(F.lit(target.seed), "src", F.col("epochs").cast("string"), F.col("block").cast("string"))
    before = Window.partitionBy("src").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("src", "block", "epochs", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "block").orderBy(_hash(F.lit(target.seed), F.lit("doc"), "id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["src", "block"])
    copies = F.col("epochs") + (F.col("start") + F.col("inside") < F.col("rest")).cast("int")
    d = d.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order_key = _hash(F.lit(target.seed), "src", F.col("epoch").cast("string"), F.col("block").cast("string"))
    return d.select("doc.*", F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), order_key.alias("mix_order_key"))


def _sql(target: Target = Target()) -> str:
    """The same rows in SQL; both bisections run as recursive queries."""
    budget = f"CAST({target.budget_tokens} AS DOUBLE)" if target.budget_tokens else "z / low"
    md5 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    at = f"""SELECT (ln(z) - e / z) / ln(n) AS entropy, high / z * ({budget}) AS repeats FROM (
        SELECT sum(pow(total / t, {{a}})) AS z, sum(pow(total / t, {{a}}) * ln(pow(total / t, {{a}}))) AS e, max(pow(total / t, {{a}}) / total) AS high,
          min(pow(total / t, {{a}}) / total) AS low, count(*) AS n FROM pos, (SELECT CAST(sum(total) AS DOUBLE) AS t FROM pos))"""
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS src, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM documents
), sources AS (SELECT src, CAST(sum(n) AS BIGINT) AS total FROM docs GROUP BY src),
pos AS (SELECT * FROM sources WHERE total > 0),
up AS (
  SELECT 0 AS k, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT up.*, (SELECT entropy >= {target.min_entropy} FROM ({at.format(a="(up.lo + up.hi) / 2")})) AS ok FROM up WHERE k < {STEPS})
), first AS (
  SELECT CASE WHEN (SELECT count(*) FROM pos) < 2 OR (SELECT entropy >= {target.min_entropy} FROM ({at.format(a="1.0")})) THEN 1.0 ELSE (SELECT lo FROM up WHERE k = {STEPS}) END AS a
), down AS (
  SELECT 0 AS k, CAST(1.0 AS DOUBLE) AS lo, CAST(a AS DOUBLE) AS hi FROM first
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT down.*, (SELECT repeats <= {target.max_repeats} FROM ({at.format(a="(down.lo + down.hi) / 2")})) AS ok FROM down WHERE k < {STEPS})
), exponent AS (
  SELECT round(CASE WHEN (SELECT count(*) FROM pos) < 2 THEN 1.0 WHEN (SELECT repeats > {target.max_repeats} FROM ({at.format(a="(SELECT a FROM first)")})) THEN (SELECT lo FROM down WHERE k = {STEPS}) ELSE a END, 6) AS a FROM first
), budgets AS (
  SELECT src, total, CASE WHEN total > 0 THEN CAST(floor(pow(CAST(total AS DOUBLE), a) / z * ({"CAST(" + str(target.budget_tokens) + " AS DOUBLE)" if target.budget_tokens else "z / least"}) + 0.5) AS BIGINT) END AS budget
  FROM sources, exponent, (SELECT sum(pow(CAST(total AS DOUBLE), a)) AS z, min(pow(CAST(total AS DOUBLE), a) / total) AS least FROM pos, exponent)
), plan AS (
  SELECT src, CASE WHEN total > 0 THEN budget // total ELSE 1 END AS epochs, CASE WHEN total > 0 THEN budget - (budget // total) * total ELSE 0 END AS rest,
    CAST(least(greatest(ceil(total / {BLOCK_TOKENS}), 1), {MAX_BLOCKS}) AS BIGINT) AS blocks FROM budgets
), dealt AS (
  SELECT d.*, epochs, rest, {md5.format(f"'{target.seed}|' || d.src || '|' || doc_id")} % blocks AS block,
    {md5.format(f"'{target.seed}|doc|' || doc_id")} AS place
  FROM docs d JOIN plan p ON d.src = p.src
), totals AS (SELECT src, block, epochs, sum(n) AS n FROM dealt GROUP BY ALL),
starts AS (
  SELECT src, block, coalesce(sum(n) OVER (PARTITION BY src ORDER BY {md5.format(f"'{target.seed}|' || src || '|' || epochs || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM totals
), inner_sums AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY src, block ORDER BY place, CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM dealt
), copies AS (
  SELECT i.*, epochs + (start + inside < rest)::INT AS c FROM inner_sums i JOIN starts s ON i.src = s.src AND i.block = s.block
), taken AS (SELECT doc_id, source, n, src, block, unnest(range(0, c)) AS epoch FROM copies)
SELECT doc_id, source, CAST(n AS INTEGER) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block,
  {md5.format(f"'{target.seed}|' || src || '|' || epoch || '|' || block")} AS order_key
FROM taken
"""


SQL = _sql()
