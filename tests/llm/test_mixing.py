"""Operator 9 and its SQL."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from reportlake.llm import mixing


def _rows():
    rows = [(i, "w " * (1 + i % 37), "en", "big") for i in range(600)]
    rows += [(1000 + i, "w " * (5 + i % 11), "en", "mid") for i in range(80)]
    rows += [(2000 + i, "w " * 9, "en", "small") for i in range(20)]
    return rows + [(3000, "only words here", "en", None), (3001, "", "en", "small"), (3002, None, "en", "nothing")]


TARGETS = [mixing.Target(), mixing.Target(min_entropy=0.8, max_repeats=3.0), mixing.Target(min_entropy=1.0, max_repeats=2.0), mixing.Target(min_entropy=0.6, max_repeats=50.0, budget_tokens=4000)]


@pytest.mark.parametrize("target", TARGETS)
def test_equals_sql(make, target, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    docs = make(_rows())
    got = mixing.mix(docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")), F.col("n_tokens"), target).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cur = con.execute(mixing._sql(target))
    names = [c[0] for c in cur.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[n] for n in ("doc_id", "source", "n_tokens", "epoch", "block", "order_key")) for r in cur.fetchall())
    assert Counter(tuple(r) for r in got) == want


def test_weights_reach_the_target(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    docs = make(_rows())
    target = mixing.Target(min_entropy=0.7, max_repeats=1000.0)
    got = mixing.mix(docs.withColumn("mix_epoch", F.lit("mine")).withColumn("src", F.lit(1)), mixing.token_count(F.col("text")), target).collect()
    assert {r.doc_id for r in got} == {r[0] for r in _rows()}  # nothing is dropped
    tokens = Counter()
    for r in got:
        tokens[r.source] += len((r.text or "").split())
    total = sum(tokens.values())
    entropy = -sum(n / total * math.log(n / total) for n in tokens.values() if n) / math.log(4)
    assert entropy == pytest.approx(0.7, abs=0.02) and got[0].src == 1
    assert max(Counter(r.doc_id for r in got).values()) == 1 + max(r.mix_epoch for r in got)


def test_edges(make):
    count = mixing.token_count(F.col("text"))
    assert mixing.mix(make([]), count).collect() == []
    assert Counter(r.doc_id for r in mixing.mix(make([(1, "", "en", "a"), (2, None, "en", "b")]), count).collect()) == {1: 1, 2: 1}
    assert Counter(r.doc_id for r in mixing.mix(make([(1, "x", "en", "a"), (1, "x", "en", "a"), (None, "x y", "en", "a")]), count).collect()) == {1: 2, None: 1}
