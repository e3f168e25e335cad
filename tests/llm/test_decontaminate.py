"""Operator 10 and its SQL."""

from itertools import combinations

import duckdb
import pytest
from conftest import prose

from reportlake.llm import decontaminate


def test_planted_overlaps_and_edges(spark, make):
    items = [(1, prose(1, 30)), (2, prose(2, 50)), (3, "too short item"), (4, None), (5, ""), (2, prose(2, 50))]
    sub = prose(2, 50).split()
    for i in range(4, 50, 7):
        sub[i] = "changed"
    rows = [
        (10, prose(50, 40) + " " + items[0][1] + " " + prose(51, 40)),
        (11, prose(52, 10) + "\n" + " ".join(sub).upper()),
        (12, " ".join(prose(2, 50).split()[:26]) + " " + prose(60, 200)),
        (13, prose(53, 5000)),
        (14, " ".join(items[0][1].split()[:9]) + " " + prose(54, 60)),
        (15, None), (16, ""), (None, items[0][1]), (10, "other row"), (17, "too short item"),
    ]
    docs = make(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs.withColumn("_t", docs.text).withColumn("seed", docs.doc_id), bench).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 2), (None, 1)}
    assert got[10, 1].n_matched == 30 and got[10, 1].best_window == 24
    kept = decontaminate.clean(docs.withColumn("bad", docs.doc_id), bench).collect()
    assert sorted(r.doc_id for r in kept) == [13, 14, 15, 16, 17] and kept[0].bad is not None
    assert decontaminate.overlaps(make([]), bench).collect() == []
    assert decontaminate.overlaps(docs, bench.where("false")).collect() == []

    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null and text <> 'other row'").toPandas())
    con.register("benchmark", bench.distinct().toPandas())
    sql = {r[:6] for r in con.execute(decontaminate.SQL).fetchall()}
    assert sql == {tuple(r) for k, r in got.items() if k[0] is not None}


def test_without_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(make([(1, prose(1, 30)), (2, prose(3, 30))]), bench).collect()] == [1]


@pytest.mark.parametrize("n", range(decontaminate.SPAN, decontaminate.WINDOW + 1))
def test_masks_hit_every_allowed_substitution(n):
    masks = (*decontaminate.MASKS, *([decontaminate.SHORT_MASK] if n < decontaminate.WINDOW else []))
    placed = [sum(1 << p + j for j, bit in enumerate(m) if bit == "1") for m in masks for p in range(n - len(m) + 1)]
    allowed = n - -(-n * round(100 * decontaminate.MIN_SHARE) // 100)
    for sub in combinations(range(n), allowed):
        changed = sum(1 << i for i in sub)
        assert any(not m & changed for m in placed), sub


def test_short_items_with_substitutions(spark, make):
    items, rows = [], []
    for n in (8, 10, 11):
        words = prose(n, n).split()
        items.append((n, " ".join(words)))
        for k, sub in enumerate(combinations(range(n), n // 5)):
            text = " ".join("changed" if i in sub else w for i, w in enumerate(words))
            rows.append((100 * n + k, text if k % 2 else prose(70, 9) + " " + text + " " + prose(71, 9)))
    rows += [(1, " ".join(items[0][1].split()[:7])), (2, " ".join(items[0][1].split()[:6])), (3, " ".join(items[1][1].split()[3:]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i // 100) for i, _ in rows if i >= 800} | {(1, 8)}
    con = duckdb.connect()
    con.register("documents", make(rows).toPandas())
    con.register("benchmark", spark.createDataFrame(items, "item_id long, text string").toPandas())
    assert {r[:2] for r in con.execute(decontaminate.SQL).fetchall()} == got
