"""Operator 7 against brute force."""

import numpy as np
import pytest

from reportlake.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows):
    ok = [(i, np.asarray(v, "f4").astype("f8")) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n = {i: 0 for i, _ in rows if i is not None}
    comp = {i: i for i in n}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for p in range(len(ok)):
        for q in range(p):
            (a, x), (b, y) = ok[p], ok[q]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= embeddings.THRESHOLD:
                n[a] += 1
                n[b] += 1
                comp[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (n[i], find(i)) for i in n}


def _vectors():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for g in range(12):
        c = rng.standard_normal(48)
        for e in (0, 0, 0.02, 0.1, 0.18, 0.22, 0.3, 0.5, 1.0):
            rows.append((i, (c / np.linalg.norm(c) + e * rng.standard_normal(48) / 7).astype("f4").tolist()))
            i += 1
    return rows + [(i + j, rng.standard_normal(48).astype("f4").tolist()) for j in range(150)]


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = _vectors() + [(1000, None), (1001, []), (1002, [0.0] * 48), (1003, [float("nan")] * 48), (1004, [1.0] + [float("inf")] * 47), (1005, [1.0, None]), (1006, [1.0, 1.0]), (1007, [2.0, 2.0]), (1008, [1e30, 1e30]), (1009, [-0.0, 1.0]), (1010, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(None, rows[0][1], 0)], SCHEMA)
    got = embeddings.near_duplicates(df.selectExpr("*", "1 as key", "2 as n", "3 as cid")).collect()
    assert len(got) == len(rows) + 1
    want = _brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    none = [r for r in got if r.vec_id is None][0]
    assert (none.n_links, none.component_id) == (0, None)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    d, errors = 64, []
    for k in range(300):
        o, q = rng.standard_normal((2, d))
        q = 0.8 * o + 0.6 * q
        o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
        p = embeddings.rotation(d, k + 1)
        turned = p @ o
        f = np.abs(turned).sum() / np.sqrt(d)
        est = np.where(turned > 0, 1, -1) @ (p @ q) / np.sqrt(d) / f
        errors.append(((est - o @ q), embeddings.EPSILON * np.sqrt((1 - f * f) / f / f / (d - 1))))
    e = np.array(errors)
    assert abs(e[:, 0].mean()) < 0.01 and (np.abs(e[:, 0]) <= e[:, 1]).mean() > 0.99


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
