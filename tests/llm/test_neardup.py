"""Operator 4 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from reportlake.llm import neardup
from reportlake.llm.shingles import shingles


def _edit(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def _jaccard(a, b):
    def bag(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_shingles_of_long_and_short_texts():
    texts = ["", None, "one two", "a b c d e f", "A, b c. d e f!", "x" * 3_000_000 + " y z", prose(1, 400_000)]
    got = list(shingles(texts))
    assert [len(x) for x, _ in got[:5]] == [0, 0, 1, 2, 2] and (got[3][0] == got[4][0]).all()
    assert sum(got[6][1]) == 400_000 - 4 and len(got[5][0]) >= 1
    alone = next(shingles([texts[6]]))
    assert (alone[0] == got[6][0]).all()


def test_classes_equal_brute_force(make):
    rows, i = [], 0
    for g in range(30):
        base = prose(100 + g, 200)
        for k in (0, 0, 1, 2, 3, 12, 60):
            rows.append((i, _edit(base, k, i) if k else base))
            i += 1
    center = prose(7, 300)
    rows += [(1000 + j, _edit(center, 1 + j % 4, j)) for j in range(80)]
    common = prose(8, 40)
    rows += [(2000 + j, common + " " + prose(3000 + j, 120)) for j in range(80)]
    rows += [(5000, None), (5001, ""), (5002, "two words"), (5003, "two words"), (None, center), (5004, "z " * 20_000)]
    random.Random(2).shuffle(rows)
    docs = make(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs.withColumn("key", docs.text).withColumn("cid", docs.doc_id)).collect()}
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows if i is not None}
    ids = sorted(text)
    near = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if text[a] == text[b] or abs(len(text[a]) - len(text[b])) < 600 and _jaccard(text[a], text[b]) >= 0.79}
    sure = {(a, b) for a, b in near if text[a] == text[b] or _jaccard(text[a], text[b]) >= 0.84}
    assert all(got[a].class_id == got[b].class_id for a, b in sure)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(got[i].class_id) for i in ids)
    assert all(got[i].class_id <= i and got[i].kept == (got[i].class_id == i) for i in ids)
    kept = [r.doc_id for r in neardup.keep_one(docs.withColumn("copy", docs.doc_id)).collect()]
    assert sorted(k for k in kept if k is not None) == [i for i in ids if got[i].kept] and kept.count(None) == 1


def test_versions_of_versions_are_one_class(make):
    """Trees and a chain of edited copies, in buckets over LARGE: classes hold the all-pairs components."""
    r, text = random.Random(5), {}
    for g in range(3):
        base = prose(700 + 100 * g, 220)
        text[1000 * g] = base
        for j in range(40):
            text[1000 * g + 2 * j + 1] = _edit(base, 1, 1000 * g + j)
            text[1000 * g + 2 * j + 2] = _edit(text[1000 * g + 2 * j + 1], 4, 5000 + 1000 * g + j)
    text |= {5000: prose(9, 220)}
    for j in range(1, 60):
        text[5000 + j] = _edit(text[5000 + j - 1], 2, j)
    rows = list(text.items())
    r.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    near = [(a, b) for a in text for b in text if a < b and a // 1000 == b // 1000 and _jaccard(text[a], text[b]) >= 0.82]
    assert len(near) > 1000 and [(a, b) for a, b in near if got[a] != got[b]] == []


def test_large_bucket_makes_few_pairs(make, monkeypatch):
    """Texts that share a passage leave a large bucket before any pair is made."""
    monkeypatch.setattr(neardup, "LARGE", 4)
    common = prose(1, 60)
    rows = [(j, common + " " + prose(50 + j, 60)) for j in range(60)]
    got = neardup.near_duplicates(make(rows)).collect()
    assert all(r.class_id == r.doc_id for r in got)


def test_empty_and_repeated(make):
    assert neardup.near_duplicates(make([])).collect() == []
    rows = neardup.near_duplicates(make([(1, "a"), (1, "a"), (2, None)])).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(1, 1), (1, 1), (2, 2)]


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    w = rng.uniform(1, 3, 400)
    sampler, agree = neardup.Sampler(), []
    for j in range(40):
        y = np.concatenate([x[40:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        v = np.concatenate([w[40:], rng.uniform(1, 3, 40)])
        true = np.minimum(w[40:], v[:360]).sum() / (w.sum() + v.sum() - w[40:].sum())
        agree.append(((sampler(x, w) == sampler(y, v)).mean(), true))
        x, w = y, v
    est, true = np.mean(agree, axis=0)
    assert est == pytest.approx(true, abs=0.04)


def test_blocks_that_meet_link_what_all_pairs_link():
    import random

    import numpy as np

    r = random.Random(9)
    base = [r.sample(range(1, 1 << 40), 60) for _ in range(3)]
    texts = []
    for i in range(90):
        x = np.array(sorted(set(r.choice(base)[: r.randrange(40, 61)] + [r.randrange(1, 1 << 40) for _ in range(r.randrange(6))])), np.uint64)
        texts.append((x, np.array([1 + (int(v) % 3) / 2 for v in x])))
    ids = list(range(90))
    block = [r.randrange(3) for _ in ids]
    links = []
    for p in range(3):
        for q in range(p, 3):
            rows = [(i, 1000 + i // 2, block[i] == p, block[i] == q, texts[i][0].tobytes() + texts[i][1].tobytes()) for i in ids if block[i] in (p, q)]
            links += neardup._Meeting(*(list(c) for c in zip(*rows, strict=True))).links()

    def classes(pairs):
        root = list(ids)
        for a, b in [*pairs, *((i, i + 1) for i in range(0, 90, 2))]:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
        return root

    every = [(a, b) for a in ids for b in ids[:a] if neardup._similarity(texts[a], texts[b]) >= neardup.THRESHOLD]
    assert len(links) < len(every) and all(neardup._similarity(texts[a], texts[b]) == s >= neardup.THRESHOLD for a, b, s in links)
    assert classes([(a, b) for a, b, _ in links]) == classes(every)
