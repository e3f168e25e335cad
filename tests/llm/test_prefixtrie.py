"""Operator 11: against a trie of dictionaries; the list ranking and the block sums alone."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from reportlake.llm import prefixtrie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild):
    """The contract by dictionaries; rows of equal turn must be equal."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    paths = own
    if rebuild:
        paths = {}
        for c, x in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            paths[c] = own.get(c - c % 5, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in paths.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids, under = defaultdict(set), defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].add(key)
        for d in range(len(key) + 1):
            under[key[:d]].append(key)
    out = []
    for key, m in members.items():
        leaves = sum(not kids[k] for k in under[key])
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under[key] if k)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids[key]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed, n, deep=0):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "é", "long text " * 3, None])) for c in r.sample(range(3 * n), n) for t in range(r.randrange(1, 9))]
    rows += [(3 * n, t, "user", f"turn {t}") for t in range(deep)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_equals_brute_force(spark, monkeypatch, rebuild):
    monkeypatch.setattr(prefixtrie, "BITS", 3)
    monkeypatch.setattr(prefixtrie, "_CHUNK", 16)
    rows = conversations(1, 60, deep=150)
    rows += [(None, 1, "user", "no conversation"), (901, None, "user", "first"), (901, 0, "user", "second"), (902, 4, "user", "x" * 200_000), (902, 4, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], TURNS + ", node double").withColumnRenamed("node", "arc")
    assert got(prefixtrie.prefix_trie(df, rebuild)) == brute(rows, rebuild)


def test_turnless_conversations_and_copies(spark):
    # h of 1 is 2 and that of 3 is 4: their only turns are the replaced ones, and conversation 0 is absent
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    gone = [c for c, n in h.items() if n]
    rows = [(c, 0, "user", "gone") for c in gone] + [(100 + i, 0, "user", "same") for i in range(0, 500, 5)]
    out = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS), rebuild=True)
    assert got(out) == brute(rows, True)


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert got(prefixtrie.prefix_trie(none, rebuild=True)) == got(prefixtrie.prefix_trie(none)) == []


@pytest.mark.parametrize("n", [1, 2, 700])
def test_list_rank(spark, n):
    ids = random.Random(n).sample(range(10**12), n)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], None], strict=True)), "arc long, next long").repartition(7)
    ranks = {r.arc: r.position for r in prefixtrie.list_rank(arcs, n, short=40).collect()}
    assert ranks == {a: i for i, a in enumerate(ids)}


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BITS", 2)
    rows = [(g, i, i * i) for g, n in (("a", 90), ("b", 1), ("c", 17)) for i in range(n)]
    df = prefixtrie.running(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], "i", {"v": "s"})
    assert {(r.g, r.i): r.s for r in df.collect()} == {(g, i): sum(j * j for j in range(i + 1)) for g, i, _ in rows}
