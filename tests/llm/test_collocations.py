"""Operator 13: against counts by dictionaries; the trie, the cutter and the filter alone."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reportlake.llm import collocations as co

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        rows_ = []
        for g, a in cand.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) and 100 * b >= 80 * a for h, b in cand.items()):
                rows_.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(c for g, c in f.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "cc", "Dd", "é", "É", "zzz", "漢字", "x-y", "1"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\xa0", "! "]
    return [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("tight", [False, True])
def test_equals_brute_force(spark, monkeypatch, tight):
    if tight:  # spills, bursts, merges in steps and texts in chunks
        for name, value in (("TRIE_ENTRIES", 50), ("BURST", 3), ("MERGE_ENTRIES", 40), ("CHUNK", 40), ("PART_WORDS", 300), ("WORD_ENTRIES", 5)):
            monkeypatch.setattr(co, name, value)
    rows = corpus(1, 300) + [(None, None), ("en", ""), ("en", "A b. " * 40), ("fr", "one Two three four five " * 50), ("fr", "q" * 5000 + " end " + "q" * 5000 + " end"), ("en", ".,;"), ("it", "solo")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, id int")
    got = co.collocations(df, min_count=5, top=40).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, 5, 40)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_past_64_bits(spark):
    big = 3 * 10**18
    rows = [("en", 1, [1], big), ("en", 1, [2], big + 1), ("en", 2, [1, 2], big - 7), ("en", 2, [2, 1], 40), ("en", 3, [1, 2, 1], 32)]
    got = {tuple(r.ids): (r.a, r.l, r.r, r.score) for r in co.scored(spark.createDataFrame(rows, "lang string, words int, ids array<long>, n long")).collect()}
    assert got[1, 2] == (big - 7, big, big + 1, 2_000_000 * (big - 7) // (2 * big + 1))
    assert (2, 1) not in got and got[1, 2, 1] == (32, big, 40, 0)


@pytest.mark.parametrize("words", [2, 3, 4])
def test_trie_spills_whole_subtrees(words):
    r, trie, total, want = random.Random(words), co.HatTrie(words, burst=4), Counter(), Counter()
    for _ in range(30):
        rows = [[r.randrange(1 << 63, (1 << 63) + 6) for _ in range(words)] for _ in range(80)]
        want.update(map(tuple, rows))
        trie.add(*np.unique(np.array(rows, np.uint64), axis=0, return_counts=True))
        if trie.entries > 60:
            ids, counts = trie.spill(30)
            assert trie.entries <= 30 and ids.tolist() == sorted(ids.tolist())
            assert not {x[0] for x in ids.tolist()} & set(trie.root)
            total.update({tuple(i): int(c) for i, c in zip(ids.tolist(), counts, strict=True)})
    ids, counts = trie.spill(0)
    for i, c in zip(ids.tolist(), counts.tolist(), strict=True):
        total[tuple(i)] += c
    assert total == want and not trie.root and not trie.entries and not trie.burst_nodes


def test_words_that_share_an_id_are_noticed(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "ab ba ab"), ("en", "cd")], "lang string, text string")
    assert co.word_counts(rows, 0).where("word <> other").isEmpty()

    class Flat(co.Words):
        """Every byte has the same value wherever it stands."""

        def __init__(self, seed):
            co.Words.__init__(self, seed)
            self.values[: 64 * 256] = np.tile(self.values[:256], 64)

    monkeypatch.setattr(co, "Words", Flat)
    assert co.word_counts(rows, 0).where("word <> other").count() == 1


def test_filter_holds_its_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    f = co.Bloom(17)
    f.add(keys[:3000])
    assert f.has(keys[:3000]).all() and f.has(keys[3000:]).mean() < 0.05


@pytest.mark.parametrize("different", [3, 70_000])
def test_phrases_of_a_chunk(different):
    r = np.random.default_rng(different)
    ids = r.integers(0, 1 << 63, different, dtype=np.uint64)[r.integers(0, different, 140_000)]
    linked = r.random(len(ids)) < 0.9
    for words in (2, 3, 4):
        rows, counts = co._grams(ids, linked, words, 5)
        want = Counter(tuple(x) for i, x in enumerate(zip(*(ids[k:].tolist() for k in range(words)), strict=False)) if i + words > 5 and linked[i + 1 : i + words].all())
        assert rows.tolist() == sorted(rows.tolist()) and dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == want
