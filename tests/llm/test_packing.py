"""Operator 12: pieces against the tokenizer, sequences against their rules and the least possible number."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reportlake.llm import encoding, packing
from reportlake.llm.common import table

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_units_encode_as_whole_texts(tok):
    r = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "É", "e\u0301", "12", "!", "'s", "Don't", "<|endoftext|>", "<|", " b.", "ñ", "\u3000", "\x1c", "\x0b", "\x0c", "漢", "\xa0", "İ", "ß", "Σ", "\x00", "\r\n", "x.\ny", "...", "word,", "word;\u0301", "ａ", "-", "😀", "\u200d"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(4000)] + [None, "", "x" * 3000, ("y" * 64 + "z" * 64) * 9]
    enc = packing.Encoder(PATH, max_units=30)
    for i in range(0, len(texts), 100):
        for text, got in zip(texts[i : i + 100], enc.encode(texts[i : i + 100]), strict=True):
            assert got.tolist() == tok.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_units_with_equal_hashes_stay_apart(monkeypatch, tok):
    monkeypatch.setattr(encoding, "_VALUES", encoding._VALUES * np.uint64(0))
    texts = ["ab ba cd. ab", "dc ab! zz"]
    for text, got in zip(texts, packing.Encoder(PATH).encode(texts), strict=True):
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_bins_are_best_fit():
    r, bins, free, fill = random.Random(1), packing.Bins(50, 6), {}, {}
    for _ in range(3000):
        n = r.randrange(1, 51)
        fits = [f for f in free.values() if f >= n]
        own, at = bins.put(n)
        if fits:
            assert free[own] == min(fits)
        else:
            assert own not in fill
            if len(free) == 6:  # the fullest closed
                gone = min(free.values())
                free.pop(next(b for b, f in free.items() if f == gone and b not in sum(bins.at, [])))
            free[own] = 50
        assert at == fill.get(own, 0)
        fill[own] = at + n
        free[own] -= n
        if not free[own]:
            del free[own]
        assert sorted(free) == sorted(sum(bins.at, [])) and len(free) <= 6
        assert bins.bits == sum({1 << f for f in free.values()})


def _sequences(rows):
    seqs = defaultdict(list)
    for x in rows:
        seqs[x.sequence_id].append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return seqs


@pytest.mark.parametrize("task_pieces", [1 << 15, 40])
def test_query_follows_the_contract(spark, make, tok, monkeypatch, task_pieces):
    monkeypatch.setattr(packing, "BATCH_BYTES", 5000)
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs += [(None, "no id"), (None, None), (7, ""), (7, ""), (8, "Word, " * 30_000), (9, "one" * 4000)]
    rows = packing.pieces(make(docs)).withColumn("id", packing.F.monotonically_increasing_id())
    rows = packing.stored(rows, "test-pieces")
    out = rows.join(packing.pack(rows, task_pieces=task_pieces), "id").collect()
    want, total = [], 0
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out), key=str) == sorted(want, key=str)
    assert len(_sequences(out)) <= -(-total // 4096) * 1.02 + 1


def test_many_tasks_make_few_sequences(spark):
    r = random.Random(4)
    items = [(i, r.choice([r.randrange(1, 300), r.randrange(1, 4097)])) for i in range(6000)]
    rows = {i: n for i, n in items}
    out = packing.pack(spark.createDataFrame(items, "id long, length long"), task_pieces=300).collect()
    assert sorted(x.id for x in out) == sorted(rows)
    load = defaultdict(int)
    for x in out:
        load[x.sequence_id] += rows[x.id]
    assert max(load.values()) <= 4096 and len(load) <= sum(rows.values()) / 4096 * 1.02 + 1


def test_empty_and_clashing_names(spark, make):
    assert packing.packed(make([])).collect() == []
    df = make([(1, "a b")]).withColumn("id", packing.F.lit("x")).withColumn("offset", packing.F.lit(9)).withColumn("length", packing.F.lit("y"))
    assert [(x.doc_id, x.piece, x.start, x.length, x.offset) for x in packing.packed(df).collect()] == [(1, 0, 0, 3, 0)]
