"""Operator 1: round trip, random access, brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from reportlake.llm import tokens


def _ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")


def test_cut_texts_encode_as_whole_ones():
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "!", "'s", "<|endoftext|>", " b.", "ñ", "　", "\x1c", "漢", "\xa0", "​", " ", "Ġ", "\r\n", "it's", "x.\ny"]
    enc = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), max_words=30)
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        for text, got in zip(texts[i : i + 100], enc.encode(pa.array(texts[i : i + 100])), strict=True):
            assert got == _ids_fast(enc, text), repr(text)


def _ids_fast(enc, text):
    return np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_segment_random_access():
    r = np.random.default_rng(5)
    docs = [(i if i % 5 else None, r.integers(0, [200, 70_000, 2**32][i % 3], i * 41 % 900).astype("<u4").tobytes()) for i in range(40)]
    seg = tokens.Segment(tokens.pack(docs))
    flat = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert (seg.decode() == flat).all() and [seg.access(i) for i in range(0, len(flat), 7)] == flat[::7].tolist()
    assert [(d, x.tobytes()) for d, _, x in seg.documents()] == docs
    assert tokens.Segment(tokens.pack([(1, b"")])).decode().tolist() == []


def test_index_equals_brute_force(make, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_TOKENS", 300)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 500)
    rows = [(i, f"text {i} " * (i % 90)) for i in range(60, 0, -1)] + [(7, "again"), (7, "again"), (None, "no id"), (100, None), (101, ""), (102, "word " * 5000)]
    got = [r.asDict() for r in tokens.token_ids(make(rows)).collect()]
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    at = 0
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(_ids(t))
    for r in got:
        ids = [x for x in want[r["doc_id"]] if zlib.crc32(x.tobytes()) == r["ids_crc32"]]
        assert r["start"] == at and ids and r["n_tokens"] == len(ids[0])
        at += r["n_tokens"]
    assert len({(r["part"], r["seg"]) for r in got}) > 3
    assert tokens.token_ids(make([])).collect() == []
