"""Units learned many in a text get the ids of a call each, and tables of units survive a failed call."""

import random

import numpy as np
import public_tokenizers
import pytest

from reportlake.llm import packing, tokens
from reportlake.llm.encoding import Units, UnitTable


class _Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.tok.encode_batch_fast(texts, **kw)


def _units(n, seed):
    r = random.Random(seed)
    chars = "abcxyz" * 4 + "ABZ" + "0189" + "'''***!!$&_.,;:<>|~^`" + "éèçñßöÉİſŉǅɐ×÷" + "Ωж中́ª½²①😀"
    found = {"".join(r.choice(chars) for _ in range(r.randrange(1, 9))) for _ in range(n)} | {"it's", "we'll", "'s's", "a'res", "x'", "'", "ab***", "12", "a1b2"}
    return sorted(x.lower().encode() if "İ" not in x else x.encode() for x in found if "<|" not in x)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_word_units_are_learned_as_in_calls_of_their_own(seed):
    enc, units = packing.Encoder(public_tokenizers.path(packing.TOKENIZER)), _units(3000, seed)
    ids, size = enc._learn(units)
    want = [enc._ids(u.decode()) for u in units]
    assert size.tolist() == [len(x) for x in want]
    assert ids.tolist() == np.concatenate(want).tolist()


def test_units_of_several_words_share_texts():
    enc = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    enc.tok = _Counting(enc.tok)
    units = [f"word{a}{b}é***".encode() for a in "abcdefghij" for b in "klmnopqrst"]
    assert len(enc._learn(units)[1]) == 100
    assert enc.tok.texts <= 2  # not a text each


def test_byte_units_share_texts():
    enc = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    units = [f"word{k}".encode() for k in range(512)]
    want = [enc._ids(" " + u.decode()).tolist() for u in units]
    enc.tok = _Counting(enc.tok)
    ids, size = enc._learn(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want
    assert enc.tok.texts <= 2  # not eight


def test_a_failed_call_leaves_no_units():
    calls = []

    def learn(names):
        calls.append(names)
        if len(calls) == 2:
            raise ValueError
        return np.array([len(x) for x in names], "<u4"), np.ones(len(names), np.int64)

    table, blank, heads = UnitTable(learn), np.array([b == 32 for b in range(256)]), np.zeros(256, bool)
    get = lambda raw: table.ids(Units(raw, blank, heads))[0].tolist()
    assert get(b"a bbb a cc") == [1, 3, 1, 2]
    with pytest.raises(ValueError):
        get(b"cc dddd")
    assert get(b"dddd a dddd") == [4, 1, 4]
    assert get(b"dddd eeeee") == [4, 5] and calls[-1] == [b"eeeee"]
