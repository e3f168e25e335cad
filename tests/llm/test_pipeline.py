"""The pipeline's stages: each against a brute-force version of itself, and all together on the driver's table."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from reportlake.llm import toxicity
from reportlake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs, got.columns, rows))
        docs = spark.createDataFrame(rows, docs.schema) if name != "token_ids" else None
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    assert all(s[2] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_toxicity_drops_what_it_scores(spark, stages):
    _, docs, _, rows = stages[0]
    model = toxicity.train(docs, table(spark, SF, "labels"))
    want = {r.doc_id for r in docs.collect() if model.score(r.text) < 0.5}
    assert {r.doc_id for r in rows} == want and len(want) > 100


def test_near_dedup_and_decontamination(spark, stages):
    import re

    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    texts = [r.text for r in stages[1][3]]
    bags = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            assert both < 0.85 * max(1, sum((bags[i] | bags[j]).values())) and texts[i] != texts[j]
    items = [re.sub(r"\W+", " ", r.text.lower()).strip() for r in table(spark, SF, "benchmark").collect()]
    hit = {r.doc_id for r in stages[2][1].collect() if any(x in re.sub(r"\W+", " ", r.text.lower()) for x in items)}
    kept = {r.doc_id for r in stages[2][3]}
    assert not hit & kept and len(stages[1][3]) - len(kept) <= len(hit) + 2


def test_mixing_keeps_all_and_tokens_follow(stages):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = Counter(r.doc_id for r in stages[3][1].collect()), Counter(r.doc_id for r in stages[3][3])
    assert set(before) == set(after)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text, start = {r.doc_id: r.text for r in stages[3][3]}, 0
    for r in sorted(stages[4][3], key=lambda r: r.start):
        ids = np.array([*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert Counter(r.doc_id for r in stages[4][3]) == after


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[4][3])


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
