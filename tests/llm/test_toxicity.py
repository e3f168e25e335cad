"""Operator 8: held-out accuracy and edge cases."""

from conftest import prose

from reportlake.llm import toxicity

BAD = ["gribble", "snorkwit", "flobnard", "wretchling"]


def _corpus(n=400):
    import random

    r, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, make):
    rows, labels = _corpus()
    edge = [(None, "x"), (1000, None), (1001, ""), (1002, "word " * 50_000), (0, rows[0][1]), (1003, prose(9, 300) + " gribble flobnard gribble")]
    docs = make(rows + edge)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None), (5001, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs.withColumn("score", docs.doc_id).withColumn("tox_score", docs.text), lab).collect()
    assert len(got) == len(rows) + len(edge)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[1003].predicted == 1 and by[1002].predicted == 0 and by[1000].score == by[1001].score
    assert all(0 <= r.score <= 1 and r.held_out == (toxicity.fold(str(r.doc_id)) == 0) for r in got if r.doc_id is not None)


def test_empty_tables_and_one_class(spark, make):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(make([]), lab).collect() == []
    got = toxicity.toxicity(make([(1, "a b c"), (2, "d")]), lab.where("false")).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}
