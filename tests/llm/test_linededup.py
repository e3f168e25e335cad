"""Operator 5: brute force, SQL, edges."""

import random

import duckdb
from conftest import prose

from reportlake.llm import linededup


def _edit(words, r):
    w, i = list(words), r.randrange(len(words))
    kind = r.randrange(4)
    if kind == 0:
        w[i] = "new" + str(r.randrange(9))
    elif kind == 1:
        del w[i]
    elif kind == 2:
        w.insert(i, r.choice(w))
    else:
        j = r.randrange(len(w))
        w[i], w[j] = w[j], "two"
    return w


def _apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _brute(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept, n = [], 0
        for line in (text or "").split("\n"):
            w = line.split()
            gone = bool(w) and any(v == w or max(len(v), len(w)) >= 5 and abs(len(v) - len(w)) <= 1 and _apart(v, w) <= 1 for v in seen)
            if w:
                seen.append(w)
            n += gone
            if not gone:
                kept.append(line)
        out[i] = (text if not n else "\n".join(kept), n)
    return out


def _rows():
    r = random.Random(4)
    pool = [prose(i, r.choice([3, 4, 5, 6, 9, 14, 30])).split() for i in range(25)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randrange(6)):
            w = r.choice(pool)
            if r.random() < 0.6 and len(w) > 1:
                w = _edit(w, r)
                if r.random() < 0.3:
                    pool.append(w)
            lines.append(("  " if r.random() < 0.1 else " ").join(w) + ("\t" if r.random() < 0.1 else ""))
        rows.append((i, "\n".join(lines)))
    long = prose(99, 700).split()
    rows += [(100, " ".join(long)), (101, " ".join(long[:300] + long[301:])), (102, " ".join(long[:500] + ["x"] + long[501:])), (103, " ".join(["x", "y", *long]))]
    return rows + [(200, None), (201, ""), (202, "a a b a a\na a a b a a\nb a a\n\n\nb a a")]


def test_equals_brute_force_and_sql(make):
    rows = _rows()
    docs = make(rows)
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(docs.withColumn("h", docs.text).withColumn("line_no", docs.doc_id)).collect()}
    want = _brute(rows)
    assert got == want and sum(n for _, n in want.values()) > 60
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: (r[1], r[3]) for r in con.execute(linededup.SQL).fetchall()} == want


def test_edges(make):
    assert linededup.dedup_lines(make([])).collect() == []
    got = linededup.dedup_lines(make([(1, "x y\nz"), (1, "x y\nz"), (2, "z\nx y"), (None, "z"), (3, "q")])).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got) == [(0, "z", 1, 0), (1, "x y", 2, 1), (1, "x y", 2, 1), (2, "", 2, 2), (3, "q", 1, 0)]
