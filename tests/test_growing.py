"""Lines of files that grow: whole lines once each, whatever the cuts."""

import os
import random

import pytest

from reportlake.sources import growing
from reportlake.streaming import reports as streams

HEADER = "TX_HASH,POWER,TIMESTAMP,VALUE"


def test_ranges_hold_each_line_once(tmp_path):
    r = random.Random(1)
    lines = ["x" * r.randrange(30) + str(i) for i in range(200)]
    path = str(tmp_path / "f.csv")
    raw = ("\r\n".join(lines) + "\r\n").encode()
    open(path, "wb").write(raw + b"not whole")
    reader = growing.GrowingReader(str(tmp_path), "*.csv", 70)
    end = reader.latestOffset()
    assert end == {path: len(raw)}
    start = {}
    for cut in (0, 500, len(raw)):  # an end is always behind a line break
        stop = {path: raw[:cut].rfind(b"\n") + 1} if cut < len(raw) else end
        got = [x for p in reader.partitions(start, stop) for b in reader.read(p) for x, at in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True) if at >= 0]
        begin = start.get(path, 0)
        assert got == raw[begin : stop[path]].decode().split("\r\n")[:-1]
        start = stop
    heads = [b.column(2).to_pylist() for p in reader.partitions({path: len(raw) - 40}, end) for b in reader.read(p) if b.column(1)[0].as_py() == -1]
    assert heads and all(h == [lines[0]] for h in heads)
    with pytest.raises(ValueError):
        reader.partitions({path: len(raw) + 5}, end)


def test_appends_are_read_once(spark, tmp_path):
    folder, table, ck = str(tmp_path / "csv"), str(tmp_path / "table"), str(tmp_path / "ck")
    os.makedirs(folder)
    rows = [f"TX{i % 40},{i},{1000 + i // 10},1.5" for i in range(60)]
    text = "\n".join([HEADER, *rows]) + "\n"
    want = {}
    for i, row in enumerate(rows):
        want.setdefault(f"TX{i % 40}", i)
    at = 0
    for cut in (0, 300, 305, len(text)):  # nothing yet, inside a line, some bytes more, all
        with open(f"{folder}/table_1.csv", "a") as f:
            f.write(text[at:cut])
        at = cut
        streams.ingest_stream(spark, growing.growing_lines(spark, folder, part_bytes=100), table, ck).awaitTermination()
        whole = text[:cut].count("\n") - 1
        got = {r.TX_HASH: (r.POWER, r.TIMESTAMP, r.source_file) for r in streams.read_ingested(spark, table).collect()}
        assert got == {k: (i, 1000 + i // 10, "table_1.csv") for k, i in want.items() if i < whole}
    blocks = {r.TIMESTAMP: (r.rows, r.POWER_OF_AGGR) for r in streams.read_ingested_blocks(spark, table).collect()}
    assert blocks == {1000 + b: (10, sum(range(10 * b, 10 * b + 10))) for b in range(4)}
