"""Untidy report files: header sniffing, encoded names, missing/extra cells, junk cells, duplicates."""

import json

import pytest
from pyspark.sql import functions as F

from reportlake.operators import blocks, dedupe
from reportlake.sources import documents, report_files

HEADER = "REPORTER,QUERY_TYPE,QUERY_ID,AGGREGATE_METHOD,CYCLELIST,POWER,TIMESTAMP,TRUSTED_VALUE,TX_HASH,CURRENT_TIME,TIME_DIFF,VALUE,DISPUTABLE,POWER_OF_AGG,"
POWERS_6 = [1110, 900, 800, 700, 648, 600]  # sums to 4758
POWERS_10 = POWERS_6 + [1000, 500, 509, 400]  # sums to 7167
BLOCKS = [(1748870488336, POWERS_6), (1748870491820, POWERS_10), (1748870499834, POWERS_10)]


def addr(i):
    return "reporter" + "1" + f"{i:038d}"


def row(i, ts, power, tx, value="104111", disputable="False"):
    return [addr(i), "SpotPrice", "a6f0" + "0" * 60, "weighted-median", "true", str(power), str(ts), "104071.12",
            tx, str(ts + 10944), "10944", value, disputable]


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    d = tmp_path_factory.mktemp("reports")
    lines, n = [HEADER], 0
    for ts, powers in BLOCKS:
        for p in powers:
            lines.append(",".join(row(n, ts, p, f"TX{n:062d}")))
            n += 1
    (d / "table_1000.csv").write_text("\n".join(lines) + "\n")
    # headerless: a duplicate of TX0 (ignored: an earlier file wrote it), junk and odd widths
    rows2 = [
        row(100, 1748870600000, 5, f"TX{0:062d}"),
        row(101, 1748870600000, "abc", "TXB1"),
        row(102, 1748870600000, "1.5", "TXB2") + ["extra", "cells"],
        row(103, 1748870600000, 7, "TXB3")[:12],
    ]
    (d / "table_2000.csv").write_text("\n".join(",".join(r) for r in rows2) + "\n")
    # encoded, reordered header without AGGREGATE_METHOD; TXC1 twice in one file (first line wins)
    cols = ["TX+AF8-HASH", "QUERY%5FID", "REPORTER", "POWER", "TIMESTAMP", "VALUE", "TRUSTED_VALUE", "DISPUTABLE",
            "CYCLELIST", "QUERY_TYPE", "CURRENT_TIME", "TIME_DIFF"]
    body = [["TXC1", "q1", addr(200), "11", "1748870700000", "1.5", "1.4", "yes", "False", "Other", "1748870700100", "100"],
            ["TXC1", "q1", addr(201), "99", "1748870700000", "9.9", "1.4", "no", "True", "Other", "1748870700100", "100"]]
    (d / "table_3000.csv").write_text(",".join(cols) + "\n" + "\n".join(",".join(b) for b in body) + "\n")
    (d / "table_4000.csv").write_text("")
    (d / "table_x.csv").write_text(HEADER + "\n" + ",".join(row(999, 1, 1, "TXX")) + "\n")
    return str(d)


def test_listing_and_classes(spark, landed):
    files = report_files.list_report_files(spark, landed)
    names = {r.filename for r in files.collect()}
    # zero-byte files have no rows and are not listed by Spark's file sources
    assert names == {"table_1000.csv", "table_2000.csv", "table_3000.csv"}
    kinds = {r.filename: r.type for r in report_files.classify_files(files).collect()}
    assert kinds["table_3000.csv"] == "active" and kinds["table_1000.csv"] == "historical"


def test_read_and_dedupe(spark, landed):
    raw = report_files.read_report_dir(spark, landed)
    rep = dedupe.dedupe_reports(raw)
    rows = {r.TX_HASH: r for r in rep.collect()}
    assert len(rows) == 26 + 3 + 1  # TX0 kept once (from table_1000), TXC1 once
    assert rows[f"TX{0:062d}"].source_file == "table_1000.csv"
    assert rows["TXB1"].POWER is None  # junk cell -> NULL
    assert rows["TXB2"].POWER == 2  # '1.5' rounds like the original's TRY_CAST
    assert rows["TXB3"].DISPUTABLE is None  # short row padded
    assert rows["TXC1"].REPORTER == addr(200) and rows["TXC1"].DISPUTABLE is True  # first line wins
    assert rows["TXC1"].AGGREGATE_METHOD is None and rows["TXC1"].QUERY_ID == "q1"
    assert "TXX" not in rows  # table_x.csv is not a report file


def test_block_power_golden(spark, landed):
    rep = dedupe.dedupe_reports(report_files.read_report_dir(spark, landed))
    audit = {r.TIMESTAMP: r for r in blocks.block_consistency(blocks.power_of_aggr(rep)).collect()}
    assert [(audit[ts].row_count, audit[ts].total_power) for ts, _ in BLOCKS] == [(6, 4758), (10, 7167), (10, 7167)]
    assert all(audit[ts].consistency == "CONSISTENT" and audit[ts].verification == "CORRECT" for ts, _ in BLOCKS)
    first = blocks.first_n_per_block(blocks.power_of_aggr(rep), 3).where(F.col("TIMESTAMP") == BLOCKS[1][0]).collect()
    assert sorted(r.rn for r in first) == [1, 2, 3]


def test_instance_column(spark, tmp_path):
    for inst in ("alpha", "beta"):
        d = tmp_path / f"source_tables_{inst}"
        d.mkdir()
        (d / "table_1.csv").write_text(HEADER + "\n" + ",".join(row(1, 5, 10, f"TX-{inst}")) + "\n")
    rep = report_files.read_reports(spark, str(tmp_path), with_instance=True)
    assert {(r.TX_HASH, r.instance) for r in rep.collect()} == {("TX-alpha", "alpha"), ("TX-beta", "beta")}


def test_registry_dump_json_and_yaml(spark, tmp_path):
    doc = {
        "pagination": {"total": "3"},
        "reporters": [
            {"address": "addr1aaa", "metadata": {"commission_rate": "250000000000000000", "jailed": True,
                                                  "jailed_until": "2025-06-20T10:11:12.123456789Z",
                                                  "last_updated": "0001-01-01T00:00:00Z",
                                                  "min_tokens_required": "1000000", "moniker": "alpha"}, "power": "42"},
            {"address": "addr1bbb", "metadata": {"commission_rate": "50000000000000000", "jailed_until": "bad",
                                                  "last_updated": "2025-06-01T00:00:00Z", "min_tokens_required": "5",
                                                  "moniker": "beta"}},
            {"metadata": {"moniker": "no address"}},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    import yaml

    (tmp_path / "d.yaml").write_text(yaml.safe_dump(doc))
    for df in (documents.read_registry_json(spark, str(tmp_path / "d.json"), 7),
               documents.read_registry_yaml(spark, str(tmp_path / "d.yaml"), 7)):
        rows = {r.address: r for r in df.collect()}
        assert set(rows) == {"addr1aaa", "addr1bbb"}
        a, b = rows["addr1aaa"], rows["addr1bbb"]
        assert (a.power, a.jailed, a.last_updated, a.jailed_until) == (42, True, None, 1750414272123)
        assert (b.power, b.jailed, b.jailed_until, b.last_updated) == (0, False, None, 1748736000000)
        assert a.fetched_at == 7 and b.min_tokens_required == 5


def test_query_mappings_and_snapshots(spark, tmp_path):
    (tmp_path / "m1.json").write_text(json.dumps({"0xabc": "BTC/USD", "def": "ETH/USD"}))
    m = {r.query_id: r.name for r in documents.read_query_mappings(spark, str(tmp_path / "m1.json")).collect()}
    assert m == {"abc": "BTC/USD", "def": "ETH/USD"}
    snaps = [{"height": 4518890 - 5000 * i, "power": 8422 - i, "timestamp": 1750428423.5 - 30000 * i} for i in range(20)]
    (tmp_path / "s.json").write_text(json.dumps(snaps))
    df = documents.read_power_snapshots(spark, str(tmp_path / "s.json"))
    rows = sorted(df.collect(), key=lambda r: -r.height)
    assert len(rows) == 20 and rows[0].timestamp_ms == 1750428423500 and rows[-1].height == 4423890
