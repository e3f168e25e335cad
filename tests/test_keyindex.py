"""The key index against a set of all keys, and what a lookup reads."""

import random

from pyspark.sql import functions as F

from reportlake.keyindex import SLOT_KEYS, SMALL_SLOTS, KeyIndex, folders


def _rows(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "TX_HASH string, n int")


def test_runs_merges_and_retries(spark, tmp_path):
    r = random.Random(3)
    index, known, versions = KeyIndex(spark, str(tmp_path / "keys"), slot_keys=16, share=4), set(), set()
    assert index.is_empty()
    for run in range(8):
        batch = [f"k{r.randrange(400)}" for _ in range(40)]
        rows = _rows(spark, sorted(set(batch)))
        fresh = index.absent(rows, run)
        assert {x.TX_HASH for x in fresh.collect()} == set(batch) - known
        index.add(fresh, run)
        # a try after a failed one: what the step itself has stored doesn't count
        assert {x.TX_HASH for x in index.absent(rows, run).collect()} == set(batch) - known
        index.add(index.absent(rows, run), run)
        known |= set(batch)
        assert index.next_run() == run + 1
        versions |= set(folders(spark, str(tmp_path / "keys/slots")))
    assert len(versions) > 2
    index.prune(keep=1)
    assert len(folders(spark, str(tmp_path / "keys/slots"))) == 1
    again = index.absent(_rows(spark, [f"k{i}" for i in range(400)]))
    assert {x.TX_HASH for x in again.collect()} == {f"k{i}" for i in range(400)} - known


def test_lookup_reads_the_slots_of_its_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), slot_keys=64)
    index.add(spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("TX_HASH")), 0)
    newest, runs = index._state(None)
    assert runs == [] and 2**newest[1] >= 20_000 / 64
    rows = _rows(spark, ["new"] + [f"{i}" for i in range(2)]).persist()
    out = index.absent(rows)
    assert out.count() == 3
    scan = next(x for x in out._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in x and "slot" in x)
    named = scan.split("PartitionFilters: ")[1].split("]")[0]
    assert "slot" in named
    touched = rows.select(index._slot(newest[1]).alias("slot")).distinct()
    read = index._slots(newest).join(F.broadcast(touched), "slot", "left_semi").count()
    assert read <= 3 * 64 * 2 < 20_000


def test_null_keys_are_not_stored(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"))
    index.add(_rows(spark, [None, "a"]), 0)
    assert {x.TX_HASH for x in index.absent(_rows(spark, ["a", "b"])).collect()} == {"b"}


def test_small_slots_are_bounded(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), slot_keys=1)
    keys = spark.range(1_500).select(F.md5(F.col("id").cast("string")).alias("TX_HASH"))
    index.add(keys, 0)
    slots = [x for x in (tmp_path / "keys/slots").glob("v=*/slot=*")]
    assert 512 < len(slots) <= SMALL_SLOTS  # not 2048
    assert [index._bits(SLOT_KEYS * n) for n in (1 << 9, 1 << 10, 1 << 12)] == [10, 10, 12]  # beyond, SLOT_KEYS each
    rows = _rows(spark, ["new"]).select("TX_HASH").unionByName(keys).persist()
    assert [x.TX_HASH for x in index.absent(rows).collect()] == ["new"]
    usual = KeyIndex(spark, str(tmp_path / "usual"))
    assert [usual._bits(n) for n in (1, SLOT_KEYS, SLOT_KEYS + 1, SLOT_KEYS << 14)] == [0, 0, 1, 14]
