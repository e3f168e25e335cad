"""Which keys a stored table holds (K3, T2), looked up at a cost that follows the keys asked for.

Layout under the index's folder:

* ``runs/run=<n>``: the keys of one append;
* ``slots/v=<n>-bits=<b>/slot=<s>``: the keys of all runs up to n, dealt into 2^b slots by the top bits of their hash, about
  ``slot_keys`` keys each. Smaller ones than ``SLOT_KEYS`` are only made up to ``SMALL_SLOTS`` of them: each is a folder to
  write and to list, which takes longer than reading its keys.

A lookup reads the slots that hold the hash of a key asked for, and the runs since the last merge; these hold at most
``slot_keys`` keys or a ``share``-th of the merged ones before they are merged into a new version. So an append of b keys to a
table of any size reads about b slots, and the rewriting of slots costs a bounded number of writes per key.

Steps are numbered and write a folder of their own: a step that is tried again takes no notice of what its failed try (or a
later one) has left, and overwrites it. Superseded versions stay until :meth:`KeyIndex.prune`.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.operators.dedupe import KEY

SLOT_KEYS = 1 << 16
#: Slots of fewer than SLOT_KEYS keys that a version may have; above that a slot takes up to SLOT_KEYS before more are made.
SMALL_SLOTS = 1 << 10
SHARE = 8
#: Slots that a lookup names one by one; a batch that touches more reads all slots.
NAMED_SLOTS = 4096


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders (with a ``_SUCCESS`` file) in ``path``, ascending; none if there is no such path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and done(s))


class KeyIndex:
    """The keys (column ``key``, strings; rows without one are never stored) of a table, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = KEY, slot_keys: int = SLOT_KEYS, share: int = SHARE):
        self.spark, self.path, self.key, self.slot_keys, self.share = spark, path, key, slot_keys, share
        self.schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("slot", T.LongType())])
        self._listed: dict[tuple[int, int], DataFrame] = {}

    def _versions(self, before: int | None) -> list[tuple[int, int]]:
        """(n, bits) of the merged versions, oldest first."""
        found = [re.fullmatch(r"v=(\d+)-bits=(\d+)", x) for x in folders(self.spark, f"{self.path}/slots")]
        return [(int(m[1]), int(m[2])) for m in found if m and (before is None or int(m[1]) < before)]

    def _state(self, before: int | None) -> tuple[tuple[int, int] | None, list[int]]:
        """The newest merged version and the runs after it, of steps below ``before``."""
        versions = self._versions(before)
        newest = versions[-1] if versions else None
        runs = [int(x.removeprefix("run=")) for x in folders(self.spark, f"{self.path}/runs")]
        return newest, [r for r in runs if (newest is None or r > newest[0]) and (before is None or r < before)]

    def next_run(self) -> int:
        newest, runs = self._state(None)
        return max([newest[0] if newest else -1, *runs]) + 1

    def is_empty(self) -> bool:
        return self.next_run() == 0

    def _slot(self, bits: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(self.key), 64 - bits) if bits else F.lit(0).cast("long")

    def _bits(self, keys: int) -> int:
        """2^bits slots for so many keys."""
        bits, large = (max(0, math.ceil(math.log2(keys / n))) for n in (self.slot_keys, SLOT_KEYS))
        return min(bits, max(large, SMALL_SLOTS.bit_length() - 1))

    def _slots(self, version: tuple[int, int]) -> DataFrame:
        """The slots of a complete version, whose folders are listed once."""
        if version not in self._listed:
            path = f"{self.path}/slots/v={version[0]:012d}-bits={version[1]:02d}"
            self._listed[version] = self.spark.read.schema(self.schema).parquet(path)
        return self._listed[version]

    def _runs(self, runs: list[int]) -> DataFrame:
        paths = [f"{self.path}/runs/run={r:012d}" for r in runs]
        return self.spark.read.schema(T.StructType(self.schema.fields[:1])).parquet(*paths) if paths else self.spark.createDataFrame([], T.StructType(self.schema.fields[:1]))

    def absent(self, rows: DataFrame, run: int | None = None) -> DataFrame:
        """The rows of ``rows`` (a stored or persisted frame) whose key no step below ``run`` has stored."""
        newest, runs = self._state(run)
        out = rows
        if newest:
            slot = self._slot(newest[1])
            touched = [r[0] for r in rows.select(slot.alias("slot")).distinct().limit(NAMED_SLOTS + 1).collect()]
            slots = self._slots(newest)
            if len(touched) <= NAMED_SLOTS:
                slots = slots.where(F.col("slot").isin(touched))
            out = out.join(slots.select(self.key), self.key, "left_anti")
        return out.join(self._runs(runs), self.key, "left_anti") if runs else out

    def add(self, keys: DataFrame, run: int) -> None:
        """Stores the keys of step ``run``, and merges the runs if they have grown large."""
        keys.select(self.key).where(F.col(self.key).isNotNull()).write.mode("overwrite").parquet(f"{self.path}/runs/run={run:012d}")
        newest, runs = self._state(run + 1)
        merged = self._slots(newest).count() if newest else 0  # from the files' footers
        fresh = self._runs(runs).count()
        if fresh > max(self.slot_keys, merged // self.share):
            old = self._runs(runs) if newest is None else self._runs(runs).unionByName(self._slots(newest).select(self.key))
            bits = self._bits(merged + fresh)
            slotted = old.withColumn("slot", self._slot(bits))
            slotted = slotted.repartition("slot").sortWithinPartitions("slot", self.key)
            slotted.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/slots/v={run:012d}-bits={bits:02d}")

    def prune(self, keep: int = 2) -> None:
        """Deletes merged versions but the newest ``keep``, and the runs that the oldest kept one holds. Not while a step
        or a reader of an older version is under way."""
        versions = self._versions(None)
        names = [f"slots/v={n:012d}-bits={b:02d}" for n, b in versions[:-keep]]
        if versions[:-keep]:
            runs = [int(x.removeprefix("run=")) for x in folders(self.spark, f"{self.path}/runs")]
            names += [f"runs/run={r:012d}" for r in runs if r <= versions[-keep][0]]
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
