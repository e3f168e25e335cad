"""The driver imports the entry module from another working directory: Python workers must still
import the package (pandas-backed operators ship it with addPyFile)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ENTRY", E.entry(spark).count())
print("THROTTLE", E.queries()["snapshot_throttle"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_and_pandas_operator_from_other_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ENTRY 48" in out.stdout, out.stderr[-2000:]
    assert "THROTTLE" in out.stdout, out.stderr[-2000:]
