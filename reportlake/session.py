"""Session helpers for tests, the bench and scripts.

Library operators never touch the session configuration; only these helpers do, and only when a
setting is still unset (a cluster's own values always win).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for a local session; on a cluster the submitting job owns these settings.
_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "reportlake") -> SparkSession:
    """A ``local[cpus]`` session with UTC, AQE on and the UI off."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("REPORTLAKE_DRIVER_MEMORY", "8g"))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is; unset, it is an error there. Only in a
    local run without it a fresh scratch folder is created and registered with the context.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not fallback and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="reportlake-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``reportlake`` importable in Python workers (as ``--py-files`` would), once per application.

    Needed by the operators that run Python inside tasks (``applyInPandas``/``mapInPandas``): their
    functions are pickled by reference to this package.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import reportlake

    pkg = os.path.dirname(os.path.abspath(reportlake.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="reportlake-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
