"""Session helpers: builder defaults and what Python workers need."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings this package relies on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("cubeframe")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    On a cluster the package is installed on every node or shipped with ``--py-files``; the
    path below then simply adds nothing. Arrow batches of the default 10,000 rows hold tens of MB
    of long texts in each worker; unless set otherwise they get 1,000.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder, as in tests; a cluster without
    it is an error, as a machine's own folder is not seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not (made := getattr(spark.sparkContext, "_cubeframe_shared", None)):
        made = spark.sparkContext._cubeframe_shared = f"file://{tempfile.mkdtemp(prefix='cubeframe-')}"
    return made
