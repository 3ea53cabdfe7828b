"""Spark session helpers.

The library never assumes a particular cluster: it reads settings from the
active session and only fills in defaults that are unset (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings every job in this package relies on. Each one is set
# only when the session (cluster defaults, submit options or the job) has not
# set it already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Never plan a broadcast of a side whose size is unknown or large; sides
    # that are broadcast explicitly are bounded by construction (see joins).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Keep vector-buffer aggregates (ML Summarizer) hash-based when one task
    # holds many events before falling back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
}
# Launch-time settings, used only when this process starts the first session.
STATIC_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tremor",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session (or a new local one) with the package's
    defaults filled in where unset. Settings passed here are explicit and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if SparkSession.getActiveSession() is None:
        for key, value in STATIC_DEFAULTS.items():
            builder = builder.config(key, value)
    requested = {key.replace("__", "."): value for key, value in conf.items()}
    if shuffle_partitions:
        requested["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in requested.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    fill_unset(spark, DEFAULTS)
    ensure_checkpoint_dir(spark)
    return spark


def is_set(spark: SparkSession, key: str) -> bool:
    """True when the session holds an explicit value for ``key`` (from the
    cluster, the submit options or the job), not just Spark's built-in default."""
    try:
        return bool(spark._jsparkSession.sessionState().conf().contains(key))
    except Exception:  # noqa: BLE001 - no JVM handle: trust the launch conf
        return spark.sparkContext.getConf().contains(key)


def fill_unset(spark: SparkSession, settings: dict[str, str]) -> dict[str, str]:
    """Apply the runtime settings the session has not set; returns those applied."""
    applied = {}
    for key, value in settings.items():
        if not is_set(spark, key) and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
            applied[key] = value
    return applied


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside, for tables of wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without it a cluster job stops here. Only a local master gets a fresh
    scratch folder (tests, laptops).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tremor-ckpt-")
        os.makedirs(configured, exist_ok=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
