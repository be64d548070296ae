"""Session construction and lineage cutting.

On a cluster the session already exists and carries ``spark.checkpoint.dir`` pointing at a
shared folder; we only read it.  Tests and the bench build a local session and set a
scratch folder themselves when (and only when) none is configured.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # Text tables are one parquet file each; small splits give every core work, before a
    # shuffle and after it.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.maxPartitionBytes": str(8 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "groundeval", **conf) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    for k, v in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where it is unset a local session
    (tests, bench) gets a scratch folder; on a cluster that is an error, because executors do
    not see each other's disks."""
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        configured = None
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="groundeval-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    try:  # core configs may be read-only at runtime; the context setting above is what counts
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001
        pass
    return local


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss, unlike localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
