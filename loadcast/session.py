"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "loadcast",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with ANSI on, AQE (coalesce + skew join) on, UTC, UI off.

    On a cluster ``master`` is left to spark-submit; ``shuffle_partitions`` should then be sized
    so a post-shuffle partition is ~128-256 MB (AQE coalesces small ones at run time).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # checkpoint files of DataFrames that went out of scope are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent on a local master (tests) a private folder is created and
    recorded in the session so every later caller sees the same one; on a cluster a missing
    setting is an error, because a folder of one machine would lose data.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured and not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set: a cluster needs a shared folder")
    if not configured:
        configured = tempfile.mkdtemp(prefix="loadcast-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"


def store_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written by columns under the shared checkpoint folder, where it takes a fraction of
    a checkpoint's bytes, and its folder, which the caller deletes."""
    path = scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    # small row groups: a file of many rows is read by several tasks
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release_disk(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and checkpoints of tables that went out of scope when the
    driver's garbage is collected. A driver with memory to spare may wait with that until the
    disks are full: this asks for it now."""
    gc.collect()
    spark._jvm.System.gc()
