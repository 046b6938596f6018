"""SparkSession helpers.

The library never assumes it owns the session: the functions here only add
defaults that are missing, so a cluster's own settings (shuffle partitions,
checkpoint directory, time zone) win.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app_name: str = "helpdesk-lake",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the bench: UTC, AQE on, UI off, Arrow on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Read from ``spark.checkpoint.dir``. A single-process session without one
    (tests) gets a fresh scratch folder; on a cluster it must be set, since a
    folder of the driver's machine is not seen by the executors.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the whole cluster shares")
    local = tempfile.mkdtemp(prefix="helpdesk-lake-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: several
    readers then share one computation, and a lost executor loses no part."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan whose files give fewer tasks than the session has cores, dealt
    out by ``key``; any larger scan as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


FINE = "spark.sql.adaptive.coalescePartitions.minPartitionNum"


@contextmanager
def fine_tasks(spark: SparkSession) -> Iterator[None]:
    """For a job whose narrow rows cost much each: AQE would join their
    partitions down to a task a core, so that the last one runs alone. Unless
    the session says otherwise, as many are kept as shuffles have, of 1 MB at least."""
    if spark.conf.get(FINE, None) is not None:
        yield
        return
    spark.conf.set(FINE, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.unset(FINE)


MAX_SHUFFLE_PARTITIONS = 20_000


def scale_conf(input_bytes: int, executor_cores: int = 4, executors: int = 1000,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a run over ``input_bytes`` of Parquet input.

    * scan splits of ``target_partition_bytes`` (256 MiB) keep a task's
      decoded batch well inside an executor core's memory share;
    * the initial shuffle partition count is sized so that a shuffle moving
      as much as the input lands near the target per partition, at least two
      waves of the cluster's cores; AQE then coalesces small partitions to
      the advisory size and splits skewed ones (a partition 5x the median
      and over 1 GiB);
    * joins become broadcasts only below 64 MiB as measured at run time.
    """
    cores = executor_cores * executors
    # map tasks times partitions is the number of shuffle blocks: keep it within reason
    partitions = min(MAX_SHUFFLE_PARTITIONS, max(2 * cores, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_missing(spark: SparkSession, conf: dict[str, str]) -> list[str]:
    """Set only the keys absent from the launch configuration (the cluster's
    spark-defaults and submit flags win); returns the keys that were set."""
    launched = spark.sparkContext.getConf()
    applied = []
    for key, value in conf.items():
        if not launched.contains(key):
            spark.conf.set(key, value)
            applied.append(key)
    return applied
