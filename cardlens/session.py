"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE merges small shuffle partitions up to this size; at cluster scale
    # partitions are far larger, locally it keeps small tables on all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers run numpy block products; one BLAS thread each, since
    # every executor core already runs its own worker.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cardlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB), AQE coalesces the rest at run time.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CARDLENS_DRIVER_MEMORY", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when nothing is configured (a
    local test run) do we create a fresh folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    # a local session without the setting, as in tests: one process, so its own disk is shared by all of it
    local_dir = tempfile.mkdtemp(prefix="cardlens-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def size_shuffle_partitions(spark: SparkSession, shuffle_bytes: int, target_bytes: int = 256 << 20,
                            minimum: int | None = None) -> int:
    """Set ``spark.sql.shuffle.partitions`` so that each reducer gets about
    ``target_bytes`` of the largest expected shuffle (so it fits in executor
    memory without spilling); never fewer than the cluster's cores.  AQE then
    merges partitions that turn out small."""
    cores = spark.sparkContext.defaultParallelism
    n = max(minimum or cores, -(-int(shuffle_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n
