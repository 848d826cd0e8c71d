"""SparkSession construction and table loading.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir``
only fills in ``spark.checkpoint.dir`` when nobody configured it (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "mutscope") -> SparkSession:
    """A local session for tests and measurements, with a scratch checkpoint folder."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a local
    session gets a scratch folder (one machine reads and writes it); a
    cluster's executors could not read such a folder, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _SCRATCH:
        _SCRATCH[key] = tempfile.mkdtemp(prefix="mutscope-ckpt-", dir=os.environ.get("TMPDIR") or "/tmp")
    return _SCRATCH[key]


def stage_folder(spark: SparkSession) -> str:
    """This application's folder of written intermediates."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/mutscope-{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's written intermediates.

    A returned DataFrame reads them, so only its consumer knows when they are
    no longer needed: call this after the results have been written.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
