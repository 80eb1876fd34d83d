"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "vellum",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings this package is tuned for (AQE on, Arrow on, UTC).

    An active session is returned unchanged. Otherwise only settings that are not already
    given (``spark-submit`` / ``spark-defaults.conf`` reach the builder as a SparkConf) get
    the defaults below, so cluster settings such as the shuffle partition count are kept.
    """
    from pyspark import SparkConf

    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    given = SparkConf()
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.driver.memory": os.environ.get("VELLUM_DRIVER_MEMORY", "16g"),
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # One BLAS thread per Python worker: tasks already use every core.
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    builder = SparkSession.builder.appName(app)
    if master and not given.contains("spark.master"):
        builder = builder.master(master)
    if shuffle_partitions:  # asked for explicitly; else Spark's own default and AQE decide
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in defaults.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one already set on the SparkContext, else
    the one the cluster names in ``spark.checkpoint.dir``. There is no machine-local fallback."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_saved(*saved) -> None:
    """Deletes the files of frames that :func:`cut_lineage` made and nothing reads any more, and has the driver look for shuffles
    that went with them. Otherwise both stay until it happens to collect its garbage."""
    for df in saved:
        file, sc = df._jdf.queryExecution().logical().rdd().getCheckpointFile(), df.sparkSession.sparkContext
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if saved:
        sc._jvm.System.gc()


#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Caps the session's Arrow batches at ``BATCH_BYTES`` (Spark's own cap is 64 MB and 10,000
    rows), as a task holds several copies of a batch on both sides. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
