"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above this size; a stage that would hold one is better run
# as separate projections, which are cut into small methods.
# A batch of texts is copied several times in a Python worker, so batches are held small in bytes.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on; instants in the silver tables are UTC."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "oddslake", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None, tidy: bool = False) -> DataFrame:
    """Write a table once and read it back: later plans start from the files, not from its lineage.

    Without a path the table goes below :func:`shared_dir`. This runs a job. With ``tidy`` its shuffle files go as
    soon as the table is written, and not when the driver next collects its garbage, and the files are packed closer.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer, before = df.write.mode("overwrite"), spark.conf.get(_CLEANUP)
    if tidy:
        writer = writer.option("compression", "zstd")
        spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent, as in a bare local test.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
