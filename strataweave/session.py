"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def build_session(app: str = "strataweave", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may do without the setting; on a cluster a machine's own folder would split what is written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: operators need a folder that all executors share")
        root = LOCAL_SCRATCH
    return f"{root.rstrip('/')}/strataweave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the application's scratch."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to scratch. Results that were not yet written elsewhere are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    Cuts lineage with committed files, so a lost executor costs a re-read and
    not a recomputation, and nothing lives in executor-local storage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
