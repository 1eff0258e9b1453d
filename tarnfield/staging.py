"""Tables written to the folder that all executors share, where a result serves several later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarnfield-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of an execution when it ends, not when the driver's heap happens to be collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: it is made once, and a lost executor takes nothing with it. The files stay until the folder is cleared; what was shuffled to make them goes at once."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{fresh_name(name)}", spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)
