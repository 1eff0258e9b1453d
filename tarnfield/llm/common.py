"""Helpers that the corpus operators share: durable intermediate tables, text defaults, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HEAVY_PARTS of all rows, and more than LIGHT, is heavy; there can be at most HEAVY_PARTS of them.
HEAVY_PARTS = 32_768
LIGHT = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarnfield-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # what this write shuffled is not needed again
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once all that was made of them is staged itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, everything else untouched (``lower`` would also change other alphabets)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of the id written as decimal text, unsigned."""
    return F.crc32(F.encode((F.col(column) if isinstance(column, str) else column).cast("string"), "UTF-8"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join per-key ``groups`` (one row per key, with the key's row count ``size``) onto ``rows``.

    Keys with more than ``total / HEAVY_PARTS`` rows and more than LIGHT number at most HEAVY_PARTS, so these few go out by broadcast;
    their rows get a salt, which spreads them over all tasks of the sort-merge join that serves every other key.
    """
    most = max(total // HEAVY_PARTS, LIGHT)
    heavy = groups.where(F.col(size) > most).withColumn("_heavy", F.lit(True))
    values = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(heavy.select(key, "_heavy", *[F.col(c).alias(f"_h_{c}") for c in values])), key, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_heavy"), F.lit(1) + F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(4096))).otherwise(F.lit(0)))
    # a salt that Catalyst cannot tell is 0: it takes literals out of join keys
    rest = groups.where(F.col(size) <= most).withColumn("_salt", F.least(F.col(size), F.lit(0)).cast("bigint"))
    joined = marked.join(rest.hint("merge"), [key, "_salt"], "left")
    out = [F.coalesce(F.col(f"_h_{c}"), F.col(c)).alias(c) for c in values]
    return joined.select(*rows.columns, *out)
