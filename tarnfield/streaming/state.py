"""A table of mergeable feature states, kept up to date from a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import sketches
from tarnfield.operators.features import finalize_state, merge_states, partial_state


def state_writer(key: str, level: str, max_level: str, path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the states of a batch go to a partition of their batch id, so that a batch that is repeated replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_state(batch, key, level, max_level).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_features(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """Features of all batches so far."""
    return finalize_state(merge_states(spark.read.parquet(path).drop("batch"), key=key), key, prefix)


def compact(spark: SparkSession, path: str, target: str, key: str) -> None:
    """All states of ``path`` as one batch in ``target``: what keeps their number from growing with the batches."""
    merge_states(spark.read.parquet(path).drop("batch"), key=key).write.mode("overwrite").parquet(f"{target}/batch=-1")


def sketch_writer(path: str, numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str] = (), capacity: int = 256) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the sketches of a batch, numeric ones by ``keys``, go to partitions of its id, so that a batch that is repeated replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sketches.numeric_state(batch, numeric, keys).write.mode("overwrite").parquet(f"{path}/numeric/batch={batch_id}")
        sketches.frequent_state(batch, categorical, capacity).write.mode("overwrite").parquet(f"{path}/frequent/batch={batch_id}")

    return write


def read_sketches(spark: SparkSession, path: str, keys: Sequence[str] = (), capacity: int = 256) -> tuple[DataFrame, DataFrame]:
    """(numeric, frequent) states of all batches so far, for ``sketches.numeric_from_state`` and ``sketches.frequent_values``."""
    numeric = sketches.merge_numeric(spark.read.parquet(f"{path}/numeric").drop("batch"), keys=keys)
    frequent = spark.read.parquet(f"{path}/frequent")
    return numeric, sketches.merge_frequent_batches(frequent.withColumnRenamed("batch", "_batch"), capacity)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window, streamed or not; rows later than ``late`` are left to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
