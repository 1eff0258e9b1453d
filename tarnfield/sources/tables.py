"""Tables: scans with a contract, schema alignment, sinks, idempotent appends, logs and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.functions import rename_keys


class ContractError(ValueError):
    """A table lacks a column, repeats a key or holds no usable row."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; an error that names up to five repeated keys if there are any. Runs one aggregate."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"repeated keys {list(keys)}: " + "; ".join(str(tuple(r)[:-1]) for r in twice))
    return df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """A Parquet table that must have ``columns`` and at most one row for each value of ``keys``."""
    df = require_columns(spark.read.parquet(path), [*columns, *keys])
    return require_unique(df, keys) if keys else df


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: missing ones null, others dropped, values cast or null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def write_tables(tables: Mapping[str, DataFrame], folder: str, schemas: Mapping[str, T.StructType] | None = None) -> None:
    """Full rebuild: each table replaces what was there; an empty one is written with its types."""
    for name, df in tables.items():
        (align(df, schemas[name]) if schemas and name in schemas else df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def append_new(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is not in ``existing``: what an append that may be repeated writes."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns)


def read_history(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """A log of searches (JSON lines or a list): location_id, filters with renamed keys, used_at, results, new_clans."""
    schema = "location_id string, filters map<string,bigint>, used_at string, results bigint, new_clans bigint"
    log = spark.read.schema(schema).option("multiLine", True).json(path)
    return log.withColumn("filters", rename_keys("filters", names))


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A long table of metrics as JSON."""
    report.write.mode("overwrite").json(path)
