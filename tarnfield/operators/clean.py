"""Filling, imputing and de-duplicating rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.functions import finite, number, quantile
from tarnfield.operators.order import exact_quantiles


def valid_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key columns are neither null nor empty."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return df


def zero_fill(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Every other column as a double, 0 where it is missing or no number."""
    return df.select(*[F.col(c) if c in exclude else F.coalesce(number(c), F.lit(0.0)).alias(c) for c in df.columns])


def clean_infinite(df: DataFrame, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    return df.withColumns({c: finite(c, fill) for c in cols})


def typed_fill(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Nulls become 0, false or ``unknown`` by the column's type; ``exclude`` stays as it is."""

    def filled(f: T.StructField) -> Column:
        if f.name in exclude:
            return F.col(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return F.coalesce(F.col(f.name), F.lit(False)).alias(f.name)
        return F.coalesce(F.col(f.name).cast("string"), F.lit("unknown")).alias(f.name)

    return df.select(*[filled(f) for f in df.schema])


def medians(df: DataFrame, cols: Sequence[str], approximate: int | None = None) -> dict[str, float | None]:
    """The median of each column, null for a column without values."""
    if not cols:
        return {}
    if approximate is None:
        return {c: q and q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    return df.agg(*[quantile(c, 0.5, approximate).alias(c) for c in cols]).first().asDict()


def median_impute(df: DataFrame, cols: Sequence[str], approximate: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(nulls of ``cols`` filled with medians, all-null columns dropped; the medians)."""
    found = medians(df, cols, approximate)
    known = {c: m for c, m in found.items() if m is not None}
    out = df.drop(*[c for c in cols if c not in known])
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in known.items()}), known


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order_by``; null key parts form groups like any value."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))).where("_nth = 1").drop("_nth")
