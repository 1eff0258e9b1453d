"""Choosing columns and joining without collisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.functions import quantile
from tarnfield.operators.clean import keep_first, median_impute
from tarnfield.operators.order import exact_quantiles
from tarnfield.sources.tables import ContractError, require_columns
from tarnfield.staging import staged


def whitelist(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Those of ``cols`` that are there, in their order."""
    return df.select(*[c for c in cols if c in df.columns])


def is_banned(column: str, banned: Sequence[str], strict: bool = False) -> bool:
    """The column is a banned one or starts with ``<banned>_``; strict: also ``..._<banned>``."""
    return any(column == b or column.startswith(f"{b}_") or (strict and column.endswith(f"_{b}")) for b in banned)


def ban(df: DataFrame, banned: Sequence[str], keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Without banned columns; ``keep`` stays. None of ``banned`` is left but those kept."""
    return df.select(*[c for c in df.columns if c in keep or not is_banned(c, banned, strict)])


def exclude(df: DataFrame, names: Sequence[str] = (), substrings: Sequence[str] = ()) -> DataFrame:
    """Without columns of these names or with one of the substrings in theirs, case ignored."""
    return df.select(*[c for c in df.columns if c not in names and not any(s.lower() in c.lower() for s in substrings)])


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def key_column(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key as a string; nulls stay null."""
    return require_columns(df, [key]).withColumn(key, F.col(key).cast("string"))


def join_keep_left(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join; where both have a column, the left one stays."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in on]), list(on), how)


def join_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """Join; where both have a column, the right one gets ``suffix``."""
    return left.join(right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}), list(on), how)


def require_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself; an error if it has one of ``columns``."""
    if found := [c for c in columns if c in df.columns]:
        raise ContractError(f"columns that must not be there: {', '.join(found)}")
    return df


def column_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column_name, side, n_values) for the columns that only one of two tables has, with their values that are not null."""

    def only(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        cols = [c for c in df.columns if c not in other.columns]
        if not cols:
            return df.sparkSession.createDataFrame([], "column_name string, side string, n_values bigint")
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(side).alias("side"), F.col(c).alias("n_values")) for c in cols])))

    return only(left, right, "left").unionByName(only(right, left, "right"))


def high_cardinality(df: DataFrame, cols: Sequence[str], share: float = 0.9) -> list[str]:
    """Columns with more different values than ``share`` of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > share * row["_n"]]


def clustering_matrix(df: DataFrame, key: str, cols: Sequence[str], names: Sequence[str] = (), substrings: Sequence[str] = (), approximate: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key and the numeric ones of ``cols``, median-imputed; one row that reports the choice)."""
    available = [c for c in whitelist(exclude(df, names, substrings), cols).columns if c != key]
    numeric = [c for c in available if c in numeric_columns(df)]
    if not numeric:
        raise ContractError("no numeric column to cluster by")
    # of rows with one key that with the smallest values stays; written once, as the medians read it several times
    base = keyed = staged(keep_first(df.select(key, *numeric), [key], numeric), "clustering")
    matrix, found = median_impute(keyed, numeric, approximate)
    n = base.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in numeric]).select(
        "n_rows", F.lit(len(cols)).alias("n_requested"), F.lit(len(available)).alias("n_available"), F.lit(len(cols) - len(available)).alias("n_missing"),
        F.lit(len(available) - len(numeric)).alias("n_non_numeric"), F.lit(len(numeric) - len(found)).alias("n_all_null"),
        sum((F.col(f"m_{c}") for c in numeric), F.lit(0).cast("bigint")).alias("n_imputed"),
    )
    return matrix, n


def cutoffs(df: DataFrame, c: str, at: Sequence[float] = (1 / 3, 2 / 3), approximate: int | None = None) -> list[float]:
    """Quantiles of a target, as class thresholds."""
    return exact_quantiles(df, [c], at)[c] if approximate is None else list(df.agg(quantile(c, list(at), approximate)).first()[0])
