"""Transforms of a numeric matrix before clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions import quantile
from tarnfield.operators.order import exact_quantiles


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a column without spread becomes 0."""
    row = df.agg(*[F.struct(F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(row[c][0])) / F.lit(row[c][1] or 1.0) for c in cols})


def robust_scale(df: DataFrame, cols: Sequence[str], approximate: int | None = None) -> DataFrame:
    """(x - median) / interquartile range; a column without range is only centred."""
    at = [0.25, 0.5, 0.75]
    row = exact_quantiles(df, cols, at) if approximate is None else df.agg(*[quantile(c, at, approximate).alias(c) for c in cols]).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(row[c][1])) / F.lit((row[c][2] - row[c][0]) or 1.0) for c in cols})


def pca_variance(df: DataFrame, cols: Sequence[str], components: int = 20) -> DataFrame:
    """(component, explained, cumulative) of the standard-scaled columns; component from 1."""
    k = min(components, len(cols))
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(standard_scale(df, cols)).select("_v")
    shares = [float(x) for x in PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors).explainedVariance]
    total, rows = 0.0, []
    for n, x in enumerate(shares, 1):
        total += x
        rows.append((n, x, total))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def components_needed(variance: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: the least number of components whose variance reaches ``share``."""
    return variance.where(F.col("cumulative") >= share).agg(F.min("component").alias("n_components"))


def pca_project(df: DataFrame, key: str, cols: Sequence[str], k: int = 2) -> DataFrame:
    """(key, pc1, ..., pck) of the standard-scaled columns; the sign of a component is arbitrary."""
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(standard_scale(df, cols)).select(key, "_v")
    p = vector_to_array(F.col("_p"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors).select(key, *[p[i].alias(f"pc{i + 1}") for i in range(k)])


def distance_outliers(df: DataFrame, key: str, cols: Sequence[str], share: float = 0.99) -> DataFrame:
    """(key, distance) of rows whose robust-scaled distance from the centroid is above that quantile of all distances."""
    scaled = robust_scale(df, cols)
    centre = scaled.agg(*[F.avg(c).alias(c) for c in cols]).first()
    far = scaled.select(key, F.sqrt(sum((F.pow(F.col(c) - F.lit(centre[c]), 2) for c in cols[1:]), F.pow(F.col(cols[0]) - F.lit(centre[cols[0]]), 2))).alias("distance"))
    (limit,) = exact_quantiles(far, ["distance"], [share], many=True)["distance"] or [None]
    return far.where(F.col("distance") > F.lit(limit))
