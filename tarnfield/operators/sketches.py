"""Mergeable states of columns: moments, quantile sketches and frequent values of batches, merged in any order.

Quantiles come from KLL sketches, which Spark's own aggregates build and merge: with ``k`` = 200 the rank of an answer is
within 1.65 % of the one asked for, at 99 % confidence, whatever the number of batches. Frequent values are Misra-Gries
summaries of ``capacity`` values: a count is never too high, and too low by ``error`` at most, which all merges together
keep under the number of rows over ``capacity`` + 1. A column of no more different values has exact counts.

Edge cases: nulls do not count; a column without values has no quantiles; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.functions import safe_ratio

#: Rank error of KLL sketches with k = 200, as a share.
RANK_ERROR = 0.0165


def numeric_state(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), k: int = 200) -> DataFrame:
    """(keys, feature, n, total, squares, min_value, max_value, sketch) of a batch, from one aggregate; squares are of deviations from the mean."""
    aggs = []
    for j, c in enumerate(cols):
        x = F.col(c).cast("double")
        spread = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), spread.alias("squares"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch")).alias(f"_{j}"))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*[f"_{j}" for j in range(len(cols))])))


def merge_numeric(*states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States of any number of batches as one."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    n = F.sum("n")
    # squares about the mean of all: those within the batches, and those of the batches' means
    between = F.sum(F.when(F.col("n") > 0, F.col("total") * F.col("total") / F.col("n"))) - F.sum("total") * F.sum("total") / F.nullif(n, F.lit(0))
    return every.groupBy(*keys, "feature").agg(
        n.alias("n"), F.sum("total").alias("total"), (F.sum("squares") + F.coalesce(F.greatest(between, F.lit(0.0)), F.lit(0.0))).alias("squares"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def numeric_from_state(state: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, min, max, mean, std (0 for one value), the quantiles ``at`` (pNN), iqr where both quartiles are asked for, cv."""
    known = F.col("n") > 0
    names = {p: f"p{p * 100:g}".replace(".", "_") for p in at}
    out = state.withColumns({
        "mean_value": safe_ratio("total", "n"), "std_value": F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).when(F.col("n") == 1, F.lit(0.0)),
        **{name: F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))) for p, name in names.items()},
    })
    if {0.25, 0.75} <= set(at):
        out = out.withColumn("iqr", F.col("p75") - F.col("p25"))
    return out.withColumn("cv", safe_ratio("std_value", "mean_value")).drop("total", "squares", "sketch")


def _reduced(counts: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` largest counts of each feature, less the next one, which joins its error."""
    order = W.partitionBy("feature").orderBy(F.desc("n"), "value")
    top = counts.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= capacity + 1)
    whole = W.partitionBy("feature")
    cut = F.coalesce(F.max(F.when(F.col("_nth") == capacity + 1, F.col("n"))).over(whole), F.lit(0))
    kept = top.withColumns({"_cut": cut}).withColumns({"n": F.col("n") - F.col("_cut"), "error": F.col("error") + F.col("_cut")})
    # the first stays though nothing is left of it: it has the error
    return kept.where((F.col("_nth") <= capacity) & ((F.col("n") > 0) | (F.col("_nth") == 1))).select("feature", "value", "n", "error", "rows")


def frequent_state(df: DataFrame, cols: Sequence[str], capacity: int = 256) -> DataFrame:
    """(feature, value, n, error, rows): the frequent values of a batch as text; rows counts those of the feature that are not null."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]))).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("feature").agg(F.sum("n").alias("rows"))
    return _reduced(counts.join(F.broadcast(rows), "feature").withColumn("error", F.lit(0).cast("bigint")), capacity)


def merge_frequent(*states: DataFrame, capacity: int = 256) -> DataFrame:
    """States of any number of batches as one: counts and errors add up, and the largest stay."""
    every = None
    for k, s in enumerate(states):
        part = s.withColumn("_batch", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return merge_frequent_batches(every, capacity)


def merge_frequent_batches(every: DataFrame, capacity: int = 256) -> DataFrame:
    """``merge_frequent`` of states in one table, told apart by ``_batch``."""
    totals = every.groupBy("feature", "_batch").agg(F.max("error").alias("error"), F.max("rows").alias("rows")).groupBy("feature").agg(F.sum("error").alias("error"), F.sum("rows").alias("rows"))
    counts = every.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    return _reduced(counts.join(F.broadcast(totals), "feature"), capacity)


def frequent_values(state: DataFrame, least: float = 0.0) -> DataFrame:
    """(feature, value, at_least, at_most, share, is_dominant): values that may have a share of ``least`` of the feature's rows or more; of several dominant ones the first."""
    first = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "value")) == 1
    out = state.select("feature", "value", F.col("n").alias("at_least"), (F.col("n") + F.col("error")).alias("at_most"), safe_ratio("n", "rows").alias("share"), first.alias("is_dominant"), "rows")
    return out.where(F.col("at_most") >= F.lit(least) * F.col("rows")).drop("rows")
