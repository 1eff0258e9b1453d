"""Statistics from the counts of different values, which one scan gives for all columns and classes at once.

A table of counts (key, feature, value, text, n) holds each column's different values: ``value`` for numbers, ``text``
for others, both null for what is missing. Counts of batches add up, so the table is a state that merges. Everything below
reads that table alone, whatever the number of statistics; results and names are those of ``stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.functions import safe_ratio
from tarnfield.operators.order import average_ranks, picked_quantiles, running_total


def counted(df: DataFrame, numeric: Sequence[str], others: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """The counts of ``df``; with ``key``, for each value of that column (``key``; null is one)."""
    fact = lambda c, value, text: F.struct(F.lit(c).alias("feature"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    none = F.lit(None)
    facts = F.array(*[fact(c, F.col(c), none) for c in numeric], *[fact(c, none, F.col(c)) for c in others])
    long = df.select((F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.inline(facts))
    return long.groupBy("key", "feature", "value", "text").agg(F.count(F.lit(1)).alias("n"))


def without_key(counts: DataFrame) -> DataFrame:
    """Counts of all keys together."""
    return counts.groupBy("feature", "value", "text").agg(F.sum("n").alias("n"))


def _numbers(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("value").isNotNull())


def edges(counts: DataFrame) -> DataFrame:
    """(feature, cuts) that part each feature's different values into stretches, as ``order.cuts`` does those of a column."""
    n = max(2, min(1000, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = F.array(*[F.lit(k / n) for k in range(1, n)])
    return _numbers(counts).groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", at, F.lit(10 * n))).alias("cuts"))


def quantiles(counts: DataFrame, at: Sequence[float], keyed: bool = False) -> DataFrame:
    """((key,) feature, q): exact quantiles with linear interpolation."""
    numbers = _numbers(counts).withColumn("_key", F.struct("key")) if keyed else _numbers(counts)
    run = running_total(numbers, edges(counts), "n", keys=["_key"] if keyed else [])
    found = picked_quantiles(run, ["_key", "feature"] if keyed else ["feature"], at)
    return found.select(F.col("_key.key").alias("key"), "feature", "q") if keyed else found


def moments(counts: DataFrame) -> DataFrame:
    """feature, n_rows, n, n_missing, n_zero, n_distinct, mode_n, min_value, max_value, mean_value and the central sums m2, m3, m4."""
    there = F.col("value").isNotNull() | F.col("text").isNotNull()
    x, n = F.col("value"), F.col("n")
    sums = counts.groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("n_zero"), F.count_if(there).alias("n_distinct"),
        F.max("n").alias("mode_n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean_value"),
    )
    off = x - F.col("mean_value")
    central = _numbers(counts).join(F.broadcast(sums.select("feature", "mean_value")), "feature").groupBy("feature").agg(*[F.sum(F.pow(off, F.lit(float(k))) * n).alias(f"m{k}") for k in (2, 3, 4)])
    return sums.join(central, "feature", "left").withColumn("n_missing", F.col("n_rows") - F.col("n"))


def _deviation() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


def _shape() -> dict[str, Column]:
    n = F.col("n").cast("double")
    varied = F.nullif(F.col("m2"), F.lit(0.0))
    skew, kurt = F.sqrt(n) * F.col("m3") / F.pow(varied, F.lit(1.5)), n * F.col("m4") / (varied * varied) - 3
    return {
        "skew": F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))), "kurt": F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * kurt + 6)),
        "skew_pop": skew, "kurt_pop": kurt,
    }


def numeric_summary(counts: DataFrame) -> DataFrame:
    """As ``stats.numeric_summary``."""
    at = [0.25, 0.5, 0.75, 0.95]
    out = moments(_numbers(counts)).join(quantiles(counts, at), "feature").withColumn("std_value", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(_deviation()))
    out = out.withColumns({f"p{p}": F.get("q", F.lit(k)) for k, p in enumerate((25, 50, 75, 95))})
    names = ["feature", "n", "min_value", "max_value", "mean_value", "std_value", "p25", "p50", "p75", "p95"]
    return out.select(*names, (F.col("p75") - F.col("p25")).alias("iqr"), safe_ratio("std_value", "mean_value").alias("cv"))


def describe(counts: DataFrame, tails: Sequence[float] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """As ``stats.describe``."""
    at = [0.25, 0.5, 0.75, *tails]
    out = moments(_numbers(counts)).join(quantiles(counts, at), "feature")
    return out.select("feature", "n", "mean_value", _deviation().alias("std_value"), "min_value", "max_value", *[F.get("q", F.lit(k)).alias(f"p{p * 100:g}".replace(".", "_")) for k, p in enumerate(at)])


def shape(counts: DataFrame) -> DataFrame:
    """As ``stats.shape``."""
    return moments(_numbers(counts)).select("feature", *[x.alias(k) for k, x in _shape().items()])


def zero_missing_profile(counts: DataFrame) -> DataFrame:
    """As ``stats.zero_missing_profile``."""
    out = moments(counts).withColumn("skew", _shape()["skew"])
    advice = F.when(F.abs("skew") > 1.0, "strong").when(F.abs("skew") > 0.5, "moderate").otherwise("none")
    return out.select("feature", (100 * safe_ratio("n_zero", "n_rows")).alias("zero_pct"), (100 * safe_ratio("n_missing", "n_rows")).alias("missing_pct"), "skew", advice.alias("log_advice"))


def missing(counts: DataFrame) -> DataFrame:
    """As ``stats.missing``."""
    return moments(counts).select("feature", "n_missing", (100 * safe_ratio("n_missing", "n_rows")).alias("missing_pct"))


def cardinality(counts: DataFrame, share: float = 0.9) -> DataFrame:
    """As ``stats.cardinality``."""
    return moments(counts).select("feature", "n_distinct", (F.col("n_distinct") > share * F.col("n_rows")).alias("high_cardinality"))


def mode_frequency(counts: DataFrame, constant: float = 0.95, low_variance: float = 1e-6) -> DataFrame:
    """As ``stats.mode_frequency``, nulls counted."""
    variance = F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))
    out = moments(counts).withColumn("mode_share", safe_ratio("mode_n", "n_rows"))
    return out.select("feature", "mode_n", "mode_share", (F.col("mode_share") >= constant).alias("nearly_constant"), (variance == 0).alias("zero_variance"), (variance < low_variance).alias("low_variance"))


def iqr_outliers(counts: DataFrame, factor: float = 1.5) -> DataFrame:
    """As ``stats.iqr_outliers``."""
    q = [F.get("q", F.lit(k)) for k in (0, 1)]
    bounds = quantiles(counts, [0.25, 0.75]).select("feature", (q[0] - factor * (q[1] - q[0])).alias("lower_bound"), (q[1] + factor * (q[1] - q[0])).alias("upper_bound"))
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    both = _numbers(counts).join(F.broadcast(bounds), "feature").groupBy("feature", "lower_bound", "upper_bound").agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_outliers"), F.sum("n").alias("_n"))
    return both.select("feature", "lower_bound", "upper_bound", "n_outliers", (100 * safe_ratio("n_outliers", "_n")).alias("outlier_pct"))


def histograms(counts: DataFrame, bins: int = 20) -> DataFrame:
    """(feature, bucket, n) over equal widths from minimum to maximum of each feature."""
    ends = _numbers(counts).groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    share = (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bucket = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return _numbers(counts).join(F.broadcast(ends), "feature").groupBy("feature", bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def distribution(counts: DataFrame, c: str, rare: float = 0.01) -> DataFrame:
    """As ``stats.categorical_distribution`` of one text column."""
    own = counts.where((F.col("feature") == c) & F.col("text").isNotNull()).select(F.col("text").alias("value"), "n")
    total = own.agg(F.sum("n").alias("_total"), F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("_top"))
    out = own.crossJoin(F.broadcast(total)).withColumn("share", safe_ratio("n", "_total"))
    return out.select("value", "n", "share", (F.col("value") == F.col("_top")).alias("is_dominant"), (F.col("share") < rare).alias("is_rare"))


def class_balance(counts: DataFrame, c: str, high: float = 60, moderate: float = 45) -> DataFrame:
    """As ``stats.class_balance`` of one text column."""
    own = counts.where((F.col("feature") == c) & F.col("text").isNotNull()).select(F.col("text").alias("class"), "n")
    both = own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("_t"), F.max("n").alias("_max"), F.min("n").alias("_min"))))
    top = 100 * safe_ratio("_max", "_t")
    return both.select("class", "n", (100 * safe_ratio("n", "_t")).alias("pct"), safe_ratio("_max", "_min").alias("imbalance_ratio"), F.when(top > high, "high").when(top > moderate, "moderate").otherwise("low").alias("severity"))


# by class -----------------------------------------------------------------------------------------------------------


def five_numbers(by_class: DataFrame) -> DataFrame:
    """(key, feature, min_value, q1, median, q3, max_value) of each class."""
    out = quantiles(by_class.where(F.col("key").isNotNull()), [0, 0.25, 0.5, 0.75, 1], keyed=True)
    return out.select("key", "feature", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("min_value", "q1", "median", "q3", "max_value"))])


def anova_f(by_class: DataFrame) -> DataFrame:
    """As ``stats.anova_f``."""
    x, n = F.col("value"), F.col("n")
    own = _numbers(by_class).where(F.col("key").isNotNull())
    means = own.groupBy("key", "feature").agg(F.sum("n").alias("_k"), (F.sum(x * n) / F.sum("n")).alias("_m"))
    within = own.join(means, ["key", "feature"]).groupBy("feature").agg(F.sum(n * F.pow(x - F.col("_m"), F.lit(2.0))).alias("within"))
    whole = means.groupBy("feature").agg((F.sum(F.col("_k") * F.col("_m")) / F.sum("_k")).alias("_all"), F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_groups"))
    between = means.join(whole, "feature").groupBy("feature", "_n", "_groups").agg(F.sum(F.col("_k") * F.pow(F.col("_m") - F.col("_all"), F.lit(2.0))).alias("between"))
    return between.join(within, "feature").select("feature", safe_ratio(safe_ratio("between", F.col("_groups") - 1), safe_ratio("within", F.col("_n") - F.col("_groups"))).alias("f"))


def kruskal_h(by_class: DataFrame, larger_than: int = 5) -> DataFrame:
    """As ``stats.kruskal_h``: a class's rank sum is that of its values' ranks times their counts."""
    own = _numbers(by_class).where(F.col("key").isNotNull())
    sizes = own.groupBy("key", "feature").agg(F.sum("n").alias("_k")).where(F.col("_k") > larger_than)
    own = own.join(sizes, ["key", "feature"])
    values = own.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranks = average_ranks(values, edges(values)).select("feature", "value", "avg_rank", F.col("n").alias("_ties"))
    sums = own.join(ranks, ["feature", "value"]).groupBy("feature", "key", "_k").agg(F.sum(F.col("avg_rank") * F.col("n")).alias("_s"))
    ties = values.groupBy("feature").agg(F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"), F.sum("n").alias("_all"))
    h = sums.groupBy("feature").agg(F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("_q"), (F.count(F.lit(1)) - 1).alias("df")).join(ties, "feature")
    n = F.col("_all").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    return h.select("feature", safe_ratio(raw, 1 - F.col("ties") / F.nullif(F.pow(n, F.lit(3.0)) - n, F.lit(0.0))).alias("h"), "df")


#: The schema of counts without a key.
COUNTS = T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
