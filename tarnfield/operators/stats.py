"""Profiles and statistics of a dataset, as tables with a row per feature, value, class or pair.

Everything about one dataset's columns comes from one aggregate where it can. Ranks and value counts work on the
long form (feature, value), so that their exchange is keyed by both. Quantiles are exact, and those of whole columns
need no task that holds all values (``order``); ``approximate`` gives an accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnfield.functions import adjusted_kurtosis, adjusted_skewness, concept, number, quantile, safe_ratio
from tarnfield.operators.clean import medians
from tarnfield.operators.features import average_rank
from tarnfield.operators import order
from tarnfield.operators.order import attach, average_ranks, cuts, exact_quantiles, largest_group, quantiles_by, running_total, text_cuts, value_counts
from tarnfield.staging import staged

Metric = Callable[[Column], Column]


def per_column(df: DataFrame, cols: Sequence[str], metrics: Mapping[str, Metric], keys: Sequence[str] = ()) -> DataFrame:
    """A row per (keys and) column with its metrics, from one aggregate."""
    aggs = [F.struct(F.lit(c).alias("feature"), *[m(F.col(c)).alias(k) for k, m in metrics.items()]).alias(f"_{k}") for k, c in enumerate(cols)]
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*[f"_{k}" for k in range(len(cols))])))


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value): one row per row and column, values as doubles."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))


def with_quantiles(summary: DataFrame, df: DataFrame, cols: Sequence[str], at: Sequence[float]) -> DataFrame:
    """``summary`` (a row per feature) with q, the exact quantiles of the columns of ``df``."""
    rows = list(exact_quantiles(df, cols, at).items())
    return summary.join(F.broadcast(df.sparkSession.createDataFrame(rows, "feature string, q array<double>")), "feature")


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


# distributions ------------------------------------------------------------------------------------------------------


def numeric_summary(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), approximate: int | None = None) -> DataFrame:
    """n, min, max, mean, std (0 for one value), p25, p50, p75, p95, iqr, cv (null for mean 0); what is no number is left out."""
    clean, at = df.select(*keys, *[number(c).alias(c) for c in cols]), [0.25, 0.5, 0.75, 0.95]
    apart = keys and not approximate
    out = per_column(clean, cols, {
        "n": F.count, "min_value": F.min, "max_value": F.max, "mean_value": F.avg,
        "std_value": lambda x: F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0)),
    } | ({"q": lambda x: quantile(x, at, approximate)} if approximate else {}), keys)
    if apart:
        by = quantiles_by(clean, keys, cols, at).withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("feature", "_feature")
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("feature") == F.col("_feature"))
        out = out.join(by, same).drop("_feature", *[f"_{k}" for k in keys])
    elif not approximate:
        out = with_quantiles(out, clean, cols, at)
    q = {f"p{p}": F.get("q", F.lit(k)) for k, p in enumerate((25, 50, 75, 95))}
    return out.withColumns(q).drop("q").withColumns({"iqr": F.col("p75") - F.col("p25"), "cv": safe_ratio("std_value", "mean_value")})


def describe(df: DataFrame, cols: Sequence[str], tails: Sequence[float] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """Count, mean, std, min, quartiles, tail percentiles, max."""
    at = [0.25, 0.5, 0.75, *tails]
    out = per_column(df, cols, {"n": F.count, "mean_value": F.avg, "std_value": lambda x: F.stddev_samp(x.cast("double")), "min_value": lambda x: F.min(x.cast("double")), "max_value": lambda x: F.max(x.cast("double"))})
    return with_quantiles(out, df, cols, at).withColumns({f"p{p * 100:g}".replace(".", "_"): F.get("q", F.lit(k)) for k, p in enumerate(at)}).drop("q")


def categorical_distribution(df: DataFrame, c: str, rare: float = 0.01) -> DataFrame:
    """value, n, share of non-missing, is_dominant (the most frequent, ties by value), is_rare; most frequent first."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"), F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("_top"))
    out = with_row(counts, total).withColumn("share", safe_ratio("n", "_total"))
    return out.select("value", "n", "share", (F.col("value") == F.col("_top")).alias("is_dominant"), (F.col("share") < rare).alias("is_rare")).orderBy(F.desc("n"), "value")


def concentration(df: DataFrame, c: str) -> DataFrame:
    """One row: n_values, hhi, entropy (natural log), normalised entropy (0 for one value)."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("_total")
    out = with_row(counts, counts.agg(F.sum("n").alias("_total"))).agg(F.count(F.lit(1)).alias("n_values"), F.sum(p * p).alias("hhi"), (-F.sum(p * F.ln(p))).alias("entropy"))
    return out.withColumn("normalised_entropy", F.when(F.col("n_values") > 1, F.col("entropy") / F.ln("n_values")).otherwise(F.lit(0.0)))


def missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, n_missing, missing_pct (null for no rows)."""
    return per_column(df, cols, {"n_missing": lambda x: F.count_if(x.isNull()), "missing_pct": lambda x: 100 * safe_ratio(F.count_if(x.isNull()), F.count(F.lit(1)))})


def group_sizes(df: DataFrame, key: str, tops: Sequence[int] = (1, 10, 50, 100)) -> DataFrame:
    """One row: n_groups, mean, median, min and max size, and the share of all rows in the largest groups."""
    return size_summary(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, tops)


def size_summary(sizes: DataFrame, key: str, tops: Sequence[int] = (1, 10, 50, 100)) -> DataFrame:
    """``group_sizes`` from the sizes (key, n) themselves."""
    stats = sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("_total"), F.avg("n").alias("mean_size"), quantile("n", 0.5).alias("median_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    largest = sizes.orderBy(F.desc("n"), key).limit(max(tops)).agg(F.sort_array(F.collect_list("n"), False).alias("_n"))
    top = {f"top{k}_share": safe_ratio(F.aggregate(F.slice("_n", 1, k), F.lit(0).cast("bigint"), lambda s, x: s + x), F.col("_total")) for k in tops}
    return with_row(stats, largest).withColumns(top).drop("_n", "_total")


def association_totals(df: DataFrame, key: str, association: str) -> DataFrame:
    """One row: rows, different keys, rows with and without an association."""
    has = F.col(association).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"))


def binned(df: DataFrame, c: str, edges: Sequence[float], labels: Sequence[str], weight: str | None = None) -> DataFrame:
    """Left-closed bins [edge, next edge), the last open; empty bins stay. bin, label, n, pct of rows, share at or above the bin. ``weight``: a row counts so often."""
    if len(edges) != len(labels):
        raise ValueError("one label per edge is needed")
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(c).cast("double"))) - 1
    counts = df.where(F.col(c).isNotNull()).groupBy(at.alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).where("bin >= 0")
    bins = df.sparkSession.createDataFrame(list(enumerate(labels)), "bin int, label string")
    full = bins.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    above = F.sum("n").over(W.orderBy(F.desc("bin")))
    return full.select("bin", "label", "n", (100 * safe_ratio("n", total)).alias("pct"), safe_ratio(above, total).alias("share_from"))


def histogram(df: DataFrame, c: str, bins: int = 20, log: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) bucket, n over equal widths from minimum to maximum; ``log``: of log1p."""
    x = F.log1p(F.col(c).cast("double")) if log else F.col(c).cast("double")
    rows = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull())
    both = with_row(rows, rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return both.groupBy(*keys, bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def five_number(df: DataFrame, cls: str, c: str) -> DataFrame:
    """Box-plot data: minimum, quartiles and maximum of ``c`` by class."""
    out = quantiles_by(df, [cls], [c], [0, 0.25, 0.5, 0.75, 1])
    return out.select(cls, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("min_value", "q1", "median", "q3", "max_value"))])


# shape, constancy, outliers -----------------------------------------------------------------------------------------


def shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skewness and excess kurtosis, bias-adjusted and of the population."""
    return per_column(df, cols, {"skew": adjusted_skewness, "kurt": adjusted_kurtosis, "skew_pop": lambda x: F.skewness(x.cast("double")), "kurt_pop": lambda x: F.kurtosis(x.cast("double"))})


def zero_missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of zeros, share missing, skewness and the advice on a log transform (over 1 strong, over 0.5 moderate)."""
    n = F.count(F.lit(1))
    out = per_column(df, cols, {"zero_pct": lambda x: 100 * safe_ratio(F.count_if(x == 0), n), "missing_pct": lambda x: 100 * safe_ratio(F.count_if(x.isNull()), n), "skew": adjusted_skewness})
    return out.withColumn("log_advice", F.when(F.abs("skew") > 1.0, "strong").when(F.abs("skew") > 0.5, "moderate").otherwise("none"))


def group_profile(profile: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """``zero_missing_profile`` by conceptual group of the feature's name."""
    grouped = profile.withColumn("concept", concept("feature", rules)).groupBy("concept")
    return grouped.agg(F.count(F.lit(1)).alias("n_features"), F.avg("missing_pct").alias("mean_missing_pct"), F.avg("zero_pct").alias("mean_zero_pct"), F.avg(F.abs("skew")).alias("mean_abs_skew"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (rows beyond the first of equal ones)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def mode_frequency(df: DataFrame, cols: Sequence[str], count_nulls: bool = True, constant: float = 0.95, low_variance: float = 1e-6) -> DataFrame:
    """Share of the commonest value, nearly_constant, zero_variance, low_variance of each column, whatever its type.

    The two on variance are null for columns that are not numeric.
    """
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])))
    rows = rows if count_nulls else rows.where(F.col("value").isNotNull())
    top = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.max("n").alias("mode_n"), F.sum("n").alias("n"))
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    spread = per_column(df.select(*[F.col(c).cast("double") if c in numeric else F.lit(None).cast("double").alias(c) for c in cols]), cols, {"variance": F.var_samp})
    out = top.join(F.broadcast(spread), "feature").withColumn("mode_share", safe_ratio("mode_n", "n"))
    return out.select("feature", "mode_n", "mode_share", (F.col("mode_share") >= constant).alias("nearly_constant"), (F.col("variance") == 0).alias("zero_variance"), (F.col("variance") < low_variance).alias("low_variance"))


def cardinality(df: DataFrame, cols: Sequence[str], share: float = 0.9, rsd: float | None = None) -> DataFrame:
    """Different values and whether there are more than ``share`` of the rows; ``rsd``: approximate, of that deviation."""
    count = (lambda x: F.approx_count_distinct(x, rsd)) if rsd else F.count_distinct
    out = per_column(df, cols, {"n_distinct": count, "_n": lambda x: F.count(F.lit(1))})
    return out.select("feature", "n_distinct", (F.col("n_distinct") > share * F.col("_n")).alias("high_cardinality"))


def iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, approximate: int | None = None) -> DataFrame:
    """Bounds quartile -/+ factor * iqr, values outside and their share; the bounds of the first aggregate are literals of the second."""
    q = exact_quantiles(df, cols, [0.25, 0.75]) if approximate is None else df.agg(*[quantile(c, [0.25, 0.75], approximate).alias(c) for c in cols]).first()
    bounds = {c: (q[c][0] - factor * (q[c][1] - q[c][0]), q[c][1] + factor * (q[c][1] - q[c][0])) if q[c] else (None, None) for c in cols}
    aggs = []
    for k, c in enumerate(cols):
        lo, hi = (F.lit(b).cast("double") for b in bounds[c])
        out = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
        aggs.append(F.struct(F.lit(c).alias("feature"), lo.alias("lower_bound"), hi.alias("upper_bound"), out.alias("n_outliers"), (100 * safe_ratio(out, F.count(c))).alias("outlier_pct")).alias(f"_{k}"))
    return df.agg(*aggs).select(F.inline(F.array(*[f"_{k}" for k in range(len(cols))])))


# targets ------------------------------------------------------------------------------------------------------------


def class_balance(df: DataFrame, cls: str, high: float = 60, moderate: float = 45) -> DataFrame:
    """class, n, pct, imbalance_ratio (largest over smallest class), severity by the largest class's share."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    both = with_row(counts, counts.agg(F.sum("n").alias("_t"), F.max("n").alias("_max"), F.min("n").alias("_min")))
    top = 100 * safe_ratio("_max", "_t")
    return both.select("class", "n", (100 * safe_ratio("n", "_t")).alias("pct"), safe_ratio("_max", "_min").alias("imbalance_ratio"), F.when(top > high, "high").when(top > moderate, "moderate").otherwise("low").alias("severity"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null for fewer than two different values on a side (where corr would divide by zero)."""
    a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def ranked(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value, avg_rank, ties): ranks over the whole column from counts of its different values."""
    rows = long_form(df, cols, keep).where(F.col("value").isNotNull())
    ranks = staged(average_ranks(value_counts(df, cols), cuts(df, cols)).select("feature", "value", "avg_rank", F.col("n").alias("ties")), "ranks")
    return attach(rows, ranks, ["feature", "value"], "ties")


def pair_ranks(rows: DataFrame, edges: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` (keys, feature, value, _y) with _rx and _ry, the average ranks of both over the rows of their key and feature.

    Ranks come from counts of the different values, of which ``edges`` cuts each feature's, and the target's, into stretches.
    """
    own = f"\0{target}"
    edges = edges.unionByName(edges.where(F.col("feature") == target).withColumn("feature", F.lit(own)))
    sides = F.array(F.struct(F.col("feature").alias("axis"), "value"), F.struct(F.lit(own).alias("axis"), F.col("_y").alias("value")))
    counts = rows.select(*keys, F.col("feature").alias("_of"), F.inline(sides)).groupBy(*keys, "_of", F.col("axis").alias("feature"), "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = staged(average_ranks(counts, edges, [*keys, "_of"]), "pair-ranks")
    x = ranks.where(F.col("feature") != own).select(*keys, F.col("_of").alias("feature"), "value", F.col("avg_rank").alias("_rx"), F.col("n").alias("_nx"))
    y = ranks.where(F.col("feature") == own).select(*keys, F.col("_of").alias("feature"), F.col("value").alias("_y"), F.col("avg_rank").alias("_ry"), F.col("n").alias("_ny"))
    return attach(attach(rows, x, [*keys, "feature", "value"], "_nx"), y, [*keys, "feature", "_y"], "_ny").drop("_nx", "_ny")


def target_correlation(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of each feature with the target, over rows that have both.

    Ranks of features of few values are added up by value of the target, whose own ranks come from the same counts: one
    exchange of a row per value of the target, none of rows. Other features are looked up row by row (``pair_ranks``).
    """
    y, sizes = F.col(target).cast("double"), df.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    few = [c for c, n in zip(cols, sizes, strict=True) if n <= FEW]
    many = [c for c in cols if c not in few]
    parts = []
    if few:
        wide = df.where(y.isNotNull()).select(y.alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(few)])
        pearson = per_column_of(wide, few, lambda k: safe_corr(f"_x{k}", "_y").alias("pearson"))
        parts.append(pearson.join(F.broadcast(_counted_spearman(wide, few)), "feature", "left"))
    if many:
        rows = long_form(df, many, [y.alias("_y")]).where(F.col("value").isNotNull() & F.col("_y").isNotNull())
        rows = pair_ranks(rows, cuts(df, list(dict.fromkeys([target, *many]))), target)
        parts.append(rows.groupBy("feature").agg(safe_corr("value", "_y").alias("pearson"), safe_corr("_rx", "_ry").alias("spearman")))
    return reduce(DataFrame.unionByName, parts)


#: Different values of a feature whose ranks stand in a map.
FEW = 1000


def per_column_of(wide: DataFrame, cols: Sequence[str], metric: Callable[[int], Column]) -> DataFrame:
    """A row per column that has a row with both (``_x<k>``, not null) with its metric, from one aggregate."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(f"_x{k}").alias("_n"), metric(k)).alias(f"_{k}") for k, c in enumerate(cols)]
    return wide.agg(*aggs).select(F.inline(F.array(*[f"_{k}" for k in range(len(cols))]))).where("_n > 0").drop("_n")


def _counted_spearman(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, spearman) of columns ``_x<k>`` of few values with ``_y``, by their centred ranks over the rows that have both."""
    names = [f"_x{k}" for k in range(len(cols))]
    counts = value_counts(wide, names)
    w = W.partitionBy("feature").orderBy("value")
    place = (F.sum("n").over(w) - (F.col("n") - 1) / F.lit(2.0)) - (F.sum("n").over(W.partitionBy("feature")) + 1) / F.lit(2.0)
    ranks: dict[str, dict[float, float]] = {c: {} for c in names}
    spread = dict.fromkeys(names, 0.0)
    for r in counts.select("feature", "value", "n", place.alias("r")).collect():  # at most some FEW a column
        ranks[r.feature][r.value] = r.r
        spread[r.feature] += r.r * r.r * r.n
    used = [k for k, c in enumerate(names) if ranks[c]]
    if not used:
        return wide.sparkSession.createDataFrame([], "feature string, spearman double")
    table = wide.sparkSession.createDataFrame([({c: ranks[c] for c in names if ranks[c]},)], "_ranks map<string,map<double,double>>")
    rank = lambda k: F.try_element_at(F.try_element_at("_ranks", F.lit(names[k])), F.col(names[k]))
    looked = with_row(wide, table).select("_y", *[rank(k).alias(f"_r{k}") for k in used])
    by_y = looked.groupBy("_y").agg(*[x for k in used for x in (F.count(f"_r{k}").alias(f"_n{k}"), F.sum(f"_r{k}").alias(f"_s{k}"))])
    long = by_y.select(F.col("_y").alias("value"), F.inline(F.array(*[F.struct(F.lit(names[k]).alias("feature"), F.col(f"_n{k}").alias("n"), F.col(f"_s{k}").alias("_s")) for k in used]))).where("n > 0")
    long = staged(long, "target-values")
    edges = cuts(long.select("value"), ["value"]).select("cuts").crossJoin(wide.sparkSession.createDataFrame([(names[k],) for k in used], "feature string"))
    ry = F.col("avg_rank") - (F.col("total") + 1) / F.lit(2.0)
    sums = average_ranks(long, edges, []).groupBy("feature").agg(F.sum(F.col("_s") * ry).alias("xy"), F.sum(F.col("n") * ry * ry).alias("yy"))
    known = wide.sparkSession.createDataFrame([(names[k], cols[k], spread[names[k]]) for k in used], "feature string, _name string, xx double")
    return sums.join(F.broadcast(known), "feature").select(F.col("_name").alias("feature"), (F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("spearman"))


#: Products that one aggregate sums up.
PRODUCTS = 200


def rank_correlations(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    """Spearman of each pair of columns without nulls: the Gram matrix of their centred ranks, PRODUCTS entries at a time.

    A column's ranks are looked up by value, from a broadcast table or, for a column of many values, by one exchange.
    """
    ranks = staged(average_ranks(value_counts(df, cols), cuts(df, cols)), "column-ranks")
    wide = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(cols)])
    for k, c in enumerate(cols):
        own = ranks.where(F.col("feature") == c).select(F.col("value").alias(f"_{k}"), (F.col("avg_rank") - (F.col("total") + 1) / F.lit(2.0)).alias(f"_r{k}"), "n")
        wide = attach(wide, own, [f"_{k}"], "n").drop("n", f"_{k}")
    entries = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(entries) > PRODUCTS:
        wide = staged(wide, "rank-columns")
    sums: dict[tuple[int, int], float] = {}
    for low in range(0, len(entries), PRODUCTS):
        part = entries[low : low + PRODUCTS]
        sums |= dict(zip(part, wide.agg(*[F.sum(F.col(f"_r{i}") * F.col(f"_r{j}")).alias(f"s{i}_{j}") for i, j in part]).first(), strict=True))
    return {(cols[i], cols[j]): sums[i, j] / (sums[i, i] * sums[j, j]) ** 0.5 for i, j in entries if i < j and sums[i, i] and sums[j, j]}


def correlation_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson", threshold: float = 0.0) -> DataFrame:
    """(feature_a, feature_b, r) with a before b in ``cols`` and abs(r) > threshold; nulls are medians first. The matrix alone reaches the driver."""
    middle = medians(df, cols)
    used = [c for c in cols if middle[c] is not None]
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(middle[c])).alias(c) for c in used])
    if method == "spearman":
        r = rank_correlations(filled, used)
    else:
        m = Correlation.corr(VectorAssembler(inputCols=used, outputCol="_v").transform(filled).select("_v"), "_v", method).first()[0].toArray()
        r = {(used[i], used[j]): float(m[i, j]) for i in range(len(used)) for j in range(i + 1, len(used))}
    pairs = [(a, b, x) for (a, b), x in r.items() if abs(x) > threshold]
    return df.sparkSession.createDataFrame(pairs, "feature_a string, feature_b string, r double")


def anova_f(df: DataFrame, cls: str, cols: Sequence[str]) -> DataFrame:
    """F of each feature over the classes; null without spread inside them."""
    rows = long_form(df, cols, [cls]).where(F.col("value").isNotNull() & F.col(cls).isNotNull())
    groups = rows.groupBy("feature", cls).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = groups.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    both = groups.join(whole, "feature").groupBy("feature", "_n", "_k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_m"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return both.select("feature", safe_ratio(safe_ratio("between", F.col("_k") - 1), safe_ratio("within", F.col("_n") - F.col("_k"))).alias("f"))


def kruskal_h(df: DataFrame, cls: str, cols: Sequence[str], larger_than: int = 5) -> DataFrame:
    """H of each feature, corrected for ties, over classes of more than ``larger_than`` values; with degrees of freedom."""
    rows = long_form(df, cols, [F.col(cls).alias("_c")]).where(F.col("value").isNotNull() & F.col("_c").isNotNull())
    large = rows.groupBy("feature", "_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > larger_than).select("feature", "_c")
    rows = rows.join(large, ["feature", "_c"], "left_semi")
    counts = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = staged(average_ranks(counts, cuts(df, cols)).select("feature", "value", F.col("avg_rank").alias("r"), F.col("n").alias("t")), "kruskal-ranks")
    ties = ranks.groupBy("feature").agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    sums = attach(rows, ranks, ["feature", "value"], "t").groupBy("feature", "_c").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("k"))
    h = sums.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), (F.count(F.lit(1)) - 1).alias("df")).join(ties, "feature")
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return h.select("feature", safe_ratio(raw, 1 - F.col("ties") / F.nullif(F.pow(n, 3) - n, F.lit(0.0))).alias("h"), "df")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared > x): the closed sums for whole degrees of freedom."""
    import math

    if x <= 0 or df < 1:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return total
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, df // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


def with_p_values(tests: DataFrame) -> DataFrame:
    """``kruskal_h`` with p and the uncapped Bonferroni p * number of features; these few rows pass the driver."""
    rows = [(r.feature, r.h, r.df, chi2_tail(r.h, r.df) if r.h is not None else None) for r in tests.collect()]
    return tests.sparkSession.createDataFrame([(*r, r[3] * len(rows) if r[3] is not None else None) for r in rows], "feature string, h double, df bigint, p double, p_bonferroni double")


def binned_mutual_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10, bin_target: bool = False) -> DataFrame:
    """Mutual information (nats) of each feature, cut at its ``bins`` quantiles, with a class or a cut target."""
    at = [k / bins for k in range(1, bins)]
    used = [*cols, *([target] if bin_target else [])]
    q = exact_quantiles(df, used, at)

    def cut(c: str) -> Column:
        x = F.col(c).cast("double")  # comparisons, which Spark compiles; a function over an array it would interpret for each row
        return F.when(F.col(c).isNotNull(), sum(((F.lit(float(p)) < x).cast("int") for p in q[c] or []), F.lit(0)))

    y = cut(target) if bin_target else F.col(target).cast("string")
    rows = df.select(y.alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), cut(c).alias("x")) for c in cols]))).where("x is not null and y is not null")
    n = rows.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy
    p = n.select("feature", "n", F.sum("n").over(w("feature", "x")).alias("nx"), F.sum("n").over(w("feature", "y")).alias("ny"), F.sum("n").over(w("feature")).alias("t"))
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))).alias("mi"))


# proxies ------------------------------------------------------------------------------------------------------------


def group_spearman(df: DataFrame, group: str, target: str, variables: Sequence[str]) -> DataFrame:
    """(group, feature, rho): Spearman of each variable with the target inside each group, over rows that have both; null groups and those without spread are left out."""
    df = df.select(*dict.fromkeys([group, target, *variables])).where(F.col(group).isNotNull() & F.col(target).cast("double").isNotNull())
    largest, n = order.group_rows(df, [group])
    if largest <= order.GROUP_ROWS:  # rows are shuffled as they are, and put in long form in the tasks of their groups
        df = order.dealt(df, n * len(variables) // 5, group)
    rows = long_form(df, variables, [group, F.col(target).cast("double").alias("_y")]).where(F.col("value").isNotNull())
    if largest > order.GROUP_ROWS:
        ranks = pair_ranks(rows, cuts(df, list(dict.fromkeys([target, *variables]))), target, [group])
    else:
        ranks = rows.select(group, "feature", average_rank("value", [group, "feature"]).alias("_rx"), average_rank("_y", [group, "feature"]).alias("_ry"))
    return ranks.groupBy(group, "feature").agg(safe_corr("_rx", "_ry").alias("rho")).where(F.col("rho").isNotNull())


#: Limits of the proxy classes.
TOO_DIRECT_MEDIAN, TOO_DIRECT_SHARE = 0.95, 0.8
PROXY_MEDIAN, PROXY_SHARE = 0.8, 0.5
NEAR_ONE = 0.9


def proxy_audit(df: DataFrame, group: str, target: str, variables: Sequence[str], banned: Sequence[str] = ()) -> DataFrame:
    """How closely variables stand in for the target inside groups: median rho, 90th percentile of abs(rho), share above 0.9, class.

    TOO_DIRECT: abs(median) >= 0.95 and share >= 0.8; POTENTIAL PROXY: abs(median) >= 0.8 or share >= 0.5; else SAFE;
    INSUFFICIENT_DATA without a usable group; EXCLUDE for banned names. Classes come from unrounded values.
    """
    rho = staged(group_spearman(df, group, target, variables), "rho").select(F.col("feature").alias("variable"), "rho", F.abs("rho").alias("abs_rho"))
    at = quantiles_by(rho, ["variable"], ["rho", "abs_rho"], [0.5, 0.9])
    middles = at.groupBy("variable").agg(F.max(F.when(F.col("feature") == "rho", F.get("q", F.lit(0)))).alias("median_rho"), F.max(F.when(F.col("feature") == "abs_rho", F.get("q", F.lit(1)))).alias("p90_abs_rho"))
    sums = rho.groupBy("variable").agg(F.avg(F.when(F.col("abs_rho") > NEAR_ONE, 1.0).otherwise(0.0)).alias("share_above"), F.count(F.lit(1)).alias("n_groups"))
    sums = sums.join(middles, "variable").withColumnRenamed("variable", "feature")
    every = df.sparkSession.createDataFrame([(v,) for v in variables], "feature string")
    out = every.join(F.broadcast(sums), "feature", "left")
    middle = F.abs("median_rho")
    kind = (
        F.when(F.col("feature").isin(list(banned)), "EXCLUDE")
        .when(F.col("median_rho").isNull(), "INSUFFICIENT_DATA")
        .when((middle >= TOO_DIRECT_MEDIAN) & (F.col("share_above") >= TOO_DIRECT_SHARE), "TOO_DIRECT")
        .when((middle >= PROXY_MEDIAN) | (F.col("share_above") >= PROXY_SHARE), "POTENTIAL PROXY")
        .otherwise("SAFE")
    )
    return out.select("feature", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), *[F.bround(c, 4).alias(c) for c in ("median_rho", "p90_abs_rho", "share_above")], kind.alias("classification"))


# audit --------------------------------------------------------------------------------------------------------------


#: Shares above which the audit warns.
DOMINANCE_LIMIT = 0.4
LOCATION_LIMIT = 0.3
WITHOUT_GROUP_LIMIT = 30.0
MISSING_LIMIT = 10.0
TOP1_LIMIT = 0.5


def warnings(distributions: Mapping[str, DataFrame], missing_table: DataFrame, sizes: DataFrame | None = None, totals: DataFrame | None = None, locations: Sequence[str] = ("location",), dominance: float = DOMINANCE_LIMIT, location: float = LOCATION_LIMIT, without_group: float = WITHOUT_GROUP_LIMIT, missing_limit: float = MISSING_LIMIT, top1: float = TOP1_LIMIT) -> DataFrame:
    """(rule, field, value in percent): dominant values, dominant locations, missing fields, rows without a group, one group that is too large."""
    rows = missing_table.where(F.col("missing_pct") > missing_limit).select(F.lit("missing").alias("rule"), F.col("feature").alias("field"), F.col("missing_pct").alias("value"))
    for name, d in distributions.items():
        rule, limit = ("location", location) if name in locations else ("dominance", dominance)
        rows = rows.unionByName(d.where(F.col("is_dominant") & (F.col("share") > limit)).select(F.lit(rule).alias("rule"), F.lit(name).alias("field"), (100 * F.col("share")).alias("value")))
    if totals is not None:
        share = 100 * safe_ratio("n_without", "n_rows")
        rows = rows.unionByName(totals.where(share > without_group).select(F.lit("without_group").alias("rule"), F.lit("groups").alias("field"), share.alias("value")))
    if sizes is not None:
        rows = rows.unionByName(sizes.where(F.col("top1_share") > top1).select(F.lit("top1").alias("rule"), F.lit("groups").alias("field"), (100 * F.col("top1_share")).alias("value")))
    return rows


def coverage_grade(metrics: DataFrame) -> DataFrame:
    """``metrics`` (one row: n_rows, mean_missing_pct, dominance, top1, without_group, the last three in percent) with a grade."""
    # fixed values: the limits of the grades
    m = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n_rows", "mean_missing_pct", "dominance", "top1", "without_group")}
    grade = (
        F.when(m["n_rows"] < 1000, "Limited")
        .when((m["n_rows"] >= 10000) & (m["mean_missing_pct"] < 5) & (m["dominance"] < 40) & (m["top1"] < 40) & (m["without_group"] < 10), "Excellent")
        .when((m["n_rows"] >= 5000) & (m["mean_missing_pct"] < 10) & (m["dominance"] < 50) & (m["top1"] < 50), "Good")
        .when(m["mean_missing_pct"] < 15, "Moderate")
        .otherwise("Limited")
    )
    return metrics.withColumn("grade", F.concat(grade, F.lit(" coverage")))


def manifest(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: row_count, feature_count, target, content_hash.

    The hash is the sum over all rows of 60 bits of the md5 of a row's values as text (null: ``\\N``), parted by a unit separator:
    it does not depend on the order of rows, and repeated rows count as often as they occur.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    bits = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns) - bool(target)).alias("feature_count"), F.lit(target).cast("string").alias("target"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("content_hash"))


def top_rows(df: DataFrame, c: str, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(c), *tie).limit(n)


def rank_features(scores: DataFrame, c: str, n: int = 15, absolute: bool = False) -> DataFrame:
    """The ``n`` best features by score, or by its absolute value."""
    return scores.orderBy((F.abs(c) if absolute else F.col(c)).desc_nulls_last(), "feature").limit(n)


def encode_category(df: DataFrame, c: str, out: str) -> DataFrame:
    """``c`` as whole numbers from 0 in the order of its values; null stays null. The different values alone are ranked, in stretches."""
    values = staged(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("_n")).withColumns({"feature": F.lit(c), "_one": F.lit(1)}), "categories")
    edges = df.sparkSession.createDataFrame([(c, text_cuts(values, "value"))], T.StructType([T.StructField("feature", T.StringType()), T.StructField("cuts", T.ArrayType(values.schema["value"].dataType))]))
    codes = staged(running_total(values, edges, "_one").select(F.col("value").alias(c), (F.col("upto") - 1).cast("int").alias(out), "_n"), "category-codes")
    empty = df.where(F.col(c).isNull()).withColumn(out, F.lit(None).cast("int"))
    return attach(df.drop(out), codes, [c], "_n").drop("_n").select(*df.drop(out).columns, out).unionByName(empty.select(*df.drop(out).columns, out))
