"""Entity features from child tables, features relative to a group, and group compositions."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnfield.functions import finite, quantile, safe_ratio
from tarnfield.operators import order
from tarnfield.operators.clean import zero_fill
from tarnfield.operators.order import attach, average_ranks, cuts, largest_group, quantiles_by, value_counts
from tarnfield.sources.tables import ContractError
from tarnfield.staging import staged

STATE = ("row_count", "sum_level", "sum_ratio", "count_ratio")


def child_aggregate(child: DataFrame, key: str, prefix: str, level: str | None, max_level: str | None, null_level: str = "zero", value: tuple[str, str] | None = None) -> DataFrame:
    """Per key: ``<prefix>_count``, ``_mean_level``, ``_mean_completion_ratio`` (level over a non-zero maximum).

    ``null_level``: "zero" counts null levels as 0, "skip" leaves them out of the mean. ``value`` = (value, target)
    gives instead ``<prefix>_count`` and ``<prefix>_completion_ratio``.
    """
    rows = child.where(F.col(key).isNotNull()).groupBy(key)
    if value:
        return rows.agg(F.count(F.lit(1)).alias(f"{prefix}_count"), F.avg(safe_ratio(*value)).alias(f"{prefix}_completion_ratio"))
    mean = F.coalesce(F.sum(F.col(level).cast("double")), F.lit(0.0)) / F.count(F.lit(1)) if null_level == "zero" else F.avg(F.col(level).cast("double"))
    return rows.agg(F.count(F.lit(1)).alias(f"{prefix}_count"), mean.alias(f"{prefix}_mean_level"), F.avg(safe_ratio(level, max_level)).alias(f"{prefix}_mean_completion_ratio"))


def partial_state(child: DataFrame, key: str, level: str, max_level: str) -> DataFrame:
    """Mergeable sums and counts of a batch of child rows."""
    ratio = safe_ratio(level, max_level)
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col(level).cast("double")), F.lit(0.0)).alias("sum_level"),
        F.coalesce(F.sum(ratio), F.lit(0.0)).alias("sum_ratio"), F.count(ratio).alias("count_ratio"),
    )


def merge_states(*states: DataFrame, key: str) -> DataFrame:
    """States of any number of batches as one."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(key).agg(*[F.sum(c).alias(c) for c in STATE])


def finalize_state(state: DataFrame, key: str, prefix: str) -> DataFrame:
    """``child_aggregate`` with null levels as 0, from a state."""
    return state.select(key, F.col("row_count").alias(f"{prefix}_count"), safe_ratio("sum_level", "row_count").alias(f"{prefix}_mean_level"), safe_ratio("sum_ratio", "count_ratio").alias(f"{prefix}_mean_completion_ratio"))


def entity_features(base: DataFrame, key: str, aggregates: Sequence[DataFrame], derived: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``base``: its columns, the derived ones, the aggregates of each child; all but the key 0 where missing."""
    out = base.withColumns(dict(derived or {}))
    for a in aggregates:
        out = out.join(a, key, "left")
    return zero_fill(out, [key])


def percentile_rank(c: str, group: Sequence[str]) -> Column:
    """Average rank of equal values over the number of values in the group; null for null."""
    return average_rank(c, group) / F.count(c).over(W.partitionBy(*group))


def average_rank(c: str, group: Sequence[str]) -> Column:
    """Average rank of equal values: half of the first one's rank and the number of values up to mine."""
    upto = W.partitionBy(*group).orderBy(F.col(c).asc_nulls_last())
    return F.when(F.col(c).isNotNull(), (F.rank().over(upto) + F.count(c).over(upto)) / F.lit(2.0))


def group_relative(df: DataFrame, group: str, cols: Sequence[str], pct_cols: Sequence[str] = (), emit_means: bool = False, fill: float | None = 0.0, name: str = "group", row: str | None = None) -> DataFrame:
    """Adds ``<c>_diff_from_<name>_mean``, ``<c>_ratio_to_<name>_mean`` and, for ``pct_cols``, ``<c>_<name>_pct``.

    One exchange serves all and leaves the rows parted by group, unless a group has more than ``order.GROUP_ROWS`` rows: then
    means and ranks come from aggregates, and no task takes a group. The sizes of the groups are looked at when this is called.

    ``row``: a column that numbers the rows of a staged ``df``. If a group has more than ``order.TASK_ROWS`` rows, only the
    columns in question are ranked, and come back to the others by that number.
    """
    largest, rows = order.group_rows(df, [group])
    used = list(dict.fromkeys([group, *cols, *pct_cols]))
    if row is not None and largest > order.TASK_ROWS:
        alone = group_relative(df.select(row, *used), group, cols, pct_cols, emit_means, fill, name)
        return df.join(alone.drop(*used), row)
    if largest > order.GROUP_ROWS:
        out = _with_group_statistics(df, group, cols, pct_cols, name)
        ranks = {f"{c}_{name}_pct": F.col(f"_{c}_pct") for c in pct_cols}
    else:
        w = W.partitionBy(group)
        wide = -(-len(df.columns) // order.TASK_COLUMNS)
        out = order.dealt(df, rows * wide, group).withColumns({f"{name}_mean_{c}": F.avg(F.col(c).cast("double")).over(w) for c in cols})
        ranks = {f"{c}_{name}_pct": percentile_rank(c, [group]) for c in pct_cols}
    new = {f"{c}_diff_from_{name}_mean": F.col(c) - F.col(f"{name}_mean_{c}") for c in cols}
    new |= {f"{c}_ratio_to_{name}_mean": safe_ratio(c, f"{name}_mean_{c}") for c in cols}
    for made in (new, ranks):  # apart, as one method for all would be too long for the JVM to compile
        out = out.withColumns({c: e if fill is None else finite(e, fill) for c, e in made.items()})
    out = out.drop(*[f"_{c}_pct" for c in pct_cols])
    return out if emit_means else out.drop(*[f"{name}_mean_{c}" for c in cols])


def _with_group_statistics(df: DataFrame, group: str, cols: Sequence[str], pct_cols: Sequence[str], name: str) -> DataFrame:
    """``df`` with the means of its groups and ``_<c>_pct``, by tables of a row per group and per value of a group."""
    out = df.withColumn("_key", F.struct(group))
    means = out.groupBy("_key").agg(*[F.avg(F.col(c).cast("double")).alias(f"{name}_mean_{c}") for c in cols], F.count(F.lit(1)).alias("_size"))
    kept = list(df.columns)
    if pct_cols:
        ranks = staged(average_ranks(value_counts(out, pct_cols, ["_key"]), cuts(df, pct_cols), ["_key"]), "group-ranks")
    out = attach(out, staged(means, "group-means"), ["_key"], "_size").drop("_size")
    kept += [f"{name}_mean_{c}" for c in cols]
    for c in pct_cols:
        own = ranks.where(F.col("feature") == c).select("_key", F.col("value").alias("_value"), "n", (F.col("avg_rank") / F.col("total")).alias(f"_{c}_pct"))
        ranked = attach(out.where(F.col(c).isNotNull()).withColumn("_value", F.col(c).cast("double")), own, ["_key", "_value"], "n")
        kept.append(f"_{c}_pct")
        out = ranked.select("_key", *kept).unionByName(out.where(F.col(c).isNull()).withColumn(f"_{c}_pct", F.lit(None).cast("double")).select("_key", *kept))
    return out.select(*kept)


def group_composition(df: DataFrame, group: str, stat_cols: Sequence[str] = (), mean_cols: Sequence[str] = (), shares: Mapping[str, Column] | None = None, sum_cols: Sequence[str] = (), count: str = "member_count") -> DataFrame:
    """Per group: mean, median and sample deviation; means; shares of rows (null counts as no); sums (0 if there is nothing to add); the row count.

    One aggregate, unless a group has more than ``order.GROUP_ROWS`` rows: then its medians come from running totals.
    """
    df = df.where(F.col(group).isNotNull())
    large = stat_cols and largest_group(df, [group]) > order.GROUP_ROWS
    aggs = [F.count(F.lit(1)).alias(count)]
    for c in stat_cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), *([] if large else [quantile(c, 0.5).alias(f"median_{c}")]), F.stddev_samp(x).alias(f"std_{c}")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in mean_cols]
    aggs += [F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(k) for k, cond in (shares or {}).items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sum_cols]
    out = df.groupBy(group).agg(*aggs)
    if not large:
        return out
    medians = quantiles_by(df, [group], stat_cols, [0.5]).groupBy(group).agg(*[F.max(F.when(F.col("feature") == c, F.get("q", F.lit(0)))).alias(f"median_{c}") for c in stat_cols])
    names = [x for c in stat_cols for x in (f"mean_{c}", f"median_{c}", f"std_{c}")]
    return out.join(medians, group).select(group, count, *names, *[c for c in out.columns if c not in (group, count, *names)])


def rate_target(df: DataFrame, win: str, parts: Sequence[str], min_total: int, out: str) -> DataFrame:
    """Rows with a history of ``min_total`` or more, with ``out`` = win over the total of ``parts``; without a rate they go."""
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return df.where(total >= min_total).withColumn(out, safe_ratio(F.col(win), total)).where(F.col(out).isNotNull())


def valid_rates(df: DataFrame, c: str, low: float = 0.0, high: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with a rate in range, one row with the numbers kept and dropped)."""
    good = F.coalesce(F.col(c).between(low, high) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    return df.where(good), df.agg(F.count_if(good).alias("n_kept"), F.count_if(~good).alias("n_dropped"))


def require_rates(df: DataFrame, c: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``valid_rates`` that runs at once: a warning with the number dropped, an error if nothing is left."""
    good, counts = valid_rates(df, c, low, high)
    row = counts.first()
    if not row.n_kept:
        raise ContractError(f"no row has a {c} from {low:g} to {high:g}")
    if row.n_dropped:
        warnings.warn(f"{row.n_dropped} rows without a {c} from {low:g} to {high:g} are dropped", UserWarning, stacklevel=2)
    return good
