"""Exact order statistics of columns and groups: quantiles, ranks and running totals, without one task that sees all values.

A column's values are cut into stretches at approximate quantiles, which one mergeable aggregate gives. Stretches are
counted and ordered apart; what lies before a stretch is the sum of the stretches below it. The results are exact
wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Different values that one aggregation buffer may hold, of all its columns: one task merges the buffers of all others. Columns with more are cut into stretches.
BUFFER_VALUES = 20_000
#: Relative accuracy of the approximate quantiles between which an exact one is looked for.
ACCURACY = 10_000
#: Most stretches of a column.
MOST_STRETCHES = 1000


def _double(c: str):
    return F.col(f"`{c}`").cast("double")


def _stretches(df: DataFrame) -> int:
    return max(2, min(MOST_STRETCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cuts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, cuts): where the columns are cut, from one aggregate; a row per column."""
    n = _stretches(df)
    at = F.array(*[F.lit(k / n) for k in range(1, n)])
    row = df.agg(*[F.percentile_approx(_double(c), at, F.lit(10 * n)).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    rows = [(c, sorted({x for x in row[k] or [] if x == x})) for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, cuts array<double>")


def text_cuts(values: DataFrame, c: str) -> list:
    """Where a column of any ordered type is cut: every 16th of a sample of its values, drawn by hash, of a size that the number of stretches gives."""
    n = _stretches(values)
    different = values.agg(F.approx_count_distinct(c)).first()[0]
    drawn = F.pmod(F.xxhash64(c), F.lit(max(1, different // (16 * n)))) == 0
    sample = sorted(r[0] for r in values.where(F.col(c).isNotNull() & drawn).select(c).distinct().collect())
    return sample[16::16]


def _with_stretch(counts: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    stretch = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    return counts.join(F.broadcast(edges), "feature").withColumn("_stretch", stretch).drop("cuts")


def running_total(counts: DataFrame, edges: DataFrame, n: str, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """``counts`` (keys, feature, value, n, one row per different value) with ``upto``, the sum of n up to this value, and ``total``, that of all.

    No task takes more of a key than one stretch of a feature's values. Keys are not null; a struct of a null is a key.
    """
    by = [*keys, "feature"]
    cut = _with_stretch(counts, edges, value)
    sums = cut.groupBy(*by, "_stretch").agg(F.sum(n).alias("_in"))
    whole = W.partitionBy(*by)  # as many rows as there are stretches
    below = F.coalesce(F.sum("_in").over(whole.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_stretch", below.alias("_below"), F.sum("_in").over(whole).alias("total"))
    within = F.sum(n).over(W.partitionBy(*by, "_stretch").orderBy(value))
    both = cut.withColumn("_within", within).join(sums if keys else F.broadcast(sums), [*by, "_stretch"])
    return both.withColumn("upto", F.col("_within") + F.col("_below")).drop("_stretch", "_within", "_below")


def value_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value, n): the different values of the columns, as doubles, from one exchange of counts."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _double(c).alias("value")) for c in cols])))
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def average_ranks(counts: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``counts`` with avg_rank, that of equal values, and total."""
    out = running_total(counts, edges, "n", keys=keys)
    return out.withColumn("avg_rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).drop("upto")


#: Rows of a table that may go out by broadcast.
SMALL = 500_000
#: A value with more than LIGHT rows, and more than 1 / HEAVY_PARTS of all, is heavy: at most HEAVY_PARTS are.
LIGHT, HEAVY_PARTS = 1000, 4096


def attach(rows: DataFrame, per_value: DataFrame, on: Sequence[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``per_value`` (a row per value of ``on``, of which ``rows`` has ``size``); rows without a match go.

    A small table goes out by broadcast. Of a larger one the heavy values do, and their rows are spread over the tasks of the
    join that serves all others. ``per_value`` is read several times: a staged table.
    """
    on = list(on)
    n, total = per_value.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= SMALL:
        return rows.join(F.broadcast(per_value), on)
    heavy = F.col(size) > max(LIGHT, total // HEAVY_PARTS)
    values = F.struct(*[c for c in per_value.columns if c not in on])
    marked = rows.join(F.broadcast(per_value.where(heavy).select(*on, values.alias("_heavy"))), on, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.lit(1) + F.pmod(F.xxhash64(*rows.columns), F.lit(HEAVY_PARTS))).otherwise(F.lit(0)).cast("bigint"))
    # a salt that Catalyst cannot tell is 0: it takes literals out of join keys
    light = per_value.where(~heavy).select(*on, values.alias("_light"), F.least(F.col(size), F.lit(0)).cast("bigint").alias("_salt"))
    joined = marked.join(light.hint("merge"), [*on, "_salt"], "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return joined.where(F.col("_found").isNotNull()).select(*rows.columns, "_found.*")


#: Rows of a group that one task orders, or one buffer takes. Larger groups are cut into stretches.
GROUP_ROWS = 1_000_000


def group_rows(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, all rows); runs at once."""
    largest, rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return largest or 0, rows or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; runs at once."""
    return group_rows(df, keys)[0]


#: Rows that a task orders in about as many ways as there are columns.
TASK_ROWS = 100_000
#: Columns of such rows; of wider ones a task orders fewer.
TASK_COLUMNS = 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of so many rows, parted by ``keys`` for windows over them: the number of tasks grows with the rows, so that none orders more than about TASK_ROWS."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def picked_quantiles(run: DataFrame, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(by, q): quantiles with linear interpolation from the ``running_total`` of each group's values."""
    held = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in at]
    ends = [held(f(x)).alias(f"_{side}{k}") for k, x in enumerate(places) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    q = F.array(*[F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (x - F.floor(x)) for k, x in enumerate(places)])
    return run.groupBy(*by, "total").agg(*ends).select(*by, q.alias("q"))


def quantiles_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(keys, feature, q): exact quantiles of the columns in each group, with linear interpolation; groups without values have null.

    Where a group has more than GROUP_ROWS rows, the values of all are counted, and found by running totals: no task or
    buffer holds a group.
    """
    points = F.array(*[F.lit(float(p)) for p in at])
    if largest_group(df, keys) <= GROUP_ROWS:
        each = [F.struct(F.lit(c).alias("feature"), F.percentile(_double(c), points).alias("q")).alias(f"_{k}") for k, c in enumerate(cols)]
        return df.groupBy(*keys).agg(*each).select(*keys, F.inline(F.array(*[f"_{k}" for k in range(len(cols))])))
    keyed = df.withColumn("_key", F.struct(*keys))
    run = running_total(value_counts(keyed, cols, ["_key"]), cuts(df, cols), "n", keys=["_key"])
    found = picked_quantiles(run, ["_key", "feature"], at)
    every = keyed.select("_key", F.explode(F.array(*map(F.lit, cols))).alias("feature")).distinct()
    return every.join(found, ["_key", "feature"], "left").select(*[F.col("_key")[k].alias(k) for k in keys], "feature", "q")


def exact_quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float], many: bool = False) -> dict[str, list[float] | None]:
    """Quantiles of whole columns with linear interpolation; None for a column without values. They pass the driver.

    ``many``: the columns are known to have about as many values as rows, so that these need not be counted.
    """
    cols, points = list(dict.fromkeys(cols)), F.array(*[F.lit(float(p)) for p in at])
    if many or not cols:
        return _large_quantiles(df, cols, at) if cols else {}
    n, *sizes = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(_double(c)).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    small, held = [], 0
    for size, c in sorted((min(n, size), c) for size, c in zip(sizes, cols, strict=True)):
        held += size
        if held <= BUFFER_VALUES:
            small.append(c)
    large = [c for c in cols if c not in small]
    out: dict[str, list[float] | None] = {}
    if small:
        row = df.agg(*[F.percentile(_double(c), points).alias(f"_{k}") for k, c in enumerate(small)]).first()
        out = {c: list(row[k]) if row[k] is not None else None for k, c in enumerate(small)}
    return out | (_large_quantiles(df, large, at) if large else {})


def _large_quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float]) -> dict[str, list[float] | None]:
    """Of each column only the stretches between approximate quantiles on both sides of the wanted ones are counted and put in order; no other value is shuffled."""
    near = F.array(*[F.lit(min(1.0, max(0.0, p + side / ACCURACY))) for p in at for side in (-2, 2)])
    row = df.agg(*[F.percentile_approx(_double(c), near, F.lit(ACCURACY)).alias(f"_{k}") for k, c in enumerate(cols)]).first()
    ends = {c: sorted({x for x in row[k] or [] if x == x}) for k, c in enumerate(cols)}
    upto = [F.count(_double(c)) if e is None else F.count_if(_double(c) <= e) for c in cols for e in [*ends[c], None]]
    found_upto = iter(df.agg(*[x.alias(f"_{k}") for k, x in enumerate(upto)]).first())
    wanted, places, kept, sought = [], {}, [], []
    for c in cols:
        sums = [next(found_upto) for _ in range(len(ends[c]) + 1)]
        places[c] = [p * (sums[-1] - 1) for p in at] if sums[-1] else None
        ranks = sorted({f(x) for x in places[c] or [] for f in (floor, ceil)})
        for stretch, (below, top) in enumerate(zip([0, *sums], sums, strict=False)):
            own = [(c, stretch, r, r - below) for r in ranks if below <= r < top]
            if own:
                wanted += own
                bounds = [_double(c) > ends[c][stretch - 1]] * (stretch > 0) + [_double(c) <= ends[c][stretch]] * (stretch < len(ends[c]))
                inside = reduce(lambda x, y: x & y, bounds, _double(c).isNotNull())
                sought.append(inside)
                kept.append(F.when(inside, F.struct(F.lit(c).alias("feature"), F.lit(stretch).alias("_stretch"), _double(c).alias("value"))))
    if not kept:
        return dict.fromkeys(cols)
    few = df.where(reduce(lambda x, y: x | y, sought))  # structs are made of these rows alone
    counts = few.select(F.inline(F.array_compact(F.array(*kept)))).groupBy("feature", "_stretch", "value").agg(F.count(F.lit(1)).alias("n"))
    asked = [F.struct(F.lit(c).alias("feature"), F.lit(k).alias("_stretch"), F.lit(r).cast("bigint").alias("_rank"), F.lit(place).cast("bigint").alias("_at")) for c, k, r, place in wanted]
    asked = df.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*asked)))
    within = F.sum("n").over(W.partitionBy("feature", "_stretch").orderBy("value"))
    hit = counts.withColumn("_upto", within).join(F.broadcast(asked), ["feature", "_stretch"]).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("n") <= F.col("_at")))
    found = {(r.feature, r._rank): r.value for r in hit.select("feature", "_rank", "value").collect()}
    between = lambda c, x: found[c, floor(x)] + (found[c, ceil(x)] - found[c, floor(x)]) * (x - floor(x))
    return {c: places[c] and [between(c, x) for x in places[c]] for c in cols}
