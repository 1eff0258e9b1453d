"""Column expressions: ratios, keys, names, maps, classes and closed-form moments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den in doubles; null where den is 0 or null."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def finite(c: ColumnOrName, fill: float = 0.0) -> Column:
    """Nulls, NaN and infinities become ``fill``."""
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(fill)).otherwise(x)


def number(c: ColumnOrName) -> Column:
    """A double where the value reads as one, else null."""
    return col(c).try_cast("double")


def normalize_tag(c: ColumnOrName) -> Column:
    """Trimmed, null if empty, with a leading ``#``."""
    tag = F.nullif(F.trim(col(c)), F.lit(""))
    return F.when(tag.startswith("#"), tag).otherwise(F.concat(F.lit("#"), tag))


def fallback_key(nested: ColumnOrName, flat: ColumnOrName, file_name: ColumnOrName) -> Column:
    """The first that is there: the nested key, the flat one, what stands before ``__`` in the file name if that is a tag."""
    stem = F.split_part(col(file_name), F.lit("__"), F.lit(1))
    return F.coalesce(F.nullif(col(nested), F.lit("")), F.nullif(col(flat), F.lit("")), F.when(stem.startswith("#"), stem))


def composite_key(key: ColumnOrName, name: ColumnOrName) -> Column:
    """``key|name``; null without a key, ``None`` for a missing name."""
    return F.when(col(key).isNotNull(), F.concat_ws("|", col(key).cast("string"), F.coalesce(col(name).cast("string"), F.lit("None"))))


def classify(c: ColumnOrName, low: float, high: float, labels: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Below low, [low, high), high and above."""
    if not (0 <= low < high <= 1):
        raise ValueError(f"thresholds must satisfy 0 <= low < high <= 1, not {low} and {high}")
    return between(c, low, high, labels)


def between(c: ColumnOrName, low: float | Column, high: float | Column, labels: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Like ``classify`` for thresholds of any range, columns among them."""
    return F.when(col(c) < low, labels[0]).when(col(c) < high, labels[1]).when(col(c).isNotNull(), labels[2])


def concept(name: ColumnOrName, rules: Mapping[str, str], default: str = "other") -> Column:
    """The first group whose pattern is found in a feature's name, case ignored."""
    low = F.lower(col(name))
    return reduce(lambda rest, kv: F.when(low.rlike(kv[1]), F.lit(kv[0])).otherwise(rest), reversed(list(rules.items())), F.lit(default))


def rename_keys(c: ColumnOrName, names: Mapping[str, str]) -> Column:
    """A map with its keys renamed; unknown keys stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(col(c), lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def map_fingerprint(c: ColumnOrName) -> Column:
    """Text that is equal for maps with equal entries in any order; entries with null values do not count."""
    kept = F.map_filter(col(c), lambda k, v: v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def canonical_json(variant: ColumnOrName) -> Column:
    """JSON text with the keys of all objects sorted, ``", "`` and ``": "`` between, all but printing ASCII as \\u escapes; null stays null."""
    # a separator with all strings and other text since the one before it; possessive repeats take no stack
    spaced = F.regexp_replace(F.to_json(col(variant)), r'(?s)\G((?:"(?:[^"\\]++|\\.)*+"|[^",:]++)*+[,:])', "$1 ")
    runs = F.regexp_extract_all(spaced, F.lit(r"[\x00-~]++|[^\x00-~]++"), F.lit(0))
    units = lambda t: F.regexp_replace(F.lower(F.hex(F.encode(t, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.when(spaced.rlike(r"[^\x00-~]"), F.array_join(F.transform(runs, lambda t: F.when(t < "\x7f", t).otherwise(units(t))), "")).otherwise(spaced)


def adjusted_skewness(c: ColumnOrName) -> Column:
    """Bias-adjusted skewness; null under three values or without spread."""
    x, n = col(c).cast("double"), F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: ColumnOrName) -> Column:
    """Bias-adjusted excess kurtosis; null under four values or without spread."""
    x, n = col(c).cast("double"), F.count(col(c)).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(x) + 6))


def quantile(c: ColumnOrName, p: float | Sequence[float], approximate: int | None = None) -> Column:
    """Exact quantiles with linear interpolation, or approximate ones of the given accuracy for columns of any size."""
    at = F.array(*[F.lit(float(x)) for x in p]) if isinstance(p, (list, tuple)) else F.lit(float(p))
    x = col(c).cast("double")
    return F.percentile(x, at) if approximate is None else F.percentile_approx(x, at, approximate)
