"""Profiles of any dataset: the audit of raw documents and the exploratory report as long tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import counted, matrix, stats
from tarnfield.staging import staged


def _metric(name: str, one_row: DataFrame, c: str) -> DataFrame:
    return one_row.select(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))


def executive_summary(df: DataFrame, sparse: DataFrame, fields: Sequence[str], keys: Sequence[str], cls: str) -> DataFrame:
    """(metric, value): rows, repeated keys, mean missing share of ``fields``, class imbalance."""
    twice = stats.duplicates(df.select(*keys))
    return (
        _metric("rows", twice, "n_rows")
        .unionByName(_metric("duplicates", twice, "n_duplicates"))
        .unionByName(_metric("mean_missing_pct", stats.missing(sparse, fields).agg(F.avg("missing_pct").alias("x")), "x"))
        .unionByName(_metric("imbalance_ratio", stats.class_balance(df, cls).agg(F.max("imbalance_ratio").alias("x")), "x"))
    )


class Profile:
    """The tables of the exploratory report of a dataset, each made when it is asked for.

    ``counts``, written once, holds the different values of all columns by class: one scan, from which most tables come.
    Only what relates columns with each other (correlations, information, principal components, distances) reads rows again.
    """

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, rules: Mapping[str, str] | None = None, cls: str | None = None, key: str | None = None):
        self.df, self.numeric, self.categorical, self.target, self.rules, self.cls, self.key = df, list(numeric), list(categorical), target, rules or {}, cls, key
        self.others = [c for c in self.numeric if c != target]

    @cached_property
    def by_class(self) -> DataFrame:
        return staged(counted.counted(self.df, self.numeric, self.categorical, self.cls), "class-counts")

    @cached_property
    def counts(self) -> DataFrame:
        return staged(counted.without_key(self.by_class), "value-counts")

    def executive(self) -> DataFrame:
        """(metric, value): rows, repeated rows, mean missing share, class imbalance."""
        twice = stats.duplicates(self.df.select(self.key) if self.key else self.df)
        return (
            _metric("rows", twice, "n_rows")
            .unionByName(_metric("duplicates", twice, "n_duplicates"))
            .unionByName(_metric("mean_missing_pct", counted.missing(self.counts).agg(F.avg("missing_pct").alias("x")), "x"))
            .unionByName(_metric("imbalance_ratio", counted.class_balance(self.counts, self.cls).agg(F.max("imbalance_ratio").alias("x")), "x"))
        )

    def table(self, name: str) -> DataFrame:
        return self.makers()[name]()

    def makers(self) -> dict[str, Callable[[], DataFrame]]:
        """Name -> what makes the table."""
        numbers = lambda: self.counts.where(F.col("feature").isin(self.numeric))
        df, others, target = self.df, self.others, self.target
        out: dict[str, Callable[[], DataFrame]] = {
            "summary": lambda: counted.numeric_summary(self.counts),
            "describe": lambda: counted.describe(self.counts),
            "shape": lambda: counted.shape(self.counts),
            "zero_missing": lambda: counted.zero_missing_profile(numbers()),
            "groups": lambda: stats.group_profile(counted.zero_missing_profile(numbers()), self.rules),
            "missing": lambda: counted.missing(self.counts),
            "cardinality": lambda: counted.cardinality(self.counts),
            "mode": lambda: counted.mode_frequency(self.counts),
            "outliers": lambda: counted.iqr_outliers(self.counts),
            "histograms": lambda: counted.histograms(self.counts),
            "duplicates": lambda: stats.duplicates(df),
            "scale_dispersion": lambda: stats.describe(staged(counted.numeric_summary(self.counts), "summary"), ["std_value", "iqr"]),
            "target_correlation": lambda: stats.target_correlation(df, target, others),
            "correlation_pairs": lambda: stats.correlation_pairs(df, others, "spearman", 0.85),
            "mutual_information": lambda: stats.binned_mutual_information(df, others, target, bin_target=True),
            "pca": lambda: matrix.pca_variance(df.na.drop(subset=others), others),
            "components": lambda: matrix.components_needed(self.table("pca")),
            "manifest": lambda: stats.manifest(df, target),
        }
        out |= {f"distribution_{c}": lambda c=c: counted.distribution(self.counts, c) for c in self.categorical}
        if self.cls:
            out |= {"five_numbers": lambda: counted.five_numbers(self.by_class), "anova": lambda: counted.anova_f(self.by_class), "kruskal": lambda: stats.with_p_values(counted.kruskal_h(self.by_class))}
            if self.cls in self.categorical:
                out["class_balance"] = lambda: counted.class_balance(self.counts, self.cls)
                out["executive"] = self.executive
        if self.key:
            out["distances"] = lambda: matrix.distance_outliers(df.na.drop(subset=others), self.key, others)
        return out


def profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, rules: Mapping[str, str] | None = None, cls: str | None = None, key: str | None = None) -> dict[str, DataFrame]:
    """All tables of the exploratory report of a dataset with a numeric target: those of ``Profile``. ``cls`` adds those by class, ``key`` the distances."""
    return {name: make() for name, make in Profile(df, numeric, categorical, target, rules, cls, key).makers().items()}


def raw_audit(entities: DataFrame, numeric: Sequence[str], categorical: Sequence[str], members: DataFrame, group: str, association: str, key: str) -> dict[str, DataFrame]:
    """The audit of flattened documents: summaries, distributions, gaps, group sizes, warnings and the grade."""
    distributions = {c: stats.categorical_distribution(entities, c) for c in categorical}
    gaps = stats.missing(entities, [*numeric, *categorical])
    sizes = stats.group_sizes(members, group)
    totals = stats.association_totals(entities, key, association)
    dominance = None
    for d in distributions.values():
        one = d.agg((100 * F.max("share")).alias("x"))
        dominance = one if dominance is None else dominance.unionByName(one)
    metrics = stats.with_row(stats.with_row(stats.with_row(
        totals.select("n_rows", (100 * F.col("n_without") / F.nullif("n_rows", F.lit(0))).alias("without_group")),
        gaps.agg(F.avg("missing_pct").alias("mean_missing_pct"))), dominance.agg(F.max("x").alias("dominance"))),
        sizes.select((100 * F.col("top1_share")).alias("top1")))
    return {"numeric": stats.numeric_summary(entities, numeric), "missing": gaps, "sizes": sizes, "totals": totals, "warnings": stats.warnings(distributions, gaps, sizes, totals), "grade": stats.coverage_grade(metrics)} | {f"distribution_{c}": d for c, d in distributions.items()}
