"""The audit of raw documents: one pass over the texts gives counted facts, and every table of the audit comes from those.

A fact is (table, feature, text, value): a file that was read, a field of an object with its value or without one, the
group that an object belongs to, its key. Facts are counted where they are made, so what is shuffled are the different
ones; counts of batches of files add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions import safe_ratio
from tarnfield.operators import counted, stats
from tarnfield.sources.documents import get, is_object
from tarnfield.staging import staged

Fields = Mapping[str, tuple[str, str]]
FACT = "array<struct<table:string,feature:string,text:string,value:double>>"


def _fact(table: str, feature: str, text: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(table).alias("table"), F.lit(feature).alias("feature"), (none if text is None else text).cast("string").alias("text"), (none if value is None else value).cast("double").alias("value"))


def document_facts(texts: DataFrame, fields: Fields, numeric: Sequence[str], categorical: Sequence[str], key: str, group: str | None = None, association: str | None = None, items: str | None = None, text_col: str = "value") -> DataFrame:
    """(table, feature, text, value, n) of documents: file counters and, of each object in them, its fields, group, association and key.

    An object stands alone in its text or, with others, in a list. ``items`` is the path of a list inside an object: then its
    objects count, and an object without that list is one itself if it has the path ``$.tag``; a text without any is empty.
    Texts that do not parse are corrupt, those of another shape are not objects.
    """
    v = F.col("_v")
    whole = F.filter(get(v, "$", "array<variant>"), is_object)
    if items:
        held = F.filter(get(v, items, "array<variant>"), is_object)
        objects = F.coalesce(held, whole, F.when(is_object(v) & get(v, "$.tag", "string").isNotNull(), F.array(v)))
    else:
        objects = F.coalesce(whole, F.when(is_object(v), F.array(v)))
    parsed = texts.select(F.try_parse_json(F.col(text_col)).alias("_v")).withColumn("_objects", objects)
    state = F.when(v.isNull(), "corrupt").when(F.col("_objects").isNull() & ~is_object(v), "not an object").otherwise("valid")
    empty = F.lit(bool(items)) & (state == "valid") & (F.coalesce(F.size("_objects"), F.lit(0)) <= 0)
    files = F.filter(F.array(_fact("files", "read"), F.struct(F.lit("files").alias("table"), state.alias("feature"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("value")), F.when(empty, _fact("files", "empty"))), lambda x: x.isNotNull())

    def of_object(o: Column) -> Column:
        at = lambda c: get(o, *fields[c])
        facts = [*[_fact("numeric", c, value=at(c)) for c in numeric], *[_fact("category", c, text=at(c)) for c in categorical], _fact("key", key, text=at(key))]
        if group:
            facts.append(_fact("group", group, text=at(group)))
        if association:
            facts.append(_fact("association", association, text=F.when(at(association).isNotNull(), "with").otherwise("without")))
        return F.array(*facts)

    own = F.coalesce(F.flatten(F.transform("_objects", of_object)), F.array().cast(FACT))
    return parsed.select(F.inline(F.concat(files, own))).groupBy("table", "feature", "text", "value").agg(F.count(F.lit(1)).alias("n"))


class Audit:
    """The tables of an audit, from facts that are written once."""

    def __init__(self, facts: DataFrame, categorical: Sequence[str], group: str | None = None, association: str | None = None, locations: Sequence[str] = ("location",)):
        self.facts = staged(facts, "facts")
        self.categorical, self.group, self.association, self.locations = list(categorical), group, association, locations

    def _of(self, *tables: str) -> DataFrame:
        return self.facts.where(F.col("table").isin(list(tables))).select("feature", "value", "text", "n")

    def counters(self, metrics: Sequence[str] = ("read", "valid", "corrupt", "not an object", "empty")) -> DataFrame:
        """(metric, n); 0 for what did not occur."""
        every = self.facts.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
        found = self._of("files").select(F.col("feature").alias("metric"), "n")
        return every.join(F.broadcast(found), "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n"))

    def numeric(self) -> DataFrame:
        return counted.numeric_summary(self._of("numeric"))

    def missing(self) -> DataFrame:
        return counted.missing(self._of("numeric", "category"))

    def distribution(self, c: str) -> DataFrame:
        return counted.distribution(self._of("category"), c)

    def concentration(self, c: str) -> DataFrame:
        """As ``stats.concentration``."""
        own = self.distribution(c)
        p = F.col("share")
        out = own.agg(F.count(F.lit(1)).alias("n_values"), F.sum(p * p).alias("hhi"), (-F.sum(p * F.ln(p))).alias("entropy"))
        return out.withColumn("normalised_entropy", F.when(F.col("n_values") > 1, F.col("entropy") / F.ln("n_values")).otherwise(F.lit(0.0)))

    def binned(self, c: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
        """As ``stats.binned`` of a numeric field."""
        return stats.binned(self._of("numeric").where(F.col("feature") == c), "value", edges, labels, "n")

    def sizes(self) -> DataFrame:
        """As ``stats.group_sizes``."""
        return stats.size_summary(self._of("group").where(F.col("text").isNotNull()).select(F.col("text").alias("group"), "n"), "group")

    def totals(self) -> DataFrame:
        """As ``stats.association_totals``."""
        has = self._of("association").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), *[F.coalesce(F.sum(F.when(F.col("text") == w, F.col("n"))), F.lit(0)).alias(f"n_{w}") for w in ("with", "without")])
        keys = self._of("key").agg(F.count("text").alias("n_keys"))
        return stats.with_row(has, keys).select("n_rows", "n_keys", "n_with", "n_without")

    def warnings(self) -> DataFrame:
        sizes, totals = (self.sizes() if self.group else None), (self.totals() if self.association else None)
        return stats.warnings({c: self.distribution(c) for c in self.categorical}, self.missing(), sizes, totals, self.locations)

    def grade(self) -> DataFrame:
        """One row: the metrics and the grade of the coverage."""
        text = self._of("category").where(F.col("text").isNotNull())
        dominance = text.groupBy("feature").agg((100 * safe_ratio(F.max("n"), F.sum("n"))).alias("x")).agg(F.max("x").alias("dominance"))
        totals, sizes = self.totals(), self.sizes()
        metrics = totals.select("n_rows", (100 * safe_ratio("n_without", "n_rows")).alias("without_group"))
        for one in (self.missing().agg(F.avg("missing_pct").alias("mean_missing_pct")), dominance, sizes.select((100 * F.col("top1_share")).alias("top1"))):
            metrics = stats.with_row(metrics, one)
        return stats.coverage_grade(metrics)
