"""JSON documents: one object (or list of objects) per file, read whole and flattened without inferring a schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: out column -> (path in the document, type)
Mapping_ = Mapping[str, tuple[str, str]]


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def parse_documents(texts: DataFrame, text_col: str = "value", lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with column v, rejected rows). Strict: an object per text. Lenient: a list gives a row per object in it."""
    # a generator of one row: filters on v and its fields are not pushed below it, where each would make and parse the text again
    parsed = texts.select("*", F.explode(F.array(F.try_parse_json(F.col(text_col)))).alias("v"))
    corrupt = parsed.where(F.col("v").isNull()).withColumn("reason", F.lit("corrupt"))
    if not lenient:
        good = parsed.where(F.col("v").isNotNull() & is_object(F.col("v")))
        odd = parsed.where(F.col("v").isNotNull() & ~is_object(F.col("v"))).withColumn("reason", F.lit("not an object"))
        return good.drop(text_col), corrupt.unionByName(odd).drop("v")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = parsed.where(F.col("v").isNotNull()).select(*[c for c in parsed.columns if c not in (text_col, "v")], F.posexplode(items).alias("pos", "v"))
    return rows.where(is_object(F.col("v"))), corrupt.drop("v")


def read_documents(spark: SparkSession, path: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """``parse_documents`` of all .json files of a folder, with key_from_file, the decoded file name without its suffix."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    name = F.url_decode(F.col("_metadata.file_name"))
    return parse_documents(texts.select("value", F.regexp_replace(name, r"\.json$", "").alias("key_from_file")), "value", lenient)


def get(v: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def flatten(docs: DataFrame, mapping: Mapping_, keep: tuple[str, ...] = (), v: str = "v") -> DataFrame:
    """One column per mapping entry; what is missing or of another type is null."""
    return docs.select(*keep, *[get(v, path, kind).alias(out) for out, (path, kind) in mapping.items()])


def explode_objects(docs: DataFrame, path: str, mapping: Mapping_, keep: tuple[str, ...] = (), pos: str = "pos", v: str = "v") -> DataFrame:
    """One row per object of the list at ``path``. A list with anything but objects in it is rejected as a whole."""
    items = get(v, path, "array<variant>")
    clean = F.when(F.forall(items, is_object), items)
    rows = docs.select(*keep, F.posexplode(clean).alias(pos, "_item"))
    return flatten(rows, mapping, (*keep, pos), "_item")


def member_items(docs: DataFrame, path: str = "$.items", keep: tuple[str, ...] = ("key_from_file",), v: str = "v") -> DataFrame:
    """Items of files of three shapes: ``{"items": [...]}``, one object with a tag, a bare list. Item null: an empty file."""
    whole = get(v, "$", "array<variant>")
    single = F.when(get(v, "$.tag", "string").isNotNull(), F.array(F.col(v)))
    found = F.coalesce(get(v, path, "array<variant>"), whole, single)
    return docs.select(*keep, F.posexplode_outer(F.filter(found, is_object)).alias("pos", "item"))


def file_counters(docs: DataFrame, rejected: DataFrame, items: DataFrame | None = None, key: str = "key_from_file") -> DataFrame:
    """(metric, n): files read, corrupt, valid and, of ``items``, empty."""
    one = lambda df, name, cond=None: df.agg(F.lit(name).alias("metric"), (F.count_if(cond) if cond is not None else F.count(F.lit(1))).alias("n"))
    valid, corrupt = one(docs, "valid"), one(rejected, "corrupt")
    out = one(docs.select(key).unionByName(rejected.select(key)), "read").unionByName(valid).unionByName(corrupt)
    return out if items is None else out.unionByName(one(items, "empty", F.col("item").isNull()))
