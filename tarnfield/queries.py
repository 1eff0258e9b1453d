"""Registered queries of the general operators over the star-schema tables, each beside its DuckDB SQL.

Floats are rounded on both sides. The roles of the tables: orders with their lineitems stand for entities with child
rows, nations with customers (or customers with orders) for groups with members, order states for wins and losses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield import functions as fn
from tarnfield.operators import clean, features, matrix, order, relations, select, stats
from tarnfield.plans import candidates, datasets, profile
from tarnfield.plans import schemas as S
from tarnfield.session import table
from tarnfield.sources import documents as docs_io
from tarnfield.sources import tables as tables_io
from tarnfield.staging import staged
from tarnfield.streaming import state

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL of the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0."""
    doubles = cols or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


# entity features ----------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("max_level", F.round(F.col("l_tax") * 100))


_CHILD = """SELECT l_orderkey, count(*) AS line_count, coalesce(sum(l_quantity), 0) / count(*) AS line_mean_level,
  avg(l_quantity / nullif(round(l_tax * 100), 0)) AS line_mean_completion_ratio FROM lineitem GROUP BY l_orderkey"""


@query(f"""
WITH c AS ({_CHILD}),
v AS (SELECT l_orderkey, count(*) AS sale_count, avg(l_discount / nullif(l_tax, 0)) AS sale_completion_ratio FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey,
  round(coalesce(o_custkey / nullif(o_totalprice, 0), 0), 6) AS price_ratio, CAST(coalesce(line_count, 0) AS DOUBLE) AS line_count,
  round(coalesce(line_mean_level, 0), 6) AS line_mean_level, round(coalesce(line_mean_completion_ratio, 0), 6) AS line_mean_completion_ratio,
  CAST(coalesce(sale_count, 0) AS DOUBLE) AS sale_count, round(coalesce(sale_completion_ratio, 0), 6) AS sale_completion_ratio
FROM orders LEFT JOIN c ON o_orderkey = c.l_orderkey LEFT JOIN v ON o_orderkey = v.l_orderkey
""")
def entity_features(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: orders with aggregates of their lines, ratios guarded, gaps filled with 0."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    lines = _lines(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    progress = features.child_aggregate(lines, "o_orderkey", "line", "l_quantity", "max_level")
    sales = features.child_aggregate(lines, "o_orderkey", "sale", None, None, value=("l_discount", "l_tax"))
    return rounded(features.entity_features(base, "o_orderkey", [progress, sales], {"price_ratio": fn.safe_ratio("o_custkey", "o_totalprice")}))


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS row_count, coalesce(sum(l_quantity), 0) AS sum_level, coalesce(sum(l_quantity / nullif(round(l_tax * 100), 0)), 0) AS sum_ratio,
  count(l_quantity / nullif(round(l_tax * 100), 0)) AS count_ratio FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, row_count AS line_count, round(sum_level / row_count, 6) AS line_mean_level, round(sum_ratio / nullif(count_ratio, 0), 6) AS line_mean_completion_ratio FROM s
""")
def merged_states(spark: SparkSession, sf: str) -> DataFrame:
    """Mergeable states of two batches, merged and finalised."""
    lines = _lines(spark, sf)
    batches = [features.partial_state(lines.where(F.col("l_linenumber") % 2 == k), "l_orderkey", "l_quantity", "max_level") for k in (0, 1)]
    return rounded(features.finalize_state(features.merge_states(*batches, key="l_orderkey"), "l_orderkey", "line"))


@query("""
SELECT l_suppkey, count(*) AS part_count, round(avg(l_quantity), 6) AS part_mean_level, round(avg(l_quantity / nullif(round(l_tax * 100), 0)), 6) AS part_mean_completion_ratio
FROM lineitem GROUP BY l_suppkey
""")
def child_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean level and mean completion per supplier, null levels skipped."""
    return rounded(features.child_aggregate(_lines(spark, sf), "l_suppkey", "part", "l_quantity", "max_level", null_level="skip"))


# group-relative features and compositions ---------------------------------------------------------------------------


@query("""
WITH w AS (SELECT c_custkey, c_nationkey, c_acctbal, avg(c_acctbal) OVER g AS m, count(c_acctbal) OVER g AS n,
  rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey, c_acctbal) AS t
  FROM customer WINDOW g AS (PARTITION BY c_nationkey))
SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, round(m, 6) AS group_mean_c_acctbal, round(c_acctbal - m, 6) + 0.0 AS c_acctbal_diff_from_group_mean,
  round(coalesce(c_acctbal / nullif(m, 0), 0), 6) + 0.0 AS c_acctbal_ratio_to_group_mean, round((r + (t - 1) / CAST(2 AS DOUBLE)) / n, 6) AS c_acctbal_group_pct FROM w
""")
def group_relative(spark: SparkSession, sf: str) -> DataFrame:
    """Difference, ratio and tie-averaged percentile of a balance within the nation."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(features.group_relative(rows, "c_nationkey", ["c_acctbal"], ["c_acctbal"], emit_means=True))


@query("""
SELECT c_nationkey, count(*) AS member_count, round(avg(c_acctbal), 6) AS mean_c_acctbal, round(quantile_cont(c_acctbal, 0.5), 6) AS median_c_acctbal, round(stddev_samp(c_acctbal), 6) AS std_c_acctbal,
  round(avg(CAST(c_custkey AS DOUBLE)), 6) AS mean_c_custkey, round(avg(CASE WHEN c_acctbal >= 5000 THEN 1.0 ELSE 0.0 END), 6) AS rich_share, round(sum(c_acctbal), 2) AS sum_c_acctbal
FROM customer GROUP BY c_nationkey
""")
def group_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median, deviation, shares, sums and size per nation, in one aggregate."""
    out = features.group_composition(table(spark, sf, "customer"), "c_nationkey", ["c_acctbal"], ["c_custkey"], {"rich_share": F.col("c_acctbal") >= 5000}, ["c_acctbal"])
    return rounded(rounded(out, ["sum_c_acctbal"], 2))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(state("F").alias("wins"), state("O").alias("losses"), state("P").alias("ties"))


_HISTORY = "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses, count(*) FILTER (o_orderstatus = 'P') AS ties FROM orders GROUP BY o_custkey"
_RATES = f"SELECT *, wins / CAST(wins + losses + ties AS DOUBLE) AS win_rate FROM ({_HISTORY}) WHERE wins + losses + ties >= 5"


@query(f"SELECT o_custkey, wins, losses, ties, round(win_rate, 6) AS win_rate FROM ({_RATES})")
def rate_target(spark: SparkSession, sf: str) -> DataFrame:
    """Success rate of customers with a history of five orders or more."""
    return rounded(features.rate_target(_history(spark, sf), "wins", ["wins", "losses", "ties"], 5, "win_rate"))


@query(f"""
WITH r AS ({_RATES}), q AS (SELECT quantile_cont(win_rate, 1.0 / 3) AS lo, quantile_cont(win_rate, 2.0 / 3) AS hi FROM r)
SELECT o_custkey, CASE WHEN win_rate < lo THEN 'low' WHEN win_rate < hi THEN 'medium' ELSE 'high' END AS performance_class FROM r, q WHERE win_rate BETWEEN 0 AND 1
""")
def performance_class(spark: SparkSession, sf: str) -> DataFrame:
    """Terciles of the success rate as classes; the columns that would give them away are dropped."""
    rates, _ = features.valid_rates(features.rate_target(_history(spark, sf), "wins", ["wins", "losses", "ties"], 5, "win_rate"), "win_rate")
    low, high = select.cutoffs(rates, "win_rate")
    classed = rates.withColumn("performance_class", fn.between("win_rate", low, high))
    return select.drop_present(classed, ["wins", "losses", "ties", "win_rate"])


@query(f"""
WITH q AS (SELECT win_rate FROM ({_RATES}))
SELECT count(*) FILTER (win_rate >= 0.2 AND win_rate <= 0.8) AS n_kept, count(*) FILTER (NOT (win_rate >= 0.2 AND win_rate <= 0.8)) AS n_dropped FROM q
""")
def valid_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a range check keeps and drops."""
    return features.valid_rates(features.rate_target(_history(spark, sf), "wins", ["wins", "losses", "ties"], 5, "win_rate"), "win_rate", 0.2, 0.8)[1]


# rows, fills, columns -----------------------------------------------------------------------------------------------

_LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) = 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each (order, line number) in a full order."""
    return clean.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_SPARSE = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_tax, 0) AS tax, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_quantity > 10 THEN l_quantity > 25 END AS large FROM lineitem"


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 10, F.col("l_quantity") > 25).alias("large"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(tax, 0), 6) AS tax, coalesce(flag, 'unknown') AS flag, coalesce(large, false) AS large FROM ({_SPARSE})")
def typed_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls filled by type."""
    return rounded(clean.typed_fill(_sparse(spark, sf), ["l_orderkey"]))


@query(f"SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_partkey AS DOUBLE) AS l_partkey, round(coalesce(tax, 0), 6) AS tax, coalesce(TRY_CAST(flag AS DOUBLE), 0) AS flag FROM ({_SPARSE})")
def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """All but the key as doubles, 0 for what is missing or no number."""
    return rounded(clean.zero_fill(_sparse(spark, sf).drop("large"), ["l_orderkey"]))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM ({_SPARSE}))), 6) AS tax FROM ({_SPARSE})")
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Missing taxes filled with the median; a column of nulls is dropped."""
    rows = _sparse(spark, sf).select("l_orderkey", "l_linenumber", "tax").withColumn("void", F.lit(None).cast("double"))
    return rounded(clean.median_impute(rows, ["tax", "void"])[0])


@query("SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def join_keep_left(spark: SparkSession, sf: str) -> DataFrame:
    """Left join in which the left side's columns win."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"), "c_name", "c_mktsegment")
    return select.join_keep_left(orders, customers, ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem")
def banned_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Leaking columns banned by name and prefix, by substring, and a whitelist of what may stay."""
    rows = select.ban(table(spark, sf, "lineitem"), ["l_tax", "l_extendedprice"])
    return rounded(select.whitelist(select.exclude(rows, ["l_partkey"], ["DATE", "flag", "status"]), ["l_orderkey", "l_linenumber", "l_quantity", "l_absent"]))


_ONLY = {"left": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), "right": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{side}' AS side, count({c}) AS n_values FROM {t}" for side, (t, cols) in _ONLY.items() for c in cols))
def column_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that only one of two tables has, with the number of their values."""
    return select.column_difference(table(spark, sf, "customer"), table(spark, sf, "orders"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_tax, 0) AS tax FROM lineitem), f AS (SELECT l_orderkey, min(l_quantity) AS l_quantity, max(tax) AS tax FROM b GROUP BY l_orderkey)
SELECT l_orderkey, round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM f)), 6) AS l_quantity, round(coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM f)), 6) AS tax FROM f
""")
def clustering_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric whitelist of one row per key, median-imputed."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("l_quantity"), F.max(F.nullif("l_tax", F.lit(0.0))).alias("tax"), F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("price_rank"))
    return rounded(select.clustering_matrix(rows, "l_orderkey", ["l_quantity", "tax", "flag", "price_rank", "absent"], substrings=["RANK"])[0])


@query("""
WITH f AS (SELECT l_orderkey, max(nullif(l_tax, 0)) AS tax FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n_rows, 5 AS n_requested, 3 AS n_available, 2 AS n_missing, 1 AS n_non_numeric, 0 AS n_all_null, count(*) FILTER (tax IS NULL) AS n_imputed FROM f
""")
def clustering_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the clustering matrix chose, dropped and imputed."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("l_quantity"), F.max(F.nullif("l_tax", F.lit(0.0))).alias("tax"), F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("price_rank"))
    return select.clustering_matrix(rows, "l_orderkey", ["l_quantity", "tax", "flag", "price_rank", "absent"], substrings=["RANK"])[1]


# scalar expressions -------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, '#' || trim(p_brand) AS tag, CASE WHEN p_size % 7 = 0 THEN '#' || p_brand ELSE '#' || p_partkey END AS key, p_brand || '|' || p_type AS composite,
  round(ln(1 + p_retailprice), 6) AS log_price, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%copper%' THEN 'alloy' ELSE 'other' END AS concept,
  CASE WHEN p_size / 50.0 < 0.3 THEN 'low' WHEN p_size / 50.0 < 0.6 THEN 'medium' ELSE 'high' END AS size_class
FROM part
""")
def scalar_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Tags, key fallbacks, composite keys, logarithms, name groups and thresholds."""
    part = table(spark, sf, "part")
    nested = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("#"), "p_brand"))
    file_name = F.concat(F.lit("#"), F.col("p_partkey").cast("string"), F.lit("__part.json"))
    return rounded(part.select(
        "p_partkey", fn.normalize_tag(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("tag"), fn.fallback_key(nested, F.lit(""), file_name).alias("key"),
        fn.composite_key("p_brand", "p_type").alias("composite"), F.log1p("p_retailprice").alias("log_price"), fn.concept("p_type", {"metal": "steel", "alloy": "brass|copper"}).alias("concept"),
        fn.classify(F.col("p_size") / F.lit(50.0), 0.3, 0.6).alias("size_class"),
    ))


@query("SELECT e.event_id, 'event_type=' || event_type || ';k_value=' || CAST(json_extract(props, '$.k') AS VARCHAR) AS print FROM events e")
def map_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Maps with renamed keys and null entries, as texts that do not depend on the entries' order."""
    entries = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("eventType"), F.col("event_type"), F.lit("gone"), F.lit(None).cast("string")))
    return table(spark, sf, "events").select("event_id", fn.map_fingerprint(fn.rename_keys(entries, {"k": "k_value", "eventType": "event_type"})).alias("print"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS segment_code FROM customer")
def encode_category(spark: SparkSession, sf: str) -> DataFrame:
    """Categories as whole numbers in the order of their values."""
    return stats.encode_category(table(spark, sf, "customer"), "c_mktsegment", "segment_code").select("c_custkey", "segment_code")


# JSON documents -----------------------------------------------------------------------------------------------------


def _order_documents(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct(F.col("l_partkey").alias("name"), F.col("l_quantity").alias("level"), F.col("l_linenumber").alias("rank"))
    every = table(spark, sf, "lineitem")
    parted = order.dealt(every, every.count(), "l_orderkey")  # no task collects more lines than TASK_ROWS or so, at any size of the table
    lines = parted.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))
    rows = table(spark, sf, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    texts = rows.select(F.col("o_orderkey").alias("key_from_file"), F.to_json(F.struct(F.col("o_orderkey").alias("tag"), F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name")).alias("owner"), "items")).alias("value"))
    return docs_io.parse_documents(texts)[0]


@query("""SELECT o_orderkey AS tag, o_custkey AS owner_id, o_orderstatus AS owner_name, '{"id": ' || o_custkey || ', "name": "' || o_orderstatus || '"}' AS owner_json,
'{"a, b": [' || o_custkey || ', {"x": "\\u00e9: ' || o_orderstatus || '", "y": null}], "z": true}' AS nested_json FROM orders""")
def flatten_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested objects of parsed documents as columns, one of them as canonical text."""
    docs = _order_documents(spark, sf).withColumn("owner", docs_io.get("v", "$.owner", "variant"))
    flat = docs_io.flatten(docs, {"tag": ("$.tag", "bigint"), "owner_id": ("$.owner.id", "bigint"), "owner_name": ("$.owner.name", "string")}, ("owner",))
    nested = F.concat(F.lit('{"z":true,"a, b":['), F.col("owner_id").cast("string"), F.lit(',{"y":null,"x":"\u00e9: '), "owner_name", F.lit('"}]}'))
    return flat.select("tag", "owner_id", "owner_name", fn.canonical_json("owner").alias("owner_json"), fn.canonical_json(F.parse_json(nested)).alias("nested_json"))


@query("SELECT l_orderkey AS key_from_file, l_partkey AS item_name, round(l_quantity, 6) AS level, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def explode_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of objects in documents as child rows."""
    rows = docs_io.explode_objects(_order_documents(spark, sf), "$.items", {"item_name": ("$.name", "bigint"), "level": ("$.level", "double")}, ("key_from_file",))
    return rounded(rows.groupBy("key_from_file", "item_name", "level").agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT 'read' AS metric, count(*) AS n FROM events UNION ALL SELECT 'valid', count(*) FILTER (event_id % 10 <> 3) FROM events
UNION ALL SELECT 'corrupt', count(*) FILTER (event_id % 10 = 3) FROM events UNION ALL SELECT 'empty', count(*) FILTER (event_id % 10 = 4) FROM events
""")
def document_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Files read, corrupt, valid and empty, over members in three shapes."""
    kind = F.col("event_id") % 10
    one = F.concat(F.lit('{"tag":'), F.col("event_id").cast("string"), F.lit("}"))
    value = F.when(kind == 3, "{broken").when(kind == 4, '{"items":[]}').when(kind == 5, F.concat(F.lit("["), one, F.lit("]"))).when(kind == 6, one).otherwise(F.concat(F.lit('{"items":['), one, F.lit(","), one, F.lit("]}")))
    good, bad = docs_io.parse_documents(table(spark, sf, "events").select(F.col("event_id").alias("key_from_file"), value.alias("value")), lenient=False)
    lists, _ = docs_io.parse_documents(table(spark, sf, "events").where(kind == 5).select(F.col("event_id").alias("key_from_file"), value.alias("value")), lenient=True)
    whole = good.unionByName(lists.drop("pos"))
    return docs_io.file_counters(whole, bad.where("reason = 'corrupt'"), docs_io.member_items(whole))


# audit --------------------------------------------------------------------------------------------------------------

_AUDIT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem"


@query(f"""
SELECT feature, count(x) AS n, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value, round(avg(x), 4) AS mean_value, round(stddev_samp(x), 4) AS std_value,
  round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.95), 4) AS p95,
  round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr, round(stddev_samp(x) / nullif(avg(x), 0), 4) AS cv FROM ({_LONG}) GROUP BY feature
""")
def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of numeric columns with exact percentiles."""
    return rounded(stats.numeric_summary(table(spark, sf, "lineitem"), _AUDIT_COLS), digits=4)


@query("""
SELECT feature, count(x) AS n, round(avg(x), 4) AS mean_value, round(stddev_samp(x), 4) AS std_value, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value,
  round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
  round(quantile_cont(x, 0.01), 4) AS p1, round(quantile_cont(x, 0.05), 4) AS p5, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99
FROM (SELECT 'value' AS feature, value AS x FROM events UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) GROUP BY feature
""")
def describe(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles and tails."""
    return rounded(stats.describe(table(spark, sf, "events"), ["value", "user_id"]), digits=4)


@query("""
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand)
SELECT value, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share, row_number() OVER (ORDER BY n DESC, value) = 1 AS is_dominant, n / CAST(sum(n) OVER () AS DOUBLE) < 0.01 AS is_rare FROM c
""")
def categorical_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Values with counts and shares, the dominant and the rare ones marked."""
    return rounded(stats.categorical_distribution(table(spark, sf, "part"), "p_brand"))


@query("""
WITH c AS (SELECT count(*) AS n FROM part GROUP BY p_type), p AS (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM c)
SELECT count(*) AS n_values, round(sum(p * p), 6) AS hhi, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalised_entropy FROM p
""")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Herfindahl index and entropy of part types."""
    return rounded(stats.concentration(table(spark, sf, "part"), "p_type"))


@query(f"""
SELECT 'tax' AS feature, count(*) FILTER (tax IS NULL) AS n_missing, round(100.0 * count(*) FILTER (tax IS NULL) / count(*), 6) AS missing_pct FROM ({_SPARSE})
UNION ALL SELECT 'flag', count(*) FILTER (flag IS NULL), round(100.0 * count(*) FILTER (flag IS NULL) / count(*), 6) FROM ({_SPARSE})
UNION ALL SELECT 'large', count(*) FILTER (large IS NULL), round(100.0 * count(*) FILTER (large IS NULL) / count(*), 6) FROM ({_SPARSE})
""")
def missing(spark: SparkSession, sf: str) -> DataFrame:
    """Missing counts per field."""
    return rounded(stats.missing(_sparse(spark, sf), ["tax", "flag", "large"]))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM s)
SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median_size, min(n) AS min_size, max(n) AS max_size,
  round(sum(n) FILTER (k <= 1) / CAST(sum(n) AS DOUBLE), 6) AS top1_share, round(sum(n) FILTER (k <= 10) / CAST(sum(n) AS DOUBLE), 6) AS top10_share,
  round(sum(n) FILTER (k <= 50) / CAST(sum(n) AS DOUBLE), 6) AS top50_share, round(sum(n) FILTER (k <= 100) / CAST(sum(n) AS DOUBLE), 6) AS top100_share FROM r
""")
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of groups and what the largest hold."""
    return rounded(stats.group_sizes(table(spark, sf, "orders"), "o_custkey"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(tax) AS n_with, count(*) - count(tax) AS n_without FROM (" + _SPARSE + ")")
def association_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, keys, and rows with and without an association."""
    return stats.association_totals(_sparse(spark, sf), "l_orderkey", "tax")


@query(f"""
WITH t AS (SELECT wins + losses + ties AS n FROM ({_HISTORY})), b(bin, label, lo, hi) AS (VALUES (0, '0', 0, 1), (1, '1', 1, 2), (2, '2-4', 2, 5), (3, '5-9', 5, 10), (4, '10-19', 10, 20), (5, '20+', 20, 1000000000)),
c AS (SELECT bin, label, count(n) AS n FROM b LEFT JOIN t ON n >= lo AND n < hi GROUP BY bin, label)
SELECT CAST(bin AS INT) AS bin, label, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, round(CAST(sum(n) OVER (ORDER BY bin DESC) AS DOUBLE) / sum(n) OVER (), 6) AS share_from FROM c
""")
def binned(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by number of orders in fixed bins, empty ones kept."""
    totals = _history(spark, sf).select((F.col("wins") + F.col("losses") + F.col("ties")).alias("n_orders"))
    return rounded(stats.binned(totals, "n_orders", [0, 1, 2, 5, 10, 20], ["0", "1", "2-4", "5-9", "10-19", "20+"]))


@query(f"""
WITH d AS (SELECT 'status' AS field, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
  UNION ALL SELECT 'priority', max(n) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)),
l AS (SELECT max(n) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linestatus)),
w AS (SELECT 100.0 * count(*) FILTER (flag IS NULL) / count(*) AS pct FROM ({_SPARSE})),
m AS (SELECT 'tax' AS field, 100.0 * count(*) FILTER (tax IS NULL) / count(*) AS pct FROM ({_SPARSE}) UNION ALL SELECT 'flag', 100.0 * count(*) FILTER (flag IS NULL) / count(*) FROM ({_SPARSE}))
SELECT 'dominance' AS rule, field, round(100 * share, 6) AS value FROM d WHERE share > 0.4 UNION ALL SELECT 'missing', field, round(pct, 6) FROM m WHERE pct > 10
UNION ALL SELECT 'location', 'location', round(100 * share, 6) FROM l WHERE share > 0.3 UNION ALL SELECT 'without_group', 'groups', round(pct, 6) FROM w WHERE pct > 30
""")
def audit_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on dominance, locations, missing fields, rows without a group and the largest group."""
    orders, rows = table(spark, sf, "orders"), _sparse(spark, sf)
    found = {"status": stats.categorical_distribution(orders, "o_orderstatus"), "priority": stats.categorical_distribution(orders, "o_orderpriority"), "location": stats.categorical_distribution(table(spark, sf, "lineitem"), "l_linestatus")}
    return rounded(stats.warnings(found, stats.missing(rows, ["tax", "flag"]), stats.group_sizes(orders, "o_custkey"), stats.association_totals(rows, "l_orderkey", "flag")))


# shape, constancy, outliers -----------------------------------------------------------------------------------------


@query(f"""
WITH m AS (SELECT feature, avg(x) AS m FROM ({_LONG}) GROUP BY feature), p AS (SELECT feature, avg((x - m) ^ 3) / pow(avg((x - m) ^ 2), 1.5) AS skew_pop FROM ({_LONG}) JOIN m USING (feature) GROUP BY feature)
SELECT feature, round(skewness(x), 6) + 0.0 AS skew, round(kurtosis(x), 6) + 0.0 AS kurt, round(any_value(skew_pop), 6) + 0.0 AS skew_pop, round(kurtosis_pop(x), 6) + 0.0 AS kurt_pop FROM ({_LONG}) JOIN p USING (feature) GROUP BY feature
""")
def shape(spark: SparkSession, sf: str) -> DataFrame:
    """Skewness and kurtosis, bias-adjusted and of the population."""
    return rounded(stats.shape(table(spark, sf, "lineitem"), _AUDIT_COLS))


_PROFILE = f"""SELECT feature, 100.0 * count(*) FILTER (x = 0) / count(*) AS zero_pct, 100.0 * count(*) FILTER (x IS NULL) / count(*) AS missing_pct, skewness(x) AS skew FROM ({_LONG}) GROUP BY feature"""


@query(f"SELECT feature, round(zero_pct, 6) AS zero_pct, round(missing_pct, 6) AS missing_pct, round(skew, 6) + 0.0 AS skew, CASE WHEN abs(skew) > 1 THEN 'strong' WHEN abs(skew) > 0.5 THEN 'moderate' ELSE 'none' END AS log_advice FROM ({_PROFILE})")
def zero_missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Zeros, gaps and skewness of each column."""
    return rounded(stats.zero_missing_profile(table(spark, sf, "lineitem"), _AUDIT_COLS))


@query(f"SELECT CASE WHEN feature = 'l_extendedprice' THEN 'money' WHEN feature IN ('l_tax', 'l_discount') THEN 'rate' ELSE 'other' END AS concept, count(*) AS n_features, round(avg(missing_pct), 6) AS mean_missing_pct, round(avg(zero_pct), 6) AS mean_zero_pct, round(avg(abs(skew)), 6) AS mean_abs_skew FROM ({_PROFILE}) GROUP BY 1")
def group_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The same by conceptual group of the columns' names."""
    return rounded(stats.group_profile(stats.zero_missing_profile(table(spark, sf, "lineitem"), _AUDIT_COLS), {"money": "price", "rate": "tax|discount"}))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows beyond the first of equal ones."""
    return stats.duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(f"""
WITH c AS (SELECT feature, x, count(*) AS n FROM ({_LONG}) GROUP BY feature, x), t AS (SELECT feature, max(n) AS mode_n, sum(n) AS n FROM c GROUP BY feature), v AS (SELECT feature, var_samp(x) AS v FROM ({_LONG}) GROUP BY feature)
SELECT feature, mode_n, round(mode_n / CAST(n AS DOUBLE), 6) AS mode_share, mode_n / CAST(n AS DOUBLE) >= 0.95 AS nearly_constant, v = 0 AS zero_variance, v < 1e-6 AS low_variance FROM t JOIN v USING (feature)
UNION ALL SELECT 'flag', max(n), round(max(n) / CAST(sum(n) AS DOUBLE), 6), max(n) / CAST(sum(n) AS DOUBLE) >= 0.95, NULL, NULL FROM (SELECT count(*) AS n FROM ({_SPARSE}) GROUP BY flag)
""")
def mode_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that hardly vary."""
    rows = table(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return rounded(stats.mode_frequency(rows, [*_AUDIT_COLS, "flag"]))


@query("SELECT 'o_orderkey' AS feature, count(DISTINCT o_orderkey) AS n_distinct, count(DISTINCT o_orderkey) > 0.9 * count(*) AS high_cardinality FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) > 0.9 * count(*) FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) > 0.9 * count(*) FROM orders")
def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Different values per column."""
    return stats.cardinality(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(f"""
WITH q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM ({_LONG}) GROUP BY feature)
SELECT feature, round(a - 1.5 * (b - a), 4) AS lower_bound, round(b + 1.5 * (b - a), 4) AS upper_bound, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS n_outliers,
  round(100.0 * count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) / count(x), 4) AS outlier_pct FROM ({_LONG}) JOIN q USING (feature) GROUP BY feature, a, b
""")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside the quartile fences."""
    return rounded(stats.iqr_outliers(table(spark, sf, "lineitem"), _AUDIT_COLS), digits=4)


@query("""
WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, CAST(sum(n) OVER () AS DOUBLE) AS s, max(n) OVER () AS hi, min(n) OVER () AS lo FROM c)
SELECT class, n, round(100.0 * n / s, 6) AS pct, round(hi / CAST(lo AS DOUBLE), 6) AS imbalance_ratio, CASE WHEN 100 * hi / s > 60 THEN 'high' WHEN 100 * hi / s > 45 THEN 'moderate' ELSE 'low' END AS severity FROM t
""")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Class shares and their imbalance."""
    return rounded(stats.class_balance(table(spark, sf, "orders"), "o_orderstatus"))


# targets, correlations, tests ---------------------------------------------------------------------------------------

_RANKS = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0}) - 1) / CAST(2 AS DOUBLE)"


@query(f"""
WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem),
r AS (SELECT feature, x, y, {_RANKS.format("x")} AS rx, {_RANKS.format("y")} AS ry FROM l)
SELECT feature, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman FROM r GROUP BY feature
""")
def target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman of features with a target."""
    return rounded(stats.target_correlation(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("""
WITH p AS (SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)
SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM p WHERE abs(r) > 0.0001
""")
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of features with a correlation above a threshold."""
    return rounded(stats.correlation_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], threshold=0.0001))


@query("""
WITH r AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + """ FROM lineitem),
p AS (SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, corr(l_quantity, l_extendedprice) AS r FROM r UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM r
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM r)
SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM p WHERE abs(r) > 0.0001
""")
def rank_correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same of ranks."""
    return rounded(stats.correlation_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "spearman", 0.0001))


@query("""
WITH l AS (SELECT 'l_quantity' AS feature, l_returnflag AS c, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_returnflag, l_extendedprice FROM lineitem),
g AS (SELECT feature, c, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY feature, c), w AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM g GROUP BY feature)
SELECT g.feature, round((sum(g.n * (m - gm) ^ 2) / (w.k - 1)) / (sum(g.n * v) / (w.n - w.k)), 4) AS f FROM g JOIN w ON g.feature = w.feature GROUP BY g.feature, w.n, w.k
""")
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    """F of features over classes."""
    return rounded(stats.anova_f(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), digits=4)


_KRUSKAL = """
WITH l AS (SELECT 'l_quantity' AS feature, l_returnflag AS c, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_returnflag, l_discount FROM lineitem),
r AS (SELECT feature, c, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / CAST(2 AS DOUBLE) AS r FROM l),
s AS (SELECT feature, c, sum(r) AS s, count(*) AS k FROM r GROUP BY feature, c), q AS (SELECT feature, sum(s * s / k) AS q, sum(k) AS n, count(*) - 1 AS df FROM s GROUP BY feature),
t AS (SELECT feature, sum(CAST(t AS DOUBLE) ^ 3 - t) AS ties FROM (SELECT feature, x, count(*) AS t FROM l GROUP BY feature, x) GROUP BY feature)
SELECT feature, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ^ 3 - n)) AS h, df FROM q JOIN t USING (feature)
"""


@query(f"SELECT feature, round(h, 4) AS h, df FROM ({_KRUSKAL})")
def kruskal_h(spark: SparkSession, sf: str) -> DataFrame:
    """Rank test of features over classes, corrected for ties."""
    return rounded(stats.kruskal_h(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]), digits=4)


# three classes, so two degrees of freedom: the tail of chi-squared is exp(-h / 2)
@query(f"SELECT feature, round(h, 4) AS h, df, round(exp(-h / 2), 6) AS p, round(2 * exp(-h / 2), 6) AS p_bonferroni FROM ({_KRUSKAL})")
def kruskal_p(spark: SparkSession, sf: str) -> DataFrame:
    """The rank test with its probabilities, corrected for the number of features."""
    tested = stats.with_p_values(stats.kruskal_h(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]))
    return rounded(rounded(tested, ["h"], 4), ["p", "p_bonferroni"])


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lineitem),
r AS (SELECT len(list_filter(q, lambda p: p < l_extendedprice)) AS x, l_returnflag AS y FROM lineitem, q), n AS (SELECT x, y, count(*) AS n FROM r GROUP BY x, y),
p AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM n)
SELECT 'l_extendedprice' AS feature, round(sum(n / CAST(t AS DOUBLE) * ln(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny))), 6) AS mi FROM p
""")
def binned_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual information of a feature's deciles with a class."""
    return rounded(stats.binned_mutual_information(table(spark, sf, "lineitem"), ["l_extendedprice"], "l_returnflag"))


@query("""
WITH x AS (SELECT l_returnflag, ln(1 + l_extendedprice) AS x FROM lineitem), m AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT l_returnflag, CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS INT) AS bucket, count(*) AS n FROM x, m GROUP BY ALL
""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithmic histogram by class."""
    return stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10, log=True, keys=["l_returnflag"])


@query("SELECT l_returnflag, round(min(l_extendedprice), 4) AS min_value, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(max(l_extendedprice), 4) AS max_value FROM lineitem GROUP BY l_returnflag")
def five_number(spark: SparkSession, sf: str) -> DataFrame:
    """Box-plot data by class."""
    return rounded(stats.five_number(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), digits=4)


# proxies ------------------------------------------------------------------------------------------------------------


def _ranked_orders(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_custkey", "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("target"), "o_totalprice", "quantity", "n_lines", (F.col("o_orderkey") * 0 + 1).alias("flat"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_custkey, CAST(epoch(o_orderdate) AS DOUBLE) AS y, o_totalprice, quantity, CAST(n_lines AS DOUBLE) AS n_lines FROM orders JOIN s ON o_orderkey = l_orderkey),
l AS (SELECT o_custkey, y, 'target' AS feature, y AS x FROM o UNION ALL SELECT o_custkey, y, 'o_totalprice', o_totalprice FROM o UNION ALL SELECT o_custkey, y, 'quantity', quantity FROM o UNION ALL SELECT o_custkey, y, 'n_lines', n_lines FROM o),
r AS (SELECT o_custkey, feature, rank() OVER (PARTITION BY o_custkey, feature ORDER BY x) + (count(*) OVER (PARTITION BY o_custkey, feature, x) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY o_custkey, feature ORDER BY y) + (count(*) OVER (PARTITION BY o_custkey, feature, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM l),
g AS (SELECT o_custkey, feature, corr(rx, ry) AS rho FROM r GROUP BY o_custkey, feature HAVING count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1),
a AS (SELECT feature, count(*) AS n_groups, quantile_cont(rho, 0.5) AS m, quantile_cont(abs(rho), 0.9) AS p, avg(CASE WHEN abs(rho) > 0.9 THEN 1.0 ELSE 0.0 END) AS s FROM g GROUP BY feature)
SELECT feature, n_groups, round(s, 3) AS share_above, CASE WHEN abs(m) >= 0.95 AND s >= 0.8 THEN 'TOO_DIRECT' WHEN abs(m) >= 0.8 OR s >= 0.5 THEN 'POTENTIAL PROXY' ELSE 'SAFE' END AS classification FROM a
UNION ALL SELECT 'flat', 0, NULL, 'INSUFFICIENT_DATA'
""")
def proxy_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Variables that stand in for a rank inside groups."""
    out = stats.proxy_audit(_ranked_orders(spark, sf), "o_custkey", "target", ["target", "o_totalprice", "quantity", "n_lines", "flat"])
    return rounded(out.select("feature", "n_groups", "share_above", "classification"), digits=3)


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_custkey, o_totalprice AS y, quantity AS x FROM orders JOIN s ON o_orderkey = l_orderkey),
r AS (SELECT o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY x) + (count(*) OVER (PARTITION BY o_custkey, x) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY o_custkey ORDER BY y) + (count(*) OVER (PARTITION BY o_custkey, y) - 1) / CAST(2 AS DOUBLE) AS ry FROM o)
SELECT o_custkey, 'quantity' AS feature, round(corr(rx, ry), 6) + 0.0 AS rho FROM r GROUP BY o_custkey HAVING count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1
""")
def group_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation inside each group."""
    return rounded(stats.group_spearman(_ranked_orders(spark, sf), "o_custkey", "o_totalprice", ["quantity"]))


# tables, rankings, sets ---------------------------------------------------------------------------------------------


_MANIFEST = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "flag"]


@query(f"""
SELECT count(*) AS row_count, 5 AS feature_count, 'l_returnflag' AS target, CAST(sum(CAST('0x' || md5(concat_ws(chr(31), {", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(92) || 'N')" for c in _MANIFEST)}))[:15] AS BIGINT)) AS VARCHAR) AS content_hash
FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem)
""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and content hash of a dataset."""
    rows = table(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return stats.manifest(rows.select(_MANIFEST), "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def top_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The ten highest prices."""
    return stats.top_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 10, ["l_orderkey", "l_linenumber"])


@query(f"""
WITH m AS (SELECT feature, abs(avg(x)) AS a, skewness(x) AS s FROM ({_LONG}) GROUP BY feature), x AS (SELECT feature, a FROM m ORDER BY a DESC, feature LIMIT 3), y AS (SELECT feature, s FROM m ORDER BY abs(s) DESC, feature LIMIT 3)
SELECT x.feature, round(a, 4) AS mean_value, round(s, 4) AS skew FROM x JOIN y ON x.feature = y.feature
""")
def combined_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Features that lead two rankings at once."""
    means = stats.rank_features(stats.numeric_summary(table(spark, sf, "lineitem"), _AUDIT_COLS).select("feature", "mean_value"), "mean_value", 3)
    skews = stats.rank_features(stats.shape(table(spark, sf, "lineitem"), _AUDIT_COLS).select("feature", "skew"), "skew", 3, absolute=True)
    return rounded(means.join(skews, "feature"), digits=4)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Different pairs of a bridge table."""
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of one table that another lacks."""
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') n WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'A' AND e.l_orderkey = n.l_orderkey AND e.l_linenumber = n.l_linenumber)")
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return tables_io.append_new(lines.where("l_returnflag = 'R'").drop("l_returnflag").distinct(), lines.where("l_returnflag = 'A'"), ["l_orderkey", "l_linenumber"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(o_orderstatus AS BIGINT) AS o_orderstatus, CAST(NULL AS DOUBLE) AS absent FROM orders")
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """A table cast to a schema: missing columns null, others dropped."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("o_orderstatus", T.LongType()), T.StructField("absent", T.DoubleType())])
    return tables_io.align(table(spark, sf, "orders"), schema)


# relations ----------------------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)), f AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM (SELECT c_custkey FROM g ORDER BY c_custkey LIMIT 5))
SELECT (SELECT count(*) FROM g) AS n_missing, (SELECT array_to_string(list(k ORDER BY k), ',') FROM f) AS samples
""")
def coverage_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a related table does not cover."""
    large = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return relations.coverage_gap(table(spark, sf, "customer"), large, "c_custkey").select("n_missing", F.array_join("samples", ",").alias("samples"))


@query("""
WITH n AS (SELECT max(ts) AS t FROM events), pool AS (SELECT DISTINCT event_type, user_id FROM events), recent AS (SELECT DISTINCT event_type, user_id FROM events, n WHERE ts > t - INTERVAL 2880 MINUTE),
free AS (SELECT event_type, user_id FROM pool p WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.event_type = p.event_type AND r.user_id = p.user_id))
SELECT event_type, user_id FROM free QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id) <= 5
""")
def cooldown_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidates per type that were not used lately."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = str(events.agg(F.max("ts")).first()[0])
    return relations.cooldown_candidates(events.select("event_type", "user_id").distinct(), events, ["event_type", "user_id"], "ts", now, 2880, ["event_type"], 5, "user_id")


@query("""
WITH r AS (SELECT event_type, user_id, event_id FROM events), f AS (SELECT * FROM r WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)),
n AS (SELECT event_type, count(*) AS n_new FROM (SELECT event_type FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) GROUP BY event_type)
SELECT r.event_type, count(*) AS n_results, coalesce(any_value(n_new), 0) AS n_new FROM r LEFT JOIN n ON r.event_type = n.event_type GROUP BY r.event_type
""")
def new_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that searches found first, neither stored nor seeded."""
    events = table(spark, sf, "events")
    seeded = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return relations.new_keys(events.select("event_type", "user_id", "event_id"), events.where("value > 150"), seeded, "user_id", "event_type", ["event_id"])


_SYMBOLS = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN CAST(s_nationkey AS VARCHAR) WHEN 1 THEN 'Global' WHEN 2 THEN ' ' || lower(n_name) || ' ' ELSE 'nowhere ' || s_suppkey END AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT symbol, CASE WHEN regexp_matches(symbol, '^[0-9]+$') THEN TRY_CAST(symbol AS BIGINT) WHEN lower(symbol) = 'global' THEN NULL ELSE n_nationkey END AS resolved FROM ({_SYMBOLS}) LEFT JOIN nation ON lower(trim(symbol)) = lower(n_name) WHERE symbol NOT LIKE 'nowhere%'")
def resolve_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Names, numbers and ``global`` as ids."""
    nation = table(spark, sf, "nation")
    at = F.col("s_suppkey") % 4
    rows = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    symbol = F.when(at == 0, F.col("s_nationkey").cast("string")).when(at == 1, "Global").when(at == 2, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).otherwise(F.concat(F.lit("nowhere "), F.col("s_suppkey").cast("string")))
    return relations.resolve_symbols(rows.select(symbol.alias("symbol")), nation, "symbol", "n_name", "n_nationkey")


@query("""
WITH b AS (SELECT DISTINCT p_brand AS brand FROM part), s AS (SELECT DISTINCT p_size // 10 AS size_range FROM part), t AS (SELECT DISTINCT c_mktsegment AS segment FROM customer)
SELECT brand, NULL AS size_range, NULL AS segment FROM b UNION ALL SELECT NULL, size_range, NULL FROM s UNION ALL SELECT NULL, NULL, segment FROM t
UNION ALL SELECT brand, size_range, NULL FROM b, s UNION ALL SELECT brand, NULL, segment FROM b, t UNION ALL SELECT NULL, size_range, segment FROM s, t
""")
def pairwise_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Single ranges and all pairs of them."""
    part = table(spark, sf, "part")
    return relations.pairwise_segments({"b": part.select(F.col("p_brand").alias("brand")).distinct(), "s": part.select(F.floor(F.col("p_size") / 10).cast("int").alias("size_range")).distinct(), "t": table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()})


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem), r(g, round) USING KEY (g) AS (SELECT min(s_suppkey), 0 FROM supplier UNION
SELECT DISTINCT b.g, r.round + 1 FROM r JOIN e a ON a.g = r.g JOIN e b ON a.m = b.m WHERE r.round < 1 AND NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.g = b.g))
SELECT g AS "group", round FROM r
""")
def expand_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share a part with the first one: one round over all lines."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("member"))
    return relations.expand_frontier(edges, table(spark, sf, "supplier").agg(F.min("s_suppkey").alias("group")), 1)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem), r(g, round) USING KEY (g) AS (SELECT min(s_suppkey), 0 FROM supplier UNION
SELECT DISTINCT b.g, r.round + 1 FROM r JOIN e a ON a.g = r.g JOIN e b ON a.m = b.m WHERE NOT EXISTS (SELECT 1 FROM recurring.r x WHERE x.g = b.g))
SELECT g AS "group", round FROM r
""")
def expand_frontier_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers reached from the first one over shared parts of all lines, until no round finds another."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("member")).distinct()
    return relations.expand_frontier(edges, table(spark, sf, "supplier").agg(F.min("s_suppkey").alias("group")))


# matrices -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0.0 AS l_quantity, round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) + 0.0 AS l_tax FROM lineitem")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in population deviations from the mean."""
    return rounded(matrix.standard_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM lineitem), 6) + 0.0 AS l_extendedprice FROM lineitem")
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in interquartile ranges from the median."""
    return rounded(matrix.robust_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"]))


@query()
def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Explained variance of the principal components of the line columns."""
    return rounded(matrix.pca_variance(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_PAIR = "SELECT abs(corr(l_quantity, l_extendedprice)) AS r, avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, sign(corr(l_quantity, l_extendedprice)) AS s FROM lineitem"


@query(f"SELECT CAST(1 AS INT) AS component, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM ({_PAIR}) UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0 FROM ({_PAIR})")
def pca_pair_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Explained variance of two columns, which their correlation gives in closed form."""
    return rounded(matrix.pca_variance(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(f"SELECT CAST(CASE WHEN (1 + r) / 2 >= 0.9 THEN 1 ELSE 2 END AS INT) AS n_components FROM ({_PAIR})")
def pca_pair_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components that carry nine tenths of the variance of two columns."""
    return matrix.components_needed(matrix.pca_variance(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(f"SELECT l_orderkey * 10 + l_linenumber AS line, round(abs((l_quantity - ma) / sa + s * (l_extendedprice - mb) / sb) / sqrt(2), 4) AS pc1, round(abs((l_quantity - ma) / sa - s * (l_extendedprice - mb) / sb) / sqrt(2), 4) AS pc2 FROM lineitem, ({_PAIR})")
def pca_pair_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on the two components of two columns; signs are arbitrary."""
    lines = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = matrix.pca_project(lines, "line", ["l_quantity", "l_extendedprice"])
    return rounded(out.select("line", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")), digits=4)


@query()
def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components that carry nine tenths of the variance."""
    return matrix.components_needed(matrix.pca_variance(table(spark, sf, "lineitem"), _AUDIT_COLS))


@query("""
WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iq, quantile_cont(l_extendedprice, 0.5) AS mp, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ip FROM lineitem),
s AS (SELECT l_orderkey, (l_quantity - mq) / iq AS a, (l_extendedprice - mp) / ip AS b FROM lineitem, q), c AS (SELECT avg(a) AS ca, avg(b) AS cb FROM s), d AS (SELECT l_orderkey, sqrt((a - ca) ^ 2 + (b - cb) ^ 2) AS distance FROM s, c)
SELECT l_orderkey, round(distance, 6) AS distance FROM d WHERE distance > (SELECT quantile_cont(distance, 0.99) FROM d)
""")
def distance_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows farther from the centroid than 99 percent."""
    return rounded(matrix.distance_outliers(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_extendedprice"]))


@query(f"""
WITH f AS (SELECT feature, stddev_samp(x) AS s, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS i FROM ({_LONG}) GROUP BY feature), l AS (SELECT 'std_value' AS feature, s AS x FROM f UNION ALL SELECT 'iqr', i FROM f)
SELECT feature, count(x) AS n, round(avg(x), 4) AS mean_value, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value FROM l GROUP BY feature
""")
def scale_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """How much the scales of the columns differ."""
    summary = stats.numeric_summary(table(spark, sf, "lineitem"), _AUDIT_COLS)
    return rounded(stats.describe(summary, ["std_value", "iqr"]).select("feature", "n", "mean_value", "min_value", "max_value"), digits=4)


@query(f"""
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'duplicates', CAST(sum(n - 1) AS DOUBLE) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'mean_missing_pct', round((100.0 * count(*) FILTER (tax IS NULL) / count(*) + 100.0 * count(*) FILTER (flag IS NULL) / count(*)) / 2, 6) FROM ({_SPARSE})
UNION ALL SELECT 'imbalance_ratio', round(max(n) / CAST(min(n) AS DOUBLE), 6) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)
""")
def executive_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Headline figures of one dataset as a long table."""
    lines = table(spark, sf, "lineitem")
    return rounded(profile.executive_summary(lines, _sparse(spark, sf), ["tax", "flag"], ["l_orderkey", "l_linenumber"], "l_returnflag"))


# domain pipelines: the star schema cast into their tables -------------------------------------------------------------


def game_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers as clans, orders as memberships, orders as players, lines as their progression."""
    orders, customers, lines = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    tag = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    mod = lambda c, n, k=0: ((F.col(c) * 7 + k) % n).cast("bigint")
    player = orders.withColumns({"player_tag": tag("o_orderkey"), "clan_tag": tag("o_custkey")})
    price = F.floor("o_totalprice").cast("bigint")
    base = {"town_hall_level": mod("o_orderkey", 18, 1), "exp_level": mod("o_orderkey", 97), "trophies": price, "best_trophies": price + mod("o_orderkey", 1000), "war_stars": mod("o_orderkey", 131), "attack_wins": mod("o_orderkey", 53), "defense_wins": mod("o_orderkey", 11), "builder_hall_level": mod("o_orderkey", 10), "builder_base_trophies": mod("o_orderkey", 3001), "best_builder_base_trophies": mod("o_orderkey", 5), "donations": mod("o_orderkey", 701), "donations_received": mod("o_orderkey", 13), "clan_capital_contributions": mod("o_orderkey", 1009)}
    players = player.select("player_tag", F.lit("p").alias("name"), *[e.alias(c) for c, e in base.items()], "clan_tag")
    members = player.select("clan_tag", "player_tag", F.col("o_orderpriority").alias("role"), *[base[c].alias(c) for c in ("town_hall_level", "exp_level", "trophies", "builder_base_trophies", "donations", "donations_received")], base["clan_capital_contributions"].alias("capital_contributions"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("clan_rank"), mod("o_orderkey", 50).alias("previous_clan_rank"))
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    wars = orders.groupBy("o_custkey").agg(state("F").alias("war_wins"), state("O").alias("war_losses"), state("P").alias("war_ties"))
    clans = customers.join(wars, F.col("c_custkey") == F.col("o_custkey"), "left").select(tag("c_custkey").alias("clan_tag"), mod("c_custkey", 30).alias("clan_level"), F.col("c_custkey").alias("clan_points"), F.col("c_mktsegment").alias("war_frequency"), F.col("c_nationkey").cast("bigint").alias("location_id"), "war_wins", "war_losses", "war_ties")
    line = lines.select(tag("l_orderkey").alias("player_tag"), F.col("l_quantity").cast("bigint").alias("level"), F.round(F.col("l_tax") * 100).cast("bigint").alias("max_level"), "l_linenumber", F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("target"))
    part = lambda k: line.where(F.col("l_linenumber") % 4 == k)
    return {"players": players, "clan_members": members, "clans": clans, "player_troops": part(0), "player_heroes": part(1), "player_spells": part(2), "player_hero_equipment": part(3), "player_achievements": line}


def stored_features(t: dict[str, DataFrame]) -> DataFrame:
    """Player features, written once for the datasets, which read them several times."""
    return staged(datasets.player_features(t), "player-features")


_PLAYER = """SELECT '#' || o_orderkey AS player_tag, '#' || o_custkey AS clan_tag, o_orderkey AS k, CAST((o_orderkey * 7 + 1) % 18 AS DOUBLE) AS th, CAST((o_orderkey * 7) % 97 AS DOUBLE) AS xp, CAST(floor(o_totalprice) AS DOUBLE) AS tr,
  CAST((o_orderkey * 7) % 131 AS DOUBLE) AS ws, CAST((o_orderkey * 7) % 701 AS DOUBLE) AS don, CAST((o_orderkey * 7) % 13 AS DOUBLE) AS rec, CAST((o_orderkey * 7) % 1009 AS DOUBLE) AS cap, o_orderpriority AS role FROM orders"""


def _raw_documents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers as documents of clans, their orders as lists of members, orders with their lines as documents of players."""
    orders, customers, lines = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    tag = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    named = lambda i, n: F.struct(i.alias("id"), n.alias("name"))
    clan = F.struct(
        tag("c_custkey").alias("tag"), F.col("c_name").alias("name"), (F.col("c_custkey") % 30).alias("clanLevel"), F.col("c_custkey").alias("warWins"), (F.col("c_nationkey") > 12).alias("warLogPublic"),
        named(F.col("c_nationkey"), F.col("c_mktsegment")).alias("location"), named(F.col("c_nationkey"), F.lit("league")).alias("warLeague"), F.col("c_mktsegment").alias("type"),
    )
    member = F.struct(
        tag("o_orderkey").alias("tag"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("role"), (F.col("o_orderkey") % 18).alias("townHallLevel"), named(F.col("o_custkey") % 7, F.lit("league")).alias("league"),
        F.floor("o_totalprice").cast("bigint").alias("trophies"), (F.col("o_orderkey") % 50).alias("clanRank"), (F.col("o_orderkey") % 13).alias("donations"),
    )
    lists = orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(member).alias("items"))).alias("value"))
    troop = F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").alias("level"), F.lit("home").alias("village"))
    held = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(troop)).alias("troops"))
    player = F.struct(tag("o_orderkey").alias("tag"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("expLevel"), "troops")
    people = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey")).select(tag("o_orderkey").alias("key_from_file"), F.to_json(player).alias("value"))
    texts = {
        "clans": customers.select(tag("c_custkey").alias("key_from_file"), F.to_json(clan).alias("value")),
        "members": lists.select(tag("o_custkey").alias("key_from_file"), "value"),
        "players": people,
    }
    return {k: docs_io.parse_documents(v)[0] for k, v in texts.items()}


def _columns_sql(fields: dict[str, tuple[str, str]], given: dict[str, str]) -> str:
    """All of a table's columns as SQL: those given, null for the others."""
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    return ", ".join(f"CAST({given.get(c, 'NULL')} AS {kinds[k]}) AS {c}" for c, (_, k) in fields.items())


_CLAN_SQL = {"clan_tag": "'#' || c_custkey", "name": "c_name", "clan_level": "c_custkey % 30", "war_wins": "c_custkey", "war_log_public": "c_nationkey > 12", "location_id": "c_nationkey", "location_name": "c_mktsegment", "type": "c_mktsegment"}
_MEMBER_SQL = {"player_tag": "'#' || o_orderkey", "name": "o_orderstatus", "role": "o_orderpriority", "town_hall_level": "o_orderkey % 18", "league_id": "o_custkey % 7", "league_name": "'league'", "trophies": "floor(o_totalprice)", "clan_rank": "o_orderkey % 50", "donations": "o_orderkey % 13"}


@query(f"""SELECT {_columns_sql(S.CLANS, _CLAN_SQL)}, '{{"id": ' || c_nationkey || ', "name": "league"}}' AS war_league, CAST(NULL AS VARCHAR) AS capital_league FROM customer""")
def normalised_clans(spark: SparkSession, sf: str) -> DataFrame:
    """The table of clans from raw documents, all of its columns."""
    return datasets.normalised_tables(**_raw_documents(spark, sf))["clans"]


@query(f"SELECT '#' || o_custkey AS clan_tag, {_columns_sql(S.MEMBERS, _MEMBER_SQL)} FROM orders")
def normalised_members(spark: SparkSession, sf: str) -> DataFrame:
    """The table of members from lists in raw documents, all of its columns."""
    return datasets.normalised_tables(**_raw_documents(spark, sf))["clan_members"]


@query("SELECT '#' || l_orderkey AS player_tag, CAST(l_partkey AS VARCHAR) AS troop_name, min(CAST(l_linenumber AS BIGINT)) AS level, CAST(NULL AS BIGINT) AS max_level, 'home' AS village FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_partkey")
def normalised_troops(spark: SparkSession, sf: str) -> DataFrame:
    """A progression table from lists inside raw documents: of repeated names the first stays."""
    return datasets.normalised_tables(**_raw_documents(spark, sf))["player_troops"]


#: The base columns of a player as SQL over orders.
_BASE = {c: f"(o_orderkey * 7 + {k}) % {n}" for c, n, k in (
    ("town_hall_level", 18, 1), ("exp_level", 97, 0), ("war_stars", 131, 0), ("attack_wins", 53, 0), ("defense_wins", 11, 0), ("builder_hall_level", 10, 0), ("builder_base_trophies", 3001, 0),
    ("best_builder_base_trophies", 5, 0), ("donations", 701, 0), ("donations_received", 13, 0), ("clan_capital_contributions", 1009, 0),
)} | {"trophies": "floor(o_totalprice)", "best_trophies": "floor(o_totalprice) + (o_orderkey * 7) % 1000"}
_PART = """SELECT '#' || l_orderkey AS player_tag, count(*) AS {0}_count, coalesce(sum(CAST(trunc(l_quantity) AS BIGINT)), 0) / CAST(count(*) AS DOUBLE) AS {0}_mean_level,
  avg(CAST(trunc(l_quantity) AS DOUBLE) / nullif(round(l_tax * 100), 0)) AS {0}_mean_completion_ratio FROM lineitem WHERE l_linenumber % 4 = {1} GROUP BY 1"""
_PARTS = {"troop": 0, "hero": 1, "spell": 2, "equipment": 3}
_DERIVED = {
    "donation_balance": "donations - donations_received", "donation_ratio": "donations / nullif(donations_received, 0)", "combat_activity_total": "attack_wins + defense_wins",
    "progression_ratio_trophies": "trophies / nullif(best_trophies, 0)", "builder_progression_ratio": "builder_base_trophies / nullif(best_builder_base_trophies, 0)",
}
_PARTED = [*(f"{p}_{m}" for p in _PARTS for m in ("count", "mean_level", "mean_completion_ratio")), "achievement_count", "achievement_completion_ratio"]
_FEATURES = [*_BASE, *_DERIVED, *_PARTED]
_FEATURE_SQL = f"""
SELECT p.player_tag, clan_tag, role, {", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in [*_BASE, *_PARTED])}, {", ".join(f"CAST(coalesce({e}, 0) AS DOUBLE) AS {c}" for c, e in _DERIVED.items())}
FROM (SELECT '#' || o_orderkey AS player_tag, '#' || o_custkey AS clan_tag, o_orderpriority AS role, {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _BASE.items())} FROM orders) p
{" ".join(f"LEFT JOIN ({_PART.format(n, k)}) x{k} ON p.player_tag = x{k}.player_tag" for n, k in _PARTS.items())}
LEFT JOIN (SELECT '#' || l_orderkey AS player_tag, count(*) AS achievement_count, avg(CAST(l_partkey AS DOUBLE) / nullif(l_suppkey, 0)) AS achievement_completion_ratio FROM lineitem GROUP BY 1) a ON p.player_tag = a.player_tag"""
_ROUND = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _FEATURES)


@query(f"SELECT player_tag, {_ROUND} FROM ({_FEATURE_SQL})")
def player_feature_preset(spark: SparkSession, sf: str) -> DataFrame:
    """Player features from six tables, all of their columns."""
    return rounded(datasets.player_features(game_tables(spark, sf)))


_RELATIVE = ["trophies", "exp_level", "town_hall_level", "war_stars", "capital_contributions", "donations", "donations_received", "attack_wins", "defense_wins"]
_RANKED = ["trophies", "exp_level", "war_stars"]


@query(f"""
WITH f AS (SELECT *, clan_capital_contributions AS capital_contributions FROM ({_FEATURE_SQL})),
w AS (SELECT *, {", ".join(f"avg({c}) OVER g AS m_{c}" for c in _RELATIVE)}, count(*) OVER g AS n, {", ".join(f"rank() OVER (PARTITION BY clan_tag ORDER BY {c}) + (count(*) OVER (PARTITION BY clan_tag, {c}) - 1) / CAST(2 AS DOUBLE) AS r_{c}" for c in _RANKED)} FROM f WINDOW g AS (PARTITION BY clan_tag))
SELECT w.clan_tag, w.player_tag, {", ".join(f"round({c} - m_{c}, 6) + 0.0 AS {c}_diff_from_clan_mean, round(coalesce({c} / nullif(m_{c}, 0), 0), 6) AS {c}_ratio_to_clan_mean" for c in _RELATIVE)},
  {", ".join(f"round(r_{c} / n, 6) AS {c}_clan_pct" for c in _RANKED)}, (c_custkey * 7) % 30 AS clan_level, c_custkey AS clan_points, c_mktsegment AS war_frequency, {_ROUND}, role
FROM w LEFT JOIN customer ON w.clan_tag = '#' || c_custkey
""")
def role_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The role dataset with all columns: relative features, clan context, player features, target."""
    t = game_tables(spark, sf)
    return rounded(datasets.role_dataset(t, stored_features(t)))


@query(f"""
WITH p AS ({_PLAYER}), w AS (SELECT *, avg(don) OVER g AS m, count(*) OVER g AS n, rank() OVER (PARTITION BY clan_tag ORDER BY don) + (count(*) OVER (PARTITION BY clan_tag, don) - 1) / CAST(2 AS DOUBLE) AS r FROM p WINDOW g AS (PARTITION BY clan_tag))
SELECT w.clan_tag, w.player_tag, round(don - m, 6) + 0.0 AS donations_diff_from_clan_mean, round(m, 6) AS clan_mean_donations, round(r / n, 6) AS donations_clan_pct, CAST(epoch(o_orderdate) AS BIGINT) AS clan_rank FROM w JOIN orders ON w.k = o_orderkey
""")
def rank_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The rank dataset without trophies."""
    t = game_tables(spark, sf)
    out = datasets.rank_datasets(t, datasets.player_features(t))["without_trophies"]
    return rounded(out.select("clan_tag", "player_tag", "donations_diff_from_clan_mean", "clan_mean_donations", "donations_clan_pct", "clan_rank"))


_WAR = f"""SELECT '#' || o_custkey AS clan_tag, win_rate FROM ({_RATES})"""


@query(f"""
WITH p AS ({_PLAYER}), v AS ({_WAR})
SELECT v.clan_tag, c_mktsegment AS war_frequency, count(p.k) AS member_count, round(avg(tr), 4) AS mean_trophies, round(quantile_cont(tr, 0.5), 4) AS median_trophies, round(coalesce(stddev_samp(tr), 0), 4) AS std_trophies,
  round(avg(CASE WHEN th >= 17 THEN 1.0 ELSE 0.0 END), 4) AS th17_plus_percentage, CAST(sum(don) AS DOUBLE) AS sum_donations, round(sum(don) / count(p.k), 4) AS donation_rate, round(any_value(win_rate), 4) AS war_success_rate
FROM v JOIN customer ON v.clan_tag = '#' || c_custkey JOIN p ON p.clan_tag = v.clan_tag GROUP BY v.clan_tag, c_mktsegment
""")
def war_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The war dataset: composition of each clan with enough history, and its success rate."""
    t = game_tables(spark, sf)
    out = datasets.war_dataset(t, stored_features(t))
    return rounded(out.select("clan_tag", "war_frequency", "member_count", "mean_trophies", "median_trophies", "std_trophies", "th17_plus_percentage", F.col("sum_donations").cast("double").alias("sum_donations"), "donation_rate", "war_success_rate"), digits=4)


@query(f"""
WITH v AS ({_WAR}), q AS (SELECT quantile_cont(win_rate, 1.0 / 3) AS lo, quantile_cont(win_rate, 2.0 / 3) AS hi FROM v)
SELECT clan_tag, CASE WHEN win_rate < lo THEN 'low' WHEN win_rate < hi THEN 'medium' ELSE 'high' END AS performance_class FROM v, q
""")
def class_preset(spark: SparkSession, sf: str) -> DataFrame:
    """Performance classes of the war dataset by terciles."""
    t = game_tables(spark, sf)
    return datasets.class_dataset(datasets.war_dataset(t, stored_features(t)))[0].select("clan_tag", "performance_class")


@query(f"SELECT player_tag, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in S.CLUSTER_FEATURES)} FROM ({_FEATURE_SQL})")
def clustering_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The clustering matrix of player features, all of its columns."""
    return rounded(datasets.clustering_dataset(datasets.player_features(game_tables(spark, sf)))[0])


_OTHERS = ["l_quantity", "l_discount", "l_tax"]


@query(f"""
WITH x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_extendedprice AS y FROM lineitem" for c in _OTHERS)}),
r AS (SELECT feature, x, y, {_RANKS.format("x")} AS rx, {_RANKS.format("y")} AS ry FROM x), c AS (SELECT feature, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY feature),
q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qx FROM x GROUP BY feature),
t AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qy FROM lineitem),
o AS (SELECT feature, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS n_outliers, count(x) AS n FROM x JOIN q USING (feature) GROUP BY feature, a, b),
k AS (SELECT feature, len(list_filter(qx, lambda p: p < x)) AS kx, len(list_filter(qy, lambda p: p < y)) AS ky FROM x JOIN q USING (feature), t), n AS (SELECT feature, kx, ky, count(*) AS n FROM k GROUP BY ALL),
w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, kx) AS nx, sum(n) OVER (PARTITION BY feature, ky) AS ny, sum(n) OVER (PARTITION BY feature) AS s FROM n),
m AS (SELECT feature, sum(n / CAST(s AS DOUBLE) * ln(CAST(n AS DOUBLE) * s / (CAST(nx AS DOUBLE) * ny))) AS mi FROM w GROUP BY feature)
SELECT feature, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound, n_outliers, round(100.0 * n_outliers / n, 4) AS outlier_pct, round(pearson, 4) + 0.0 AS pearson, round(spearman, 4) + 0.0 AS spearman, round(mi, 4) AS mi FROM o JOIN c USING (feature) JOIN m USING (feature)
""")
def profile_preset(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines of the exploratory profile of lines: outliers, correlation and information per feature."""
    found = profile.Profile(table(spark, sf, "lineitem"), _AUDIT_COLS, ["l_returnflag"], "l_extendedprice", {"money": "price"})
    return rounded(found.table("outliers").join(found.table("target_correlation"), "feature").join(found.table("mutual_information"), "feature"), digits=4)


@query("""
WITH e AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS clan, * FROM orders), d AS (SELECT 100.0 * max(n) / sum(n) AS dom FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)), s AS (SELECT 100.0 * max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))
SELECT count(*) AS n_rows, round(100.0 * count(*) FILTER (clan IS NULL) / count(*), 6) AS without_group, CAST(0 AS DOUBLE) AS mean_missing_pct, round(any_value(dom), 6) AS dominance, round(any_value(top), 6) AS top1,
  CASE WHEN count(*) < 1000 THEN 'Limited coverage' WHEN count(*) >= 10000 AND any_value(dom) < 40 AND any_value(top) < 40 AND 100.0 * count(*) FILTER (clan IS NULL) / count(*) < 10 THEN 'Excellent coverage' WHEN count(*) >= 5000 AND any_value(dom) < 50 AND any_value(top) < 50 THEN 'Good coverage' ELSE 'Moderate coverage' END AS grade FROM e, d, s
""")
def audit_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The grade of a raw audit of orders."""
    orders = table(spark, sf, "orders").withColumn("clan", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return rounded(profile.raw_audit(orders, ["o_totalprice"], ["o_orderstatus"], orders, "o_custkey", "clan", "o_orderkey")["grade"])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type, by the expression that a stream runs."""
    return state.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""
WITH l AS (SELECT DISTINCT CASE WHEN regexp_matches(symbol, '^[0-9]+$') THEN symbol WHEN lower(symbol) = 'global' THEN 'global' ELSE CAST(n_nationkey AS VARCHAR) END AS location FROM ({_SYMBOLS}) LEFT JOIN nation ON lower(trim(symbol)) = lower(n_name) WHERE symbol NOT LIKE 'nowhere%'),
s AS (SELECT DISTINCT 'min_size=' || (p_size // 10) AS fingerprint FROM part), n AS (SELECT max(ts) AS t FROM events),
h AS (SELECT DISTINCT CAST(user_id % 25 AS VARCHAR) AS location, 'min_size=' || (event_id % 5) AS fingerprint FROM events, n WHERE ts > t - INTERVAL 240 MINUTE)
SELECT location, fingerprint FROM l, s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.location = l.location AND h.fingerprint = s.fingerprint) QUALIFY row_number() OVER (PARTITION BY location ORDER BY fingerprint) <= 3
""")
def candidate_preset(spark: SparkSession, sf: str) -> DataFrame:
    """Searches to run next: regions by symbol, size ranges, and a log of events as past searches."""
    nation, events = table(spark, sf, "nation"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    at = F.col("s_suppkey") % 4
    symbol = F.when(at == 0, F.col("s_nationkey").cast("string")).when(at == 1, "Global").when(at == 2, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).otherwise(F.concat(F.lit("nowhere "), F.col("s_suppkey").cast("string")))
    segments = table(spark, sf, "part").select(F.floor(F.col("p_size") / 10).alias("min_size")).distinct()
    log = events.select((F.col("user_id") % 25).alias("location_id"), F.create_map(F.lit("minSize"), F.col("event_id") % 5).alias("filters"), F.col("ts").alias("used_at"))
    now = str(events.agg(F.max("ts")).first()[0])
    out = candidates.candidate_table(rows.select(symbol.alias("symbol")), "symbol", nation, "n_name", "n_nationkey", segments, log, now, {"minSize": "min_size"}, 240, 3)
    return out.select("location", "fingerprint")
