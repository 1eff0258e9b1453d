"""Registered queries of the whole reports: the profile of a dataset, the audit of raw documents, merged sketches, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield import functions as fn
from tarnfield.operators import sketches
from tarnfield.plans import datasets
from tarnfield.plans import schemas as S
from tarnfield.plans.audit import Audit, document_facts
from tarnfield.plans.profile import Profile
from tarnfield.queries import _AUDIT_COLS, _FEATURE_SQL, _FEATURES, _LONG, _SPARSE, _WAR, ORACLE_SQL, _columns_sql, game_tables, query, rounded, stored_features
from tarnfield.session import table
from tarnfield.sources import documents as docs_io
from tarnfield.sources import tables as tables_io
from tarnfield.staging import fresh_name, shared_folder

# the profile of the lines, target l_extendedprice, classes l_returnflag ----------------------------------------------

_TEXTS = ["l_returnflag", "l_linestatus"]
_EVERY = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS x FROM lineitem" for c in [*_AUDIT_COLS, *_TEXTS])


def _lines_profile(spark: SparkSession, sf: str) -> Profile:
    lines = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Profile(lines, _AUDIT_COLS, _TEXTS, "l_extendedprice", {"money": "price", "rate": "tax|discount"}, "l_returnflag", "line")


@query(ORACLE_SQL["numeric_summary"])
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of all numeric columns, from counted values."""
    return rounded(_lines_profile(spark, sf).table("summary"), digits=4)


@query(f"""
SELECT feature, count(x) AS n, round(avg(x), 4) AS mean_value, round(stddev_samp(x), 4) AS std_value, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value,
  {", ".join(f"round(quantile_cont(x, {p / 100}), 4) AS p{p}" for p in (25, 50, 75, 1, 5, 95, 99))} FROM ({_LONG}) GROUP BY feature
""")
def profile_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles and tails of all numeric columns, from counted values."""
    return rounded(_lines_profile(spark, sf).table("describe"), digits=4)


@query(ORACLE_SQL["shape"])
def profile_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Skewness and kurtosis from counted values."""
    return rounded(_lines_profile(spark, sf).table("shape"))


@query(ORACLE_SQL["zero_missing_profile"])
def profile_zero_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Zeros, gaps and skewness from counted values."""
    return rounded(_lines_profile(spark, sf).table("zero_missing"))


@query(ORACLE_SQL["group_profile"])
def profile_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The same by conceptual group."""
    return rounded(_lines_profile(spark, sf).table("groups"))


@query(f"SELECT feature, count(*) FILTER (x IS NULL) AS n_missing, round(100.0 * count(*) FILTER (x IS NULL) / count(*), 6) AS missing_pct FROM ({_EVERY}) GROUP BY feature")
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of all columns."""
    return rounded(_lines_profile(spark, sf).table("missing"))


@query(f"SELECT feature, count(DISTINCT x) AS n_distinct, count(DISTINCT x) > 0.9 * count(*) AS high_cardinality FROM ({_EVERY}) GROUP BY feature")
def profile_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Different values of all columns."""
    return _lines_profile(spark, sf).table("cardinality")


@query(f"""
WITH c AS (SELECT feature, x, count(*) AS n FROM ({_EVERY}) GROUP BY feature, x), t AS (SELECT feature, max(n) AS mode_n, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY feature), v AS (SELECT feature, var_samp(x) AS v FROM ({_LONG}) GROUP BY feature)
SELECT feature, mode_n, round(mode_n / n, 6) AS mode_share, mode_n / n >= 0.95 AS nearly_constant, v = 0 AS zero_variance, v < 1e-6 AS low_variance FROM t LEFT JOIN v USING (feature)
""")
def profile_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Commonest values of all columns."""
    return rounded(_lines_profile(spark, sf).table("mode"))


@query(ORACLE_SQL["iqr_outliers"])
def profile_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside the quartile fences, from counted values."""
    return rounded(_lines_profile(spark, sf).table("outliers"), digits=4)


@query(f"""
WITH m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM ({_LONG}) GROUP BY feature)
SELECT feature, CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS INT) AS bucket, count(*) AS n FROM ({_LONG}) JOIN m USING (feature) GROUP BY ALL
""")
def profile_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of all numeric columns."""
    return _lines_profile(spark, sf).table("histograms")


@query("SELECT l_linestatus AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) = 1 AS is_dominant, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) < 0.01 AS is_rare FROM lineitem GROUP BY l_linestatus")
def profile_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a categorical column."""
    return rounded(_lines_profile(spark, sf).table("distribution_l_linestatus"))


@query(ORACLE_SQL["class_balance"].replace("o_orderstatus", "l_returnflag").replace("orders", "lineitem"))
def profile_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Class shares and their imbalance."""
    return rounded(_lines_profile(spark, sf).table("class_balance"))


_BY_CLASS = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS c, {c} AS x FROM lineitem" for c in _AUDIT_COLS)


@query(f"SELECT c AS key, feature, {', '.join(f'round(quantile_cont(x, {p}), 4) AS {n}' for p, n in ((0, 'min_value'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'max_value')))} FROM ({_BY_CLASS}) GROUP BY ALL")
def profile_five_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Box-plot data of all numeric columns by class."""
    return rounded(_lines_profile(spark, sf).table("five_numbers"), digits=4)


@query(f"""
WITH g AS (SELECT feature, c, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM ({_BY_CLASS}) GROUP BY feature, c), w AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM g GROUP BY feature)
SELECT g.feature, round((sum(g.n * (m - gm) ^ 2) / (w.k - 1)) / (sum(g.n * v) / (w.n - w.k)), 4) AS f FROM g JOIN w ON g.feature = w.feature GROUP BY g.feature, w.n, w.k
""")
def profile_anova(spark: SparkSession, sf: str) -> DataFrame:
    """F of all numeric columns, from values counted by class."""
    return rounded(_lines_profile(spark, sf).table("anova"), digits=4)


@query(f"""
WITH l AS ({_BY_CLASS}), r AS (SELECT feature, c, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / CAST(2 AS DOUBLE) AS r FROM l),
s AS (SELECT feature, c, sum(r) AS s, count(*) AS k FROM r GROUP BY feature, c), q AS (SELECT feature, sum(s * s / k) AS q, sum(k) AS n, count(*) - 1 AS df FROM s GROUP BY feature),
t AS (SELECT feature, sum(CAST(t AS DOUBLE) ^ 3 - t) AS ties FROM (SELECT feature, x, count(*) AS t FROM l GROUP BY feature, x) GROUP BY feature),
h AS (SELECT feature, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ^ 3 - n)) AS h, df FROM q JOIN t USING (feature))
SELECT feature, round(h, 4) AS h, df, round(exp(-h / 2), 5) AS p FROM h
""")
def profile_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    """Rank tests of all numeric columns, from values counted by class."""
    out = _lines_profile(spark, sf).table("kruskal").select("feature", "h", "df", "p")
    return rounded(rounded(out, ["h"], 4), ["p"], 5)


@query(ORACLE_SQL["target_correlation"])
def profile_target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all columns with the target."""
    return rounded(_lines_profile(spark, sf).table("target_correlation"))


@query("""
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS line, """ + ", ".join(f"({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem) AS {c}" for c in ("l_quantity", "l_discount", "l_tax")) + """ FROM lineitem),
c AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS d FROM s), f AS (SELECT line, sqrt((l_quantity - a) ^ 2 + (l_discount - b) ^ 2 + (l_tax - d) ^ 2) AS distance FROM s, c)
SELECT count(*) AS n_outliers, round(min(distance), 4) AS least, round(max(distance), 4) AS most FROM f WHERE distance > (SELECT quantile_cont(distance, 0.99) FROM f) + 1e-9
""")
def profile_distances(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows are farther from the centroid than 99 percent, and how far."""
    far = _lines_profile(spark, sf).table("distances")
    limit = far.agg(F.min("distance").alias("_limit"))
    return rounded(far.crossJoin(F.broadcast(limit)).where(F.col("distance") > F.col("_limit") - 1).agg(F.count(F.lit(1)).alias("n_outliers"), F.min("distance").alias("least"), F.max("distance").alias("most")), digits=4)


@query(ORACLE_SQL["scale_dispersion"])
def profile_scale_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """How much the scales of the columns differ, from counted values."""
    return rounded(_lines_profile(spark, sf).table("scale_dispersion").select("feature", "n", "mean_value", "min_value", "max_value"), digits=4)


@query(f"""
WITH m AS (SELECT avg(pct) AS x FROM (SELECT 100.0 * count(*) FILTER (x IS NULL) / count(*) AS pct FROM ({_EVERY}) GROUP BY feature)), c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'duplicates', CAST(count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS DOUBLE) FROM lineitem UNION ALL SELECT 'mean_missing_pct', round(x, 6) FROM m UNION ALL SELECT 'imbalance_ratio', round(max(n) / CAST(min(n) AS DOUBLE), 6) FROM c
""")
def profile_executive(spark: SparkSession, sf: str) -> DataFrame:
    """The headline numbers of the profile."""
    return rounded(_lines_profile(spark, sf).table("executive"))


_TENTHS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
_PAIRED = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_extendedprice AS y FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@query(f"""
WITH x AS ({_PAIRED}), q AS (SELECT feature, quantile_cont(x, {_TENTHS}) AS qx FROM x GROUP BY feature), t AS (SELECT quantile_cont(l_extendedprice, {_TENTHS}) AS qy FROM lineitem),
k AS (SELECT feature, len(list_filter(qx, lambda p: p < x)) AS kx, len(list_filter(qy, lambda p: p < y)) AS ky FROM x JOIN q USING (feature), t), n AS (SELECT feature, kx, ky, count(*) AS n FROM k GROUP BY ALL),
w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, kx) AS nx, sum(n) OVER (PARTITION BY feature, ky) AS ny, sum(n) OVER (PARTITION BY feature) AS s FROM n)
SELECT feature, round(sum(n / CAST(s AS DOUBLE) * ln(CAST(n AS DOUBLE) * s / (CAST(nx AS DOUBLE) * ny))), 6) AS mi FROM w GROUP BY feature
""")
def profile_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    """Information of all columns on the target."""
    return rounded(_lines_profile(spark, sf).table("mutual_information"))


@query()
def profile_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Explained variance of all columns but the target."""
    return rounded(_lines_profile(spark, sf).table("pca"))


# the audit of raw documents -------------------------------------------------------------------------------------------

_FIELDS = {"tag": ("$.tag", "string"), "clan": ("$.clan.tag", "string"), "price": ("$.price", "double"), "status": ("$.status", "string"), "priority": ("$.priority", "string")}
_OBJECTS = """SELECT o_orderkey AS tag, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS clan, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 NOT IN (3, 4, 7)
  UNION ALL SELECT -o_orderkey, NULL, NULL, o_orderstatus, NULL FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 8, 9)"""


def _audit(spark: SparkSession, sf: str) -> Audit:
    """Orders as files of all shapes: broken, empty, a list, one object, no object, two objects in a list inside an object."""
    kind = F.pmod(F.col("o_orderkey"), F.lit(10))
    own = F.to_json(F.struct(F.col("o_orderkey").alias("tag"), F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_custkey").alias("tag"))).alias("clan"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    twin = F.to_json(F.struct((-F.col("o_orderkey")).alias("tag"), F.col("o_orderstatus").alias("status")))
    text = F.when(kind == 3, "{broken").when(kind == 4, '{"items":[]}').when(kind == 5, F.concat(F.lit("["), own, F.lit(",7]"))).when(kind == 6, own).when(kind == 7, '"text"').otherwise(F.concat(F.lit('{"items":['), own, F.lit(","), twin, F.lit("]}")))
    facts = document_facts(table(spark, sf, "orders").select(text.alias("value")), _FIELDS, ["price"], ["status", "priority"], "tag", "clan", "clan", "$.items")
    return Audit(facts, ["status", "priority"], "clan", "clan", ["priority"])


@query("""
SELECT 'read' AS metric, count(*) AS n FROM orders UNION ALL SELECT 'corrupt', count(*) FILTER (o_orderkey % 10 = 3) FROM orders UNION ALL SELECT 'not an object', count(*) FILTER (o_orderkey % 10 = 7) FROM orders
UNION ALL SELECT 'valid', count(*) FILTER (o_orderkey % 10 NOT IN (3, 7)) FROM orders UNION ALL SELECT 'empty', count(*) FILTER (o_orderkey % 10 = 4) FROM orders
""")
def raw_audit_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Files read, valid, corrupt, of another shape, and empty."""
    return _audit(spark, sf).counters()


@query(f"""
SELECT 'price' AS feature, count(price) AS n, round(min(price), 4) AS min_value, round(max(price), 4) AS max_value, round(avg(price), 4) AS mean_value, round(stddev_samp(price), 4) AS std_value, {", ".join(f"round(quantile_cont(price, 0.{p}), 4) AS p{p}" for p in (25, 50, 75, 95))},
  round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS iqr, round(stddev_samp(price) / avg(price), 4) AS cv FROM ({_OBJECTS})
""")
def raw_audit_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of the numeric fields of raw documents."""
    return rounded(_audit(spark, sf).numeric(), digits=4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM ({_OBJECTS})" for c in ("price", "status", "priority")))
def raw_audit_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the fields of raw documents."""
    return rounded(_audit(spark, sf).missing())


@query(f"SELECT priority AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, priority) = 1 AS is_dominant, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) < 0.01 AS is_rare FROM ({_OBJECTS}) WHERE priority IS NOT NULL GROUP BY priority")
def raw_audit_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a field of raw documents."""
    return rounded(_audit(spark, sf).distribution("priority"))


@query(f"WITH c AS (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM ({_OBJECTS}) GROUP BY status) SELECT count(*) AS n_values, round(sum(p * p), 6) AS hhi, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalised_entropy FROM c")
def raw_audit_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Concentration of a field of raw documents."""
    return rounded(_audit(spark, sf).concentration("status"))


_EDGES = [0, 50_000, 100_000, 200_000, 900_000]


@query(f"""
WITH b AS (SELECT unnest(range(0, {len(_EDGES)})) AS bin), p AS (SELECT len(list_filter({_EDGES}, lambda e: e <= price)) - 1 AS bin, count(*) AS n FROM ({_OBJECTS}) WHERE price IS NOT NULL GROUP BY 1),
f AS (SELECT CAST(b.bin AS INT) AS bin, '>= ' || ({_EDGES})[b.bin + 1] AS label, coalesce(CAST(n AS BIGINT), 0) AS n FROM b LEFT JOIN p ON b.bin = p.bin)
SELECT bin, label, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, round(sum(n) OVER (ORDER BY bin DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share_from FROM f
""")
def raw_audit_binned(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of a numeric field of raw documents."""
    return rounded(_audit(spark, sf).binned("price", _EDGES, [f">= {e}" for e in _EDGES]))


_CLANS = f"s AS (SELECT clan, count(*) AS n FROM ({_OBJECTS}) WHERE clan IS NOT NULL GROUP BY clan), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM s)"


@query(f"""
WITH {_CLANS} SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median_size, min(n) AS min_size, max(n) AS max_size,
  {", ".join(f"round(sum(n) FILTER (k <= {k}) / CAST(sum(n) AS DOUBLE), 6) AS top{k}_share" for k in (1, 10, 50, 100))} FROM r
""")
def raw_audit_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the groups that raw documents belong to."""
    return rounded(_audit(spark, sf).sizes())


@query(f"SELECT count(*) AS n_rows, count(DISTINCT tag) AS n_keys, count(clan) AS n_with, count(*) - count(clan) AS n_without FROM ({_OBJECTS})")
def raw_audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Objects, keys, and objects with and without a group."""
    return _audit(spark, sf).totals()


_AUDITED = f"""o AS ({_OBJECTS}), d AS (SELECT 'status' AS field, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT count(*) AS n FROM o GROUP BY status) UNION ALL SELECT 'priority', max(n) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM o WHERE priority IS NOT NULL GROUP BY priority)),
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, 100.0 * (count(*) - count({c})) / count(*) AS pct FROM o" for c in ("price", "status", "priority"))}), g AS (SELECT 100.0 * (count(*) - count(clan)) / count(*) AS pct, count(*) AS n FROM o),
t AS (SELECT max(n) / CAST(sum(n) AS DOUBLE) AS top FROM (SELECT count(*) AS n FROM o WHERE clan IS NOT NULL GROUP BY clan))"""


@query(f"""
WITH {_AUDITED}
SELECT 'missing' AS rule, field, round(pct, 6) AS value FROM m WHERE pct > 10 UNION ALL SELECT CASE field WHEN 'priority' THEN 'location' ELSE 'dominance' END, field, round(100 * share, 6) FROM d WHERE share > CASE field WHEN 'priority' THEN 0.3 ELSE 0.4 END
UNION ALL SELECT 'without_group', 'groups', round(pct, 6) FROM g WHERE pct > 30 UNION ALL SELECT 'top1', 'groups', round(100 * top, 6) FROM t WHERE top > 0.5
""")
def raw_audit_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What the audit of raw documents warns of."""
    return rounded(_audit(spark, sf).warnings())


@query(f"""
WITH {_AUDITED}, x AS (SELECT g.n AS n_rows, g.pct AS without_group, (SELECT avg(pct) FROM m) AS mean_missing_pct, (SELECT 100 * max(share) FROM d) AS dominance, (SELECT 100 * top FROM t) AS top1 FROM g)
SELECT n_rows, round(without_group, 6) AS without_group, round(mean_missing_pct, 6) AS mean_missing_pct, round(dominance, 6) AS dominance, round(top1, 6) AS top1,
  CASE WHEN n_rows < 1000 THEN 'Limited' WHEN n_rows >= 10000 AND mean_missing_pct < 5 AND dominance < 40 AND top1 < 40 AND without_group < 10 THEN 'Excellent' WHEN n_rows >= 5000 AND mean_missing_pct < 10 AND dominance < 50 AND top1 < 50 THEN 'Good' WHEN mean_missing_pct < 15 THEN 'Moderate' ELSE 'Limited' END || ' coverage' AS grade FROM x
""")
def raw_audit_grade(spark: SparkSession, sf: str) -> DataFrame:
    """The grade of the audit of raw documents."""
    return rounded(_audit(spark, sf).grade())


# sketches that merge --------------------------------------------------------------------------------------------------


def _batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    """All lines, in four batches."""
    lines = table(spark, sf, "lineitem")
    return [lines.where(F.pmod(F.col("l_orderkey"), F.lit(4)) == k) for k in range(4)]


@query("""
WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT feature, count(x) AS n, round(min(x), 4) AS min_value, round(max(x), 4) AS max_value, round(avg(x), 4) AS mean_value, round(stddev_samp(x), 4) AS std_value, round(stddev_samp(x) / avg(x), 4) AS cv, true AS p25_near, true AS p50_near, true AS p75_near, true AS p95_near FROM l GROUP BY feature
""")
def merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of four merged batches, and whether each quantile of their sketches is within the stated rank error of all lines."""
    cols, at = ["l_quantity", "l_extendedprice"], {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    out = sketches.numeric_from_state(sketches.merge_numeric(*[sketches.numeric_state(b, cols) for b in _batches(spark, sf)]))
    lines = table(spark, sf, "lineitem").select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_x")) for c in cols])))
    ranks = lines.join(F.broadcast(out.select("feature", *at)), "feature").groupBy("feature").agg(*[F.struct(F.avg((F.col("_x") < F.col(p)).cast("double")).alias("below"), F.avg((F.col("_x") <= F.col(p)).cast("double")).alias("upto")).alias(f"_{p}") for p in at])
    near = [((F.col(f"_{p}.below") <= share + sketches.RANK_ERROR) & (F.col(f"_{p}.upto") >= share - sketches.RANK_ERROR)).alias(f"{p}_near") for p, share in at.items()]
    return rounded(out.join(ranks, "feature").select("feature", "n", "min_value", "max_value", "mean_value", "std_value", "cv", *near), digits=4)


@query("""
WITH l AS (SELECT 'l_returnflag' AS feature, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem), c AS (SELECT feature, value, count(*) AS n FROM l GROUP BY ALL)
SELECT feature, value, n AS at_least, n AS at_most, round(n / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE), 6) AS share, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1 AS is_dominant FROM c
""")
def merged_frequent_values(spark: SparkSession, sf: str) -> DataFrame:
    """Frequent values of four merged batches: exact for columns of few values."""
    cols = ["l_returnflag", "l_linenumber"]
    return rounded(sketches.frequent_values(sketches.merge_frequent(*[sketches.frequent_state(b, cols) for b in _batches(spark, sf)])))


@query("SELECT count(*) AS n_rows, true AS covered, true AS bounded FROM lineitem")
def merged_frequent_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """A column of more values than a summary holds: each true count lies within the bounds, and the error under rows / (capacity + 1)."""
    capacity = 64
    state = sketches.merge_frequent(*[sketches.frequent_state(b, ["l_partkey"], capacity) for b in _batches(spark, sf)], capacity=capacity)
    lines = table(spark, sf, "lineitem")
    true = lines.groupBy(F.col("l_partkey").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = sketches.frequent_values(state).join(true, "value")
    checks = both.agg(F.every((F.col("at_least") <= F.col("n")) & (F.col("n") <= F.col("at_most"))).alias("covered"), F.max(F.col("at_most") - F.col("at_least")).alias("_error"))
    return lines.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(F.broadcast(checks)).select("n_rows", "covered", (F.col("_error") <= F.col("n_rows") / (capacity + 1)).alias("bounded"))


# canonical text of long values ------------------------------------------------------------------------------------------


def _escaped(x: str) -> str:
    unit = "printf('\\u%04x', {0})".replace("{0}", "unicode(c)")
    pair = "printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023))"
    return f"array_to_string(list_transform(regexp_extract_all(CAST(to_json({x}) AS VARCHAR), '(?s).'), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN {unit} ELSE {pair} END), '')"


@query(f"SELECT doc_id, sha256('{{\"a\": ' || {_escaped('source')} || ', \"z\": [' || {_escaped('text')} || ']}}') AS json_sha256 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def canonical_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of documents as canonical JSON: whole texts, of any length and alphabet."""
    docs = table(spark, sf, "documents").where("text is not null and source is not null")
    made = fn.canonical_json(F.parse_json(F.to_json(F.struct(F.array("text").alias("z"), F.col("source").alias("a")))))
    return docs.select("doc_id", F.sha2(made, 256).alias("json_sha256"))


# files ----------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey AS tag, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def documents_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers written as one JSON file per nation, and read back whole: files to objects to columns."""
    item = F.struct(F.col("s_suppkey").alias("tag"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    lists = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(item).alias("items"))
    path = f"{shared_folder(spark)}/{fresh_name('documents')}"
    lists.withColumn("nation", F.col("s_nationkey")).repartition("nation").write.partitionBy("nation").json(path)
    docs, _ = docs_io.read_documents(spark, f"{path}/*")
    items = docs_io.member_items(docs.withColumn("s_nationkey", docs_io.get("v", "$.s_nationkey", "bigint")), keep=("s_nationkey",)).where(F.col("item").isNotNull())
    return rounded(docs_io.flatten(items, {"tag": ("$.tag", "bigint"), "name": ("$.name", "string"), "balance": ("$.balance", "double")}, ("s_nationkey",), "item"), digits=2)


@query("SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS score, c_nationkey FROM customer")
def tables_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written twice over by the table sink, aligned with a schema, and read back under a contract."""
    from pyspark.sql import types as T

    folder = f"{shared_folder(spark)}/{fresh_name('tables')}"
    customers = table(spark, sf, "customer")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("c_nationkey", customers.schema["c_nationkey"].dataType)])
    tables_io.write_tables({"customers": customers.limit(5)}, folder)
    tables_io.write_tables({"customers": customers}, folder, {"customers": schema})
    return tables_io.read_table(spark, f"{folder}/customers.parquet", ["c_name", "score"], ["c_custkey"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS location_id, CAST(o_custkey AS BIGINT) AS minimum, count(*) AS n FROM orders GROUP BY ALL")
def history_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as log rows, appended in two batches and read back with their keys renamed."""
    path = f"{shared_folder(spark)}/{fresh_name('history')}"
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("location_id"), F.create_map(F.lit("min"), F.col("o_custkey").cast("bigint")).alias("filters"), F.lit("2024-01-01").alias("used_at"), F.lit(1).cast("bigint").alias("results"), F.lit(0).cast("bigint").alias("new_clans"))
    even = F.pmod(F.col("location_id").cast("bigint"), F.lit(2)) == 0
    tables_io.append_history(rows.where(even), path)
    tables_io.append_history(rows.where(~even), path)
    log = spark.read.json(path, schema="location_id string, filters map<string,bigint>")
    return log.select("location_id", fn.rename_keys("filters", {"min": "minimum"})["minimum"].alias("minimum")).groupBy("location_id", "minimum").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT feature, round(missing_pct, 6) AS missing_pct FROM (SELECT 'tax' AS feature, 100.0 * count(*) FILTER (tax IS NULL) / count(*) AS missing_pct FROM ({_SPARSE}) UNION ALL SELECT 'flag', 100.0 * count(*) FILTER (flag IS NULL) / count(*) FROM ({_SPARSE}))")
def report_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as JSON and read back."""
    from tarnfield.operators import stats
    from tarnfield.queries import _sparse

    path = f"{shared_folder(spark)}/{fresh_name('report')}"
    tables_io.write_report(stats.missing(_sparse(spark, sf), ["tax", "flag"]), path)
    return rounded(spark.read.schema("feature string, missing_pct double").json(path))


# datasets with all of their columns -------------------------------------------------------------------------------------

_MEMBERS_SQL = f"SELECT *, clan_capital_contributions AS capital_contributions FROM ({_FEATURE_SQL})"
_MEMBER_BASE = ["town_hall_level", "exp_level", "trophies", "builder_base_trophies", "donations", "donations_received", "capital_contributions"]


def _doubles(df: DataFrame, *keep: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """All numbers but ``keep`` as rounded doubles; a small ``shift``, as in the SQL, keeps halves from being rounded either way.

    They are rounded as one array: an expression for each of many columns makes a method too long for the JVM to compile.
    """
    numbers = [c for c, kind in df.dtypes if c not in keep and kind != "string"]
    values = F.transform(F.array(*[F.col(c).cast("double") for c in numbers]), lambda x: F.round(x + F.lit(shift), digits) + F.lit(0.0))
    apart = df.select(*[c for c in df.columns if c not in numbers], values.alias("_rounded"))
    return apart.select(*[F.get("_rounded", F.lit(numbers.index(c))).alias(c) if c in numbers else c for c in df.columns])


def _rank_sql(banned: list[str]) -> str:
    made = {c: c for c in [*_MEMBER_BASE, *(c for c in _FEATURES if c not in _MEMBER_BASE)]}
    for c in S.RANK_RELATIVE:
        made |= {f"clan_mean_{c}": f"m_{c}", f"{c}_diff_from_clan_mean": f"{c} - m_{c}", f"{c}_ratio_to_clan_mean": f"coalesce({c} / nullif(m_{c}, 0), 0)", f"{c}_clan_pct": f"r_{c} / n"}
    made |= {"clan_level": "CAST((c_custkey * 7) % 30 AS DOUBLE)", "clan_points": "CAST(c_custkey AS DOUBLE)"}
    rank = "rank() OVER (PARTITION BY clan_tag ORDER BY {0}) + (count(*) OVER (PARTITION BY clan_tag, {0}) - 1) / CAST(2 AS DOUBLE) AS r_{0}"
    return f"""WITH w AS (SELECT *, count(*) OVER g AS n, {", ".join(f"avg({c}) OVER g AS m_{c}, {rank.format(c)}" for c in S.RANK_RELATIVE)} FROM ({_MEMBERS_SQL}) WINDOW g AS (PARTITION BY clan_tag))
SELECT w.clan_tag, w.player_tag, c_mktsegment AS war_frequency, CAST(epoch(o_orderdate) AS BIGINT) AS clan_rank, {", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in made.items() if c not in banned)}
FROM w LEFT JOIN customer ON w.clan_tag = '#' || c_custkey JOIN orders ON w.player_tag = '#' || o_orderkey"""


def _ranks(spark: SparkSession, sf: str, variant: str) -> DataFrame:
    t = game_tables(spark, sf)
    return _doubles(datasets.rank_datasets(t, datasets.player_features(t))[variant], "clan_rank")


@query(_rank_sql([]))
def rank_with_trophies(spark: SparkSession, sf: str) -> DataFrame:
    """The rank dataset with trophies, all of its columns."""
    return _ranks(spark, sf, "with_trophies")


@query(_rank_sql(S.TROPHY_BANNED))
def rank_without_trophies(spark: SparkSession, sf: str) -> DataFrame:
    """The rank dataset without trophies, all of its columns."""
    return _ranks(spark, sf, "without_trophies")


_TEAM = {
    **{f"{a}_{c}": e.format(c) for c in S.WAR_STATS for a, e in (("mean", "avg({0})"), ("median", "quantile_cont({0}, 0.5)"), ("std", "coalesce(stddev_samp({0}), 0)"))},
    **{f"mean_{c}": f"avg({c})" for c in S.WAR_MEANS}, **{f"sum_{c}": f"sum({c})" for c in S.WAR_SUMS},
    "th18_percentage": "avg(CASE WHEN town_hall_level >= 18 THEN 1.0 ELSE 0.0 END)", "th17_plus_percentage": "avg(CASE WHEN town_hall_level >= 17 THEN 1.0 ELSE 0.0 END)",
    "member_count": "CAST(count(*) AS DOUBLE)", "donation_balance": "sum(donations) - sum(donations_received)", "donation_ratio": "coalesce(sum(donations) / nullif(sum(donations_received), 0), 0)",
    "donation_rate": "sum(donations) / count(*)", "capital_contribution_rate": "sum(clan_capital_contributions) / count(*)",
}
_WAR_SQL = f"""WITH v AS ({_WAR}), f AS ({_FEATURE_SQL}), t AS (SELECT f.clan_tag, {", ".join(f"round({e} + 1e-7, 5) + 0.0 AS {c}" for c, e in _TEAM.items())} FROM f JOIN v ON f.clan_tag = v.clan_tag GROUP BY f.clan_tag)
SELECT t.*, c_mktsegment AS war_frequency, CAST((c_custkey * 7) % 30 AS DOUBLE) AS clan_level, CAST(c_custkey AS DOUBLE) AS clan_points, CAST(c_nationkey AS DOUBLE) AS location_id, {{0}} FROM t JOIN v ON t.clan_tag = v.clan_tag JOIN customer ON t.clan_tag = '#' || c_custkey"""


def _wars(spark: SparkSession, sf: str) -> DataFrame:
    t = game_tables(spark, sf)
    return datasets.war_dataset(t, stored_features(t))


@query(_WAR_SQL.format("round(win_rate + 1e-7, 5) AS war_success_rate"))
def war_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The war dataset, all of its columns."""
    return _doubles(_wars(spark, sf), digits=5, shift=1e-7)


@query(_WAR_SQL.format("CASE WHEN win_rate < (SELECT quantile_cont(win_rate, 1.0 / 3) FROM v) THEN 'low' WHEN win_rate < (SELECT quantile_cont(win_rate, 2.0 / 3) FROM v) THEN 'medium' ELSE 'high' END AS performance_class"))
def class_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset of performance classes, all of its columns."""
    return _doubles(datasets.class_dataset(_wars(spark, sf))[0], digits=5, shift=1e-7)


def _player_documents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Orders as documents of players, with their lines as heroes, equipment, spells and achievements by line number."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    item = F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").alias("level"), F.col("l_suppkey").alias("maxLevel"), F.lit("home").alias("village"))
    award = F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").alias("stars"), F.col("l_suppkey").alias("value"), F.lit("home").alias("village"))
    kind = F.col("l_linenumber") % 4
    held = lines.groupBy("l_orderkey").agg(*[F.sort_array(F.collect_list(F.when(kind == k, x))).alias(n) for k, n, x in ((0, "heroes", item), (1, "heroEquipment", item), (2, "spells", item), (3, "achievements", award))])
    clan = F.struct(F.concat(F.lit("#"), "o_custkey").alias("tag"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 30).alias("clanLevel"))
    player = F.struct(F.concat(F.lit("#"), "o_orderkey").alias("tag"), F.col("o_orderstatus").alias("name"), (F.col("o_orderkey") % 18).alias("townHallLevel"), F.floor("o_totalprice").cast("bigint").alias("trophies"), F.when(F.col("o_orderstatus") != "P", clan).alias("clan"), "heroes", "heroEquipment", "spells", "achievements")
    texts = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("#"), "o_orderkey").alias("key_from_file"), F.to_json(player).alias("value"))
    people = docs_io.parse_documents(texts)[0]
    return datasets.normalised_tables(people.limit(0), people.limit(0), people)


_WITH_CLAN = "CASE WHEN o_orderstatus <> 'P' THEN {0} END"
_PLAYERS_SQL = {"player_tag": "'#' || o_orderkey", "name": "o_orderstatus", "town_hall_level": "o_orderkey % 18", "trophies": "floor(o_totalprice)", "clan_tag": _WITH_CLAN.format("'#' || o_custkey"), "clan_name": _WITH_CLAN.format("o_orderpriority"), "clan_level": _WITH_CLAN.format("o_custkey % 30")}


@query(f"SELECT {_columns_sql(S.PLAYERS, _PLAYERS_SQL)} FROM orders")
def normalised_players(spark: SparkSession, sf: str) -> DataFrame:
    """The players table from raw documents, all of its columns."""
    return _player_documents(spark, sf)["players"]


_HELD = "SELECT '#' || l_orderkey AS player_tag, CAST(l_partkey AS VARCHAR) AS name, l_linenumber AS line, l_suppkey AS supplier, l_linenumber % 4 AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY kind, player_tag, name ORDER BY line, supplier) = 1"


@query(f"SELECT ['player_heroes', 'player_hero_equipment', 'player_spells'][kind + 1] AS source, player_tag, name, CAST(line AS BIGINT) AS level, CAST(supplier AS BIGINT) AS max_level, 'home' AS village FROM ({_HELD}) WHERE kind < 3 {_FIRST}")
def normalised_progression(spark: SparkSession, sf: str) -> DataFrame:
    """Heroes, equipment and spells of players from raw documents; of equal names the first."""
    found, out = _player_documents(spark, sf), None
    for name in ("player_heroes", "player_hero_equipment", "player_spells"):
        part = found[name].select(F.lit(name).alias("source"), "player_tag", F.col(S.PROGRESSION[name][1]).alias("name"), "level", "max_level", "village")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT player_tag, name AS achievement_name, CAST(line AS BIGINT) AS stars, CAST(supplier AS BIGINT) AS value, CAST(NULL AS BIGINT) AS target, 'home' AS village FROM ({_HELD}) WHERE kind = 3 {_FIRST}")
def normalised_achievements(spark: SparkSession, sf: str) -> DataFrame:
    """Achievements of players from raw documents; of equal names the first."""
    return _player_documents(spark, sf)["player_achievements"]
