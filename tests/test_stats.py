"""Statistics against plain Python."""

import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from tarnfield import staging
from tarnfield.operators import features, matrix, order, stats

VALUES = [1, 2, 2, 7, 9, 30]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(x, i % 2) for i, x in enumerate(VALUES)] + [(None, 1)], "x int, c int")


def test_summary_and_shape(spark, rows, numbers):
    r = stats.numeric_summary(numbers, ["x"]).first()
    assert (r.n, r.min_value, r.max_value, r.p25, r.p50) == (6, 1, 30, 2.0, 4.5) and abs(r.mean_value - 8.5) < 1e-9 and abs(r.std_value - st.stdev(VALUES)) < 1e-9
    assert abs(r.cv - st.stdev(VALUES) / 8.5) < 1e-9 and r.iqr == r.p75 - r.p25
    s = stats.shape(numbers, ["x"]).first()
    assert [round(v, 6) for v in (s.skew, s.kurt, s.skew_pop, s.kurt_pop)] == [2.017934, 4.270822, 1.473690, 0.607139]
    one = stats.numeric_summary(spark.createDataFrame([("5",), ("text",), (None,)], "x string"), ["x"]).first()
    assert (one.n, one.std_value, one.p50) == (1, 0.0, 5.0)
    assert stats.numeric_summary(spark.createDataFrame([(-1.0,), (1.0,)], "x double"), ["x"]).first().cv is None
    assert stats.describe(numbers, ["x"]).first().p50 == 4.5
    assert rows(stats.numeric_summary(numbers, ["x"], ["c"]), "c", "n") == [(0, 3), (1, 3)]
    flat = stats.shape(spark.createDataFrame([(1.0,)] * 5, "x double"), ["x"]).first()
    assert flat.skew is None or math.isnan(flat.skew) or flat.skew == 0


def test_distributions(spark, rows):
    df = spark.createDataFrame([("a",)] * 9 + [("b",), (None,)], "v string")
    assert rows(stats.categorical_distribution(df, "v")) == [("a", 9, 0.9, True, False), ("b", 1, 0.1, False, False)]
    c = stats.concentration(df, "v").first()
    assert (c.n_values, round(c.hhi, 6), round(c.entropy, 6)) == (2, 0.82, 0.325083) and abs(c.normalised_entropy - 0.325083 / math.log(2)) < 1e-5
    assert stats.concentration(df.where("v = 'a'"), "v").first().normalised_entropy == 0.0
    assert rows(stats.missing(df, ["v"])) == [("v", 1, 9.090909)]
    assert rows(stats.missing(df.limit(0), ["v"])) == [("v", 0, None)]
    assert rows(stats.class_balance(df, "v"), "class", "n", "imbalance_ratio", "severity") == [("a", 9, 9.0, "high"), ("b", 1, 9.0, "high")]
    assert rows(stats.encode_category(df.distinct(), "v", "code")) == [("a", 0), ("b", 1), (None, None)]


def test_group_sizes_and_bins(spark, rows):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 3 + [("c",)], "g string")
    s = stats.group_sizes(df, "g").first()
    assert (s.n_groups, s.mean_size, s.median_size, s.min_size, s.max_size, s.top1_share, s.top10_share) == (3, 2.0, 2.0, 1, 3, 0.5, 1.0)
    n = spark.createDataFrame([(0,), (1,), (7,), (250,), (None,)], "n int")
    assert rows(stats.binned(n, "n", [0, 1, 5, 10], ["0", "1-4", "5-9", "10+"])) == [(0, "0", 1, 25.0, 1.0), (1, "1-4", 1, 25.0, 0.75), (2, "5-9", 1, 25.0, 0.5), (3, "10+", 1, 25.0, 0.25)]
    assert sum(r.n for r in stats.histogram(n, "n", 4).collect()) == 4
    assert rows(stats.histogram(spark.createDataFrame([(3,), (3,)], "n int"), "n", 4)) == [(0, 2)]
    assert rows(stats.five_number(n.withColumn("c", F.lit("k")), "c", "n")) == [("k", 0.0, 0.75, 4.0, 67.75, 250.0)]


def test_constancy_and_outliers(spark, rows):
    df = spark.createDataFrame([(1.0, None if k % 2 else 2.0, float(k)) for k in range(20)] + [(1.0, 2.0, 500.0)], "flat double, holes double, x double")
    m = {r.feature: r for r in stats.mode_frequency(df, ["flat", "holes", "x"]).collect()}
    assert (m["flat"].nearly_constant, m["flat"].zero_variance, m["holes"].mode_n, m["x"].low_variance) == (True, True, 11, False)
    assert {r.feature: r.mode_share for r in stats.mode_frequency(df, ["holes"], count_nulls=False).collect()} == {"holes": 1.0}
    o = {r.feature: r for r in stats.iqr_outliers(df, ["flat", "x"]).collect()}
    assert (o["x"].n_outliers, o["flat"].n_outliers) == (1, 0)
    assert rows(stats.duplicates(df.select("flat"))) == [(21, 20)] and rows(stats.duplicates(df.limit(0))) == [(0, 0)]
    assert rows(stats.cardinality(df, ["flat", "x"])) == [("flat", 1, False), ("x", 21, True)]
    z = {r.feature: r for r in stats.zero_missing_profile(df, ["holes", "x"]).collect()}
    assert abs(z["holes"].missing_pct - 1000 / 21) < 1e-9 and z["x"].log_advice == "strong"
    assert rows(stats.group_profile(stats.zero_missing_profile(df, ["holes", "x"]), {"gaps": "hole"}), "concept", "n_features") == [("gaps", 1), ("other", 1)]


def ranks(xs):
    s = sorted(xs)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in xs]


def corr(a, b):
    ma, mb = st.mean(a), st.mean(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def test_correlations(spark):
    r = random.Random(1)
    data = [(r.randint(0, 9), r.randint(0, 9) + k / 10, 1.0) for k in range(40)]
    df = spark.createDataFrame([*data, (None, 3.0, 1.0)], "x int, y double, flat double")
    out = {t.feature: t for t in stats.target_correlation(df, "y", ["x", "flat"]).collect()}
    x, y = [d[0] for d in data], [d[1] for d in data]
    assert abs(out["x"].pearson - corr(x, y)) < 1e-9 and abs(out["x"].spearman - corr(ranks(x), ranks(y))) < 1e-9
    assert out["flat"].pearson is None and out["flat"].spearman is None
    pairs = stats.correlation_pairs(spark.createDataFrame([(a, b, a * 2.0) for a, b, _ in data], "x int, y double, z double"), ["x", "y", "z"], "spearman", 0.85).collect()
    assert [(p.feature_a, p.feature_b, round(p.r, 6)) for p in pairs] == [("x", "z", 1.0)]


def test_tests_of_groups(spark):
    r = random.Random(2)
    data = [(k % 3, r.randint(0, 20) + k % 3) for k in range(60)] + [(7, 3)] * 3
    df = spark.createDataFrame(data, "c int, x int")
    groups = [[x for c, x in data if c == k] for k in (0, 1, 2, 7)]
    every = [x for _, x in data]
    m = st.mean(every)
    f = (sum(len(g) * (st.mean(g) - m) ** 2 for g in groups) / 3) / (sum(sum((x - st.mean(g)) ** 2 for x in g) for g in groups) / (len(every) - 4))
    assert abs(stats.anova_f(df, "c", ["x"]).first().f - f) < 1e-6
    large = [x for c, x in data if c != 7]
    rk = dict(zip(large, ranks(large), strict=True))
    n = len(large)
    h = 12 / (n * (n + 1)) * sum(sum(rk[x] for x in g) ** 2 / len(g) for g in groups[:3]) - 3 * (n + 1)
    h /= 1 - sum(large.count(v) ** 3 - large.count(v) for v in set(large)) / (n**3 - n)
    got = stats.with_p_values(stats.kruskal_h(df, "c", ["x"])).first()
    assert abs(got.h - h) < 1e-6 and got.df == 2 and abs(got.p - math.exp(-h / 2)) < 1e-9
    assert abs(stats.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(stats.chi2_tail(7.814728, 3) - 0.05) < 1e-6 and abs(stats.chi2_tail(9.487729, 4) - 0.05) < 1e-6


def test_mutual_information(spark):
    same = spark.createDataFrame([(float(k % 4), k % 4) for k in range(80)], "x double, c int")
    assert abs(stats.binned_mutual_information(same, ["x"], "c", bins=4).first().mi - math.log(4)) < 1e-9
    free = spark.createDataFrame([(float(k % 4), k // 4 % 2) for k in range(80)], "x double, c int")
    assert abs(stats.binned_mutual_information(free, ["x"], "c", bins=4).first().mi) < 1e-9


def test_proxy_audit(spark):
    r = random.Random(3)
    data = [(g, k, float(-k), r.random(), None, 1) for g in range(6) for k in range(12)] + [(99, 1, 1.0, 1.0, None, 1)]
    df = spark.createDataFrame(data, "g int, y int, direct double, noise double, void double, flat int")
    out = {x.feature: (x.n_groups, x.median_rho, x.classification) for x in stats.proxy_audit(df, "g", "y", ["direct", "noise", "void", "flat"], ["void"]).collect()}
    assert out["direct"] == (6, -1.0, "TOO_DIRECT") and out["noise"][2] == "SAFE" and out["flat"] == (0, None, "INSUFFICIENT_DATA") and out["void"][2] == "EXCLUDE"


def test_warnings_and_grades(spark, rows):
    df = spark.createDataFrame([("a", None if k < 3 else 1) for k in range(10)], "v string, n int")
    out = stats.warnings({"v": stats.categorical_distribution(df, "v")}, stats.missing(df, ["n"]), stats.group_sizes(df, "v"))
    assert rows(out) == [("dominance", "v", 100.0), ("missing", "n", 30.0), ("top1", "groups", 100.0)]
    cases = [(0, None, None, None, None), (999, 0, 0, 0, 0), (10_000, 4.9, 39, 39, 9), (10_000, 4.9, 39, 39, 11), (5000, 9, 49, 49, 90), (1000, 14, 99, 99, 99), (1000, 16, 0, 0, 0)]
    got = stats.coverage_grade(spark.createDataFrame([tuple(None if x is None else float(x) for x in c) for c in cases], "n_rows double, mean_missing_pct double, dominance double, top1 double, without_group double")).collect()
    assert [r.grade.split()[0] for r in got] == ["Limited", "Limited", "Excellent", "Good", "Good", "Moderate", "Limited"]


def test_manifest_and_rankings(spark, rows):
    df = spark.createDataFrame([("a", 3.0), ("b", -5.0), ("c", None)], "feature string, s double")
    a, b = stats.manifest(df).first(), stats.manifest(df.orderBy(F.desc("feature"))).first()
    assert a == b and (a.row_count, a.feature_count) == (3, 2) and stats.manifest(df.limit(2)).first().content_hash != a.content_hash
    assert [r.feature for r in stats.rank_features(df, "s", 2, absolute=True).collect()] == ["b", "a"]
    assert [r.feature for r in stats.top_rows(df, "s", 2).collect()] == ["a", "b"]


def test_matrix(spark, rows):
    df = spark.createDataFrame([(k, float(k % 10), 3.0, float(k)) for k in range(100)] + [(100, 900.0, 3.0, 5.0)], "id int, x double, flat double, y double")
    s = matrix.standard_scale(df, ["x", "flat"]).agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("flat"))).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and s[2] == 0
    r = matrix.robust_scale(df, ["x", "flat"]).where("id = 4").first()
    assert r.flat == 0 and abs(r.x - (4 - 5) / 5) < 0.3
    v = matrix.pca_variance(df, ["x", "y"]).collect()
    assert abs(v[-1].cumulative - 1) < 1e-9 and v[0].explained >= v[1].explained
    assert matrix.components_needed(matrix.pca_variance(df, ["x", "y"]), 0.99).first()[0] == 2
    assert [x.id for x in matrix.distance_outliers(df, "id", ["x"]).collect()] == [100]
    assert matrix.pca_project(df, "id", ["x", "y"]).count() == 101


@pytest.mark.parametrize("buffer", [1_000_000, 10])
def test_exact_quantiles(spark, monkeypatch, buffer):
    """The same from one buffer and from stretches that are put in order apart."""
    monkeypatch.setattr(order, "BUFFER_VALUES", buffer)
    r = random.Random(3)
    data = [(r.choice([0.0, 1.0, r.gauss(0, 5)]), r.randrange(400), None if k % 3 else float(k), None) for k in range(997)]
    df = spark.createDataFrame(data, "a double, b int, c double, none double")
    at = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = order.exact_quantiles(df, ["a", "b", "c", "none"], at)
    for k, c in enumerate("abc"):
        values = sorted(x[k] for x in data if x[k] is not None)
        for p, q in zip(at, got[c], strict=True):
            low = int(p * (len(values) - 1))
            high = min(low + 1, len(values) - 1)
            assert q == pytest.approx(values[low] + (values[high] - values[low]) * (p * (len(values) - 1) - low))
    assert got["none"] is None and order.exact_quantiles(df, [], at) == {}


def test_running_totals(spark):
    data = [("x", float(k % 37), 1 + k % 3) for k in range(37)] + [("y", float(-k), 2) for k in range(90)]
    df = spark.createDataFrame([(float(k % 37), float(-k)) for k in range(90)], "x double, y double")
    out = order.running_total(spark.createDataFrame(data, "feature string, value double, n int"), order.cuts(df, ["x", "y"]), "n").collect()
    for f in "xy":
        total = 0
        for row in sorted((r for r in out if r.feature == f), key=lambda r: r.value):
            total += row.n
            assert row.upto == total
    assert len(out) == len(data)


def test_audit_rules_on_locations_and_groups(spark):
    df = spark.createDataFrame([("a", None if k % 2 else k, "p" if k < 4 else f"p{k}") for k in range(10)], "v string, g int, place string")
    out = stats.warnings({"v": stats.categorical_distribution(df, "v"), "location": stats.categorical_distribution(df, "place")}, stats.missing(df, ["v"]), None, stats.association_totals(df, "v", "g"))
    assert sorted((r.rule, r.field, r.value) for r in out.collect()) == [("dominance", "v", 100.0), ("location", "location", 40.0), ("without_group", "groups", 50.0)]


def test_mode_of_text_and_hash_of_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, None)], "t string, n int")
    m = {r.feature: r for r in stats.mode_frequency(df, ["t", "n"]).collect()}
    assert (m["t"].mode_n, m["t"].zero_variance, m["n"].mode_share, m["n"].zero_variance) == (2, None, 0.75, True)
    twice = lambda v: spark.createDataFrame([(v,), (v,)], "x string")
    hashes = {stats.manifest(d).first().content_hash for d in (twice("a"), twice("b"), twice(None), twice("a").limit(1))}
    assert len(hashes) == 4 and stats.manifest(df).first().content_hash == stats.manifest(df.orderBy("t")).first().content_hash


# groups and values of any size --------------------------------------------------------------------------------------


@pytest.fixture
def large_groups(spark):
    """Rows of which one group holds most, with one value in nine of ten of them."""
    r = random.Random(7)
    data = [(r.choice([1, 1, 1, 1, 2, 3, None]), 0.0 if r.random() < 0.9 else round(r.random(), 2), r.choice([None, 1.0, 2.5, r.random()]), k) for k in range(1500)]
    return spark.createDataFrame(data, "g int, x double, y double, k int")


def same_both_ways(monkeypatch, build, *cols):
    """The result with whole groups in a task and with stretches of them."""
    key = lambda t: [repr(x) for x in t]
    got = []
    for bound in (1_000_000, 10):
        monkeypatch.setattr(order, "GROUP_ROWS", bound)
        monkeypatch.setattr(order, "SMALL", bound)
        got.append(sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in build().select(*cols).collect()), key=key))
    assert got[0] == got[1] and got[0]


def test_quantiles_of_large_groups(large_groups, monkeypatch):
    df = large_groups.where("g is not null")
    same_both_ways(monkeypatch, lambda: stats.numeric_summary(large_groups, ["x", "y"], ["g"]), "g", "feature", "n", "p25", "p50", "p75", "p95", "iqr")
    same_both_ways(monkeypatch, lambda: stats.five_number(df, "g", "y"), "g", "min_value", "q1", "median", "q3", "max_value")
    same_both_ways(monkeypatch, lambda: features.group_composition(large_groups, "g", ["x", "y"], ["k"], {"zero": F.col("x") == 0}, ["k"]), "*")
    same_both_ways(monkeypatch, lambda: stats.proxy_audit(large_groups, "g", "k", ["x", "y"]), "*")


def test_ranks_of_large_groups(large_groups, monkeypatch):
    same_both_ways(monkeypatch, lambda: features.group_relative(large_groups, "g", ["x", "y"], ["x", "y"], emit_means=True), "*")
    same_both_ways(monkeypatch, lambda: stats.group_spearman(large_groups, "g", "k", ["x", "y"]), "*")
    same_both_ways(monkeypatch, lambda: stats.target_correlation(large_groups, "k", ["x", "y", "k"]), "*")
    same_both_ways(monkeypatch, lambda: stats.kruskal_h(large_groups, "g", ["x", "y"]), "*")
    same_both_ways(monkeypatch, lambda: stats.correlation_pairs(large_groups, ["x", "y", "k"], "spearman"), "*")


def test_no_task_holds_a_large_group(large_groups, monkeypatch):
    """Windows are keyed by stretches besides the group, and no buffer collects its values."""
    monkeypatch.setattr(order, "GROUP_ROWS", 10)
    plan = order.quantiles_by(large_groups, ["g"], ["x", "y"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and "percentile(" not in plan
    assert all("_stretch" in line.split("], [")[1] or "_in" in line for line in windows)


def test_heavy_values_are_spread(spark, monkeypatch):
    """Nine of ten values are 0: their rows go to many tasks, and have the ranks of all the others."""
    monkeypatch.setattr(order, "SMALL", 10)
    df = spark.range(40_000).select(F.when(F.col("id") % 10 != 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"), "id")
    ranks = order.average_ranks(order.value_counts(df, ["x"]), order.cuts(df, ["x"]))
    ranks = staging.staged(ranks, "ranks")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = order.attach(df.select(F.lit("x").alias("feature"), F.col("x").alias("value"), "id"), ranks, ["feature", "value"], "n")
        parts = [r["count"] for r in joined.where("value = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(parts) < 0.4 * sum(parts) and sum(parts) == 36_001
    assert {r.avg_rank for r in joined.where("value = 0").select("avg_rank").distinct().collect()} == {18_001.0}


def test_category_codes_without_one_task(spark):
    r = random.Random(3)
    values = [r.choice([None, "", "é", "zz", f"v{r.randint(0, 3000)}"]) for _ in range(6000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    out = stats.encode_category(df, "v", "code")
    codes = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    assert {x.k: x.code for x in out.collect()} == {k: codes.get(v) for k, v in enumerate(values)}
    assert out.columns == ["k", "v", "code"] and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert stats.encode_category(df.limit(0), "v", "code").count() == 0
