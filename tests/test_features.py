"""Entity features, group-relative features, compositions, targets."""

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import clean, features, select
from tarnfield.sources.tables import ContractError

PROGRESS = [("#P1", 5, 50), ("#P1", 6, 60), ("#P2", 4, 0), ("#P2", None, 10)]


def test_child_aggregate_and_null_policies(spark, rows):
    child = spark.createDataFrame(PROGRESS, "k string, level bigint, max_level bigint")
    assert rows(features.child_aggregate(child, "k", "troop", "level", "max_level")) == [("#P1", 2, 5.5, 0.1), ("#P2", 2, 2.0, None)]
    assert rows(features.child_aggregate(child, "k", "troop", "level", "max_level", "skip")) == [("#P1", 2, 5.5, 0.1), ("#P2", 2, 4.0, None)]
    assert rows(features.child_aggregate(child, "k", "a", None, None, value=("level", "max_level"))) == [("#P1", 2, 0.1), ("#P2", 2, None)]


def test_states_merge_to_the_whole(spark, rows):
    child = spark.createDataFrame([(f"#{k % 7}", k % 11 if k % 5 else None, k % 3) for k in range(200)], "k string, level bigint, max_level bigint")
    parts = [features.partial_state(child.where(F.col("max_level") == m), "k", "level", "max_level") for m in range(3)]
    got = features.finalize_state(features.merge_states(*parts, key="k"), "k", "x")
    assert rows(got) == rows(features.child_aggregate(child, "k", "x", "level", "max_level"))


def test_entities_without_children_get_zero(spark, rows):
    base = spark.createDataFrame([("#P1", 10, 4), ("#P2", None, 0), ("#P3", 1, 1)], "k string, given bigint, got bigint")
    child = spark.createDataFrame(PROGRESS[:2], "k string, level bigint, max_level bigint")
    from tarnfield.functions import safe_ratio

    out = features.entity_features(base, "k", [features.child_aggregate(child, "k", "t", "level", "max_level")], {"ratio": safe_ratio("given", "got")})
    assert rows(out) == [("#P1", 10.0, 4.0, 2.5, 2.0, 5.5, 0.1), ("#P2", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("#P3", 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)]


def test_group_relative_ties_and_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 2.0), ("a", 4, None), ("a", 5, 5.0), ("b", 6, 3.0), ("b", 7, 3.0), ("b", 8, None)], "g string, id int, x double")
    out = features.group_relative(df, "g", ["x"], ["x"], fill=None)
    assert rows(out, "id", "x_group_pct") == [(1, 0.25), (2, 0.625), (3, 0.625), (4, None), (5, 1.0), (6, 0.75), (7, 0.75), (8, None)]
    assert rows(out, "id", "x_diff_from_group_mean")[0] == (1, -1.5)
    zero = features.group_relative(spark.createDataFrame([("z", 1, 0.0)], "g string, id int, x double"), "g", ["x"], emit_means=True)
    assert rows(zero) == [("z", 1, 0.0, 0.0, 0.0, 0.0)]
    assert out.count() == df.count() and features.group_relative(df.limit(0), "g", ["x"], ["x"]).count() == 0


def test_group_composition(spark, rows):
    df = spark.createDataFrame([("a", 10, 18, 5), ("a", 20, None, None), ("b", 30, 17, None), (None, 1, 1, 1)], "g string, x int, th int, d int")
    out = features.group_composition(df, "g", ["x"], ["th"], {"th18": F.col("th") >= 18}, ["d"])
    assert rows(out) == [("a", 2, 15.0, 15.0, 7.071068, 18.0, 0.5, 5), ("b", 1, 30.0, 30.0, None, 17.0, 0.0, 0)]


def test_rate_target_and_classes(spark, rows):
    df = spark.createDataFrame([("a", 3, 1, 1), ("b", 0, 0, 0), ("c", 1, None, 5), ("d", 2, 0, 0)], "k string, w int, l int, t int")
    assert rows(features.rate_target(df, "w", ["w", "l", "t"], 2, "r"), "k", "r") == [("a", 0.6), ("d", 1.0)]
    from tarnfield.functions import classify

    rates = spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.59, 0.6, 0.9, 0.0, 1.0)], "r double")
    assert [r[1] for r in rates.select("r", classify("r", 0.4, 0.6)).collect()] == ["low", "medium", "medium", "high", "high", "low", "high"]
    for low, high in ((0.6, 0.4), (-0.1, 0.5), (0.5, 1.5), (0.5, 0.5)):
        with pytest.raises(ValueError):
            classify("r", low, high)
    kept, counts = features.valid_rates(spark.createDataFrame([(float("nan"),), (-0.1,), (0.3,), (1.5,), (0.7,), (None,)], "r double"), "r")
    assert rows(kept) == [(0.3,), (0.7,)] and rows(counts) == [(2, 4)]


def test_keep_first_is_ordered(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 2, "w")], "k string, o int, v string")
    assert rows(clean.keep_first(df, ["k"], ["o"]), "k", "v") == [("a", "y"), (None, "z")]


def test_fills(spark, rows):
    df = spark.createDataFrame([("k", None, None, None), (None, 3, True, "x")], "key string, n int, b boolean, t string")
    assert rows(clean.typed_fill(df, ["key"])) == [("k", 0, False, "unknown"), (None, 3, True, "x")]
    text = spark.createDataFrame([("a", "1.5", None), ("b", "no", 2)], "k string, x string, y int")
    assert rows(clean.zero_fill(text, ["k"])) == [("a", 1.5, 0.0), ("b", 0.0, 2.0)]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert rows(clean.clean_infinite(odd, ["x"])) == [(0.0,), (0.0,), (0.0,), (2.0,)]
    out, medians = clean.median_impute(spark.createDataFrame([(1.0, None), (4.0, None), (None, None)], "x double, y double"), ["x", "y"])
    assert out.columns == ["x"] and medians == {"x": 2.5} and rows(out) == [(1.0,), (2.5,), (4.0,)]


def test_selection(spark, rows):
    df = spark.createDataFrame([(1,) * 6], "donations int, donations_received int, clan_mean_donations int, role int, ROLE_name int, x int")
    assert select.ban(df, ["donations"]).columns == ["clan_mean_donations", "role", "ROLE_name", "x"]
    assert select.ban(df, ["donations"], strict=True).columns == ["role", "ROLE_name", "x"]
    assert select.ban(df, ["donations"], keep=["donations"]).columns[0] == "donations"
    assert select.exclude(df, ["x"], ["role"]).columns == ["donations", "donations_received", "clan_mean_donations"]
    assert select.whitelist(df, ["x", "none", "role"]).columns == ["x", "role"]
    left, right = spark.createDataFrame([(1, "l")], "k int, v string"), spark.createDataFrame([(1, "r", 2)], "k int, v string, w int")
    assert rows(select.join_keep_left(left, right, ["k"])) == [(1, "l", 2)]


def test_clustering_matrix(spark, rows):
    df = spark.createDataFrame([("a", 1.0, None, None, "t", 9), ("b", None, 4.0, None, "u", 9), ("b", None, 4.0, None, "u", 9), ("c", 3.0, 5.0, None, None, 9)], "k string, x double, y double, void double, text string, target_rank int")
    matrix, report = select.clustering_matrix(df, "k", ["x", "y", "void", "text", "absent", "target_rank"], substrings=["RANK"])
    assert matrix.columns == ["k", "x", "y"] and rows(matrix) == [("a", 1.0, 4.5), ("b", 2.0, 4.0), ("c", 3.0, 5.0)]
    assert rows(report) == [(3, 6, 4, 2, 1, 1, 5)]
    assert select.high_cardinality(matrix, ["k", "x"]) == ["k", "x"]
    with pytest.raises(ContractError):
        select.clustering_matrix(df, "k", ["text"])
