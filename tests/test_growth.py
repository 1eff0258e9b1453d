"""What operators shuffle and make again: figures that must not grow faster than their input."""

import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield import queries, report_queries, staging
from tarnfield.operators import features, matrix, order, select, stats
from tarnfield.plans import datasets
from tarnfield.sources import documents


@pytest.fixture
def shuffled(spark):
    """The rows that an action writes to shuffles."""

    def total():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    def measure(action):
        before = total()
        out = action()
        return out, total() - before

    return measure


def read_rows(spark, action):
    """The rows that an action reads from files."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).inputRecords() for k in range(stages.size()))

    before, out = total(), action()
    return out, total() - before


def numbers(spark, n):
    return spark.range(n).select(F.concat(F.lit("#"), "id").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("x"), (F.col("id") * 104729 % n / 3).alias("y"), (F.col("id") % 5).cast("double").alias("few"))


def test_clustering_matrix_is_made_once(spark, shuffled):
    df = numbers(spark, 30_000).repartition(4)
    (matrix, n), records = shuffled(lambda: (lambda m, r: (m.agg(F.count("x"), F.sum("y")).first(), r.first()))(*select.clustering_matrix(df, "k", ["x", "y", "few"])))
    assert matrix[0] == n.n_rows == 30_000 and records < 30_000 * 2.5  # the rows come and are grouped by key, once each


@pytest.mark.parametrize("at", [[0.5], [0, 0.1, 0.25, 0.75, 0.99, 1]])
def test_quantiles_do_not_shuffle_a_column(spark, shuffled, at):
    df = numbers(spark, 50_000).withColumn("none", F.lit(None).cast("double"))
    q, records = shuffled(lambda: order.exact_quantiles(df, ["x", "y", "few", "none"], at))
    assert q["none"] is None and records < 5000
    assert all(abs(a - b) < 1e-6 for a, b in zip(q["x"], np.quantile(np.arange(50_000), at), strict=True))
    assert all(abs(a - b) < 1e-6 for a, b in zip(q["y"], np.quantile(np.arange(50_000) / 3, at), strict=True))
    assert q["few"] == [float(x) for x in np.quantile(np.arange(50_000) % 5, at)]


def test_windows_of_groups_take_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "TASK_ROWS", 1000, raising=False)
    df = numbers(spark, 30_000).withColumn("g", F.col("x") % 3000)
    out = features.group_relative(df, "g", ["y", "few"], ["y", "few"])
    assert out.count() == 30_000 and out.select(F.spark_partition_id()).distinct().count() > 20


def test_target_correlation_shuffles_values_not_rows(spark, shuffled, monkeypatch):
    x = F.col("x")
    df = numbers(spark, 20_000).select((x % 4999).alias("t"), F.when(x % 7 != 0, x % 11).alias("a"), "few", F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("none"))
    find = lambda: {r.feature: (round(r.pearson, 9), round(r.spearman, 9)) if r.pearson is not None else None for r in stats.target_correlation(df, "t", ["a", "few", "flat", "none"]).collect()}
    found, records = shuffled(find)
    monkeypatch.setattr(stats, "FEW", 0, raising=False)
    assert found == find() and found.keys() == {"a", "few", "flat"} and found["flat"] is None and records < 60_000


def test_classes_make_their_rows_once(spark, shuffled):
    war = numbers(spark, 10_000).repartition(8).select(F.col("k").alias("clan_tag"), (F.col("x") / 10_000).alias("war_success_rate"), "few")
    out, records = shuffled(lambda: datasets.class_dataset(war)[0].groupBy("performance_class").count().collect())
    assert sum(r["count"] for r in out) == 10_000 and records < 25_000  # the rows come once, and are grouped once by key


def test_documents_are_parsed_once(spark):
    texts = spark.range(5).select(F.to_json(F.struct(F.col("id").alias("tag"))).alias("value"))
    docs = documents.flatten(documents.parse_documents(texts)[0], {"tag": ("$.tag", "bigint")}).where("tag > 1")
    assert docs._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1 and docs.count() == 3


def test_distances_take_few_passes(spark, tmp_path):
    numbers(spark, 30_000).write.parquet(f"{tmp_path}/n")
    df = spark.read.parquet(f"{tmp_path}/n")
    out, rows = read_rows(spark, lambda: matrix.distance_outliers(df, "k", ["few", "x"]).collect())
    assert len(out) == 300 and rows < 10.5 * 30_000  # 11 passes where distances are counted before their quantile
    one = matrix.distance_outliers(df.where("x < 1"), "k", ["few", "x"])
    assert one.count() == 0 and order.exact_quantiles(df.where("x < 0"), ["x"], [0.5], many=True) == {"x": None}


def test_cuts_of_information_are_compiled(spark):
    df = numbers(spark, 2000).select("few", (F.col("y") * 2).alias("twice"), "y", F.lit(None).cast("double").alias("none"))
    out = stats.binned_mutual_information(df, ["twice", "few", "none"], "y", bin_target=True)
    found = {r.feature: r.mi for r in out.collect()}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.keys() == {"twice", "few"} and abs(found["twice"] - np.log(10)) < 1e-9 and abs(found["few"]) < 0.1


def test_lines_are_collected_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "TASK_ROWS", 100)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = queries.explode_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {-(-n // 100)}" in "".join(line for line in plan.splitlines() if "RepartitionByExpression" in line)


def test_ranks_shuffle_their_rows_once(spark, shuffled):
    """The rows of the rank dataset are shuffled to be joined, for the audit, and once for ranks, means and the context of clans too large to broadcast."""
    t = queries.game_tables(spark, "/root/testdata/sf0.001")
    n, players = t["clan_members"].count(), staging.staged(datasets.player_features(t), "players")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, records = shuffled(lambda: datasets.rank_datasets(t, players)["with_trophies"].write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 4 * n < records < 8 * n  # 16 n where the audit shuffled a row per variable, and ranks went back to their rows by number


def test_ranks_of_rows_come_back_by_number(spark, rows, monkeypatch):
    df = numbers(spark, 300).withColumns({"g": F.when(F.col("x") % 3 > 0, F.col("x") % 3), "x": F.when(F.col("x") % 7 > 0, F.col("x"))})
    df = staging.staged(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    find = lambda: rows(features.group_relative(df, "g", ["x", "few"], ["y"], emit_means=True, row="_row"), "k", "g", "y_group_pct", "x_diff_from_group_mean", "few_ratio_to_group_mean", "group_mean_x")
    found = find()
    for name in ("TASK_ROWS", "GROUP_ROWS"):
        monkeypatch.setattr(order, name, 10)
        assert find() == found and len(found) == 300


def test_staged_tables_leave_no_shuffle_files(spark):
    held = lambda: {f for f in glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True)}
    before = held()
    out = staging.staged(numbers(spark, 20_000).repartition(4, "k"), "parted")
    end = time.monotonic() + 20
    while held() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not held() - before and out.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_ranks_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes for good."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = report_queries.rank_with_trophies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert stages.size() and max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
