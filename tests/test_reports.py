"""Whole reports from counted values and facts, merged sketches: against the operators that read rows, and plain Python."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import counted, sketches, stats
from tarnfield.plans.audit import Audit, document_facts
from tarnfield.plans.profile import Profile, profile
from tarnfield.streaming import state


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(11)
    data = [(k, r.choice([None, 0.0, 0.0, 1.5, r.random() * 10]), r.choice([None, r.randint(0, 5)]), 7.0, r.choice(["a", "b", "b", None, "c"]), r.choice(["x", None])) for k in range(700)]
    return spark.createDataFrame(data, "k int, u double, v int, flat double, c string, t string").cache()


def table_of(df):
    return {r[0] if len(r) else None: {k: round(x, 8) if isinstance(x, float) else x for k, x in r.asDict().items()} for r in df.collect()}


def test_counted_tables_equal_those_of_rows(mixed):
    numeric, texts = ["u", "v", "flat"], ["c", "t"]
    counts = counted.without_key(counted.counted(mixed, numeric, texts, "c"))
    for ours, theirs in (
        (counted.numeric_summary(counts), stats.numeric_summary(mixed, numeric)), (counted.describe(counts), stats.describe(mixed, numeric)), (counted.shape(counts), stats.shape(mixed, numeric)),
        (counted.missing(counts), stats.missing(mixed, [*numeric, *texts])), (counted.cardinality(counts), stats.cardinality(mixed, [*numeric, *texts])), (counted.mode_frequency(counts), stats.mode_frequency(mixed, [*numeric, *texts])),
        (counted.iqr_outliers(counts), stats.iqr_outliers(mixed, numeric)), (counted.zero_missing_profile(counts.where("feature in ('u', 'v', 'flat')")), stats.zero_missing_profile(mixed, numeric)),
        (counted.distribution(counts, "c"), stats.categorical_distribution(mixed, "c")), (counted.class_balance(counts, "c"), stats.class_balance(mixed, "c")),
    ):
        assert ours.columns == theirs.columns and table_of(ours) == table_of(theirs)


def test_counted_tables_by_class(mixed):
    by_class = counted.counted(mixed, ["u", "v", "flat"], ["t"], "c")
    assert table_of(counted.anova_f(by_class)) == table_of(stats.anova_f(mixed, "c", ["u", "v", "flat"]))
    assert table_of(counted.kruskal_h(by_class)) == table_of(stats.kruskal_h(mixed, "c", ["u", "v", "flat"]))
    theirs = {(r.c, "u"): tuple(r)[1:] for r in stats.five_number(mixed.where("c is not null"), "c", "u").collect()}
    assert {(r.key, r.feature): tuple(r)[2:] for r in counted.five_numbers(by_class).where("feature = 'u'").collect()} == theirs


def test_counts_of_batches_add_up(mixed):
    parts = [counted.counted(mixed.where(F.col("k") % 3 == k), ["u"], ["c"]) for k in range(3)]
    whole = counted.without_key(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert table_of(counted.numeric_summary(whole)) == table_of(stats.numeric_summary(mixed, ["u"]))


def test_profile_has_every_table(mixed):
    found = profile(mixed, ["u", "v", "k"], ["c", "t"], "k", {"first": "u"}, cls="c", key="k")
    assert set(found) >= {"summary", "describe", "shape", "zero_missing", "groups", "missing", "cardinality", "mode", "outliers", "histograms", "duplicates", "target_correlation", "correlation_pairs", "mutual_information", "pca", "components", "manifest", "distribution_c", "distribution_t", "five_numbers", "anova", "kruskal", "class_balance", "distances"}
    assert all(df.count() >= (0 if name in ("correlation_pairs", "distances") else 1) for name, df in found.items())


def test_profile_of_an_empty_table(mixed):
    empty = Profile(mixed.limit(0), ["u", "v"], ["c"], "v", cls="c")
    for name in ("summary", "describe", "shape", "missing", "cardinality", "mode", "outliers", "histograms", "five_numbers", "anova", "distribution_c"):
        assert empty.table(name).count() == 0


FILES = [
    "{broken", "", '"text"', "7", '{"items":[]}', "[]", '[{"tag":"a","n":1,"s":"x","g":{"tag":"G"}},3]', '{"tag":"b","n":2.5,"s":"x"}', '{"items":[{"tag":"c","n":null,"s":"y","g":{"tag":"G"}},{"tag":"c","s":1},"odd"]}', '{"other":1}', "[1,2]", None,
]


def test_audit_of_documents(spark):
    """All shapes of files: counters, gaps, distributions, bins, sizes and totals from facts of one pass."""
    fields = {"tag": ("$.tag", "string"), "n": ("$.n", "double"), "s": ("$.s", "string"), "g": ("$.g.tag", "string")}
    audit = Audit(document_facts(spark.createDataFrame([(t,) for t in FILES], "value string"), fields, ["n"], ["s"], "tag", "g", "g", "$.items"), ["s"], "g", "g", ["s"])
    assert {r.metric: r.n for r in audit.counters().collect()} == {"read": 12, "corrupt": 3, "not an object": 2, "valid": 7, "empty": 4}
    assert {r.feature: r.n_missing for r in audit.missing().collect()} == {"n": 2, "s": 0}
    assert {r.value: (r.n, r.is_dominant) for r in audit.distribution("s").collect()} == {"x": (2, True), "y": (1, False), "1": (1, False)}
    one = audit.numeric().first()
    assert (one.n, one.min_value, one.max_value, one.p50) == (2, 1.0, 2.5, 1.75)
    assert [(r.label, r.n) for r in audit.binned("n", [0, 2], ["low", "high"]).orderBy("bin").collect()] == [("low", 1), ("high", 1)]
    assert audit.sizes().first().asDict()["max_size"] == 2 and audit.totals().first().asDict() == {"n_rows": 4, "n_keys": 3, "n_with": 2, "n_without": 2}
    assert math.isclose(audit.concentration("s").first().hhi, 0.375)
    assert {(r.rule, r.field) for r in audit.warnings().collect()} == {("missing", "n"), ("location", "s"), ("without_group", "groups"), ("top1", "groups")}
    assert audit.grade().first().grade == "Limited coverage"


def test_audit_reads_documents_once(spark):
    fields = {"tag": ("$.tag", "string"), "n": ("$.n", "double"), "s": ("$.s", "string")}
    facts = document_facts(spark.createDataFrame([(json.dumps({"tag": k, "n": k % 7, "s": "x"}),) for k in range(2000)], "value string"), fields, ["n"], ["s"], "tag")
    assert facts.where("table = 'numeric'").count() == 7  # different facts, not rows, leave the tasks
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_sketches_merge_in_any_order(spark):
    r = random.Random(2)
    data = [(k % 2, r.gauss(50, 20) if r.random() < 0.9 else None, r.choice("aaabbc")) for k in range(4000)]
    df = spark.createDataFrame(data, "g int, x double, s string").withColumn("k", F.monotonically_increasing_id())
    parts = [sketches.numeric_state(df.where(F.col("k") % 5 == k), ["x"], ["g"]) for k in range(5)] + [sketches.numeric_state(df.limit(0), ["x"], ["g"])]
    for order in (parts, parts[::-1]):
        out = {x.g: x for x in sketches.numeric_from_state(sketches.merge_numeric(*order, keys=["g"]), (0.25, 0.5, 0.75)).collect()}
        for g in (0, 1):
            own = sorted(x for k, x, _ in data if k == g and x is not None)
            mean = sum(own) / len(own)
            assert out[g].n == len(own) and math.isclose(out[g].mean_value, mean) and math.isclose(out[g].std_value, math.sqrt(sum((x - mean) ** 2 for x in own) / (len(own) - 1)))
            for p, q in ((0.25, out[g].p25), (0.5, out[g].p50), (0.75, out[g].p75)):
                assert abs(sum(x <= q for x in own) / len(own) - p) < 2 * sketches.RANK_ERROR
    assert sketches.numeric_from_state(sketches.numeric_state(df.where("x > 1e9"), ["x"])).first().p50 is None


@pytest.mark.parametrize("capacity", [3, 20])
def test_frequent_values_keep_their_bounds(spark, capacity):
    r = random.Random(capacity)
    values = [r.choice(["hot", "hot", "warm", f"v{r.randint(0, 300)}"]) for _ in range(3000)]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "k int, s string, one string")
    states = [sketches.frequent_state(df.where(F.col("k") % 4 == k), ["s", "one"], capacity) for k in range(4)]
    found = sketches.frequent_values(sketches.merge_frequent(*states, capacity=capacity)).collect()
    true = Counter(values)
    own = {x.value: (x.at_least, x.at_most) for x in found if x.feature == "s"}
    assert len(own) <= capacity and {"hot", "warm"} <= set(own)
    for v, (low, high) in own.items():
        assert low <= true[v] <= high and high - low <= len(values) / (capacity + 1)
    assert [(x.value, x.at_least, x.at_most, x.is_dominant) for x in found if x.feature == "one"] == [("x", 3000, 3000, True)]


def test_sketches_of_a_stream(spark, tmp_path):
    """Batches of a stream, one of them delivered twice, give the sketches of all rows once."""
    r = random.Random(5)
    rows = [(k % 3, r.random() * 100, r.choice("abbc")) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, x double, s string").withColumn("k", F.monotonically_increasing_id())
    write = state.sketch_writer(str(tmp_path / "sketches"), ["x"], ["s"], ["g"], 2)
    for batch in (0, 1, 2, 1):
        write(df.where(F.pmod(F.col("k"), F.lit(3)) == batch), batch)
    numeric, frequent = state.read_sketches(spark, str(tmp_path / "sketches"), ["g"], 2)
    out = {x.g: x for x in sketches.numeric_from_state(numeric).collect()}
    for g in range(3):
        own = [x for k, x, _ in rows if k == g]
        assert out[g].n == 300 and math.isclose(out[g].mean_value, sum(own) / 300) and (out[g].min_value, out[g].max_value) == (min(own), max(own))
    found = {x.value: (x.at_least, x.at_most) for x in sketches.frequent_values(frequent).collect()}
    true = Counter(s for *_, s in rows)
    assert len(found) <= 2 and "b" in found and all(low <= true[v] <= high for v, (low, high) in found.items())
