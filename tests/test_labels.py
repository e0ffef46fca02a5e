import pytest
from pyspark.sql import functions as F

from heatwise.operators.labels import label_files, valid_temperature
from heatwise.plans.catalog import labels_for

from conftest import SF01


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_name string, hole_size string, temperature double")


def one(df, name):
    return {r["file_name"]: r for r in df.collect()}[name]


def test_one_row_file_std_is_null_and_criterion_false(spark):
    df = frame(spark, [("a", "25mm", 400.0)])
    r = one(label_files(df, "four"), "a")
    assert r["std"] is None
    assert r["n_rows"] == 1
    # hot share 1 > .15, mean > 302, std null -> false, outliers: sigma 0 -> false
    assert r["criteria_count"] == 2 and r["total_criteria"] == 4 and r["leak_status"] == 1


def test_constant_temperature_has_no_outliers(spark):
    df = frame(spark, [("a", "25mm", 300.0)] * 5)
    r = one(label_files(df, "four"), "a")
    assert r["outlier_ratio"] == 0.0
    assert r["criteria_count"] == 0 and r["leak_status"] == 0


def test_six_denominator_is_five_without_hot_readings(spark):
    df = frame(spark, [("a", "25mm", 290.0), ("a", "25mm", 291.0)])
    r = one(label_files(df, "six"), "a")
    assert r["total_criteria"] == 5
    df2 = frame(spark, [("b", "25mm", 290.0), ("b", "25mm", 400.0)])
    assert one(label_files(df2, "six"), "b")["total_criteria"] == 6


def test_sensitivity_cutoffs(spark):
    # 25mm, thr 305: mean 350 > 302, hot 1.0 > .15, std 0 -> false, outliers false -> 2 of 4
    df = frame(spark, [("a", "25mm", 350.0)] * 3)
    assert one(label_files(df, "four", "balanced"), "a")["leak_status"] == 1   # >= 2
    assert one(label_files(df, "four", "strict"), "a")["leak_status"] == 0     # >= 3
    assert one(label_files(df, "four", "sensitive"), "a")["leak_status"] == 1  # >= 1


def test_large_hole_boost_raises_confidence(spark):
    # 40mm thr 457.5: mean/hot false; std of (0, 100) large -> 2 criteria? build it
    rows = [("a", "40mm", 300.0)] * 10 + [("a", "40mm", 600.0)] * 2
    r = one(label_files(frame(spark, rows), "six"), "a")
    assert r["criteria_count"] >= 2
    assert r["leak_status"] == 1
    assert r["confidence"] == pytest.approx(min(1.0, r["criteria_count"] / r["total_criteria"]
                                                + 0.2 + (0.1 if r["file_idx"] % 4 == 0 else 0)))


def test_messages_follow_criteria(spark):
    df = frame(spark, [("a", "25mm", 350.0)] * 3)
    r = one(label_files(df, "four"), "a")
    assert len(r["criteria_met"]) == r["criteria_count"]
    assert any(m.startswith("Mean temp (350.0K) > 302.0K") for m in r["criteria_met"])


def test_valid_temperature_is_exclusive(spark):
    df = spark.createDataFrame([(250.0,), (250.0001,), (999.9,), (1000.0,)], "temperature double")
    assert valid_temperature(df).count() == 2


@pytest.mark.parametrize("policy,expected", [
    ("four", {"20mm": 25, "25mm": 20, "30mm": 13, "40mm": 1}),
    ("three", {"20mm": 23, "25mm": 20, "30mm": 17, "40mm": 16}),
])
def test_bridge_label_parity(spark, policy, expected):
    lab = labels_for(spark, SF01, policy)
    got = {r["hole_size"]: r["n"] for r in
           lab.groupBy("hole_size").agg(F.sum("leak_status").alias("n")).collect()}
    assert got == expected


def test_labels_do_not_depend_on_partitioning(spark):
    from heatwise.sources import bridge
    v = valid_temperature(bridge.readings(spark, SF01))
    a = sorted(tuple(r) for r in label_files(v.repartition(1), "six").select(
        "file_name", "leak_status", "criteria_count").collect())
    b = sorted(tuple(r) for r in label_files(v.repartition(7), "six").select(
        "file_name", "leak_status", "criteria_count").collect())
    assert a == b


def test_file_index_follows_the_names_of_each_size(spark):
    from heatwise.operators.labels import file_index
    rows = [(f"f{i:04d}", ["20mm", "25mm", None][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:50], "file_name string, hole_size string").repartition(5)
    got = {(r.file_name, r.hole_size): r.file_idx for r in file_index(df).collect()}
    assert got == {(name, size): i // 3 for i, (name, size) in enumerate(rows)}
