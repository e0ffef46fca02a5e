"""Missing values, null groups and equal file names under several sizes."""
import math

import pytest
from pyspark.sql import functions as F

from heatwise.functions.exprs import temp_category
from heatwise.operators import features, sampling
from heatwise.operators.labels import label_files, tag_rows
from heatwise.operators.ordered import positions
from heatwise.sources.files import read_labelled_csv


@pytest.mark.parametrize("policy", ["four", "six", "three"])
def test_equal_names_under_two_sizes_are_two_files(spark, policy):
    rows = [(i, "test-0005", size, 300.0 + i * step) for size, step in (("20mm", 0.1), ("30mm", 9.0), (None, 1.0)) for i in range(10)]
    df = spark.createDataFrame(rows, "node long, file_name string, hole_size string, temperature double")
    labels = label_files(df, policy, quantiles="exact")
    got = {r.hole_size: r for r in labels.collect()}
    assert len(got) == 3 and labels.count() == 3
    assert all(r.outlier_ratio is None or 0 <= r.outlier_ratio <= 1 for r in got.values())
    assert got["20mm"].temp_stats.q75 == pytest.approx(300.675) and got["30mm"].temp_stats.q75 == pytest.approx(360.75)
    tagged = tag_rows(df, labels).collect()
    assert len(tagged) == 30
    assert all(r.leak_status == got[r.hole_size].leak_status for r in tagged)


def test_null_groups_keep_their_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 3).cast("int").alias("g"))
    out = positions(df, "id", group_cols=["g"])
    assert out.count() == 100
    assert sorted(r._before for r in out.where("g is null").collect()) == list(range(10))
    assert sampling.stratified_split(df, label="g", key="id").count() == 100
    assert sampling.stratified_folds(df, label="g", key="id").count() == 100


def test_missing_values_in_categories_and_flags(spark):
    df = spark.createDataFrame([(None, None, 1.0), (math.nan, 1.0, None), (400.0, -1.0, math.nan), (284.0, 0.0, 0.0)], "t double, x double, y double")
    got = df.select(temp_category("t").alias("c")).collect()
    assert [r.c for r in got] == [None, None, 6, 0]
    thermal = features.thermal_exprs("dashboard", "t", None)
    spatial = features.spatial_exprs("dashboard", "x", "y", None)
    rows = df.select(thermal["is_hot_spot"].alias("h"), spatial["quadrant"].alias("q")).collect()
    assert [(r.h, r.q) for r in rows] == [(0, 1), (0, 2), (1, 0), (0, 3)]


def test_integer_median_is_not_truncated(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, None)], "k int, v int")
    assert sorted(r.v for r in features.impute_median(df, ["v"]).collect()) == [1, 1.5, 1.5, 2]


def test_labelled_csv_reads_float_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nodenumber,x-coordinate,y-coordinate,temperature,leak_status,leak_confidence\n"
                                    "1,0.5,1,300,1.0,0.7\n2,0.1,2,301,0,bad\n3,0.1,2,301,,\n")
    rows = read_labelled_csv(spark, str(tmp_path / "a.csv")).orderBy("node_number").collect()
    assert [(r.leak_status, r.leak_confidence, r.criteria_count) for r in rows] == [(1, 0.7, 3), (0, None, 1), (None, None, None)]
