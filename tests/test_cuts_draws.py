"""Sampling and splitting by cut tuples, draws inside hash cells."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heatwise.operators import evaluate, ranks, sampling as smp


def rows(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("node_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file"),
                                 F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") % 3 == 0).cast("int"))
                                 .alias("leak_status"), F.lit("payload").alias("other"))


@pytest.mark.parametrize("fine", [5, 100_000])
@pytest.mark.parametrize("key", ["node_id", ["file", "node_id"]])
def test_members_are_the_first_of_the_seeded_order(spark, monkeypatch, fine, key):
    monkeypatch.setattr(ranks, "FINE", fine)
    df = rows(spark)
    order = {r.node_id: (r.leak_status, r._pos) for r in smp.ranked(df, key, 42, ["leak_status"]).collect()}
    splits = smp.split_counts(smp.class_counts(df), smp.SPLITS_NOTEBOOK)
    for r in smp.stratified_split(df.repartition(5), key=key).collect():
        cls, pos = order[r.node_id]
        a, b, _ = splits[cls]
        assert r.split == ("train" if pos < a else "val" if pos < a + b else "test")
    whole = {r.node_id: r._pos for r in smp.ranked(df, key, 7).collect()}
    assert {r.node_id for r in smp.sample_exact(df, 100, key, 7).collect()} == {i for i, p in whole.items() if p < 100}
    assert smp.sample_exact(df, 0, key).count() == 0 and smp.sample_exact(df, 10_000, key).count() == 3000


def test_rows_are_not_exchanged(spark):
    df = rows(spark).cache()
    df.count()
    for out in (smp.stratified_split(df), smp.balance_dataset(df.where("leak_status is not null"), target=0.2),
                smp.stratified_folds(df), smp.sample_exact(df, 10, "node_id")):
        plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_rows_that_share_a_key_stand_together(spark):
    df = rows(spark, 90).union(rows(spark, 90))
    got = Counter(r.node_id for r in smp.sample_exact(df, 31, "node_id").collect())
    assert set(got.values()) == {2} and 30 <= sum(got.values()) <= 32


@pytest.mark.parametrize("cell_rows", [50, 100_000])
def test_draws_are_exact_and_the_same_for_any_partitioning(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(smp, "CELL_ROWS", cell_rows)
    df = rows(spark, 5000)
    one = Counter(r.node_id for r in smp.draw_rows(df.repartition(1), 12_345, "node_id").collect())
    many = Counter(r.node_id for r in smp.draw_rows(df.repartition(9, "other"), 12_345, "node_id").collect())
    assert one == many and sum(one.values()) == 12_345
    assert max(one.values()) < 14 and 4300 < len(one) < 4700          # 5000 * (1 - exp(-2.469)) = 4577
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "333")
    try:
        assert Counter(r.node_id for r in smp.draw_rows(df, 12_345, "node_id").collect()) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = smp.draw_rows(df, 10, "node_id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and smp.draw_rows(df, 0, "node_id").count() == 0
    with pytest.raises(ValueError):
        smp.draw_rows(df.where("false"), 5, "node_id")


def test_weights_of_labelled_rows_only(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "leak_status int")
    got = {r.leak_status: r.class_weight for r in smp.class_weights(df).collect()}
    assert got == {1: 2.0, 0: pytest.approx(4 / 6), None: None}


@pytest.mark.parametrize("pieces", [None, 13])
def test_roc_curve_without_collinear_points(spark, monkeypatch, pieces):
    """Runs of equal steps, one of them over many range partitions, against the plain rule."""
    if pieces:
        plain = evaluate.positions
        monkeypatch.setattr(evaluate, "positions", lambda *a, **kw: plain(*a, **kw, n_buckets=pieces))
    data = []
    for i in range(300):                      # three straight runs and a ragged part
        pos, neg = [(1, 0), (2, 1), (0, 1), (i % 3, 1 + i % 2)][i // 75]
        data += [("m", i / 300, 1)] * pos + [("m", i / 300, 0)] * neg
    data += [("one", 0.5, 1), ("one", 0.5, 0)]
    df = spark.createDataFrame(data, "model string, score double, label int")
    got = evaluate.roc_curve(df, drop_collinear=True).collect()
    steps = sorted(((s, sum(x[1] == s and x[2] == 1 and x[0] == "m" for x in data), sum(x[1] == s and x[2] == 0 and x[0] == "m" for x in data))
                    for s in {x[1] for x in data if x[0] == "m"}), reverse=True)
    keep = [i for i in range(len(steps)) if i in (0, len(steps) - 1) or steps[i][1:] != steps[i + 1][1:]]
    assert sorted(r.threshold for r in got if r.model == "m" and r.threshold is not None) == sorted(steps[i][0] for i in keep)
    full = {(r.model, r.threshold): (r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect()}
    assert all(full[r.model, r.threshold] == (r.fpr, r.tpr) for r in got) and len(got) < len(full) / 2
    assert sum(r.model == "one" for r in got) == 2
