import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatwise.operators import ranks
from heatwise.operators.ranks import column_quantiles, exact_quantiles, values_at

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, monkeypatch, fine):
    monkeypatch.setattr(ranks, "FINE", fine)
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": values})).repartition(3), "v", PROBS).first()
    want = pd.Series(values).quantile(PROBS).to_numpy()
    assert list(got) == pytest.approx(want.tolist(), rel=1e-15, abs=0), fine


@pytest.mark.parametrize("fine", [20, 100_000])
def test_quantiles_of_awkward_values(spark, monkeypatch, fine):
    rng = np.random.default_rng(2)
    hot = np.where(rng.random(4000) < 0.4, 305.0, rng.normal(310, 8, 4000))
    check(spark, hot, monkeypatch, fine)
    check(spark, np.concatenate([10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-300, 300, 1500)), np.zeros(500)]),
          monkeypatch, fine)
    check(spark, np.array([5e-324, 1e-323, 0.0, -5e-324] * 50), monkeypatch, fine)
    check(spark, np.nextafter(1.0, 2.0) * np.ones(100), monkeypatch, fine)


def test_cells_of_extreme_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FINE", 1)
    big = [-1.7e308, 1.7e308, 0.0, 1.0, -1.0, 1e300, 5.0]
    df = spark.createDataFrame([(v,) for v in big], "v double")
    got = values_at(df, "v", lambda n: F.sequence(F.lit(0).cast("long"), n - 1)).orderBy("rank").collect()
    assert [r["value"] for r in got] == sorted(big)
    whole = [-(2 ** 63), 2 ** 63 - 1, 0, 2 ** 63 - 2, -(2 ** 63) + 1, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in whole], "v long")
    got = values_at(df, "v", lambda n: F.sequence(F.lit(0).cast("long"), n - 1)).orderBy("rank").collect()
    assert [r["value"] for r in got] == sorted(whole)


def test_groups_nulls_and_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b"], 5000), "v": rng.normal(0, 1, 5000)})
    df = (spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") == "a", F.col("g")))
          .withColumn("v", F.when(F.col("v") < 2, F.col("v")))
          .union(spark.sql("select 'c', cast(null as double)")).union(spark.sql("select 'd', double('nan')")))
    for fine in (10, 10_000):
        monkeypatch.setattr(ranks, "FINE", fine)
        got = {r["g"]: r for r in exact_quantiles(df, "v", [0.1, 0.5], ["p", "q"], ["g"]).collect()}
        assert set(got) == {"a", None}
        for g, name in (("a", "a"), (None, "b")):
            own = pdf[(pdf.g == name) & (pdf.v < 2)].v
            assert got[g]["p"] == pytest.approx(own.quantile(0.1), rel=1e-15) and got[g]["q"] == pytest.approx(own.median(), rel=1e-15)
    empty = exact_quantiles(df.where("false"), "v", [0.5], ["m"]).collect()
    assert len(empty) == 1 and empty[0]["m"] is None
    assert exact_quantiles(df.where("false"), "v", [0.5], ["m"], ["g"]).collect() == []


def test_several_columns_at_once(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 999), "b": rng.integers(0, 50, 999)})
    got = column_quantiles(spark.createDataFrame(pdf).withColumn("c", F.lit(None).cast("double")),
                           {"a": [0.5], "b": [0.25, 0.75], "c": [0.5]})
    assert got["a"] == [pytest.approx(pdf.a.median())] and got["c"] == [None]
    assert got["b"] == pytest.approx([pdf.b.quantile(0.25), pdf.b.quantile(0.75)])


def test_ten_million_distinct_values_in_one_group(spark):
    """Every value is distinct, so no map of values could hold them in one task."""
    n = 10_000_000
    df = spark.range(0, n, 1, 16).select(((F.col("id") * 7_368_787) % n / 3.0).alias("v"), F.lit("g").alias("g"))
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.999], ["a", "b", "c"], ["g"]).first()
    want = np.quantile(np.arange(n) / 3.0, [0.25, 0.5, 0.999])
    assert [got["a"], got["b"], got["c"]] == pytest.approx(want.tolist(), rel=1e-14)


def test_rows_of_few_groups_are_not_moved(spark, monkeypatch):
    """The ranges go to the rows: no sort or exchange of rows by their few groups, whatever their
    size.  (Before, all rows of a group went to one sorting task.)"""
    seen = []
    within = ranks._within

    def kept(*args):
        out = within(*args)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ranks, "_within", kept)
    monkeypatch.setattr(ranks, "FINE", 100)
    n = 4000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % n).cast("double").alias("v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # the rows themselves are too many to send
    try:
        got = {r["g"]: r["m"] for r in exact_quantiles(df, "v", [0.5], ["m"], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {0: 1999.0, 1: 2000.0}
    assert len(seen) >= 2 and all("SortMergeJoin" not in p and "Exchange hashpartitioning" not in p for p in seen)
