"""One-pass moments and bins whose expressions have one size for every number of bins."""
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatwise.functions.exprs import equal_width_bin, left_closed_bin
from heatwise.operators.selection import moments, target_correlation, variances


def test_moments_match_numpy_with_offsets_nulls_and_constants(spark):
    rng = np.random.default_rng(6)
    n = 2000
    pdf = pd.DataFrame({"a": 1e9 + rng.normal(0, 1, n), "b": rng.normal(0, 1e-6, n), "c": np.full(n, 0.1),
                        "leak_status": rng.integers(0, 2, n)})
    pdf["d"] = pdf.a * 2 + pdf.leak_status * 3
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("leak_status") + F.rand(1) > 0.1, F.col("b"))).cache()
    back = df.toPandas()
    got = {r.feature: r["corr"] for r in target_correlation(df.repartition(7), ["a", "b", "c", "d"]).collect()}
    assert set(got) == {"a", "b", "d"}
    for c in got:
        ok = back[c].notna()
        assert got[c] == pytest.approx(np.corrcoef(back[c][ok], back.leak_status[ok])[0, 1], abs=1e-7)
    v = {r.feature: r.variance for r in variances(df, ["a", "b", "c"]).collect()}
    assert v["a"] == pytest.approx(back.a.var(ddof=0), rel=1e-6) and v["c"] == 0.0
    assert v["b"] == pytest.approx(back.b.var(ddof=0), rel=1e-9)
    empty = moments(df.where("false"), ["a"], "leak_status")
    assert empty == {"a": (0, None, None, None)} and target_correlation(df.where("false"), ["a"]).count() == 0


def test_one_scan_for_all_columns(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("leak_status"))
    seen = []
    frame = type(df)
    plain = frame.agg
    monkeypatch.setattr(frame, "agg", lambda self, *a: seen.append(len(a)) or plain(self, *a))
    moments(df, ["a"], "leak_status")
    assert len(seen) == 1


@pytest.mark.parametrize("k", [1, 2, 5, 20, 49, 1000])
def test_bins_on_and_beside_every_edge(spark, k):
    lo, hi = -3.1, 7.3
    step = (hi - lo) / k
    edges = np.array([i * step + lo for i in range(k)] + [hi])
    x = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf)])
    x = x[(x >= lo) & (x <= hi)]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select(
        "x", left_closed_bin("x", F.lit(lo), F.lit(hi), k).alias("l"), equal_width_bin("x", F.lit(lo), F.lit(hi), k).alias("r"))
    got = df.toPandas()
    inner = edges[1:-1]
    assert (got.l.to_numpy() == (got.x.to_numpy()[:, None] >= inner).sum(axis=1)).all()
    low = np.concatenate([[lo - (hi - lo) * 0.001], edges[1:]])
    assert (got.r.to_numpy() == (low < got.x.to_numpy()[:, None]).sum(axis=1) - 1).all()


def test_missing_and_infinite_values_have_defined_bins(spark):
    inf = float("inf")
    df = spark.createDataFrame([(None,), (float("nan"),), (-inf,), (inf,)], "x double")
    got = df.select(left_closed_bin("x", F.lit(0.0), F.lit(1.0), 4).alias("l")).collect()
    assert [r.l for r in got] == [None, None, 0, 3]


def test_code_size_does_not_grow_with_the_bins(spark):
    df = spark.range(10).select((F.col("id") / 3.0).alias("x"))
    sizes = []
    for k in (5, 500):
        out = df.select(left_closed_bin("x", F.lit(0.0), F.lit(3.0), k).alias("l"), equal_width_bin("x", F.lit(0.0), F.lit(3.0), k).alias("r"))
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
        sizes.append(max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)))
    assert max(sizes) < 8000 and abs(sizes[0] - sizes[1]) < 100
