import numpy as np
import pytest
from pyspark.sql import functions as F

from heatwise.llm import queries, whiten

SF = "/root/testdata/sf0.01"


def test_cross_products_equal_plain_integers():
    rng = np.random.default_rng(3)
    for rows, dims, width in [(1, 1, 1), (5, 3, 10), (64, 4, 2000), (200, 5, 2 ** 20), (130, 3, 2 ** 40), (70, 2, 2 ** 61)]:
        x = rng.integers(-width, width, (rows, dims), dtype=np.int64)
        sums, cross = whiten.cross_products(x)
        wide = x.astype(object)
        assert sums.tolist() == wide.sum(axis=0).tolist()
        assert cross.tolist() == np.triu(wide.T @ wide).tolist()


def brute(rows):
    """Plain numpy over all vectors at once, exact where the contract asks for it."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in ok], dtype=np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    t = n * x - s
    v = np.array([[int(a) for a in r] for r in t], dtype=object)
    cov = (v.T @ v / (n * n * n)).astype(np.float64)
    e, u = np.linalg.eigh(cov)
    return [i for i, _ in ok], n, (v * v).sum(axis=1).tolist(), (t / n) @ (u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])), \
        (e[::-1][:8] / np.trace(cov))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, n, deviation, white, share = brute(rows)
    got = queries.op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    got = got.collect()
    assert len(got) == 8 * len(ids) == len({(r.vec_id, r.component) for r in got})
    at = {i: k for k, i in enumerate(ids)}
    sign = {}
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[k]
        assert abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-9
        sign.setdefault(c, 1 if r.whitened * white[k, c] > 0 else -1)
        assert abs(r.whitened - sign[c] * white[k, c]) < 1e-7


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = whiten.fit(table.coalesce(1)), whiten.fit(table.repartition(13))
    assert one.rows == many.rows and one.sums == many.sums and (one.values == many.values).all()
    monkeypatch.setattr(whiten, "BLOCK", 37)
    assert (whiten.fit(table).values == one.values).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(7, None, "x"), (8, [nan, 1.0], "x"), (9, [inf, 1.0], "x"),
            (10, [None, 1.0], "x"), (11, [], "x"), (12, [1.0], "x"), (13, [1e300, 1.0], "x"), (None, [3.0, 3.0], "x"),
            (0, good[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = whiten.whiten(df).collect()
    assert len(got) == 2 * 6 and {r.n for r in got} == {6} and got[0].identity_error < 1e-9
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert whiten.whiten(df.where("false")).count() == 0
    flat = whiten.whiten(df.where("vec_id in (0, 3)")).collect()
    assert len(flat) == 6 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in flat)
    line = whiten.whiten(df.where("vec_id in (0, 1)")).collect()          # variance in one direction only
    assert {r.whitened is None for r in line if r.component == 2} == {True}
    assert all(abs(abs(r.whitened)) > 0 for r in line if r.component == 1)


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [1e13 * i, -3e12 * i + 0.5, float(i % 3)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(np.floor(c * 1024.0)) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((9 * c - t) ** 2 for c, t in zip(r, s)) for i, r in enumerate(x)}
    got = whiten.whiten(df).where("component = 1").collect()
    assert {r.vec_id: int(r.deviation) for r in got} == want
    floats = whiten.whiten(df.withColumn("embedding", F.col("embedding").cast("array<float>")))
    assert floats.count() == 27
    assert whiten.fit(df).sums == s


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 40, 1 << 55])
def test_deviations_by_every_width(size):
    t = np.random.default_rng(1).integers(-size, size, (5, 4), dtype=np.int64)
    want = (t.astype(object) ** 2).sum(axis=1).tolist()
    assert [int(v) for v in whiten._deviations(t).to_pylist()] == want
