"""Labelled synthetic readings as a Spark job (no driver loop).

Each row ``id`` of ``spark.range(n)`` draws its uniforms from ``xxhash64(id, seed, k)``
-- a function of the row, not of partitioning (unlike ``rand(seed)``) -- and turns
pairs into normals by Box-Muller.  Rows ``id < n_leak`` are leaks.  The final row
order is the seeded hash order; node numbers are exact 1-based positions in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatwise.operators.sampling import ranked
from heatwise.policies import DEFAULT_SEED, DEFAULT_TARGET_LEAK_RATIO

# Fixed values of the reference generator.
SIZES = ("20mm", "25mm", "30mm", "40mm")
LEAK_BOOST = {"20mm": 1.0, "25mm": 1.2, "30mm": 1.5, "40mm": 1.8}
NO_LEAK_MEAN, NO_LEAK_SD, NO_LEAK_CLIP = 301.0, 2.5, (295.0, 308.0)
LEAK_BASE, LEAK_CLIP = 320.0, (310.0, 380.0)
SPAN = 3.0
HOTSPOT_SHARE, HOTSPOT_SD = 0.6, 0.5
HOTSPOTS = ((1.2, 0.8), (-1.5, 1.1), (0.5, -1.3), (-2.0, -0.9), (2.2, -1.5))
SCENARIOS = {"high_leak_ratio": (15000, 0.7), "low_leak_ratio": (15000, 0.2),
             "large_dataset": (50000, 0.4), "small_dataset": (5000, 0.4)}
TWO_53 = float(2 ** 53)


def _u(seed: int, k: int) -> Column:
    """Uniform in (0, 1) from the row id."""
    h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(2 ** 53))
    return (h.cast("double") + 0.5) / TWO_53


def _normal(seed: int, k: int) -> Column:
    return F.sqrt(-2.0 * F.log(_u(seed, k))) * F.cos(2 * math.pi * _u(seed, k + 1))


def _pick(u: Column, values) -> Column:
    idx = F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int")
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def generate_readings(spark: SparkSession, n: int = 20000,
                      leak_ratio: float = DEFAULT_TARGET_LEAK_RATIO,
                      seed: int = DEFAULT_SEED) -> DataFrame:
    """nodenumber, x, y, temperature (6-decimal values), hole_size, leak_status."""
    n_leak = int(n * leak_ratio)
    base = spark.range(n)
    leak = F.col("id") < n_leak
    size = _pick(_u(seed, 1), SIZES)
    boost = F.when(size == "20mm", 1.0).when(size == "25mm", 1.2).when(
        size == "30mm", 1.5).otherwise(1.8)
    t_no = F.least(F.greatest(NO_LEAK_MEAN + NO_LEAK_SD * _normal(seed, 10),
                              F.lit(NO_LEAK_CLIP[0])), F.lit(NO_LEAK_CLIP[1]))
    t_leak = F.least(F.greatest(LEAK_BASE + boost * 4 + (8 + boost) * _normal(seed, 10),
                                F.lit(LEAK_CLIP[0])), F.lit(LEAK_CLIP[1]))
    ux = _u(seed, 20) * (2 * SPAN) - SPAN
    uy = _u(seed, 21) * (2 * SPAN) - SPAN
    cx = _pick(_u(seed, 30), [h[0] for h in HOTSPOTS])
    cy = _pick(_u(seed, 30), [h[1] for h in HOTSPOTS])
    clustered = leak & (_u(seed, 31) < HOTSPOT_SHARE)
    x = F.when(clustered, cx + HOTSPOT_SD * _normal(seed, 40)).otherwise(ux)
    y = F.when(clustered, cy + HOTSPOT_SD * _normal(seed, 42)).otherwise(uy)
    rows = base.select(
        "id", size.alias("hole_size"),
        F.round(x, 6).alias("x"), F.round(y, 6).alias("y"),
        F.round(F.when(leak, t_leak).otherwise(t_no), 6).alias("temperature"),
        leak.cast("int").alias("leak_status"))
    shuffled = ranked(rows, "id", seed)
    return shuffled.select((F.col("_pos") + 1).alias("nodenumber"), "x", "y", "temperature",
                           "hole_size", "leak_status")


def scenario_suite(spark: SparkSession, seed: int = DEFAULT_SEED) -> DataFrame:
    """The four reference scenarios in one frame with a ``scenario`` column (write it
    ``partitionBy("scenario")``)."""
    out = None
    for name, (n, ratio) in SCENARIOS.items():
        df = generate_readings(spark, n, ratio, seed).withColumn("scenario", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
