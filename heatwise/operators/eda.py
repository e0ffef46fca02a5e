"""Exploratory tables: class balance, per-class/per-size statistics, histograms, box
statistics, separation check.  All are grouped aggregates (partial + final); any
per-group statistic needed by a second pass is joined back (groups here are classes or hole
sizes; Spark broadcasts the table of groups by its size in bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatwise.functions.exprs import left_closed_bin, lit_double
from heatwise.operators.common import attach_one_row, materialize
from heatwise.operators.ranks import exact_quantiles
from heatwise.policies import DEFAULT_TARGET_LEAK_RATIO

# Balance quality cut-offs and separation levels.
BALANCE_LEVELS = ((0.05, "EXCELLENT"), (0.10, "GOOD"))      # else NEEDS IMPROVEMENT
SEPARATION_LEVELS = ((0.1, "EXCELLENT"), (0.2, "GOOD"))     # else POOR
SEPARATION_THRESHOLD = 308.0
LABEL_TEXT = {0: "No Leak", 1: "Leak"}


def round_half_even(c: Column, digits: int) -> Column:
    """numpy/pandas ``round``: rint(x * 10^d) / 10^d."""
    s = float(10 ** digits)
    return F.rint(c * s) / s


def label_text(label: Column) -> Column:
    return F.when(label == 0, F.lit(LABEL_TEXT[0])).otherwise(F.lit(LABEL_TEXT[1]))


def class_balance(df: DataFrame, label: str = "leak_status") -> DataFrame:
    n = F.count(F.lit(1))
    leak = F.coalesce(F.sum(F.col(label)), F.lit(0))
    return df.agg(n.alias("total"), leak.alias("leak"), (n - leak).alias("no_leak"),
                  F.try_divide(leak, n).alias("leak_ratio"))


def balance_quality(df: DataFrame, label: str = "leak_status",
                    target: float = DEFAULT_TARGET_LEAK_RATIO) -> DataFrame:
    """Balance vs target: deviation, EXCELLENT / GOOD / NEEDS IMPROVEMENT, and a
    warning when only one class is present."""
    b = class_balance(df, label)
    dev = F.abs(F.col("leak_ratio") - lit_double(target))
    quality = F.when(dev < BALANCE_LEVELS[0][0], BALANCE_LEVELS[0][1]) \
        .when(dev < BALANCE_LEVELS[1][0], BALANCE_LEVELS[1][1]).otherwise("NEEDS IMPROVEMENT")
    warn = (F.when((F.col("leak") == F.col("total")) & (F.col("total") > 0),
                   F.lit("only LEAK samples"))
            .when((F.col("leak") == 0) & (F.col("total") > 0), F.lit("only NO-LEAK samples")))
    return b.withColumns({"target_ratio": lit_double(target), "deviation": dev,
                          "balance_quality": quality, "single_class_warning": warn})


def temp_stats_by_label(df: DataFrame, label: str = "leak_status",
                        temp: str = "temperature") -> DataFrame:
    """count, mean, std, min, max per class, rounded to 2 like pandas, with label text."""
    t = F.col(temp)
    g = df.groupBy(label).agg(F.count(t).alias("count"), F.avg(t).alias("mean"),
                              F.stddev_samp(t).alias("std"), F.min(t).alias("min"),
                              F.max(t).alias("max"))
    return g.select(label, label_text(F.col(label)).alias("label_text"), "count",
                    *[round_half_even(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "max")])


def hole_size_analysis(df: DataFrame, label: str = "leak_status", temp: str = "temperature",
                       size: str = "hole_size") -> DataFrame:
    n = F.count(F.lit(1))
    leak = F.sum(F.col(label))
    return df.groupBy(size).agg(n.alias("total_samples"), leak.alias("leak_samples"),
                                (n - leak).alias("no_leak_samples"),
                                F.try_divide(leak, n).alias("leak_rate"),
                                F.avg(temp).alias("avg_temperature"))


def dataset_stats(df: DataFrame, label: str = "leak_status", temp: str = "temperature",
                  size: str = "hole_size") -> DataFrame:
    """Totals, temperature min/max/mean/std and the sorted distinct hole sizes."""
    t = F.col(temp)
    n = F.count(F.lit(1))
    leak = F.sum(F.col(label))
    return df.agg(n.alias("total_samples"), leak.alias("leak_samples"),
                  (n - leak).alias("no_leak_samples"), F.try_divide(leak, n).alias("leak_ratio"),
                  F.min(t).alias("temp_min"), F.max(t).alias("temp_max"),
                  F.avg(t).alias("temp_mean"), F.stddev_samp(t).alias("temp_std"),
                  F.array_sort(F.collect_set(size)).alias("hole_sizes")
                  ).withColumn("features", F.lit(len(df.columns)))


def describe(df: DataFrame, col: str) -> DataFrame:
    """pandas ``describe``: count mean std min 25% 50% 75% max (exact quartiles)."""
    c = F.col(col)
    base = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"),
                  F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df.select(F.col(col).cast("double").alias(col)), col,
                        [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return attach_one_row(base, q).select("count", "mean", "std", "min", "q25", "q50", "q75",
                                          "max")


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts per value (e.g. the criteria-count histogram)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def histogram(df: DataFrame, col: str, group: str | None = None, bins: int = 50,
              density: bool = True) -> DataFrame:
    """numpy-style histogram per group: ``bins`` equal-width bins from the group's min to
    max, left-closed with the last bin closed, empty bins included, density =
    count / (n * width).  Edges are ``min + i*step`` (last = max), compared exactly.

    Output: [group], bin, bin_left, bin_right, count, density.
    """
    keys = [group] if group else []
    x = F.col(col)
    st = df.filter(x.isNotNull()).groupBy(*keys).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"),
                                                     F.count(x).alias("_n"))
    same = F.col("_mn") == F.col("_mx")
    lo = F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    st = st.select(*keys, "_n", lo.alias("_lo"), hi.alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / float(bins)

    rows = df.filter(x.isNotNull()).select(*keys, col)
    rows = rows.join(materialize(st)[0], keys) if keys else attach_one_row(rows, st)
    rows = rows.withColumn("bin", left_closed_bin(x, F.col("_lo"), F.col("_hi"), bins))
    counts = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = st.select(*keys, "_n", "_lo", "_hi",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left").fillna({"count": 0})
    left = F.col("bin").cast("double") * step + F.col("_lo")
    right = F.when(F.col("bin") + 1 >= bins, F.col("_hi")).otherwise(
        (F.col("bin") + 1).cast("double") * step + F.col("_lo"))
    out = out.withColumns({"bin_left": left, "bin_right": right})
    dens = F.col("count") / (F.col("bin_right") - F.col("bin_left")) / F.col("_n")
    out = out.withColumn("density", dens if density else F.lit(None).cast("double"))
    return out.select(*keys, "bin", "bin_left", "bin_right", "count", "density")


def box_stats(df: DataFrame, col: str = "temperature", group: str = "hole_size") -> DataFrame:
    """Quartiles (exact, linear), 1.5*IQR whiskers at the furthest data inside the fences,
    and the outlier count, per group."""
    q = exact_quantiles(df.select(group, col), col, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                        group_cols=[group])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    x = F.col(col)
    q, _ = materialize(q)
    j = df.select(group, col).join(q, group)
    agg = j.groupBy(group).agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.sum(F.when((x < lo_f) | (x > hi_f), 1).otherwise(0)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return q.join(agg, group)


def separation_check(df: DataFrame, label: str = "leak_status", temp: str = "temperature",
                     threshold: float = SEPARATION_THRESHOLD) -> DataFrame:
    """Per-class count/min/max/mean/share above ``threshold`` and the overall verdict:
    EXCELLENT when < 10 % of no-leak rows are above and < 10 % of leak rows are at or
    below, GOOD under 20 %, else POOR.  One conditional aggregate."""
    t = F.col(temp)
    is_leak = F.col(label) == 1
    thr = lit_double(threshold)
    g = df.agg(
        F.count_if(~is_leak).alias("no_leak_count"), F.count_if(is_leak).alias("leak_count"),
        F.min(F.when(~is_leak, t)).alias("no_leak_min"), F.max(F.when(~is_leak, t)).alias("no_leak_max"),
        F.avg(F.when(~is_leak, t)).alias("no_leak_mean"),
        F.min(F.when(is_leak, t)).alias("leak_min"), F.max(F.when(is_leak, t)).alias("leak_max"),
        F.avg(F.when(is_leak, t)).alias("leak_mean"),
        F.try_divide(F.count_if(~is_leak & (t > thr)), F.count_if(~is_leak))
        .alias("no_leak_above_threshold"),
        F.try_divide(F.count_if(is_leak & (t <= thr)), F.count_if(is_leak))
        .alias("leak_below_threshold"))
    a, b = F.col("no_leak_above_threshold"), F.col("leak_below_threshold")
    verdict = F.when((a < SEPARATION_LEVELS[0][0]) & (b < SEPARATION_LEVELS[0][0]),
                     SEPARATION_LEVELS[0][1]) \
        .when((a < SEPARATION_LEVELS[1][0]) & (b < SEPARATION_LEVELS[1][0]),
              SEPARATION_LEVELS[1][1]).otherwise("POOR")
    return g.withColumns({"threshold": thr, "separation_quality": verdict})


def top_k(df: DataFrame, order_col: str, k: int, tiebreak: str | None = None,
          ascending: bool = False) -> DataFrame:
    """``orderBy(...).limit(k)`` -> TakeOrderedAndProject (per-partition top-k, tiny merge)."""
    o = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    order = [o] + ([F.col(tiebreak).asc()] if tiebreak else [])
    return df.orderBy(*order).limit(k)


def add_rank(df: DataFrame, order_col: str, tiebreak: str, out: str = "rank") -> DataFrame:
    """Rank of a *small* result (top-k lists); never used on row-level data."""
    return df.withColumn(out, F.row_number().over(
        Window.orderBy(F.col(order_col).desc(), F.col(tiebreak).asc())))
