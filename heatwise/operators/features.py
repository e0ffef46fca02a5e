"""Feature engineering: row-wise expressions plus global statistics.

Global statistics (mean, sample sigma, min/max of x, y and T, exact median of T, exact
quartiles of the distance) are computed by *one* aggregate plus the counting passes for exact
quantiles, which do both columns at once, collected as a single row (a proven bound) and folded in as literals,
so every feature is one ``withColumns`` inside whole-stage codegen.  Global rank and
rolling statistics share one range exchange -- never an unpartitioned window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatwise.functions.exprs import equal_width_bin, flag, temp_category
from heatwise.operators.ordered import ValueOrder, rank_pct, rolling_window_size, value_order
from heatwise.operators.ranks import column_quantiles, exact_quantiles
from heatwise.policies import AMBIENT_K

# Fixed values of the feature set.
ZONE_GRIDS = (5, 10, 20)
ROLLING_MAX_WINDOW = 5
ROLLING_MIN_ROWS = 10        # rolling features only when n > 10
EPS_DISTANCE = 1e-8
LEVELS = ("basic", "dashboard", "full")


def thermal_features(df: DataFrame, level: str = "basic", temp: str = "temperature",
                     stats: dict | None = None) -> DataFrame:
    return df.withColumns(thermal_exprs(level, temp, stats))


def thermal_exprs(level: str = "basic", temp: str = "temperature",
                  stats: dict | None = None) -> dict:
    t = F.col(temp)
    anomaly = t - AMBIENT_K
    cols: dict[str, Column] = {
        "temp_anomaly": anomaly,
        "temp_anomaly_abs": F.abs(anomaly),
        "temp_normalized": anomaly / AMBIENT_K,
        "temp_log": F.log(t),
        "temp_squared": t * t,
    }
    if level in ("dashboard", "full"):
        cols["temp_sqrt"] = F.sqrt(t)
    if level == "full":
        std = stats["t_std"]
        cols["temp_deviation"] = ((t - F.lit(stats["t_mean"])) / F.lit(std)
                                  if std not in (None, 0.0) and not _nan(std)
                                  else F.lit(None).cast("double"))
    if level in ("dashboard", "full"):
        cols["temp_category"] = temp_category(t)
        cols["temp_category_encoded"] = temp_category(t)
    cols["is_above_ambient"] = flag(t, t > AMBIENT_K + 5)
    cols["is_hot_spot"] = flag(t, t > AMBIENT_K + 15)
    cols["is_very_hot"] = flag(t, t > AMBIENT_K + 25)
    if level == "full":
        cols["is_extreme_hot"] = flag(t, t > AMBIENT_K + 40)
        cols["is_cold_spot"] = flag(t, t < AMBIENT_K - 10)
        med = stats["t_median"]
        cols["temp_vs_median"] = t - F.lit(med)
        cols["temp_vs_median_ratio"] = F.try_divide(t, F.lit(med))
    return cols


def _nan(v) -> bool:
    return isinstance(v, float) and math.isnan(v)


def spatial_features(df: DataFrame, level: str = "basic", x: str = "x", y: str = "y",
                     stats: dict | None = None) -> DataFrame:
    return df.withColumns(spatial_exprs(level, x, y, stats))


def spatial_exprs(level: str = "basic", x: str = "x", y: str = "y",
                  stats: dict | None = None) -> dict:
    X, Y = F.col(x), F.col(y)
    dist = F.sqrt(X * X + Y * Y)
    ang = F.atan2(Y, X)
    deg = F.degrees(ang)
    cols: dict[str, Column] = {
        "distance_from_origin": dist,
        "manhattan_distance": F.abs(X) + F.abs(Y),
    }
    if level == "full":
        cols["max_coordinate_distance"] = F.greatest(F.abs(X), F.abs(Y))
    cols["angle_rad"] = ang
    cols["angle_deg"] = deg
    if level == "full":
        cols["angle_deg_norm"] = (deg + 180) / 360
        for k in ZONE_GRIDS:
            xz = equal_width_bin(X, F.lit(stats["x_min"]), F.lit(stats["x_max"]), k)
            yz = equal_width_bin(Y, F.lit(stats["y_min"]), F.lit(stats["y_max"]), k)
            cols[f"x_zone_{k}"] = xz
            cols[f"y_zone_{k}"] = yz
            cols[f"spatial_zone_{k}"] = xz * k + yz
    cols["quadrant"] = flag(X, X >= 0) * 2 + flag(Y, Y >= 0)
    if level == "full":
        cols["octant"] = F.floor(F.pmod(deg + 22.5, F.lit(360.0)) / 45).cast("int")
        cols["is_center_region"] = flag(dist, dist < F.lit(stats["d_q25"]))
        cols["is_edge_region"] = flag(dist, dist > F.lit(stats["d_q75"]))
    return cols


def hole_size_levels(df: DataFrame, col: str = "hole_size") -> list:
    """Sorted distinct sizes: a category of few values, each of which becomes a CASE term."""
    return sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)


def hole_size_encoding(df: DataFrame, col: str = "hole_size", out: str = "hole_size_encoded",
                       levels: list | None = None) -> DataFrame:
    """Alphabetical index of the distinct sizes (like a label encoder fitted on the data),
    folded in as a CASE expression; ``levels`` fixes them (fitted elsewhere)."""
    levels = hole_size_levels(df, col) if levels is None else levels
    return df.withColumn(out, encoding_expr(levels, col))


def encoding_expr(levels: list, col: str = "hole_size") -> Column:
    expr = None
    for i, v in enumerate(levels):
        expr = F.when(F.col(col) == v, F.lit(i)) if expr is None else expr.when(F.col(col) == v, i)
    return (expr if expr is not None else F.lit(None)).cast("int")


def interaction_features(df: DataFrame, temp: str = "temperature") -> DataFrame:
    enc = F.col("hole_size_encoded") if "hole_size_encoded" in df.columns else None
    return df.withColumns(interaction_exprs(F.col(temp), F.col("distance_from_origin"),
                                            F.col("temp_anomaly"), F.col("quadrant"), enc))


def interaction_exprs(t: Column, d: Column, anomaly: Column, quadrant: Column,
                      enc: Column | None) -> dict:
    cols = {
        "temp_distance_product": t * d,
        "temp_distance_ratio": t / (d + EPS_DISTANCE),
        "temp_per_distance": anomaly / (d + 1),
        "temp_quadrant_interaction": t * quadrant,
    }
    if enc is not None:
        cols["temp_hole_interaction"] = t * enc
        cols["distance_hole_interaction"] = d * enc
    return cols


def zscore_features(df: DataFrame, stats: dict, temp: str = "temperature") -> DataFrame:
    return df.withColumns(zscore_exprs(stats, temp))


def zscore_exprs(stats: dict, temp: str = "temperature") -> dict:
    t, std = F.col(temp), stats["t_std"]
    if std is not None and not _nan(std) and std > 0:
        z = (t - F.lit(stats["t_mean"])) / F.lit(std)
        return {"temp_zscore": z, "temp_zscore_abs": F.abs(z),
                "is_temp_outlier": (F.abs(z) > 2).cast("int")}
    return {"temp_zscore": F.lit(0.0), "temp_zscore_abs": F.lit(0.0), "is_temp_outlier": F.lit(0)}


def global_stats(df: DataFrame, temp: str = "temperature", x: str = "x", y: str = "y", others=()) -> dict:
    """One aggregate row: count, mean, sample sigma, min/max of T, x, y and the distance."""
    t, dist = F.col(temp), _distance(x, y)
    return df.agg(F.count(t).alias("n"), F.count(F.lit(1)).alias("n_all"), F.avg(t).alias("t_mean"),
                  F.stddev_samp(t).alias("t_std"), F.min(t).alias("t_min"),
                  F.max(t).alias("t_max"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
                  F.min(y).alias("y_min"), F.max(y).alias("y_max"),
                  F.min(dist).alias("d_min"), F.max(dist).alias("d_max"),
                  F.count_if(dist.isNotNull() & ~F.isnan(dist)).alias("d_n"), F.count_if(F.isnan(dist)).alias("d_nan"),
                  *_input_checks(temp, x, y, others)).first().asDict()


def _distance(x: str, y: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def order_stats(df: DataFrame, stats: dict, temp: str, x: str, y: str, order: ValueOrder | None) -> dict:
    """Exact median of T and quartiles of the distance.  With the rows' order by T at hand the
    median is read off it, and the distance is selected over the written rows."""
    if order is None or stats["n"] != stats["n_all"]:
        got = column_quantiles(df.select(F.col(temp).alias("t"), _distance(x, y).alias("d")), {"t": [0.5], "d": [0.25, 0.75]})
        return {"t_median": got["t"][0], "d_q25": got["d"][0], "d_q75": got["d"][1]}
    low, high = order.values_at([(stats["n"] - 1) // 2, stats["n"] // 2])
    known = None
    if not stats["d_nan"]:
        known = df.sparkSession.createDataFrame([(stats["d_n"], stats["d_min"], stats["d_max"])], "n long, _lo double, _hi double")
    dist = order.rows.select(_distance(x, y).alias("d"))
    q = exact_quantiles(dist, "d", [0.25, 0.75], ["a", "b"], known=known).first()
    return {"t_median": low if low == high else high - (high - low) * 0.5, "d_q25": q["a"], "d_q75": q["b"]}


def _input_checks(temp: str, x: str, y: str, others=()) -> list:
    """Counts that decide whether any row-wise feature can be null: null inputs and
    temperatures where log/sqrt/category are undefined; nulls of other numeric inputs."""
    t = F.col(temp)
    return [F.count_if(F.col(x).isNull() | F.isnan(F.col(x))).alias("_bad_x"),
            F.count_if(F.col(y).isNull() | F.isnan(F.col(y))).alias("_bad_y"),
            F.count_if(t.isNull() | F.isnan(t) | (t <= 0)).alias("_bad_t"),
            (sum((F.count_if(F.col(c).isNull()) for c in others), F.lit(0))
             .alias("_bad_other"))]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    num = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType,
           T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, num) and f.name not in set(exclude)]


def replace_infinite(df: DataFrame, cols=None) -> DataFrame:
    """+-inf and NaN -> null in double columns (they are then median-imputed)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    inf = float("inf")
    return df.withColumns({
        c: F.when(F.isnan(F.col(c)) | (F.abs(F.col(c)) == inf), F.lit(None).cast("double"))
            .otherwise(F.col(c)) for c in cols})


def median_fills(df: DataFrame, cols=None) -> dict:
    """Exact medians of the numeric columns that contain nulls.

    One aggregate counts nulls per column; the medians of all columns that have any (usually
    none) are found by the same counting passes."""
    cols = cols or numeric_columns(df)
    if not cols:
        return {}
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    holes = [c for c in cols if nulls[c]]
    if not holes:
        return {}
    fills, dtypes = {}, dict(df.dtypes)
    for c, (m,) in column_quantiles(df.select(*holes), {c: [0.5] for c in holes}).items():
        if m is not None:
            whole = dtypes[c] not in ("double", "float") and float(m).is_integer()
            fills[c] = int(m) if whole else m
    return fills


def impute_median(df: DataFrame, cols=None) -> DataFrame:
    """Fill nulls of numeric columns with their exact median; an integer column whose
    median is not whole becomes double."""
    return fill_medians(df, median_fills(df, cols))


def fill_medians(df: DataFrame, fills: dict) -> DataFrame:
    if not fills:
        return df
    dtypes = dict(df.dtypes)
    wide = {c: F.col(c).cast("double") for c, v in fills.items()
            if isinstance(v, float) and dtypes[c] not in ("double", "float")}
    return df.withColumns(wide).fillna(fills)


def _row_features(df: DataFrame, level: str, temp: str, x: str, y: str, stats, levels,
                  clean_inputs: bool = False):
    """All row-wise features as ONE ``withColumns`` (one analysis of the plan; the
    interaction terms reuse the expressions, which codegen evaluates once)."""
    th = thermal_exprs(level, temp, stats)
    sp = spatial_exprs(level, x, y, stats)
    cols = {**th, **sp}
    enc = encoding_expr(levels) if levels is not None else None
    if enc is not None:
        cols["hole_size_encoded"] = enc
    if level == "full":
        cols.update(interaction_exprs(F.col(temp), sp["distance_from_origin"],
                                      th["temp_anomaly"], sp["quadrant"], enc))
        cols.update(zscore_exprs(stats, temp))
    out = df.withColumns(cols)
    if level == "full" and not clean_inputs:
        # with finite x, y and positive finite T every feature is finite: no-op then
        out = replace_infinite(out)
    return out


def engineer_features(df: DataFrame, level: str = "basic", key: str = "node_id",
                      temp: str = "temperature", x: str = "x", y: str = "y",
                      impute: bool = True, rolling_align: str = "value") -> DataFrame:
    """The reference's three feature sets: ``basic`` (API), ``dashboard`` and ``full``
    (notebook: ~60 columns incl. global rank, zones, rolling and z-scores).

    Plan shape: driver-side decisions (hole-size levels, the global statistics row, the
    null counts for imputation) are small jobs on the input; the rolling window and the
    rank join run on the narrow input rows, and the ~60 row-wise feature columns are
    added afterwards as one projection, so no shuffle carries them.  Rank and rolling
    columns are never null for non-null T, so imputing the row-wise columns equals the
    reference's imputing everything at the end.

    ``rolling_align``: see :func:`rolling_stats`; ``"position"`` gives the reference's
    assignment of rolling windows to rows (by ``key`` order).
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    other_nums = [c for c in numeric_columns(df) if c not in (temp, x, y)]
    stats = global_stats(df, temp, x, y, others=other_nums) if level == "full" else None
    order = None
    if level == "full":
        if stats["n"] > ROLLING_MIN_ROWS:
            order = value_order(df, temp, key, rolling_window_size(stats["n"], ROLLING_MAX_WINDOW))
        stats.update(order_stats(df, stats, temp, x, y, order))
    levels = hole_size_levels(order.rows if order else df) if "hole_size" in df.columns else None
    fills = {}
    checks = stats if stats is not None else \
        df.agg(*_input_checks(temp, x, y, other_nums)).first().asDict()
    clean_inputs = not (checks["_bad_x"] or checks["_bad_y"] or checks["_bad_t"]) and \
        (stats is None or all(stats[k] is not None and math.isfinite(stats[k])
                              for k in ("x_min", "x_max", "y_min", "y_max", "t_min", "t_max")))
    if impute:
        if not clean_inputs or checks["_bad_other"]:
            # general case: scan every row-wise feature column for nulls
            fills = median_fills(_row_features(df, level, temp, x, y, stats, levels))
        # else: with non-null x, y and positive T no row-wise feature is null except
        # temp_deviation (sigma 0) / temp_vs_median_ratio (median 0), which are then null
        # in every row -- their median is undefined and the reference leaves them NaN.
    base = df
    if level == "full":
        if order is not None:
            fill = {"mean": stats["t_mean"], "std": stats["t_std"], "min": stats["t_min"], "max": stats["t_max"]}
            base = order.aligned("temp_rolling_", fill, rolling_align, key)
            ranks = order.ranks("temp_percentile_rank", stats["n"], stats["n_all"] - stats["n"])
            base = base.join(ranks, temp, "left").select(*base.columns, "temp_percentile_rank")
        else:
            base = rank_pct(base, temp, "temp_percentile_rank")
    out = _row_features(base, level, temp, x, y, stats, levels, clean_inputs)
    return fill_medians(out, fills)
