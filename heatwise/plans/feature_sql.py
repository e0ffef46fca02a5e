"""Oracle SQL for the feature sets (assumes at least 20 valid rows, so the rolling
window is 5 -- true for every driver scale)."""

from __future__ import annotations

from heatwise.functions.exprs import equal_width_bin_sql
from heatwise.operators.features import ZONE_GRIDS
from heatwise.plans.sqltext import READINGS_CTE, VALID_CTE, d

AMB = d(300.0)


def _category(t: str) -> str:
    return (f"CASE WHEN {t} <= 0 THEN NULL WHEN {t} <= 285 THEN 0 WHEN {t} <= 295 THEN 1 "
            f"WHEN {t} <= 305 THEN 2 WHEN {t} <= 315 THEN 3 WHEN {t} <= 325 THEN 4 "
            f"WHEN {t} <= 350 THEN 5 ELSE 6 END")


def feature_columns(level: str) -> list[tuple[str, str]]:
    """(name, SQL expression) in output order; base columns come first."""
    t = "temperature"
    cols = [("temp_anomaly", f"{t} - {AMB}"), ("temp_anomaly_abs", f"abs({t} - {AMB})"),
            ("temp_normalized", f"({t} - {AMB}) / {AMB}"),
            ("temp_log", f"CASE WHEN {t} > 0 THEN ln({t}) END"), ("temp_squared", f"{t} * {t}")]
    if level in ("dashboard", "full"):
        cols.append(("temp_sqrt", f"sqrt({t})"))
    if level == "full":
        cols.append(("temp_deviation", f"({t} - g.t_mean) / nullif(g.t_std, 0)"))
        cols.append(("temp_percentile_rank", "rk.temp_percentile_rank"))
    if level in ("dashboard", "full"):
        cols += [("temp_category", _category(t)), ("temp_category_encoded", _category(t))]
    cols += [("is_above_ambient", f"CAST({t} > {AMB} + 5 AS INTEGER)"),
             ("is_hot_spot", f"CAST({t} > {AMB} + 15 AS INTEGER)"),
             ("is_very_hot", f"CAST({t} > {AMB} + 25 AS INTEGER)")]
    if level == "full":
        cols += [("is_extreme_hot", f"CAST({t} > {AMB} + 40 AS INTEGER)"),
                 ("is_cold_spot", f"CAST({t} < {AMB} - 10 AS INTEGER)"),
                 ("temp_vs_median", f"{t} - g.t_median"),
                 ("temp_vs_median_ratio", f"{t} / nullif(g.t_median, 0)")]
    dist = "sqrt(x * x + y * y)"
    deg = "degrees(atan2(y, x))"
    cols += [("distance_from_origin", dist), ("manhattan_distance", "abs(x) + abs(y)")]
    if level == "full":
        cols.append(("max_coordinate_distance", "greatest(abs(x), abs(y))"))
    cols += [("angle_rad", "atan2(y, x)"), ("angle_deg", deg)]
    if level == "full":
        cols.append(("angle_deg_norm", f"({deg} + 180) / 360"))
        for k in ZONE_GRIDS:
            xz = equal_width_bin_sql("x", "g.x_min", "g.x_max", k)
            yz = equal_width_bin_sql("y", "g.y_min", "g.y_max", k)
            cols += [(f"x_zone_{k}", f"CAST({xz} AS INTEGER)"),
                     (f"y_zone_{k}", f"CAST({yz} AS INTEGER)"),
                     (f"spatial_zone_{k}", f"CAST({xz} * {k} + {yz} AS INTEGER)")]
    quad = "(CAST(x >= 0 AS INTEGER) * 2 + CAST(y >= 0 AS INTEGER))"
    cols.append(("quadrant", quad))
    if level == "full":
        cols += [("octant",
                  f"CAST(floor(((({deg} + 22.5) % 360) + 360) % 360 / 45) AS INTEGER)"),
                 ("is_center_region", f"CAST({dist} < g.d_q25 AS INTEGER)"),
                 ("is_edge_region", f"CAST({dist} > g.d_q75 AS INTEGER)")]
    cols.append(("hole_size_encoded", "hs.hole_size_encoded"))
    if level == "full":
        cols += [("temp_distance_product", f"{t} * {dist}"),
                 ("temp_distance_ratio", f"{t} / ({dist} + {d(1e-8)})"),
                 ("temp_per_distance", f"({t} - {AMB}) / ({dist} + 1)"),
                 ("temp_quadrant_interaction", f"{t} * {quad}"),
                 ("temp_hole_interaction", f"{t} * hs.hole_size_encoded"),
                 ("distance_hole_interaction", f"{dist} * hs.hole_size_encoded")]
        for s in ("mean", "std", "min", "max"):
            cols.append((f"temp_rolling_{s}",
                         f"CASE WHEN ro.rn >= 5 THEN ro.r_{s} ELSE g.t_{s} END"))
        z = f"(({t} - g.t_mean) / g.t_std)"
        cols += [("temp_zscore", f"CASE WHEN g.t_std > 0 THEN {z} ELSE 0.0 END"),
                 ("temp_zscore_abs", f"CASE WHEN g.t_std > 0 THEN abs({z}) ELSE 0.0 END"),
                 ("is_temp_outlier",
                  f"CASE WHEN g.t_std > 0 THEN CAST(abs({z}) > 2 AS INTEGER) ELSE 0 END")]
    return cols


def features_sql(level: str) -> str:
    base = ["node_id", "file_name", "hole_size", "x", "y", "temperature"]
    cols = feature_columns(level)

    def out(name, expr):
        return f"round({expr}, 6) AS {name}" if not name.startswith(("is_", "x_zone", "y_zone",
                                                                      "spatial_zone", "octant",
                                                                      "quadrant", "hole_size_enc",
                                                                      "temp_category")) \
            else f"{expr} AS {name}"

    select = ", ".join([f"v.{c}" if c not in ("x", "y", "temperature")
                        else f"round(v.{c}, 6) AS {c}" for c in base]
                       + [out(n, e) for n, e in cols])
    ctes = [READINGS_CTE, VALID_CTE,
            "hs AS (SELECT hole_size, CAST(row_number() OVER (ORDER BY hole_size) - 1 AS INTEGER)"
            " AS hole_size_encoded FROM (SELECT DISTINCT hole_size FROM valid) q)"]
    joins = "JOIN hs ON hs.hole_size = v.hole_size"
    if level == "full":
        ctes.append(
            "g AS (SELECT count(temperature) AS n, avg(temperature) AS t_mean, "
            "stddev_samp(temperature) AS t_std, min(temperature) AS t_min, "
            "max(temperature) AS t_max, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, "
            "max(y) AS y_max, quantile_cont(temperature, 0.5) AS t_median, "
            "quantile_cont(sqrt(x * x + y * y), 0.25) AS d_q25, "
            "quantile_cont(sqrt(x * x + y * y), 0.75) AS d_q75 FROM valid)")
        ctes.append(
            "rk AS (SELECT node_id, (rank() OVER (ORDER BY temperature) + "
            "(count(*) OVER (PARTITION BY temperature) - 1) / CAST(2 AS DOUBLE)) / "
            "count(*) OVER () AS temp_percentile_rank FROM valid)")
        ctes.append(
            "ro AS (SELECT node_id, row_number() OVER (ORDER BY temperature, node_id) AS rn, "
            "avg(temperature) OVER w AS r_mean, stddev_samp(temperature) OVER w AS r_std, "
            "min(temperature) OVER w AS r_min, max(temperature) OVER w AS r_max FROM valid "
            "WINDOW w AS (ORDER BY temperature, node_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
        joins += (" CROSS JOIN g JOIN rk ON rk.node_id = v.node_id "
                  "JOIN ro ON ro.node_id = v.node_id")
    return f"WITH {', '.join(ctes)} SELECT {select} FROM valid v {joins}"


def rank_sql() -> str:
    return (f"WITH {READINGS_CTE}, {VALID_CTE} SELECT node_id, round(temperature, 6) AS "
            "temperature, round((rank() OVER (ORDER BY temperature) + (count(*) OVER "
            "(PARTITION BY temperature) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (), 6) AS "
            "temp_percentile_rank FROM valid")


def rolling_sql(window: int = 5) -> str:
    w = window
    return (f"WITH {READINGS_CTE}, {VALID_CTE}, g AS (SELECT avg(temperature) AS t_mean, "
            "stddev_samp(temperature) AS t_std, min(temperature) AS t_min, "
            "max(temperature) AS t_max FROM valid), "
            "ro AS (SELECT node_id, temperature, row_number() OVER (ORDER BY temperature, "
            "node_id) AS rn, avg(temperature) OVER w AS r_mean, stddev_samp(temperature) OVER w "
            "AS r_std, min(temperature) OVER w AS r_min, max(temperature) OVER w AS r_max "
            f"FROM valid WINDOW w AS (ORDER BY temperature, node_id ROWS BETWEEN {w - 1} "
            "PRECEDING AND CURRENT ROW)) SELECT node_id, round(temperature, 6) AS temperature, "
            + ", ".join(f"round(CASE WHEN rn >= {w} THEN r_{s} ELSE g.t_{s} END, 6) AS "
                        f"temp_rolling_{s}" for s in ("mean", "std", "min", "max"))
            + " FROM ro CROSS JOIN g")


def quantile_sql() -> str:
    return (f"WITH {READINGS_CTE}, {VALID_CTE} SELECT "
            + ", ".join(f"round(quantile_cont(temperature, {p}), 6) AS q{int(p * 100):02d}"
                        for p in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95))
            + " FROM valid")
