"""Oracle SQL for the file-label operators, generated from the same policy values."""

from __future__ import annotations

from heatwise.plans.sqltext import READINGS_CTE, VALID_CTE, case_factor, d, r6
from heatwise.policies import LabelPolicy, policy as _policy


def label_sql(policy="four", sensitivity: str = "balanced", rounded: bool = True) -> str:
    """Labels per file; ``rounded=False`` keeps raw doubles (for use as a CTE)."""
    pol: LabelPolicy = _policy(policy)
    rr = r6 if rounded else (lambda e: f"({e})")
    fac = case_factor("hole_size", pol.factors, pol.default_factor)
    thr = f"({d(pol.threshold)} * {fac})"
    crits = []  # (cond, message)
    pct = "printf('%.1f%%', {} * 100)"
    f1 = "printf('%.1f', {})"
    hot = "(CAST(n_hot AS DOUBLE) / n_rows)"
    outl = "(CAST(n_out AS DOUBLE) / n_rows)"
    if pol.use_outliers:
        crits.append((f"coalesce({outl} > {d(pol.outlier_share)} * {fac}, false)",
                      f"printf('Outlier ratio (%s) significant', {pct.format(outl)})"))
    hot_limit = f"({d(pol.hot_share)} * {fac})" if pol.hot_share_scaled else d(pol.hot_share)
    mean_thr = f"({thr} - {d(pol.mean_margin)})"
    if pol.name == "three":
        crits.append((f"{hot} > {hot_limit}",
                      f"printf('High temp ratio: %s > %s', {pct.format(hot)}, "
                      f"{pct.format(hot_limit)})"))
        crits.append((f"mean > {mean_thr}",
                      f"printf('Mean temp elevated: %sK > %sK', {f1.format('mean')}, "
                      f"{f1.format(mean_thr)})"))
    else:
        crits.append((f"{hot} > {hot_limit}",
                      f"printf('High temp ratio (%s) > threshold', {pct.format(hot)})"))
        crits.append((f"mean > {mean_thr}",
                      f"printf('Mean temp (%sK) > %sK', {f1.format('mean')}, "
                      f"{f1.format(mean_thr)})"))
    if pol.use_std:
        std_thr = f"({d(pol.std_limit)} * {fac})"
        crits.append((f"coalesce(std > {std_thr}, false)",
                      f"printf('Temp std (%s) > %s', {f1.format('std')}, {f1.format(std_thr)})"))
    if pol.use_max:
        max_thr = (f"({thr} + {d(pol.max_margin)} * {fac})" if pol.max_margin_scaled
                   else f"({thr} + {d(pol.max_margin)})")
        if pol.name == "three":
            msg = f"printf('Max temp high: %sK > %sK', {f1.format('max_t')}, {f1.format(max_thr)})"
        else:
            msg = f"printf('Max temp (%sK) > %sK', {f1.format('max_t')}, {f1.format(max_thr)})"
        crits.append((f"max_t > {max_thr}", msg))
    if pol.use_spatial:
        crits.append((f"(n_hot > 0 AND {hot} > {d(pol.spatial_share)})",
                      f"printf('Spatial clustering detected (%s)', {pct.format(hot)})"))
    count = " + ".join(f"CAST({c} AS INTEGER)" for c, _ in crits)
    fixed_total = len(crits) - (1 if pol.use_spatial else 0)
    total = (f"({fixed_total} + CASE WHEN n_hot > 0 THEN 1 ELSE 0 END)" if pol.use_spatial
             else f"{fixed_total}")
    if pol.fixed_min_count is not None:
        leak = f"cc >= {pol.fixed_min_count}"
    elif sensitivity == "strict":
        leak = "cc >= tot - 1"
    elif sensitivity == "sensitive":
        leak = "cc >= 1"
    else:
        leak = "cc >= floor(tot / 2)"
    conf = "(CAST(cc AS DOUBLE) / tot)"
    leak_expr, conf_expr = f"({leak})", conf
    if pol.large_hole_boost:
        b = "(hole_size IN ('30mm', '40mm') AND cc >= 2)"
        leak_expr = f"({leak_expr} OR {b})"
        conf_expr = f"(CASE WHEN {b} THEN least({d(1.0)}, {conf_expr} + {d(0.2)}) ELSE {conf_expr} END)"
    if pol.file_index_boost:
        b = "(file_idx % 4 = 0 AND cc >= 1)"
        leak_expr = f"({leak_expr} OR {b})"
        conf_expr = f"(CASE WHEN {b} THEN least({d(1.0)}, {conf_expr} + {d(0.1)}) ELSE {conf_expr} END)"
    method = pol.method or f"balanced_{sensitivity}"
    messages = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in crits)
    idx_cte = ""
    idx_join = ", CAST(NULL AS INTEGER) AS file_idx"
    if pol.file_index_boost:
        idx_cte = (", listed AS (SELECT DISTINCT file_name, hole_size FROM readings), "
                   "idx AS (SELECT file_name, CAST(row_number() OVER (PARTITION BY hole_size "
                   "ORDER BY file_name) - 1 AS INTEGER) AS file_idx FROM listed)")
        idx_join = ", (SELECT file_idx FROM idx WHERE idx.file_name = s.file_name) AS file_idx"
    outl_cte = ""
    outl_col = "CAST(NULL AS BIGINT) AS n_out"
    if pol.use_outliers:
        outl_cte = (", o AS (SELECT v.file_name, sum(CASE WHEN s0.std_pop > 0 AND "
                    "abs((v.temperature - s0.mean) / s0.std_pop) > 2 THEN 1 ELSE 0 END) AS n_out "
                    "FROM valid v JOIN s0 ON v.file_name = s0.file_name GROUP BY v.file_name)")
        outl_col = "(SELECT n_out FROM o WHERE o.file_name = s0.file_name) AS n_out"
    return f"""
WITH {READINGS_CTE}, {VALID_CTE},
s0 AS (SELECT file_name, hole_size, count(*) AS n_rows, avg(temperature) AS mean,
              max(temperature) AS max_t, min(temperature) AS min_t,
              stddev_samp(temperature) AS std, stddev_pop(temperature) AS std_pop,
              quantile_cont(temperature, 0.75) AS q75, quantile_cont(temperature, 0.9) AS q90,
              quantile_cont(temperature, 0.95) AS q95,
              sum(CASE WHEN temperature > {d(pol.threshold)} * {fac} THEN 1 ELSE 0 END) AS n_hot
       FROM valid GROUP BY file_name, hole_size){outl_cte},
s1 AS (SELECT s0.*, {outl_col} FROM s0){idx_cte},
s AS (SELECT s.*{idx_join} FROM s1 s),
c AS (SELECT s.*, {count} AS cc, {total} AS tot,
             concat_ws('; ', {messages}) AS criteria_text FROM s)
SELECT file_name, hole_size, CAST(n_rows AS BIGINT) AS n_rows,
       {rr('mean')} AS mean, {rr('std')} AS std, {rr('max_t')} AS max,
       {rr('min_t')} AS min, {rr('q75')} AS q75, {rr('q90')} AS q90, {rr('q95')} AS q95,
       {rr('CAST(n_out AS DOUBLE) / n_rows')} AS outlier_ratio,
       {rr('CAST(n_hot AS DOUBLE) / n_rows')} AS high_temp_ratio,
       {rr('max_t - min_t')} AS temp_range,
       CAST(cc AS INTEGER) AS criteria_count, CAST(tot AS INTEGER) AS total_criteria,
       CAST({leak_expr} AS INTEGER) AS leak_status, {rr(conf_expr)} AS confidence,
       '{method}' AS method, criteria_text
FROM c
"""
