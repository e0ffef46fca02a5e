"""Oracle SQL for the EDA / selection queries over the tagged readings (policy six)."""

from __future__ import annotations

from heatwise.plans.label_sql import label_sql
from heatwise.plans.sqltext import READINGS_CTE, VALID_CTE, d

TAGGED_POLICY = "six"


def tagged_ctes() -> str:
    lab = label_sql(TAGGED_POLICY, rounded=False)
    return (f"{READINGS_CTE}, {VALID_CTE}, lab AS ({lab}), "
            "tagged AS (SELECT v.*, l.leak_status, l.confidence AS leak_confidence, "
            "l.method AS classification_method, l.criteria_count "
            "FROM valid v JOIN lab l ON v.file_name = l.file_name)")


def w(sql: str) -> str:
    return f"WITH {tagged_ctes()} {sql}"


def r6(e: str) -> str:
    return f"round({e}, 6)"


TAGGED_ROWS = w("SELECT node_id, file_name, hole_size, round(x, 6) AS x, round(y, 6) AS y, "
                "round(temperature, 6) AS temperature, leak_status, round(leak_confidence, 6) "
                "AS leak_confidence, classification_method, criteria_count FROM tagged")

FILE_LABEL_SUMMARY = w("SELECT leak_status, count(*) AS n_files FROM lab GROUP BY leak_status")

INGEST_STATS = w("SELECT count(*) AS total_rows, CAST(sum(leak_status) AS BIGINT) AS leak_rows, "
                 "count(*) - CAST(sum(leak_status) AS BIGINT) AS no_leak_rows, "
                 f"{r6('CAST(CAST(sum(leak_status) AS BIGINT) AS DOUBLE) / count(*)')} AS leak_ratio, "
                 "count(DISTINCT file_name) AS files_processed, 10 AS n_columns FROM tagged")

_BAL = ("SELECT count(*) AS total, CAST(sum(leak_status) AS BIGINT) AS leak, count(*) - CAST(sum(leak_status) AS BIGINT) "
        "AS no_leak, CAST(CAST(sum(leak_status) AS BIGINT) AS DOUBLE) / count(*) AS leak_ratio FROM tagged")

CLASS_BALANCE = w(f"SELECT total, leak, no_leak, {r6('leak_ratio')} AS leak_ratio FROM ({_BAL}) b")

BALANCE_QUALITY = w(
    f"SELECT total, leak, no_leak, {r6('leak_ratio')} AS leak_ratio, {d(0.4)} AS target_ratio, "
    f"{r6(f'abs(leak_ratio - {d(0.4)})')} AS deviation, "
    f"CASE WHEN abs(leak_ratio - {d(0.4)}) < 0.05 THEN 'EXCELLENT' "
    f"WHEN abs(leak_ratio - {d(0.4)}) < 0.1 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END "
    "AS balance_quality, CASE WHEN leak = total AND total > 0 THEN 'only LEAK samples' "
    "WHEN leak = 0 AND total > 0 THEN 'only NO-LEAK samples' END AS single_class_warning "
    f"FROM ({_BAL}) b")

TEMP_STATS_BY_LABEL = w(
    "SELECT leak_status, CASE WHEN leak_status = 0 THEN 'No Leak' ELSE 'Leak' END AS label_text, "
    "count(temperature) AS count, round_even(avg(temperature), 2) AS mean, "
    "round_even(stddev_samp(temperature), 2) AS std, round_even(min(temperature), 2) AS min, "
    "round_even(max(temperature), 2) AS max FROM tagged GROUP BY leak_status")

HOLE_SIZE_ANALYSIS = w(
    "SELECT hole_size, count(*) AS total_samples, CAST(sum(leak_status) AS BIGINT) AS leak_samples, "
    "count(*) - CAST(sum(leak_status) AS BIGINT) AS no_leak_samples, "
    f"{r6('CAST(CAST(sum(leak_status) AS BIGINT) AS DOUBLE) / count(*)')} AS leak_rate, "
    f"{r6('avg(temperature)')} AS avg_temperature FROM tagged GROUP BY hole_size")

DATASET_STATS = w(
    "SELECT count(*) AS total_samples, CAST(sum(leak_status) AS BIGINT) AS leak_samples, "
    "count(*) - CAST(sum(leak_status) AS BIGINT) AS no_leak_samples, "
    f"{r6('CAST(CAST(sum(leak_status) AS BIGINT) AS DOUBLE) / count(*)')} AS leak_ratio, "
    f"{r6('min(temperature)')} AS temp_min, {r6('max(temperature)')} AS temp_max, "
    f"{r6('avg(temperature)')} AS temp_mean, {r6('stddev_samp(temperature)')} AS temp_std, "
    "string_agg(DISTINCT hole_size, ',' ORDER BY hole_size) AS hole_sizes, 10 AS features "
    "FROM tagged")

DESCRIBE_CONFIDENCE = w(
    "SELECT count(leak_confidence) AS count, "
    + ", ".join(f"{r6(e)} AS {n}" for n, e in [
        ("mean", "avg(leak_confidence)"), ("std", "stddev_samp(leak_confidence)"),
        ("min", "min(leak_confidence)"), ("q25", "quantile_cont(leak_confidence, 0.25)"),
        ("q50", "quantile_cont(leak_confidence, 0.5)"),
        ("q75", "quantile_cont(leak_confidence, 0.75)"), ("max", "max(leak_confidence)")])
    + " FROM tagged")

CRITERIA_HISTOGRAM = w("SELECT criteria_count, count(*) AS n FROM tagged GROUP BY criteria_count")


def histogram_sql(col: str, bins: int) -> str:
    idx = " + ".join(f"CASE WHEN {col} >= CAST({i} AS DOUBLE) * st.step + st.lo THEN 1 ELSE 0 END"
                     for i in range(1, bins))
    left = "(CAST(g.bin AS DOUBLE) * st.step + st.lo)"
    right = (f"CASE WHEN g.bin + 1 >= {bins} THEN st.hi "
             "ELSE CAST(g.bin + 1 AS DOUBLE) * st.step + st.lo END")
    return w(
        f"SELECT st.leak_status, g.bin, {r6(left)} AS bin_left, {r6(right)} AS bin_right, "
        f"coalesce(c.cnt, 0) AS count, "
        f"{r6(f'coalesce(c.cnt, 0) / ({right} - {left}) / st.n')} AS density "
        f"FROM (SELECT leak_status, n, lo, hi, (hi - lo) / CAST({bins} AS DOUBLE) AS step FROM "
        f"(SELECT leak_status, count({col}) AS n, CASE WHEN min({col}) = max({col}) "
        f"THEN min({col}) - 0.5 ELSE min({col}) END AS lo, CASE WHEN min({col}) = max({col}) "
        f"THEN max({col}) + 0.5 ELSE max({col}) END AS hi FROM tagged GROUP BY leak_status) s) st "
        f"CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) g "
        f"LEFT JOIN (SELECT t.leak_status, {idx.replace(col, 't.' + col)} AS bin, count(*) AS cnt "
        f"FROM tagged t JOIN (SELECT leak_status, lo, (hi - lo) / CAST({bins} AS DOUBLE) AS step "
        f"FROM (SELECT leak_status, CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 "
        f"ELSE min({col}) END AS lo, CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 "
        f"ELSE max({col}) END AS hi FROM tagged GROUP BY leak_status) s2) st "
        f"ON t.leak_status = st.leak_status GROUP BY 1, 2) c "
        f"ON c.leak_status = st.leak_status AND c.bin = g.bin")


BOX_STATS = w(
    "SELECT q.hole_size, " + ", ".join(f"{r6(c)} AS {c}" for c in ("q1", "median", "q3", "iqr"))
    + ", " + r6("min(CASE WHEN t.temperature >= q.q1 - 1.5 * q.iqr THEN t.temperature END)")
    + " AS whisker_low, " + r6("max(CASE WHEN t.temperature <= q.q3 + 1.5 * q.iqr THEN "
                               "t.temperature END)")
    + " AS whisker_high, CAST(sum(CASE WHEN t.temperature < q.q1 - 1.5 * q.iqr OR t.temperature > "
    "q.q3 + 1.5 * q.iqr THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, count(*) AS n "
    "FROM (SELECT hole_size, q1, median, q3, q3 - q1 AS iqr FROM (SELECT hole_size, "
    "quantile_cont(temperature, 0.25) AS q1, quantile_cont(temperature, 0.5) AS median, "
    "quantile_cont(temperature, 0.75) AS q3 FROM tagged GROUP BY hole_size) a) q "
    "JOIN tagged t ON t.hole_size = q.hole_size GROUP BY q.hole_size, q.q1, q.median, q.q3, q.iqr")

_T = d(308.0)
SEPARATION_CHECK = w(
    "SELECT no_leak_count, leak_count, " + ", ".join(
        f"{r6(c)} AS {c}" for c in ("no_leak_min", "no_leak_max", "no_leak_mean", "leak_min",
                                    "leak_max", "leak_mean", "no_leak_above_threshold",
                                    "leak_below_threshold"))
    + f", {_T} AS threshold, CASE WHEN no_leak_above_threshold < 0.1 AND "
    "leak_below_threshold < 0.1 THEN 'EXCELLENT' WHEN no_leak_above_threshold < 0.2 AND "
    "leak_below_threshold < 0.2 THEN 'GOOD' ELSE 'POOR' END AS separation_quality FROM ("
    "SELECT count(*) FILTER (WHERE leak_status <> 1) AS no_leak_count, "
    "count(*) FILTER (WHERE leak_status = 1) AS leak_count, "
    "min(temperature) FILTER (WHERE leak_status <> 1) AS no_leak_min, "
    "max(temperature) FILTER (WHERE leak_status <> 1) AS no_leak_max, "
    "avg(temperature) FILTER (WHERE leak_status <> 1) AS no_leak_mean, "
    "min(temperature) FILTER (WHERE leak_status = 1) AS leak_min, "
    "max(temperature) FILTER (WHERE leak_status = 1) AS leak_max, "
    "avg(temperature) FILTER (WHERE leak_status = 1) AS leak_mean, "
    f"CAST(count(*) FILTER (WHERE leak_status <> 1 AND temperature > {_T}) AS DOUBLE) / "
    "nullif(count(*) FILTER (WHERE leak_status <> 1), 0) AS no_leak_above_threshold, "
    f"CAST(count(*) FILTER (WHERE leak_status = 1 AND temperature <= {_T}) AS DOUBLE) / "
    "nullif(count(*) FILTER (WHERE leak_status = 1), 0) AS leak_below_threshold FROM tagged) s")


def dashboard_feature_ctes() -> str:
    """Tagged rows with the dashboard feature set, for correlation oracles."""
    from heatwise.plans.feature_sql import feature_columns
    cols = ", ".join(f"{e} AS {n}" for n, e in feature_columns("dashboard"))
    cols = cols.replace("hs.hole_size_encoded", "hs.hole_size_encoded")
    return (f"{tagged_ctes()}, hs AS (SELECT hole_size, CAST(row_number() OVER (ORDER BY "
            "hole_size) - 1 AS INTEGER) AS hole_size_encoded FROM (SELECT DISTINCT hole_size "
            f"FROM tagged) q), feat AS (SELECT t.*, {cols} FROM tagged t JOIN hs "
            "ON hs.hole_size = t.hole_size)")


def dashboard_numeric_features() -> list[str]:
    from heatwise.plans.feature_sql import feature_columns
    return ["x", "y", "temperature"] + [n for n, _ in feature_columns("dashboard")
                                        if n != "temp_category"]


def _corr_union() -> str:
    parts = []
    for c in dashboard_numeric_features():
        parts.append(f"SELECT '{c}' AS feature, covar_pop(CAST({c} AS DOUBLE), "
                     "CAST(leak_status AS DOUBLE)) / nullif(stddev_pop(CAST("
                     f"{c} AS DOUBLE)) * stddev_pop(CAST(leak_status AS DOUBLE)), 0) AS corr "
                     "FROM feat")
    return " UNION ALL ".join(parts)


TARGET_CORRELATION_TOP15 = (
    f"WITH {dashboard_feature_ctes()}, cr AS (SELECT feature, corr, abs(corr) AS abs_corr FROM "
    f"({_corr_union()}) u WHERE corr IS NOT NULL AND NOT isnan(corr)) "
    "SELECT feature, round(corr, 6) AS corr, round(abs_corr, 6) AS abs_corr, "
    "CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(abs_corr, 10) "
    "DESC, feature) AS rank FROM cr) r WHERE rank <= 15")

_CATEGORY = ("CASE WHEN lower(feature) LIKE '%temp%' THEN 'Thermal' "
             "WHEN lower(feature) LIKE '%x\\_%' ESCAPE '\\' OR lower(feature) LIKE '%y\\_%' "
             "ESCAPE '\\' OR lower(feature) LIKE '%distance%' OR lower(feature) LIKE '%angle%' "
             "OR lower(feature) LIKE '%quadrant%' OR lower(feature) LIKE '%zone%' OR "
             "lower(feature) LIKE '%spatial%' THEN 'Spatial' "
             "WHEN lower(feature) LIKE '%interaction%' THEN 'Interaction' "
             "WHEN lower(feature) LIKE '%rolling%' OR lower(feature) LIKE '%zscore%' OR "
             "lower(feature) LIKE '%percentile%' OR lower(feature) LIKE '%std%' "
             "THEN 'Statistical' ELSE 'Other' END")

FEATURE_CATEGORY_STATS = (
    f"WITH {dashboard_feature_ctes()}, cr AS (SELECT feature, abs(corr) AS abs_corr FROM "
    f"({_corr_union()}) u WHERE corr IS NOT NULL AND NOT isnan(corr)) "
    f"SELECT {_CATEGORY} AS category, count(*) AS count, round(avg(abs_corr), 6) AS "
    "avg_correlation, round(max(abs_corr), 6) AS max_correlation FROM cr GROUP BY 1")


def _var_union() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, var_pop(CAST({c} AS DOUBLE)) AS variance FROM feat"
        for c in dashboard_numeric_features())


VARIANCE_THRESHOLD = (
    f"WITH {dashboard_feature_ctes()} SELECT feature, CASE WHEN variance IS NULL OR variance = 0 "
    "THEN variance ELSE round(variance * pow(10.0, 9 - floor(log10(abs(variance))))) / "
    "pow(10.0, 9 - floor(log10(abs(variance)))) END AS variance, "
    "coalesce(variance > 0.001, false) AS selected FROM "
    f"({_var_union()}) u")


# ---- sampling / splitting (exact counts; membership is hash-defined) --------------------

_CNT = ("SELECT count(*) AS n, CAST(sum(leak_status) AS BIGINT) AS leak, count(*) - CAST(sum(leak_status) AS BIGINT) "
        "AS no_leak FROM tagged")


def balance_sql(target: float) -> str:
    t = d(target)
    keep = f"abs(CAST(leak AS DOUBLE) / n - {t}) < 0.05"
    return w(
        f"SELECT 1 AS leak_status, CAST(CASE WHEN {keep} THEN leak ELSE floor(n * {t}) END "
        f"AS BIGINT) AS n_rows FROM ({_CNT}) c UNION ALL "
        f"SELECT 0, CAST(CASE WHEN {keep} THEN no_leak WHEN no_leak > n - floor(n * {t}) "
        f"THEN n - floor(n * {t}) ELSE no_leak END AS BIGINT) FROM ({_CNT}) c")


_CLS = "cls AS (SELECT leak_status, count(*) AS m FROM tagged GROUP BY leak_status)"
_SPLIT = (f"""{_CLS},
cut AS (SELECT *, CAST(sum(m) OVER () AS BIGINT) AS n,
               CAST(sum(m) OVER () AS BIGINT) - CAST(ceil({d(0.3)} * sum(m) OVER ()) AS BIGINT) AS kept FROM cls),
part AS (SELECT *, m * kept // n AS low,
                row_number() OVER (ORDER BY m * kept % n DESC, leak_status NULLS FIRST) AS turn FROM cut),
train_cut AS (SELECT leak_status, m,
                 low + CASE WHEN turn <= kept - sum(low) OVER () THEN 1 ELSE 0 END AS n_train FROM part),
cut2 AS (SELECT leak_status, n_train, m - n_train AS m2, CAST(sum(m - n_train) OVER () AS BIGINT) AS n2 FROM train_cut),
kept2 AS (SELECT *, n2 - CAST(ceil({d(0.5)} * n2) AS BIGINT) AS k2 FROM cut2),
part2 AS (SELECT *, CASE WHEN n2 > 0 THEN m2 * k2 // n2 ELSE 0 END AS low2,
                 row_number() OVER (ORDER BY CASE WHEN n2 > 0 THEN m2 * k2 % n2 ELSE 0 END DESC,
                                    leak_status NULLS FIRST) AS turn2 FROM kept2),
val_cut AS (SELECT *, low2 + CASE WHEN turn2 <= k2 - sum(low2) OVER () THEN 1 ELSE 0 END AS n_val FROM part2),
parts AS (SELECT leak_status, 'train' AS split, n_train AS rows FROM val_cut
          UNION ALL SELECT leak_status, 'val', n_val FROM val_cut
          UNION ALL SELECT leak_status, 'test', m2 - n_val FROM val_cut)""")

STRATIFIED_SPLIT_COUNTS = (f"WITH {tagged_ctes()}, {_SPLIT} SELECT split, leak_status, "
                           "CAST(rows AS BIGINT) AS rows FROM parts WHERE rows > 0")

SPLIT_INFO = (f"WITH {tagged_ctes()}, {_SPLIT} SELECT split, CAST(sum(rows) AS BIGINT) AS rows, "
              "round(CAST(sum(CASE WHEN leak_status = 1 THEN rows ELSE 0 END) AS DOUBLE) / "
              "sum(rows), 6) AS leak_ratio FROM parts GROUP BY split HAVING sum(rows) > 0")

FOLD_COUNTS = (f"WITH {tagged_ctes()}, {_CLS} SELECT f.fold, c.leak_status, "
               "CAST((c.m + 2 - f.fold) // 3 AS BIGINT) AS rows FROM cls c CROSS JOIN "
               "(SELECT CAST(range AS INTEGER) AS fold FROM range(0, 3)) f "
               "WHERE (c.m + 2 - f.fold) // 3 > 0")

CAP_PER_CLASS = w(
    "SELECT node_id, leak_status, round(temperature, 6) AS temperature FROM (SELECT *, "
    "row_number() OVER (PARTITION BY leak_status ORDER BY node_id) AS rn FROM tagged) r "
    "WHERE rn <= 200")

CLASS_WEIGHTS = w(
    "SELECT leak_status, round(CAST(n AS DOUBLE) / (k * m), 6) AS class_weight FROM "
    "(SELECT leak_status, count(*) AS m FROM tagged GROUP BY leak_status) a CROSS JOIN "
    "(SELECT count(*) AS n, count(DISTINCT leak_status) AS k FROM tagged) b")

SCATTER_SAMPLE = w(
    "SELECT leak_status, CAST(CASE WHEN total > 5000 THEN least(m, CASE WHEN leak_status = 1 "
    "THEN 2000 ELSE 3000 END) ELSE m END AS BIGINT) AS n_rows FROM (SELECT leak_status, "
    "count(*) AS m FROM tagged GROUP BY leak_status) a CROSS JOIN (SELECT count(*) AS total "
    "FROM tagged) b")
