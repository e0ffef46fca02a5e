"""File-level rule labelling: grouped statistics -> criteria -> decision.

Physical plan (per call):
  pass 1  ``groupBy(file)`` partial+final aggregate over the rows (count, mean, max, min,
          sample and population sigma, hot count) -- only partial aggregates shuffle, so a
          file holding a third of all rows is combined map-side, not in one task;
  pass 2  only when the policy needs the outlier share: the finished per-file (mean, sigma)
          table is joined back to the rows -- broadcast by Spark if its bytes allow, otherwise
          a shuffle join that AQE splits when one file is skewed -- and aggregated again;
          files of at most ``ranks.FINE`` values have their exact quantiles read out here too;
  decide  row-wise expressions on the (small) per-file table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatwise.functions.exprs import hole_factor, lit_double, safe_div
from heatwise.operators.common import built_once, track as _track
from heatwise.operators.ordered import positions
from heatwise.operators.ranks import FINE, exact_quantiles, lerp
from heatwise.policies import SENSITIVITIES, LabelPolicy, policy as _policy

# Fixed values of the valid temperature window (exclusive bounds).
VALID_T_LOW = 250.0
VALID_T_HIGH = 1000.0


def valid_temperature(df: DataFrame, col: str = "temperature",
                      low: float = VALID_T_LOW, high: float = VALID_T_HIGH) -> DataFrame:
    """Keep ``low < T < high`` (exclusive, as in the reference); pushes into parquet scans."""
    t = F.col(col)
    return df.filter((t > low) & (t < high))


def hole_size_filter(df: DataFrame, sizes, col: str = "hole_size") -> DataFrame:
    return df.filter(F.col(col).isin(list(sizes)))


def file_temp_stats(rows: DataFrame, key: str = "file_name", temp: str = "temperature",
                    group_extra=("hole_size",), quantiles: str | None = "exact",
                    accuracy: int = 100_000) -> DataFrame:
    """Per-file mean, max, min, sample std, q75/q90/q95 (linear interpolation like pandas).

    ``quantiles="exact"`` selects them by counting passes over the values of each file
    (:mod:`heatwise.operators.ranks`): a file with a third of all rows is counted by all
    tasks, small files are read out at once.  ``"approx"`` uses ``percentile_approx`` with
    ``accuracy``; ``None`` skips them.
    """
    t = F.col(temp)
    keys = [key] + [c for c in group_extra if c in rows.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.avg(t).alias("mean"), F.max(t).alias("max"),
            F.min(t).alias("min"), F.stddev_samp(t).alias("std")]
    if quantiles == "approx":
        q = F.percentile_approx(t, list(QUANTILES.values()), accuracy)
        aggs += [q[i].alias(c) for i, c in enumerate(QUANTILES)]
    out = rows.groupBy(*keys).agg(*aggs)
    if quantiles == "exact":
        out = _same_file(out, file_quantiles(rows, keys, temp), keys, "left")
    return out


#: The quantiles of a file's temperatures.
QUANTILES = {"q75": 0.75, "q90": 0.90, "q95": 0.95}


def file_quantiles(rows: DataFrame, keys, temp: str = "temperature", known: DataFrame | None = None) -> DataFrame:
    """Exact q75, q90 and q95 of each file.  ``known``: (key..., n, _lo, _hi) of each file's values."""
    return exact_quantiles(rows, temp, list(QUANTILES.values()), list(QUANTILES), keys, known)


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def _f1(c: Column) -> Column:
    return F.format_string("%.1f", c)


def _same_file(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the whole file identity, null-safe; the right side's keys are dropped.

    A name alone does not identify a file: the same name may occur under several sizes.
    """
    own = right.withColumnsRenamed({k: f"_file_{k}" for k in keys})
    same = [left[k].eqNullSafe(own[f"_file_{k}"]) for k in keys]
    return left.join(own, same, how).drop(*[f"_file_{k}" for k in keys])


def file_index(files: DataFrame, key: str = "file_name", group: str = "hole_size") -> DataFrame:
    """0-based position of each file within its hole size, in file-name order, over the
    file table (one row per listed file)."""
    distinct = files.select(key, group).distinct()
    return positions(distinct, key, group_cols=[group]).select(
        key, group, F.col("_before").cast("int").alias("file_idx"))


def label_files(rows: DataFrame, policy="four", sensitivity: str = "balanced",
                threshold: float | None = None, files: DataFrame | None = None,
                key: str = "file_name", temp: str = "temperature",
                index: DataFrame | None = None,
                quantiles: str | None = "exact") -> DataFrame:
    """Label every file leak / no-leak with one of the three rule sets.

    ``rows``: readings with ``key``, ``hole_size`` and ``temp`` (already cleaned).
    ``files``: all listed files (``key``, ``hole_size``) for the file-index boost of the
    ``six`` policy (index counts unparseable files too); defaults to the files of ``rows``.
    ``index``: the files' indices (``key``, ``hole_size``, ``file_idx``) where the caller
    keeps them, as the stream does.

    Output, one row per file: file_name, hole_size, n_rows, leak_status, confidence,
    criteria_count, total_criteria, method, criteria_met array<string>, and the
    statistics used (mean, max, min, std, std_pop, outlier_ratio, high_temp_ratio,
    temp_range), plus the structs ``temp_stats`` and ``strategies``.

    ``quantiles`` as in :func:`file_temp_stats`; no rule reads them, so callers that need the
    verdict alone pass ``None`` and leave the three fields of ``temp_stats`` null.
    """
    pol: LabelPolicy = _policy(policy)
    if sensitivity not in SENSITIVITIES:
        raise ValueError(f"sensitivity must be one of {SENSITIVITIES}")
    base = float(threshold if threshold is not None else pol.threshold)
    keys = [key, "hole_size"]
    sums, outliers, criteria, verdict, quantile_fields, wanted = _rules(pol, sensitivity, base, key, temp, bool(quantiles))

    # one row per file; persisted once so the size check, the outlier pass, the quantiles and
    # the decision all read it instead of re-aggregating the rows
    stats = _track(rows.groupBy(*keys).agg(*sums).persist(StorageLevel.MEMORY_AND_DISK))
    listed = quantiles == "exact" and (stats.agg(F.max("n")).first()[0] or 0) <= FINE
    if listed:
        # files of so few values are read out at once, together with the outlier pass
        values, between = _listed(temp)
        stats = (_same_file(rows.select(*keys, temp), stats, keys).groupBy(*keys)
                 .agg(*[F.first(c).alias(c) for c in stats.columns if c not in keys], outliers, values)
                 .select("*", *between).drop("_values"))
    elif quantiles == "exact":
        stats_q = file_quantiles(rows, keys, temp, stats.select(*keys, "n", "_lo", "_hi"))
    elif quantiles:
        stats_q = file_temp_stats(rows, key=key, temp=temp, quantiles=quantiles).select(*keys, *QUANTILES)

    if pol.use_outliers and not listed:
        small = stats.select(*keys, "mean", "std_pop")
        outl = _same_file(rows.select(*keys, temp), small, keys).groupBy(*keys).agg(outliers)
        stats = _same_file(stats, outl, keys)
    elif not listed:
        stats = stats.withColumn("n_out", outliers)

    if pol.file_index_boost:
        idx = index if index is not None else file_index(files if files is not None else rows, key=key)
        stats = _same_file(stats, idx.select(*keys, "file_idx"), keys, "left")
    else:
        stats = stats.withColumn("file_idx", F.lit(None).cast("int"))

    out = stats.withColumns(criteria).withColumns(verdict)
    if quantiles and not listed:
        out = _same_file(out, stats_q, keys, "left")
    out = out.withColumns(quantile_fields).select(*wanted)
    # the label table (one row per file) is what every tagging join and summary reads
    return _track(out.persist())


def _value(temp: str) -> Column:
    """What a quantile counts: no null and no NaN."""
    t = F.col(temp).cast("double")
    return F.when(~F.isnan(t), t)


@built_once
def _listed(temp: str) -> tuple[Column, list]:
    """A file's sorted values, and its quantiles read from them."""
    at = {c: (F.col("n") - 1) * F.lit(p) for c, p in QUANTILES.items()}
    return F.sort_array(F.collect_list(_value(temp))).alias("_values"), [
        lerp(F.get("_values", F.floor(x).cast("int")), F.get("_values", F.ceil(x).cast("int")), x - F.floor(x)).alias(c)
        for c, x in at.items()]


@built_once
def _rules(pol: LabelPolicy, sensitivity: str, base: float, key: str, temp: str, quantiles: bool) -> tuple:
    """The columns of :func:`label_files`, step by step: a file's sums, its outliers, the criteria,
    the verdict, the structs and what is returned."""
    t = F.col(temp)
    factor = hole_factor(F.col("hole_size"), pol.factors, pol.default_factor)
    value = _value(temp)
    sums = [F.count(F.lit(1)).alias("n_rows"), F.avg(t).alias("mean"), F.max(t).alias("max"),
            F.min(t).alias("min"), F.stddev_samp(t).alias("std"),
            F.stddev_pop(t).alias("std_pop"),
            F.sum(F.when(t > lit_double(base) * factor, 1).otherwise(0)).alias("n_hot"),
            F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    z = safe_div(t - F.col("mean"), F.col("std_pop"))
    outliers = (F.sum(F.when((F.col("std_pop") > 0) & (F.abs(z) > 2), 1).otherwise(0)) if pol.use_outliers
                else F.lit(None).cast("long")).alias("n_out")

    f = hole_factor(F.col("hole_size"), pol.factors, pol.default_factor)
    thr = lit_double(base) * f
    n = F.col("n_rows")
    outlier_ratio = F.col("n_out") / n
    hot_ratio = F.col("n_hot") / n
    hot_limit = lit_double(pol.hot_share) * (f if pol.hot_share_scaled else F.lit(1.0))
    mean_thr = thr - pol.mean_margin
    std_thr = lit_double(pol.std_limit) * f
    max_thr = thr + (lit_double(pol.max_margin) * f if pol.max_margin_scaled
                     else lit_double(pol.max_margin))

    crits: list[tuple[str, Column, Column]] = []  # (name, condition, message)
    if pol.use_outliers:
        crits.append(("outliers", F.coalesce(outlier_ratio > lit_double(pol.outlier_share) * f,
                                             F.lit(False)),
                      F.format_string("Outlier ratio (%s) significant", _pct(outlier_ratio))))
    if pol.name == "three":
        crits.append(("high_temp_ratio", hot_ratio > hot_limit,
                      F.format_string("High temp ratio: %s > %s", _pct(hot_ratio),
                                      _pct(hot_limit))))
        crits.append(("mean_temp", F.col("mean") > mean_thr,
                      F.format_string("Mean temp elevated: %sK > %sK", _f1(F.col("mean")),
                                      _f1(mean_thr))))
    else:
        crits.append(("high_temp_ratio", hot_ratio > hot_limit,
                      F.format_string("High temp ratio (%s) > threshold", _pct(hot_ratio))))
        crits.append(("mean_temp", F.col("mean") > mean_thr,
                      F.format_string("Mean temp (%sK) > %sK", _f1(F.col("mean")),
                                      _f1(mean_thr))))
    if pol.use_std:
        # one-row file: sample std is null -> criterion false (NaN > x is False there)
        crits.append(("temp_variance", F.coalesce(F.col("std") > std_thr, F.lit(False)),
                      F.format_string("Temp std (%s) > %s", _f1(F.col("std")), _f1(std_thr))))
    if pol.use_max:
        if pol.name == "three":
            msg = F.format_string("Max temp high: %sK > %sK", _f1(F.col("max")), _f1(max_thr))
        else:
            msg = F.format_string("Max temp (%sK) > %sK", _f1(F.col("max")), _f1(max_thr))
        crits.append(("max_temp", F.col("max") > max_thr, msg))
    any_hot = F.col("n_hot") > 0
    if pol.use_spatial:
        crits.append(("spatial_cluster", any_hot & (hot_ratio > lit_double(pol.spatial_share)),
                      F.format_string("Spatial clustering detected (%s)", _pct(hot_ratio))))

    count = None
    for _, cond, _ in crits:
        term = cond.cast("int")
        count = term if count is None else count + term
    fixed_total = len(crits) - (1 if pol.use_spatial else 0)
    total = (F.lit(fixed_total) + F.when(any_hot, 1).otherwise(0)) if pol.use_spatial \
        else F.lit(fixed_total)

    criteria = {
        "criteria_count": count,
        "total_criteria": total,
        "outlier_ratio": outlier_ratio,
        "high_temp_ratio": hot_ratio,
        "temp_range": F.col("max") - F.col("min"),
        "criteria_met": F.filter(F.array(*[F.when(c, m) for _, c, m in crits]),
                                 lambda x: x.isNotNull()),
    }
    c, tot = F.col("criteria_count"), F.col("total_criteria")
    if pol.fixed_min_count is not None:
        leak = c >= pol.fixed_min_count
    elif sensitivity == "strict":
        leak = c >= tot - 1
    elif sensitivity == "sensitive":
        leak = c >= 1
    else:
        leak = c >= F.floor(tot / 2)
    conf = c / tot.cast("double")
    if pol.large_hole_boost:
        boost = F.col("hole_size").isin("30mm", "40mm") & (c >= 2)
        leak = leak | boost
        conf = F.when(boost, F.least(F.lit(1.0), conf + 0.2)).otherwise(conf)
    if pol.file_index_boost:
        boost = F.coalesce((F.col("file_idx") % 4 == 0) & (c >= 1), F.lit(False))
        leak = leak | boost
        conf = F.when(boost, F.least(F.lit(1.0), conf + 0.1)).otherwise(conf)
    method = pol.method or f"balanced_{sensitivity}"

    verdict = {
        "leak_status": leak.cast("int"),
        "confidence": conf,
        "method": F.lit(method),
    }
    q_cols = ([F.col("q75"), F.col("q90"), F.col("q95")] if quantiles
              else [F.lit(None).cast("double")] * 3)
    quantile_fields = {
        "temp_stats": F.struct(F.col("mean").alias("mean"), F.col("max").alias("max"),
                               F.col("min").alias("min"), F.col("std").alias("std"),
                               q_cols[0].alias("q75"), q_cols[1].alias("q90"),
                               q_cols[2].alias("q95")),
        "strategies": F.struct(F.col("outlier_ratio"), F.col("high_temp_ratio"),
                               F.col("temp_range")),
    }
    return sums, outliers, criteria, verdict, quantile_fields, [
        key, "hole_size", "n_rows", "leak_status", "confidence", "criteria_count",
        "total_criteria", "method", "criteria_met", "mean", "max", "min", "std",
        "std_pop", "outlier_ratio", "high_temp_ratio", "temp_range", "file_idx",
        "temp_stats", "strategies"]


def tag_rows(rows: DataFrame, labels: DataFrame, key: str = "file_name") -> DataFrame:
    """Put each file's label on its rows (leak_status, leak_confidence,
    classification_method, criteria_count); Spark broadcasts the finished label table if its
    bytes allow, else a shuffle join is split by AQE for a file with many rows."""
    keys = [k for k in (key, "hole_size") if k in rows.columns and k in labels.columns]
    lab = labels.select(*keys, "leak_status", F.col("confidence").alias("leak_confidence"),
                        F.col("method").alias("classification_method"), "criteria_count")
    if labels.is_cached:
        labels.count()                     # its size is known before the join is planned
    return _same_file(rows, lab, keys)


def file_label_summary(labels: DataFrame) -> DataFrame:
    """Files per label: leak_status, n_files."""
    return labels.groupBy("leak_status").agg(F.count(F.lit(1)).alias("n_files"))


def ingest_stats(tagged: DataFrame, key: str = "file_name",
                 rejected_files: int | None = None) -> DataFrame:
    """Rows, leak / no-leak rows, leak ratio, column count and files processed."""
    n = F.count(F.lit(1))
    leak = F.sum(F.col("leak_status"))
    out = tagged.agg(
        n.alias("total_rows"), leak.alias("leak_rows"), (n - leak).alias("no_leak_rows"),
        F.try_divide(leak, n).alias("leak_ratio"),
        F.count_distinct(key).alias("files_processed"))
    out = out.withColumn("n_columns", F.lit(len(tagged.columns)))
    if rejected_files is not None:
        out = out.withColumn("files_rejected", F.lit(int(rejected_files)))
    return out
