"""Registered queries over the driver's tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``. Column
names and rounding agree on both sides (doubles rounded to 6 places, NaN -> null).
Every query reads whole tables; none caps rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatwise.operators.common import round_doubles, round_sig
from heatwise.operators.labels import label_files, valid_temperature
from heatwise.plans.label_sql import label_sql
from heatwise.sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def valid_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_temperature(bridge.readings(spark, sf_dir))


# ---- 2.3 file labels --------------------------------------------------------------------

LABEL_COLUMNS = ["file_name", "hole_size", "n_rows", "mean", "std", "max", "min",
                 "outlier_ratio", "high_temp_ratio", "temp_range", "criteria_count",
                 "total_criteria", "leak_status", "confidence", "method"]


def labels_for(spark: SparkSession, sf_dir: str, policy: str, sensitivity: str = "balanced",
               quantiles: str | None = None):
    raw = bridge.readings(spark, sf_dir)
    return label_files(valid_temperature(raw), policy, sensitivity,
                       files=raw.select("file_name", "hole_size"), quantiles=quantiles)


def _label_table(lab: DataFrame) -> DataFrame:
    """The label columns with the file's quantiles, in the oracle's types."""
    out = lab.select(*LABEL_COLUMNS, "temp_stats.q75", "temp_stats.q90", "temp_stats.q95",
                     F.array_join("criteria_met", "; ").alias("criteria_text"))
    out = out.withColumns({"n_rows": F.col("n_rows").cast("bigint"),
                           "criteria_count": F.col("criteria_count").cast("int"),
                           "total_criteria": F.col("total_criteria").cast("int"),
                           "leak_status": F.col("leak_status").cast("int")})
    return round_doubles(out)


def _label_query(policy: str, sensitivity: str = "balanced"):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _label_table(labels_for(spark, sf_dir, policy, sensitivity, quantiles="exact"))
    return q


for _pol in ("four", "six", "three"):
    register(f"file_labels_{_pol}", label_sql(_pol))(_label_query(_pol))
register("file_labels_four_strict", label_sql("four", "strict"))(_label_query("four", "strict"))
register("file_labels_six_sensitive", label_sql("six", "sensitive"))(
    _label_query("six", "sensitive"))


# ---- 2.4-2.6 features -------------------------------------------------------------------

from heatwise.operators import features as _feat  # noqa: E402
from heatwise.operators import ordered as _ord  # noqa: E402
from heatwise.plans import feature_sql as _fsql  # noqa: E402

BASE_COLUMNS = ["node_id", "file_name", "hole_size", "x", "y", "temperature"]


def _features_query(level: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = valid_readings(spark, sf_dir)
        out = _feat.engineer_features(v, level=level, key="node_id")
        names = BASE_COLUMNS + [n for n, _ in _fsql.feature_columns(level)]
        return round_doubles(out.select(*names))
    return q


for _lvl in ("basic", "dashboard", "full"):
    register(f"features_{_lvl}", _fsql.features_sql(_lvl))(_features_query(_lvl))


@register("temp_percentile_rank", _fsql.rank_sql())
def q_rank(spark, sf_dir):
    v = valid_readings(spark, sf_dir).select("node_id", "temperature")
    return round_doubles(_ord.rank_pct(v, "temperature", "temp_percentile_rank"))


@register("temp_rolling", _fsql.rolling_sql(5))
def q_rolling(spark, sf_dir):
    v = valid_readings(spark, sf_dir).select("node_id", "temperature")
    st = v.agg(F.avg("temperature").alias("mean"), F.stddev_samp("temperature").alias("std"),
               F.min("temperature").alias("min"), F.max("temperature").alias("max"),
               F.count("temperature").alias("n")).first().asDict()
    w = _ord.rolling_window_size(st["n"])
    return round_doubles(_ord.rolling_stats(v, "temperature", "node_id", w, fill=st))


@register("temperature_quantiles", _fsql.quantile_sql())
def q_quantiles(spark, sf_dir):
    v = valid_readings(spark, sf_dir)
    probs = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]
    return round_doubles(_ord.exact_quantiles(v, "temperature", probs,
                                              [f"q{int(p * 100):02d}" for p in probs]))


# ---- 2.2/2.3 tagging and 2.7/2.8 EDA ----------------------------------------------------

from heatwise.operators import eda as _eda  # noqa: E402
from heatwise.operators import labels as _lab  # noqa: E402
from heatwise.operators import selection as _sel  # noqa: E402
from heatwise.plans import eda_sql as _esql  # noqa: E402


def tagged_readings(spark: SparkSession, sf_dir: str, policy: str = _esql.TAGGED_POLICY):
    """Valid readings with their file's label (the notebook's combined frame)."""
    return _lab.tag_rows(valid_readings(spark, sf_dir), labels_for(spark, sf_dir, policy))


@register("tagged_rows", _esql.TAGGED_ROWS)
def q_tagged(spark, sf_dir):
    return round_doubles(tagged_readings(spark, sf_dir))


@register("file_label_summary", _esql.FILE_LABEL_SUMMARY)
def q_file_label_summary(spark, sf_dir):
    return _lab.file_label_summary(labels_for(spark, sf_dir, _esql.TAGGED_POLICY))


@register("ingest_stats", _esql.INGEST_STATS)
def q_ingest_stats(spark, sf_dir):
    return round_doubles(_lab.ingest_stats(tagged_readings(spark, sf_dir)))


@register("class_balance", _esql.CLASS_BALANCE)
def q_class_balance(spark, sf_dir):
    return round_doubles(_eda.class_balance(tagged_readings(spark, sf_dir)))


@register("balance_quality", _esql.BALANCE_QUALITY)
def q_balance_quality(spark, sf_dir):
    return round_doubles(_eda.balance_quality(tagged_readings(spark, sf_dir)))


@register("temp_stats_by_label", _esql.TEMP_STATS_BY_LABEL)
def q_temp_stats_by_label(spark, sf_dir):
    return _eda.temp_stats_by_label(tagged_readings(spark, sf_dir))


@register("hole_size_analysis", _esql.HOLE_SIZE_ANALYSIS)
def q_hole_size_analysis(spark, sf_dir):
    return round_doubles(_eda.hole_size_analysis(tagged_readings(spark, sf_dir)))


@register("dataset_stats", _esql.DATASET_STATS)
def q_dataset_stats(spark, sf_dir):
    out = _eda.dataset_stats(tagged_readings(spark, sf_dir))
    return round_doubles(out.withColumn("hole_sizes", F.array_join("hole_sizes", ",")))


@register("describe_confidence", _esql.DESCRIBE_CONFIDENCE)
def q_describe_confidence(spark, sf_dir):
    return round_doubles(_eda.describe(tagged_readings(spark, sf_dir), "leak_confidence"))


@register("criteria_histogram", _esql.CRITERIA_HISTOGRAM)
def q_criteria_histogram(spark, sf_dir):
    return _eda.value_counts(tagged_readings(spark, sf_dir), "criteria_count")


@register("temperature_histogram", _esql.histogram_sql("temperature", 50))
def q_temperature_histogram(spark, sf_dir):
    return round_doubles(_eda.histogram(tagged_readings(spark, sf_dir), "temperature",
                                        "leak_status", bins=50))


@register("confidence_histogram", _esql.histogram_sql("leak_confidence", 30))
def q_confidence_histogram(spark, sf_dir):
    return round_doubles(_eda.histogram(tagged_readings(spark, sf_dir), "leak_confidence",
                                        "leak_status", bins=30))


@register("box_stats", _esql.BOX_STATS)
def q_box_stats(spark, sf_dir):
    # every valid reading has a label and none is read here, so the rows need no join
    return round_doubles(_eda.box_stats(valid_readings(spark, sf_dir), "temperature", "hole_size"))


@register("separation_check", _esql.SEPARATION_CHECK)
def q_separation_check(spark, sf_dir):
    return round_doubles(_eda.separation_check(tagged_readings(spark, sf_dir)))


def dashboard_features(spark: SparkSession, sf_dir: str):
    return _feat.engineer_features(tagged_readings(spark, sf_dir), level="dashboard")


@register("target_correlation_top15", _esql.TARGET_CORRELATION_TOP15)
def q_target_correlation(spark, sf_dir):
    df = dashboard_features(spark, sf_dir)
    cols = _sel.numeric_feature_columns(df)
    return round_doubles(_sel.top_correlated(_sel.target_correlation(df, cols), 15)
                         .withColumn("rank", F.col("rank").cast("int")))


@register("feature_category_stats", _esql.FEATURE_CATEGORY_STATS)
def q_feature_category_stats(spark, sf_dir):
    df = dashboard_features(spark, sf_dir)
    cols = _sel.numeric_feature_columns(df)
    return round_doubles(_sel.feature_category_stats(_sel.target_correlation(df, cols)))


@register("variance_threshold", _esql.VARIANCE_THRESHOLD)
def q_variance_threshold(spark, sf_dir):
    df = dashboard_features(spark, sf_dir)
    out = _sel.variance_threshold(df, _sel.numeric_feature_columns(df))
    return out.withColumn("variance", round_sig(F.col("variance"), 10))


# ---- 2.11 evaluation and 2.12 scoring tiers over the scored view ----------------------

from heatwise.operators import evaluate as _ev  # noqa: E402
from heatwise.plans import eval_sql as _vsql  # noqa: E402


def _scored(spark, sf_dir):
    return bridge.scored(spark, sf_dir)


@register("confusion_matrix", _vsql.CONFUSION)
def q_confusion(spark, sf_dir):
    return _ev.confusion_matrix(_scored(spark, sf_dir))


@register("confusion_normalized", _vsql.CONFUSION_NORMALIZED)
def q_confusion_norm(spark, sf_dir):
    return round_doubles(_ev.confusion_normalized(_scored(spark, sf_dir)))


@register("classification_metrics", _vsql.METRICS)
def q_metrics(spark, sf_dir):
    return round_doubles(_ev.metrics(_scored(spark, sf_dir)))


@register("roc_auc", _vsql.ROC_AUC)
def q_roc_auc(spark, sf_dir):
    return round_doubles(_ev.roc_auc(_scored(spark, sf_dir)))


@register("roc_curve", _vsql.ROC_CURVE)
def q_roc_curve(spark, sf_dir):
    return round_doubles(_ev.roc_curve(_scored(spark, sf_dir)))


@register("roc_curve_corners", _vsql.ROC_CURVE_CORNERS)
def q_roc_curve_corners(spark, sf_dir):
    """The curve over line prices, coarse enough for straight runs, without their inner points."""
    li = bridge.table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_linestatus").alias("model"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
                  F.floor(F.col("l_extendedprice") / 2).cast("double").alias("score"))
    return round_doubles(_ev.roc_curve(s, drop_collinear=True))


@register("classification_report", _vsql.CLASSIFICATION_REPORT)
def q_report(spark, sf_dir):
    return round_doubles(_ev.classification_report(_scored(spark, sf_dir)))


@register("model_comparison", _vsql.MODEL_COMPARISON)
def q_model_comparison(spark, sf_dir):
    return round_doubles(_ev.model_comparison(_scored(spark, sf_dir)))


@register("error_buckets", _vsql.ERROR_BUCKETS)
def q_error_buckets(spark, sf_dir):
    return _ev.error_buckets(_scored(spark, sf_dir))


@register("risk_tiers", _vsql.RISK_TIERS)
def q_risk_tiers(spark, sf_dir):
    s = _ev.with_risk(_scored(spark, sf_dir), prob="score")
    return s.groupBy("model", "risk_level", "action").agg(F.count(F.lit(1)).alias("n"))


@register("probability_cut", _vsql.PROBABILITY_CUT)
def q_probability_cut(spark, sf_dir):
    s = _ev.probability_cut(_scored(spark, sf_dir), "score")
    return round_doubles(s.groupBy("model", "predicted", "prediction_confidence")
                         .agg(F.count(F.lit(1)).alias("n")))


@register("batch_summary", _vsql.BATCH_SUMMARY)
def q_batch_summary(spark, sf_dir):
    return round_doubles(_ev.batch_summary(_scored(spark, sf_dir)))


# ---- 2.9 sampling and splitting (oracles check exact counts) ---------------------------

from heatwise.operators import sampling as _smp  # noqa: E402


def _count_by(df, *cols, name="n_rows"):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


@register("balance_dataset", _esql.balance_sql(0.4))
def q_balance(spark, sf_dir):
    return _count_by(_smp.balance_dataset(tagged_readings(spark, sf_dir), target=0.4),
                     "leak_status")


@register("balance_dataset_oversample", _esql.balance_sql(0.8))
def q_balance_over(spark, sf_dir):
    return _count_by(_smp.balance_dataset(tagged_readings(spark, sf_dir), target=0.8),
                     "leak_status")


@register("stratified_split_counts", _esql.STRATIFIED_SPLIT_COUNTS)
def q_split_counts(spark, sf_dir):
    s = _smp.stratified_split(tagged_readings(spark, sf_dir), splits=_smp.SPLITS_NOTEBOOK)
    return _count_by(s, "split", "leak_status", name="rows")


@register("split_info", _esql.SPLIT_INFO)
def q_split_info(spark, sf_dir):
    s = _smp.stratified_split(tagged_readings(spark, sf_dir), splits=_smp.SPLITS_NOTEBOOK)
    return round_doubles(_smp.split_info(s))


@register("stratified_fold_counts", _esql.FOLD_COUNTS)
def q_fold_counts(spark, sf_dir):
    f = _smp.stratified_folds(tagged_readings(spark, sf_dir), k=3)
    return _count_by(f, "fold", "leak_status", name="rows")


@register("cap_per_class", _esql.CAP_PER_CLASS)
def q_cap(spark, sf_dir):
    c = _smp.cap_per_class(tagged_readings(spark, sf_dir), 200, label="leak_status",
                           order="node_id")
    return round_doubles(c.select("node_id", "leak_status", "temperature"))


@register("class_weights", _esql.CLASS_WEIGHTS)
def q_class_weights(spark, sf_dir):
    w = _smp.class_weights(tagged_readings(spark, sf_dir))
    return round_doubles(w.select("leak_status", "class_weight").distinct())


@register("scatter_sample", _esql.SCATTER_SAMPLE)
def q_scatter(spark, sf_dir):
    return _count_by(_smp.scatter_sample(tagged_readings(spark, sf_dir)), "leak_status")


# ---- 2.1/2.2 ingest of reading files (written from the driver tables, read back) -------

from heatwise.session import shared_dir  # noqa: E402
from heatwise.sources import files as _files  # noqa: E402
from heatwise.sources import sinks as _sinks  # noqa: E402
from heatwise.plans.sqltext import READINGS_CTE, VALID_CTE  # noqa: E402


_WRITTEN: dict[tuple, str] = {}


def _reading_files(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """Folder of the readings as text files, written once in a session for each form: the
    queries are about reading them."""
    key = (spark.sparkContext.applicationId, sf_dir, fmt)
    if key not in _WRITTEN:
        root = shared_dir(spark, f"readings-{fmt}")
        _WRITTEN[key] = _sinks.write_reading_files(bridge.readings(spark, sf_dir), root, fmt)
    return _WRITTEN[key]


def text_readings(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Readings of ``lineitem`` written as one text file per reading file, then parsed
    back by the ingest operator (separator detection, NA rules, coercion, T filter)."""
    r = _files.read_readings(spark, _reading_files(spark, sf_dir, fmt))
    return r.withColumns({
        "file_name": F.regexp_extract("file_path", "file_name=([^/]+)/", 1),
        "hole_size": F.regexp_extract("file_path", "hole_size=([^/]+)/", 1)})


def _per_file(df: DataFrame) -> DataFrame:
    t = F.col("temperature")
    return round_doubles(df.groupBy("file_name", "hole_size").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("t_min"), F.max(t).alias("t_max"),
        F.avg(t).alias("t_mean"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean")))


_PER_FILE_SQL = (f"WITH {READINGS_CTE}, {VALID_CTE} SELECT file_name, hole_size, count(*) AS "
                 "n_rows, round(min(temperature), 6) AS t_min, round(max(temperature), 6) AS "
                 "t_max, round(avg(temperature), 6) AS t_mean, round(avg(x), 6) AS x_mean, "
                 "round(avg(y), 6) AS y_mean FROM valid GROUP BY file_name, hole_size")


@register("ingest_comma_files", _PER_FILE_SQL)
def q_ingest_comma(spark, sf_dir):
    return _per_file(text_readings(spark, sf_dir, "comma_header"))


@register("ingest_whitespace_files", _PER_FILE_SQL)
def q_ingest_ws(spark, sf_dir):
    return _per_file(text_readings(spark, sf_dir, "whitespace"))


@register("text_pipeline_labels_three", label_sql("three"))
def q_text_labels(spark, sf_dir):
    r = text_readings(spark, sf_dir, "whitespace").withColumnRenamed("node_number", "node_id")
    lab = label_files(r, "three")
    return _label_table(lab)


# ---- 2.10 training and 2.12 scoring: oracles hold what any right model must satisfy ------

from heatwise.plans import models as _models  # noqa: E402


def _trained(spark, sf_dir, models=("RandomForest", "GradientBoosting", "LogisticRegression")):
    tagged = tagged_readings(spark, sf_dir)
    feats, cols, spec = _models.prepare_training(tagged)
    split = _smp.stratified_split(feats, splits=_smp.SPLITS_API)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    fitted, comp, best = _models.train_models(train, test, cols, models=models, grid="api")
    return fitted, comp, best, spec


@register("train_compare_models", _vsql.TRAIN_COMPARE)
def q_train_compare(spark, sf_dir):
    """The grid search of all three models over the readings; for each, the test rows it was
    judged on by class, and whether its metrics follow from its confusion counts, it is better
    than a constant verdict and exactly one model is the best."""
    _, comp, best, _ = _trained(spark, sf_dir)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    close = [F.abs(F.col("accuracy") - (tp + tn) / (tp + fp + tn + fn)) < 1e-9,
             F.abs(F.col("balanced_accuracy") - (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2) < 1e-9,
             F.col("roc_auc").between(0.5, 1.0), F.col("f1_score").between(0.0, 1.0)]
    return comp.select("model", (tp + fn).cast("long").alias("leak_rows"), (tn + fp).cast("long").alias("no_leak_rows"),
                       (close[0] & close[1] & close[2] & close[3]).alias("metrics_consistent"),
                       (F.col("balanced_accuracy") > 0.5).alias("beats_constant"),
                       F.lit(best).isin(list(_models.MODEL_NAMES)).alias("best_is_known"))


def _consistent(scored: DataFrame) -> DataFrame:
    """Points by hole size, and how many have a prediction, confidence and tier that follow
    from their probability."""
    p = F.col("leak_probability")
    tier = F.when(p > 0.7, "HIGH").when(p > 0.4, "MEDIUM").otherwise("LOW")
    right = ((F.col("prediction") == (p > 0.5).cast("int")) | (p == 0.5)) & (F.col("risk_level") == tier) & \
        (F.abs(p + F.col("no_leak_probability") - 1) < 1e-9) & (F.col("confidence") == F.greatest(p, "no_leak_probability"))
    return scored.groupBy("hole_size").agg(F.count(F.lit(1)).alias("points"), F.count_if(right).alias("consistent"),
                                           (F.max(p) > F.min(p)).alias("tells_apart"))


@register("score_readings_risk", _vsql.SCORED_CONSISTENT)
def q_score_risk(spark, sf_dir):
    """All readings scored by the logistic regression that the grid search chooses."""
    fitted, _, best, spec = _trained(spark, sf_dir, models=("LogisticRegression",))
    pts = valid_readings(spark, sf_dir).select("x", "y", "temperature", "hole_size")
    return _consistent(_models.score(fitted[best], pts, spec, best))


# ---- streaming (#120, #121) -------------------------------------------------------------

from heatwise import streaming as _stream  # noqa: E402


@register("stream_labels_four", label_sql("four"))
def q_stream_labels(spark, sf_dir):
    """Reading files derived from lineitem arrive as a stream (30 files per micro-batch);
    every file is labelled once in foreachBatch; the sink equals the batch labels."""
    src = shared_dir(spark, "stream-src")
    _sinks.write_reading_files(bridge.readings(spark, sf_dir), src, "whitespace")
    sink, ckpt = shared_dir(spark, "stream-labels"), shared_dir(spark, "stream-ckpt")
    q = _stream.stream_label(spark, src, sink, ckpt, policy="four", max_files_per_trigger=30)
    q.awaitTermination()
    lab = spark.read.parquet(sink).withColumn(
        "file_name", F.regexp_extract("file_path", "file_name=([^/]+)/", 1))
    return _label_table(lab)


@register("stream_labels_six", label_sql("six"))
def q_stream_labels_six(spark, sf_dir):
    """Reading files arrive in three waves in name order; after each wave the stream starts
    again from its checkpoint.  The file index runs on from wave to wave, so labels with the
    file-index boost equal those of the batch."""
    raw = bridge.readings(spark, sf_dir)
    number = F.substring("file_name", 2, 20).cast("double")
    cuts = _ord.exact_quantiles(raw.select(number.alias("n")), "n", [1 / 3, 2 / 3], ["a", "b"]).first()
    src = shared_dir(spark, "stream-src")
    sink, ckpt = shared_dir(spark, "stream-labels"), shared_dir(spark, "stream-ckpt")
    for wave in (number <= cuts["a"], (number > cuts["a"]) & (number <= cuts["b"]), number > cuts["b"]):
        _sinks.write_reading_files(raw.where(wave), src, "whitespace", mode="append")
        _stream.stream_label(spark, src, sink, ckpt, policy="six").awaitTermination()
    lab = spark.read.parquet(sink).withColumn(
        "file_name", F.regexp_extract("file_path", "file_name=([^/]+)/", 1))
    return _label_table(lab)


@register("stream_score_risk", _vsql.SCORED_CONSISTENT)
def q_stream_score(spark, sf_dir):
    """Valid readings arrive as CSV point files; the logistic regression that the grid search
    chooses scores the stream."""
    fitted, _, best, spec = _trained(spark, sf_dir, models=("LogisticRegression",))
    src = shared_dir(spark, "points-src")
    (valid_readings(spark, sf_dir).select("x", "y", "temperature", "hole_size")
     .repartition(8).write.option("header", "true").csv(src))
    sink, ckpt = shared_dir(spark, "points-scored"), shared_dir(spark, "points-ckpt")
    q = _stream.stream_score(spark, fitted[best], spec, best, src, sink, ckpt,
                             max_files_per_trigger=3)
    q.awaitTermination()
    return _consistent(spark.read.parquet(sink))


# ---- small operators: per-file stats, name rule, size filter, valid counts -------------

from heatwise.functions.exprs import hole_size_from_name  # noqa: E402

_FTS_SQL = (f"WITH {READINGS_CTE}, {VALID_CTE} SELECT file_name, hole_size, count(*) AS n_rows, "
            + ", ".join(f"round({e}, 6) AS {n}" for n, e in [
                ("mean", "avg(temperature)"), ("max", "max(temperature)"),
                ("min", "min(temperature)"), ("std", "stddev_samp(temperature)"),
                ("q75", "quantile_cont(temperature, 0.75)"),
                ("q90", "quantile_cont(temperature, 0.9)"),
                ("q95", "quantile_cont(temperature, 0.95)")])
            + " FROM valid GROUP BY file_name, hole_size")


@register("file_temp_stats", _FTS_SQL)
def q_file_temp_stats(spark, sf_dir):
    return round_doubles(_lab.file_temp_stats(valid_readings(spark, sf_dir), quantiles="exact"))


_NAME_SQL = (f"WITH {READINGS_CTE} SELECT file_name, CASE WHEN lower(file_name) LIKE '%20%' "
             "THEN '20mm' WHEN lower(file_name) LIKE '%25%' THEN '25mm' WHEN lower(file_name) "
             "LIKE '%30%' THEN '30mm' WHEN lower(file_name) LIKE '%40%' THEN '40mm' ELSE '30mm' "
             "END AS hole_size_from_name FROM (SELECT DISTINCT file_name FROM readings) f")


@register("hole_size_from_file_name", _NAME_SQL)
def q_name_rule(spark, sf_dir):
    files = bridge.readings(spark, sf_dir).select("file_name").distinct()
    return files.select("file_name",
                        hole_size_from_name(F.col("file_name"), "30mm").alias("hole_size_from_name"))


_FILTER_SQL = _esql.w(
    "SELECT count(*) AS total, CAST(sum(leak_status) AS BIGINT) AS leak, count(*) - CAST(sum(leak_status) AS BIGINT) AS no_leak, "
    "round(CAST(CAST(sum(leak_status) AS BIGINT) AS DOUBLE) / count(*), 6) AS leak_ratio FROM tagged "
    "WHERE hole_size IN ('30mm', '40mm')")


@register("hole_size_filter_large", _FILTER_SQL)
def q_size_filter(spark, sf_dir):
    t = _lab.hole_size_filter(tagged_readings(spark, sf_dir), ["30mm", "40mm"])
    return round_doubles(_eda.class_balance(t))


_VALID_SQL = (f"WITH {_esql.dashboard_feature_ctes()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE CAST({c} AS DOUBLE) IS NOT NULL AND "
    f"NOT isnan(CAST({c} AS DOUBLE)) AND NOT isinf(CAST({c} AS DOUBLE))) AS DOUBLE) AS n_valid "
    "FROM feat" for c in _esql.dashboard_numeric_features()))


@register("feature_valid_counts", _VALID_SQL)
def q_valid_counts(spark, sf_dir):
    df = dashboard_features(spark, sf_dir)
    return _sel.valid_counts(df, _sel.numeric_feature_columns(df))


# ---- #104 error-bucket examples (top 4 per model and bucket) ---------------------------

_KEYED_SCORED_SQL = (
    "SELECT concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string)) AS row_key, "
    "l_linestatus AS model, cast(l_returnflag = 'R' as int) AS label, "
    "round((l_quantity / cast(50 as double) + l_discount * 5) / 2, 4) AS score, "
    "cast(round((l_quantity / cast(50 as double) + l_discount * 5) / 2, 4) > 0.5 as int) "
    "AS prediction FROM lineitem")

_EXAMPLES_SQL = (
    f"WITH s AS ({_KEYED_SCORED_SQL}), b AS (SELECT *, CASE WHEN label = prediction AND "
    "abs(score - 0.5) > 0.3 THEN 'high_confidence_correct' WHEN label = prediction THEN "
    "'low_confidence_correct' ELSE 'incorrect' END AS bucket FROM s) "
    "SELECT model, bucket, row_key, label, prediction, round(score, 6) AS score FROM ("
    "SELECT *, row_number() OVER (PARTITION BY model, bucket ORDER BY abs(score - 0.5) DESC, "
    "row_key) AS rn FROM b) r WHERE rn <= 4")


@register("error_bucket_examples", _EXAMPLES_SQL)
def q_error_examples(spark, sf_dir):
    """Top 4 examples per (model, bucket) by distance from 0.5, ties by row key."""
    li = bridge.table(spark, sf_dir, "lineitem")
    score = F.round((F.col("l_quantity") / F.lit(50.0) + F.col("l_discount") * 5) / 2, 4)
    s = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
        .alias("row_key"),
        F.col("l_linestatus").alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"), (score > 0.5).cast("int").alias("prediction"))
    ex = _ev.error_bucket_examples(s, "row_key", k=4)
    return round_doubles(ex.select("model", "bucket", "row_key", "label", "prediction", "score"))


# ---- #2/#18 per-file ingest report (separator chosen, fields, accepted) -----------------

_REPORT_SQL = (f"WITH {READINGS_CTE} SELECT DISTINCT file_name, hole_size, '\\s+' AS separator, "
               "4 AS n_fields, true AS accepted FROM readings")


@register("ingest_file_report", _REPORT_SQL)
def q_ingest_report(spark, sf_dir):
    """Whitespace reading files written from lineitem: every file is accepted with the
    whitespace separator and four fields (comma/tab fail the 4-field test first)."""
    rep = _files.ingest_report(spark, _reading_files(spark, sf_dir, "whitespace"))
    return rep.select(F.regexp_extract("file_path", "file_name=([^/]+)/", 1).alias("file_name"),
                      F.regexp_extract("file_path", "hole_size=([^/]+)/", 1).alias("hole_size"),
                      "separator", F.col("n_fields").cast("int").alias("n_fields"), "accepted")


from heatwise.plans import edges  # noqa: E402, F401
