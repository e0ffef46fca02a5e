"""Registered queries over awkward inputs: mixed separators, rejected files, bad text, missing
and infinite values, CSV and dataset round trips.  All inputs are derived from ``lineitem``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatwise.operators import features as feat
from heatwise.operators import selection as sel
from heatwise.operators.common import round_doubles
from heatwise.plans import catalog
from heatwise.plans import eda_sql as esql
from heatwise.plans.catalog import register
from heatwise.plans.sqltext import READINGS_CTE, VALID_CTE
from heatwise.session import shared_dir
from heatwise.sources import bridge, files, sinks

#: How the reading files of each sixth supplier (number modulo 6) are written:
#: 0 comma with a header, 1 tab, 2 padded blanks, 3 semicolon, 4 five columns, 5 bad text.
_PARTS_SQL = ("parts AS (SELECT *, CAST(split_part(node_id, '-', 4) AS BIGINT) % 6 AS style, "
              "CAST(split_part(node_id, '-', 2) AS BIGINT) AS line FROM {rows})")


def _part(i: int):
    return F.split("node_id", "-")[i].cast("long")


def _styled_files(spark: SparkSession, sf_dir: str) -> str:
    """One text file per reading file, six ways of writing them."""
    r = bridge.readings(spark, sf_dir)
    style, line = _part(3) % 6, _part(1)
    x, y, t = (F.col(c).cast("string") for c in ("x", "y", "temperature"))
    bad_t = F.when(line == 1, F.lit("n/a")).otherwise(t)
    bad_x = F.when(line == 2, F.lit("abc")).otherwise(x)
    text = (F.when(style.isin(0, 4), F.concat_ws(",", "node_id", x, y, t, F.when(style == 4, F.lit("7"))))
            .when(style == 1, F.concat_ws("\t", "node_id", x, y, t))
            .when(style == 2, F.concat(F.lit("  "), F.concat_ws("   ", "node_id", x, y, t), F.lit(" ")))
            .when(style == 3, F.concat_ws(";", "node_id", x, y, t))
            .otherwise(F.concat_ws(",", "node_id", bad_x, y, bad_t)))
    body = r.select("hole_size", "file_name", F.lit(1).alias("_ord"), text.alias("value"))
    head = (r.where(style == 0).select("hole_size", "file_name").distinct()
            .select("hole_size", "file_name", F.lit(0).alias("_ord"), F.lit(sinks.READING_HEADER).alias("value")))
    root = shared_dir(spark, "readings-styles")
    (head.unionByName(body).repartition("hole_size", "file_name").sortWithinPartitions("hole_size", "file_name", "_ord")
     .select("hole_size", "file_name", "value").write.partitionBy("hole_size", "file_name").text(root))
    return root


def _from_path(df: DataFrame) -> DataFrame:
    return df.withColumns({"file_name": F.regexp_extract("file_path", "file_name=([^/]+)/", 1),
                           "hole_size": F.regexp_extract("file_path", "hole_size=([^/]+)/", 1)})


@register("ingest_mixed_separators", (
    f"WITH {READINGS_CTE}, {VALID_CTE}, {_PARTS_SQL.format(rows='valid')} SELECT file_name, hole_size, count(*) AS n_rows, "
    "round(min(temperature), 6) AS t_min, round(max(temperature), 6) AS t_max, round(avg(temperature), 6) AS t_mean, "
    "round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM parts "
    "WHERE style <> 4 AND NOT (style = 5 AND line IN (1, 2)) GROUP BY file_name, hole_size"))
def q_mixed_separators(spark, sf_dir):
    """Comma, tab, blank and semicolon files read together; five columns reject a file, bad text a row."""
    return catalog._per_file(_from_path(files.read_readings(spark, _styled_files(spark, sf_dir))))


@register("ingest_rejections", (
    f"WITH {READINGS_CTE}, {_PARTS_SQL.format(rows='readings')} SELECT DISTINCT file_name, hole_size, "
    "CASE style WHEN 1 THEN chr(9) WHEN 2 THEN '\\s+' WHEN 3 THEN ';' ELSE ',' END AS separator, "
    "CAST(CASE WHEN style = 4 THEN 5 ELSE 4 END AS INTEGER) AS n_fields, style <> 4 AS accepted FROM parts"))
def q_rejections(spark, sf_dir):
    """Separator, field count and verdict of every file."""
    rep = _from_path(files.ingest_report(spark, _styled_files(spark, sf_dir)))
    return rep.select("file_name", "hole_size", "separator", F.col("n_fields").cast("int").alias("n_fields"), "accepted")


_HOLES_SQL = ("holes AS (SELECT node_id, CASE WHEN line % 3 = 0 THEN NULL ELSE x END AS x, "
              "CASE WHEN line = 2 THEN NULL ELSE y END AS y, CASE WHEN line = 4 THEN NULL ELSE temperature END AS temperature FROM parts)")


@register("impute_missing", (
    f"WITH {READINGS_CTE}, {VALID_CTE}, {_PARTS_SQL.format(rows='valid')}, {_HOLES_SQL}, "
    "m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(temperature, 0.5) AS mt FROM holes) "
    "SELECT node_id, round(coalesce(x, mx), 6) AS x, round(coalesce(y, my), 6) AS y, "
    "round(coalesce(temperature, mt), 6) AS temperature FROM holes, m"))
def q_impute(spark, sf_dir):
    """Null x, infinite y and NaN temperatures become the exact medians of the others."""
    line = _part(1)
    holes = catalog.valid_readings(spark, sf_dir).select(
        "node_id", F.when(line % 3 != 0, F.col("x")).alias("x"),
        F.when(line == 2, F.lit(float("inf"))).otherwise(F.col("y")).alias("y"),
        F.when(line == 4, F.lit(float("nan"))).otherwise(F.col("temperature")).alias("temperature"))
    return round_doubles(feat.impute_median(feat.replace_infinite(holes)))


@register("correlation_selected", (
    f"WITH {esql.dashboard_feature_ctes()}, cr AS (SELECT feature, abs(corr) AS abs_corr FROM ({esql._corr_union()}) u "
    f"WHERE corr IS NOT NULL AND NOT isnan(corr)), va AS ({esql._var_union()}) "
    "SELECT cr.feature FROM cr JOIN va ON va.feature = cr.feature AND va.variance > 0.001 "
    "QUALIFY row_number() OVER (ORDER BY round(abs_corr, 10) DESC, cr.feature) <= 8"))
def q_correlation_selected(spark, sf_dir):
    """The eight features that the whole selection keeps where more than ten vary."""
    names = sel.select_features(catalog.dashboard_features(spark, sf_dir), many=10, keep=8)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@register("labelled_csv_round_trip", esql.w(
    "SELECT leak_status, '30mm' AS hole_size, 'direct_upload' AS file_name, count(*) AS n, "
    "round(avg(leak_status * CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE)), 6) AS confidence, "
    "CAST(sum(leak_status * 2 + 1) AS BIGINT) AS criteria, round(sum(x), 4) AS x, round(min(temperature), 6) AS t_min "
    "FROM tagged GROUP BY leak_status"))
def q_labelled_csv(spark, sf_dir):
    """Labelled rows written as CSV without the label's details and read back with the defaults."""
    path = shared_dir(spark, "labelled")
    t = catalog.tagged_readings(spark, sf_dir)
    sinks.write_csv(t.select("node_id", F.col("x").alias("x-coordinate"), "y", "temperature", F.col("leak_status").cast("double")), path)
    back = files.read_labelled_csv(spark, path)
    out = back.groupBy("leak_status", "hole_size", "file_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("leak_confidence").alias("confidence"),
        F.sum("criteria_count").alias("criteria"), F.round(F.sum("x"), 4).alias("x"), F.min("temperature").alias("t_min"))
    return round_doubles(out)


@register("scoring_csv_round_trip", (
    f"WITH {READINGS_CTE}, {VALID_CTE}, {_PARTS_SQL.format(rows='valid')}, p AS (SELECT "
    "CASE WHEN line = 1 THEN CAST(0 AS DOUBLE) ELSE x END AS x, CASE WHEN line = 2 THEN '30mm' ELSE hole_size END AS hole_size, "
    "CASE WHEN line = 3 THEN CAST(300 AS DOUBLE) ELSE temperature END AS temperature FROM parts) "
    "SELECT hole_size, count(*) AS n, round(avg(x), 6) AS x, round(avg(temperature), 6) AS temperature FROM p GROUP BY hole_size"))
def q_scoring_csv(spark, sf_dir):
    """Scoring points with empty fields written as CSV and read back with the defaults."""
    path, line = shared_dir(spark, "points"), _part(1)
    pts = catalog.valid_readings(spark, sf_dir).select(
        F.when(line != 1, F.col("x")).alias("x"), "y", F.when(line != 3, F.col("temperature")).alias("temperature"),
        F.when(line != 2, F.col("hole_size")).alias("hole_size"))
    sinks.write_csv(pts, path)
    return round_doubles(files.read_scoring_batch(spark, path).groupBy("hole_size").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("temperature").alias("temperature")))


@register("dataset_sinks", esql.w(
    "SELECT f.fmt, t.hole_size, count(*) AS n, CAST(sum(t.leak_status) AS BIGINT) AS leak, round(avg(t.temperature), 6) AS t_mean "
    "FROM tagged t, (VALUES ('parquet'), ('csv')) f(fmt) GROUP BY f.fmt, t.hole_size"))
def q_dataset_sinks(spark, sf_dir):
    """The labelled dataset through the Parquet and the CSV sink and back, partitioned by hole size."""
    t = catalog.tagged_readings(spark, sf_dir)
    parts = []
    for fmt in ("parquet", "csv"):
        path = sinks.write_dataset(t, shared_dir(spark, f"dataset-{fmt}"), fmt)
        schema = "node_id string, file_name string, x double, y double, temperature double, leak_status int, " \
                 "leak_confidence double, classification_method string, criteria_count int, hole_size string"
        back = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema(schema).option("header", "true").csv(path)
        parts.append(back.select(F.lit(fmt).alias("fmt"), "hole_size", "leak_status", "temperature"))
    return round_doubles(parts[0].unionByName(parts[1]).groupBy("fmt", "hole_size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("leak_status").alias("leak"), F.avg("temperature").alias("t_mean")))
