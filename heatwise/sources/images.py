"""Image catalogue and image statistics (data side of the contour-image pipelines).

Discovery and labels are plain DataFrame expressions over a ``binaryFile`` listing
(contents pruned).  Decoding is Spark's ``image`` source (``dropInvalid`` drops
undecodable files); the grey-level statistics of one decoded image are computed by an
Arrow-batched pandas UDF with numpy -- the only Python worker in the library.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatwise.sources.files import IMAGE_EXTENSIONS

# Visual-hint and plausibility thresholds, image label rule.
UNIFORM_VARIANCE, UNIFORM_RANGE, HIGH_VARIANCE = 200.0, 30.0, 800.0
NO_LEAK_MAX_VARIANCE, LEAK_MIN_VARIANCE = 300.0, 600.0
SIZES = ("20mm", "25mm", "30mm", "40mm")
LEAK_ABOVE_MM = 25
STATS_SCHEMA = T.StructType([T.StructField("grey_mean", T.DoubleType()),
                             T.StructField("grey_variance", T.DoubleType()),
                             T.StructField("grey_range", T.DoubleType())])


def _ext_filter(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$")


def discover_images(spark: SparkSession, base: str) -> DataFrame:
    """Image files (extension in either case) under any ``contours`` directory:
    path, hole_size (first size found in the path, in size order), label (> 25 mm)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(base).select("path", "length"))
    files = files.filter(_ext_filter(F.col("path")) & F.col("path").contains("/contours/"))
    return with_image_label(files)


def first_size_in_path(path: Column) -> Column:
    expr = None
    for s in SIZES:
        expr = F.when(path.contains(s), F.lit(s)) if expr is None else expr.when(
            path.contains(s), F.lit(s))
    return expr


def with_image_label(df: DataFrame, path: str = "path") -> DataFrame:
    """hole_size from the path (rows without one are dropped) and label = size > 25 mm."""
    hs = first_size_in_path(F.col(path))
    out = df.withColumn("hole_size", hs).filter(F.col("hole_size").isNotNull())
    mm = F.regexp_extract("hole_size", r"(\d+)", 1).cast("int")
    return out.withColumn("label", (mm > LEAK_ABOVE_MM).cast("int"))


def discover_labelled_images(spark: SparkSession, base: str) -> DataFrame:
    """Pre-labelled folders: ``.../leak/...`` -> 1, ``.../no_leak/...`` -> 0."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(base).select("path", "length"))
    files = files.filter(_ext_filter(F.col("path")))
    lab = (F.when(F.col("path").contains("/no_leak/"), F.lit(0))
           .when(F.col("path").contains("/leak/"), F.lit(1)))
    return files.withColumn("label", lab).filter(F.col("label").isNotNull())


def image_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_images"))


@F.pandas_udf(STATS_SCHEMA)
def _grey_stats(height: pd.Series, width: pd.Series, channels: pd.Series,
                data: pd.Series) -> pd.DataFrame:
    means, vars_, ranges = [], [], []
    for h, w, c, buf in zip(height, width, channels, data):
        px = np.frombuffer(buf, dtype=np.uint8).reshape(int(h), int(w), int(c))
        colour = px[:, :, :3] if c >= 3 else px[:, :, :1]
        grey = colour.astype(np.float64).mean(axis=2)
        means.append(float(grey.mean()))
        vars_.append(float(grey.var()))
        ranges.append(float(grey.max() - grey.min()))
    return pd.DataFrame({"grey_mean": means, "grey_variance": vars_, "grey_range": ranges})


def read_images(spark: SparkSession, paths) -> DataFrame:
    """Decoded images; undecodable files are dropped (``dropInvalid``)."""
    return spark.read.format("image").option("dropInvalid", "true").load(paths)


def image_statistics(images: DataFrame) -> DataFrame:
    """path, height, width, grey mean / population variance / range per image
    (grey = mean of the colour channels, alpha ignored; channel order is irrelevant)."""
    im = F.col("image")
    st = _grey_stats(im.height, im.width, im.nChannels, im.data)
    return images.select(im.origin.alias("path"), im.height.alias("height"),
                         im.width.alias("width"), st.alias("s")).select(
        "path", "height", "width", "s.grey_mean", "s.grey_variance", "s.grey_range")


def visual_hint(variance: Column, rng: Column) -> Column:
    return (F.when((variance < UNIFORM_VARIANCE) & (rng < UNIFORM_RANGE), F.lit("Uniform"))
            .when(variance > HIGH_VARIANCE, F.lit("High Var")).otherwise(F.lit("Moderate")))


def label_plausible(label: Column, variance: Column) -> Column:
    return ((label == 0) & (variance < NO_LEAK_MAX_VARIANCE)) | \
        ((label == 1) & (variance > LEAK_MIN_VARIANCE))


def with_hints(stats: DataFrame) -> DataFrame:
    out = stats.withColumn("visual_hint", visual_hint(F.col("grey_variance"), F.col("grey_range")))
    if "label" in stats.columns:
        out = out.withColumn("label_plausible",
                             label_plausible(F.col("label"), F.col("grey_variance")))
    return out


def class_image_averages(stats: DataFrame) -> DataFrame:
    return stats.groupBy("label").agg(F.avg("grey_variance").alias("avg_variance"),
                                      F.avg("grey_range").alias("avg_range"),
                                      F.avg("grey_mean").alias("avg_intensity"),
                                      F.count(F.lit(1)).alias("n_images"))
