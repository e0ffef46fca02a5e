"""Model evaluation as DataFrame operators over ``(model, label, score, prediction)``.

Metrics are conditional sums in one aggregate per model (partial + final).  ROC-AUC is
the exact rank-sum with ties, and ROC points are cumulative counts over distinct
scores -- both from the score histogram plus the bucketed cumulative-sum helper, so
no model's rows are sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatwise.functions.exprs import action_tier, lit_double, risk_level
from heatwise.operators.ordered import positions

# The error-bucket margin and the probability cut.
CONFIDENCE_MARGIN = 0.3
PROBABILITY_CUT = 0.5
CLASS_NAMES = {0: "No Leak", 1: "Leak"}


def _z(c: Column) -> Column:
    """zero_division=0: null/NaN ratio -> 0.0"""
    return F.coalesce(c, F.lit(0.0))


def counts(df: DataFrame, group=("model",), label: str = "label",
           prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*group).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, group=("model",), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """(group..., label, prediction, count) on the full 2x2 grid, zeros included."""
    c = counts(df, group, label, prediction)
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                               F.col(name).alias("count"))
                      for a, b, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*group, F.inline(cells))


def confusion_normalized(df: DataFrame, group=("model",), label: str = "label",
                         prediction: str = "prediction") -> DataFrame:
    """Row-normalised confusion: share of each true class predicted as each class."""
    cm = confusion_matrix(df, group, label, prediction)
    w = Window.partitionBy(*group, "label")   # 2 rows per partition: tiny
    return cm.withColumn("rate", F.try_divide(F.col("count"), F.sum("count").over(w)))


def metrics(df: DataFrame, group=("model",), label: str = "label",
            prediction: str = "prediction") -> DataFrame:
    """accuracy, balanced accuracy (mean recall over classes present), precision,
    recall, F1 -- zero division gives 0."""
    c = counts(df, group, label, prediction)
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    prec = _z(F.try_divide(tp, tp + fp))
    rec = _z(F.try_divide(tp, tp + fn))
    tnr = F.try_divide(tn, tn + fp)
    tpr = F.try_divide(tp, tp + fn)
    present = F.when(tpr.isNotNull(), 1).otherwise(0) + F.when(tnr.isNotNull(), 1).otherwise(0)
    bal = F.try_divide(F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0)), present)
    f1 = _z(F.try_divide(2 * tp, 2 * tp + fp + fn))
    return c.select(*group, F.try_divide(tp + tn, n).alias("accuracy"),
                    bal.alias("balanced_accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1_score"), "tp", "fp", "tn", "fn", "n")


def score_histogram(df: DataFrame, group=("model",), label: str = "label",
                    score: str = "score") -> DataFrame:
    """Distinct scores per group with positive and negative counts (map-side combined)."""
    y = F.col(label)
    return df.groupBy(*group, score).agg(F.count_if(y == 1).alias("_pos"),
                                         F.count_if(y != 1).alias("_neg"))


def roc_auc(df: DataFrame, group=("model",), label: str = "label",
            score: str = "score") -> DataFrame:
    """Exact ROC-AUC with ties (Mann-Whitney): sum over scores of
    pos * (negatives below + negatives tied / 2) / (P * N); 0.5 with one class."""
    h = score_histogram(df, group, label, score)
    pos = positions(h, [score], group, weights=["_neg"])
    contrib = F.col("_pos") * (F.col("_before__neg") + F.col("_neg") * 0.5)
    agg = pos.groupBy(*group).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("_p"),
                                  F.sum("_neg").alias("_n"))
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(0.5)).otherwise(
        F.col("_u") / (F.col("_p").cast("double") * F.col("_n")))
    return agg.select(*group, auc.alias("roc_auc"))


def roc_curve(df: DataFrame, group=("model",), label: str = "label",
              score: str = "score", drop_collinear: bool = False) -> DataFrame:
    """ROC points per group: threshold (distinct score, descending), fpr, tpr; plus the
    (0, 0) start with a null threshold.

    ``drop_collinear`` leaves out points inside a straight run, as the reference does: the
    point of a score stays if it is the first or the last, or if the next lower score adds
    other numbers of positives and negatives (its second difference is not zero).  The next
    score's counts are carried over partition edges, so a run over an edge is one run."""
    h = score_histogram(df, group, label, score)
    pts = positions(h, [score], group, weights=["_pos", "_neg"], carry=["_pos", "_neg"] if drop_collinear else ())
    pts = pts.withColumnRenamed("_total__pos", "_P").withColumnRenamed("_total__neg", "_N")
    tot = h.groupBy(*group).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    # ascending sums before a score are the rows below it: at or above it are the others
    tp = F.col("_P") - F.col("_before__pos")
    fp = F.col("_N") - F.col("_before__neg")
    if drop_collinear:
        straight = F.col("_prev__pos").eqNullSafe(F.col("_pos")) & F.col("_prev__neg").eqNullSafe(F.col("_neg"))
        first = (tp == F.col("_pos")) & (fp == F.col("_neg"))
        pts = pts.where(first | F.col("_prev__pos").isNull() | ~straight)
    curve = pts.select(*group, F.col(score).cast("double").alias("threshold"),
                       F.try_divide(fp, F.col("_N")).alias("fpr"),
                       F.try_divide(tp, F.col("_P")).alias("tpr"))
    start = tot.select(*group, F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def classification_report(df: DataFrame, group=("model",), label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per class precision/recall/F1/support plus macro and weighted averages and
    accuracy, as rows (group..., row, precision, recall, f1_score, support)."""
    c = counts(df, group, label, prediction)
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))

    def prf(t, f_p, f_n):
        p = _z(F.try_divide(t, t + f_p))
        r = _z(F.try_divide(t, t + f_n))
        f = _z(F.try_divide(2 * t, 2 * t + f_p + f_n))
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        s.cast("long").alias("support"))

    acc = F.try_divide(tp + tn, n)
    w = lambda a, b: F.try_divide(a * s0 + b * s1, n)
    rows = F.array(
        row(CLASS_NAMES[0], p0, r0, f0, s0), row(CLASS_NAMES[1], p1, r1, f1, s1),
        row("accuracy", F.lit(None), F.lit(None), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n))
    return c.select(*group, F.inline(rows))


def model_comparison(df: DataFrame, group=("model",), label: str = "label",
                     score: str = "score", prediction: str = "prediction") -> DataFrame:
    """One row per model: accuracy, balanced accuracy, ROC-AUC, F1, precision, recall."""
    m = metrics(df, group, label, prediction)
    a = roc_auc(df, group, label, score)
    return m.join(a, list(group)).select(*group, "accuracy", "balanced_accuracy", "roc_auc",
                                         "f1_score", "precision", "recall")


def probability_cut(df: DataFrame, prob: str = "score", cut: float = PROBABILITY_CUT) -> DataFrame:
    """prediction = p > cut; confidence = p if predicted leak else 1 - p."""
    p = F.col(prob)
    return df.withColumns({"predicted": (p > cut).cast("int"),
                           "prediction_confidence": F.when(p > cut, p).otherwise(1 - p)})


def error_bucket(label: Column, pred: Column, prob: Column,
                 margin: float = CONFIDENCE_MARGIN) -> Column:
    correct = label == pred
    sure = F.abs(prob - 0.5) > margin
    return (F.when(correct & sure, "high_confidence_correct")
            .when(correct, "low_confidence_correct").otherwise("incorrect"))


def error_buckets(df: DataFrame, group=("model",), label: str = "label",
                  prediction: str = "prediction", prob: str = "score") -> DataFrame:
    """Counts per (group, bucket)."""
    b = error_bucket(F.col(label), F.col(prediction), F.col(prob))
    return df.withColumn("bucket", b).groupBy(*group, "bucket").agg(
        F.count(F.lit(1)).alias("count"))


def error_bucket_examples(df: DataFrame, key: str, k: int = 4, group=("model",),
                          label: str = "label", prediction: str = "prediction",
                          prob: str = "score") -> DataFrame:
    """Top ``k`` examples per (group, bucket) by distance from 0.5 (ties by key).
    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so only k rows per bucket and partition move."""
    b = error_bucket(F.col(label), F.col(prediction), F.col(prob))
    w = Window.partitionBy(*group, "bucket").orderBy(F.abs(F.col(prob) - 0.5).desc(),
                                                     F.col(key).asc())
    return (df.withColumn("bucket", b).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= k).drop("_rn"))


def with_risk(df: DataFrame, prob: str = "leak_probability") -> DataFrame:
    """risk_level (> .7 HIGH, > .4 MEDIUM, else LOW) and the dashboard action tier."""
    return df.withColumns({"risk_level": risk_level(F.col(prob)),
                           "action": action_tier(F.col(prob))})


def batch_summary(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """total, detections, detection rate (0 when empty)."""
    n = F.count(F.lit(1))
    det = F.coalesce(F.sum(F.col(prediction)), F.lit(0))
    return df.agg(n.alias("total"), det.alias("detections"),
                  F.coalesce(F.try_divide(det, n), lit_double(0.0)).alias("detection_rate"))
