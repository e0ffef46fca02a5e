import json
import os

from pyspark.sql import functions as F

from heatwise import streaming
from heatwise.operators.labels import label_files
from heatwise.sources import bridge, sinks
from heatwise.sources.files import read_readings

from conftest import SF001


def _labels(spark, sink):
    return sorted((r["file_path"].split("file_name=")[1].split("/")[0], r["leak_status"],
                   r["criteria_count"]) for r in spark.read.parquet(sink).collect())


def test_stream_labels_one_vs_many_batches(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    sinks.write_reading_files(bridge.readings(spark, SF001), src, "whitespace")
    outs = []
    for i, per_trigger in enumerate((None, 2)):
        sink, ck = os.path.join(tmpdir_path, f"sink{i}"), os.path.join(tmpdir_path, f"ck{i}")
        streaming.stream_label(spark, src, sink, ck, "three",
                               max_files_per_trigger=per_trigger).awaitTermination()
        outs.append(_labels(spark, sink))
    assert outs[0] == outs[1] and len(outs[0]) == 10
    # equal to the batch operator on the same files
    r = read_readings(spark, src).withColumn(
        "hole_size", F.regexp_extract("file_path", r"hole_size=(\d+mm)/", 1))
    batch = sorted((x["file_path"].split("file_name=")[1].split("/")[0], x["leak_status"],
                    x["criteria_count"]) for x in label_files(r, "three", key="file_path").collect())
    assert batch == outs[0]


def test_dataset_sink_partition_pruning(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ds")
    sinks.write_dataset(bridge.readings(spark, SF001), path)
    df = spark.read.parquet(path).filter(F.col("hole_size") == "20mm")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hole_size" in plan
    assert df.count() == bridge.readings(spark, SF001).filter("hole_size = '20mm'").count()


def test_experiment_summary_json(spark, tmpdir_path):
    from heatwise.plans import models as M
    comp = spark.createDataFrame(
        [("RandomForest", 0.9, 0.88, 0.95, 0.9, 0.91, 0.89, 3.0),
         ("LogisticRegression", 0.8, 0.79, 0.85, 0.8, 0.81, 0.79, 1.0)],
        "model string, accuracy double, balanced_accuracy double, roc_auc double, "
        "f1_score double, precision double, recall double, training_time double")
    ds = spark.createDataFrame([(1,), (0,), (0,)], "leak_status int")
    rep = M.experiment_summary(comp, ds, "RandomForest")
    out = os.path.join(tmpdir_path, "rep")
    sinks.write_json_report(rep, out)
    got = json.loads(open([os.path.join(out, f) for f in os.listdir(out)
                           if f.endswith(".json")][0]).readline())
    assert got["best_model"] == "RandomForest" and got["fastest_model"] == "LogisticRegression"
    assert got["dataset"]["total"] == 3 and len(got["models"]) == 2
    assert abs(got["total_training_time"] - 4.0) < 1e-12


def test_a_batch_is_parsed_once(spark, tmpdir_path, monkeypatch):
    """The label operators read a batch's rows several times.  (Before, each read parsed the files
    again, in plans that were not adaptive.)"""
    from heatwise.streaming import streams
    seen = []

    def label(rows, *args, **kwargs):
        seen.append((rows.is_cached, rows.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        return label_files(rows, *args, **kwargs)

    monkeypatch.setattr(streams, "label_files", label)
    src = os.path.join(tmpdir_path, "src")
    sinks.write_reading_files(bridge.readings(spark, SF001), src, "whitespace")
    streaming.stream_label(spark, src, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck"), "four").awaitTermination()
    assert seen == [(True, "true")]


def test_a_small_batch_takes_few_jobs(spark, tmpdir_path):
    """Each micro-batch pays for its jobs, however few its rows.  (Before, this batch took 30 jobs:
    quantiles had passes and joins of their own.)"""
    src = os.path.join(tmpdir_path, "src")
    sinks.write_reading_files(bridge.readings(spark, SF001), src, "whitespace")
    q = streaming.stream_label(spark, src, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck"), "four")
    q.awaitTermination()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId))
    assert 0 < len(jobs) <= 24


def test_labels_are_alike_with_quantiles_read_out_or_counted(spark, monkeypatch):
    from heatwise.operators import labels, ranks
    rows = spark.createDataFrame([(f, "20mm" if f else None, float(t)) for f in ("a", "b", None) for t in range(251, 400, 7)]
                                 + [("c", "30mm", float("nan")), ("c", "30mm", None), ("d", "40mm", 310.0)],
                                 "file_name string, hole_size string, temperature double")
    for policy in ("four", "three"):
        found = []
        for fine in (ranks.FINE, 5):
            monkeypatch.setattr(labels, "FINE", fine)
            found.append(sorted(map(str, label_files(rows, policy, files=rows).drop("file_idx").collect())))
        assert found[0] == found[1] and len(found[0]) == 5
