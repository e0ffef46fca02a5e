"""Counts and labels of two sample corpora of reading files, where they are present."""
import os

from pyspark.sql import functions as F

from heatwise.operators.labels import label_files
from heatwise.sources import files as FS

ROOT = os.environ.get("HEATWISE_SAMPLE_ROOT", "")

EXPECTED = {
    "data": {"files": 160, "rows": 329009,
             "four": {"20mm": 60, "25mm": 0, "30mm": 0, "40mm": 0},
             "six": {"20mm": 60, "25mm": 11, "30mm": 1, "40mm": 0},
             "three": {"20mm": 56, "25mm": 0, "30mm": 0, "40mm": 0},
             "sizes": {"20mm": 60, "25mm": 60, "30mm": 20, "40mm": 20}},
    "generated_data": {"files": 230, "rows": 22255,
                       "four": {"20mm": 63, "25mm": 22, "30mm": 0, "40mm": 0},
                       "six": {"20mm": 63, "25mm": 22, "30mm": 0, "40mm": 0},
                       "three": {"20mm": 63, "25mm": 22, "30mm": 1, "40mm": 0},
                       "sizes": {"20mm": 63, "25mm": 56, "30mm": 54, "40mm": 57}},
}


def test_corpus_counts_and_labels(spark):
    """Checks the corpora that are there; tests/test_small_corpus.py needs none."""
    for corpus in sorted(EXPECTED):
        if os.path.isdir(os.path.join(ROOT, corpus)):
            _check(spark, os.path.join(ROOT, corpus), EXPECTED[corpus])


def _check(spark, base, exp):
    disc = FS.discover_files(spark, base).filter("kind = 'data'")
    paths = [r["path"] for r in disc.collect()]
    rows = FS.with_hole_size(FS.read_readings(spark, paths, extensions=None), "path")
    assert len(paths) == exp["files"]
    assert rows.count() == exp["rows"]
    files = disc.select(F.col("path").alias("file_path"), "hole_size")
    for pol in ("four", "six", "three"):
        lab = label_files(rows, pol, files=files, key="file_path")
        got = {r["hole_size"]: (r["leak"], r["n"]) for r in lab.groupBy("hole_size").agg(
            F.sum("leak_status").alias("leak"), F.count(F.lit(1)).alias("n")).collect()}
        assert got == {s: (exp[pol][s], exp["sizes"][s]) for s in exp["sizes"]}, pol


def test_paths_with_blank_and_plus_join_the_listing(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "25mm")
    os.makedirs(d)
    for name in ("25mm, 1200mm-0045", "a+b 1.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write("1,0,0,300\n")
    listed = {r["path"] for r in FS.list_files(spark, tmpdir_path).collect()}
    read = {r["file_path"] for r in FS.read_lines(spark, tmpdir_path, extensions=None).collect()}
    assert listed == read
