"""Sinks: reading files, CSV/Parquet/JSON outputs of datasets, scores and reports.

Every writer is a plain ``DataFrameWriter`` call (distributed, one file per task);
nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the header line of the reference's comma reading files.
READING_HEADER = "nodenumber,    x-coordinate,    y-coordinate,     temperature"


def write_reading_files(df: DataFrame, root: str, fmt: str = "comma_header",
                        node: str = "node_id", mode: str = "overwrite") -> str:
    """Write readings as one text file per (hole_size, file_name) directory.

    ``comma_header``: padded comma fields with the header line first (like the real
    sample files); ``whitespace``: ``node x y T`` separated by blanks, no header.
    Rows of a file are co-located by ``repartition`` and ordered by
    ``sortWithinPartitions`` so the header is the file's first line.
    """
    def num(c):
        return F.col(c).cast("string")

    if fmt == "comma_header":
        line = F.concat_ws(",", F.lpad(F.col(node).cast("string"), 14, " "),
                           F.lpad(num("x"), 16, " "), F.lpad(num("y"), 16, " "),
                           F.lpad(num("temperature"), 16, " "))
    elif fmt == "whitespace":
        line = F.concat_ws(" ", F.col(node).cast("string"), num("x"), num("y"),
                           num("temperature"))
    else:
        raise ValueError("fmt must be comma_header or whitespace")
    body = df.select("hole_size", "file_name", F.lit(1).alias("_ord"), line.alias("value"))
    if fmt == "comma_header":
        head = df.select("hole_size", "file_name").distinct().select(
            "hole_size", "file_name", F.lit(0).alias("_ord"), F.lit(READING_HEADER).alias("value"))
        body = head.unionByName(body)
    (body.repartition("hole_size", "file_name")
         .sortWithinPartitions("hole_size", "file_name", "_ord")
         .select("hole_size", "file_name", "value")
         .write.mode(mode).partitionBy("hole_size", "file_name").text(root))
    return root


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by=("hole_size",)) -> str:
    """Dataset sink (#116): Parquet partitioned by hole size by default (partition
    pruning for later reads), or CSV with a header."""
    w = df.write.mode("overwrite")
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Scored batch / results / importance tables to CSV with header (#117, #118)."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_json_report(df: DataFrame, path: str) -> str:
    """Experiment summary (#119): the small (bounded, one-row) report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
