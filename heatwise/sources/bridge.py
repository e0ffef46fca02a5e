"""Views that present the driver's parquet tables as readings and scored rows.

``readings``: one reading per ``lineitem`` row; the supplier is the "file" (snapshot),
``l_suppkey % 4`` picks the hole size, quantity/tax give the mesh position and
extended price the temperature. ``scored``: per-row (label, score, prediction) for
the evaluation operators. The same text is given as SQL (``READINGS_SQL``,
``SCORED_SQL``) for the DuckDB oracle; both run unchanged in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS_SQL = """
SELECT concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string))  AS node_id,
       concat('f', lpad(cast(l_suppkey as string), 5, '0'))             AS file_name,
       CASE l_suppkey % 4 WHEN 0 THEN '20mm' WHEN 1 THEN '25mm'
                          WHEN 2 THEN '30mm' ELSE '40mm' END            AS hole_size,
       (l_quantity - 25) / cast(8 as double)                            AS x,
       (l_tax - cast(0.04 as double)) * 75                              AS y,
       cast(240 + 15 * (l_suppkey % 13) as double)
         + l_extendedprice / cast(1500 + 400 * (l_suppkey % 5) as double) AS temperature
FROM lineitem
"""

SCORED_SQL = """
SELECT l_linestatus                                                      AS model,
       cast(l_returnflag = 'R' as int)                                   AS label,
       round((l_quantity / cast(50 as double) + l_discount * 5) / 2, 4)  AS score,
       cast(round((l_quantity / cast(50 as double) + l_discount * 5) / 2, 4) > 0.5 as int)
                                                                         AS prediction
FROM lineitem
"""


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def readings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Columns: node_id, file_name, hole_size, x, y, temperature (unfiltered)."""
    sk = F.col("l_suppkey")
    return lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), sk.cast("string")).alias("node_id"),
        F.concat(F.lit("f"), F.lpad(sk.cast("string"), 5, "0")).alias("file_name"),
        F.when(sk % 4 == 0, "20mm").when(sk % 4 == 1, "25mm")
         .when(sk % 4 == 2, "30mm").otherwise("40mm").alias("hole_size"),
        ((F.col("l_quantity") - 25) / F.lit(8.0)).alias("x"),
        ((F.col("l_tax") - F.lit(0.04)) * 75).alias("y"),
        ((F.lit(240) + F.lit(15) * (sk % 13)).cast("double")
         + F.col("l_extendedprice") / (F.lit(1500) + F.lit(400) * (sk % 5)).cast("double")
         ).alias("temperature"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_lineitem(table(spark, sf_dir, "lineitem"))


def scored_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Columns: model, label, score, prediction."""
    score = F.round((F.col("l_quantity") / F.lit(50.0) + F.col("l_discount") * 5) / 2, 4)
    return lineitem.select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"),
        (score > 0.5).cast("int").alias("prediction"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from_lineitem(table(spark, sf_dir, "lineitem"))
