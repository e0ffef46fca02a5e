"""Tables written to the cluster's shared folder to cut lineage; survive lost executors."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatwise.llm.ship import ship_package
from heatwise.session import shared_dir


class Scratch:
    """Named Parquet tables of one job under the folder of ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, job: str):
        ship_package(spark)
        self.spark, self.root, self.made = spark, shared_dir(spark, job), 0
        self.tables: list[str] = []

    def keep(self, df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
        """Write the rows once and return them read back (a finished, re-readable table).

        Ids and hashes do not compress, and each compressed column chunk holds native
        buffers until the next full collection; ``codec`` is for tables with texts.
        """
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, codec: str = "snappy") -> DataFrame:
        """As :meth:`keep`, written as a table bucketed by ``key``: what groups by the key later
        reads each bucket in one task, without an exchange.  The table has a name of its own in
        the session's catalog until :meth:`close`; its files lie in the shared folder."""
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        table = "heatwise_" + path.rpartition("/")[0].rpartition("-")[2] + f"_{name}_{self.made}"
        (df.write.mode("overwrite").format("parquet").option("compression", codec).option("path", path)
         .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        """Take the bucketed tables' names out of the catalog; nothing may read them any more."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                if self.root.rpartition("/")[2] in folder:
                    path = hadoop(folder)
                    path.getFileSystem(conf).delete(path, True)
