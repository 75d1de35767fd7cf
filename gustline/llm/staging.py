"""Tables that an operator writes for itself in the shared folder.

An operator removes those that its result no longer needs; the others go when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gustline.session import delete_on_exit, ensure_checkpoint_dir


#: Most bytes of a batch between Spark and Python tasks; a single longer row goes alone.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit on the bytes of a batch, so that long texts don't add up in a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Staging:
    """A folder of Parquet tables below ``spark.checkpoint.dir``.

    Tables survive lost executors, and every reader of one sees the same rows
    without computing them again.
    """

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """``df`` written once; ``options`` are those of the writer."""
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        delete_on_exit(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them; only for tables that no later result reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
