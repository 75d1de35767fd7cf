"""Keyed state between micro-batches as a log of changes.

A batch writes only the keys that it touched, in a folder of its own; every
``SNAPSHOT_EVERY`` batches, all keys that are not finished are written together.
What a batch reads is the newest such snapshot before it and the changes since,
so its work follows the keys touched and not all keys ever seen.  A batch that
runs again reads the same state and replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.session import literal_table

SNAPSHOT_EVERY = 32
FINISHED = "finished"


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the whole folders of each kind."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"change": [], "snapshot": []}
    for status in system.listStatus(root) if system.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and system.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return found


def read_state(spark: SparkSession, path: str, schema: str, keys: Sequence[str], before: int) -> DataFrame:
    """The latest row of every key that no batch before ``before`` has finished.  ``schema`` has no ``finished``."""
    folders = _folders(spark, path)
    base = max((n for n in folders["snapshot"] if n < before), default=-1)
    # the snapshot of a batch holds that batch's changes
    names = [f"snapshot={base}"] if base >= 0 else []
    names += [f"change={n}" for n in sorted(folders["change"]) if base < n < before]
    if not names:
        return literal_table(spark, [], schema)
    rows = [
        spark.read.schema(f"{schema}, {FINISHED} boolean").parquet(f"{path}/{name}").withColumn("_batch", F.lit(i))
        for i, name in enumerate(names)
    ]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    latest = both.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1")
    return latest.where(~F.col(FINISHED)).drop("_nth", "_batch", FINISHED)


def write_state(changes: DataFrame, path: str, schema: str, keys: Sequence[str], number: int) -> None:
    """The state of the keys that batch ``number`` touched; rows with a true ``finished`` end their key."""
    spark = changes.sparkSession
    if FINISHED not in changes.columns:
        changes = changes.withColumn(FINISHED, F.lit(False))
    changes.write.mode("overwrite").parquet(f"{path}/change={number}")
    whole = _folders(spark, path)["snapshot"]
    if number - max((n for n in whole if n < number), default=-1) >= SNAPSHOT_EVERY:
        latest = read_state(spark, path, schema, keys, number + 1).withColumn(FINISHED, F.lit(False))
        latest.write.mode("overwrite").parquet(f"{path}/snapshot={number}")
