"""Windows and their metadata written as one, and removed as one.

A batch of windows is there when its manifest is: the manifest is written last,
holds what each window was read with, and says how much was written.  Windows
without one, left behind by a writer that was lost, are seen by no reader and
replaced when the batch is written again.  Removal is the same the other way
round: first a manifest of what goes, from then on unseen, then the files; a run
that was lost in between is finished by the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import text
from gustline.operators import windows
from gustline.operators.ordered import BLOCK_ROWS
from gustline.session import cut_lineage, join_with_nulls, literal_table, spread

KEYS = ["session_id", "window_number"]
MANIFEST_SCHEMA = (
    "session_id string, window_number bigint, window_metadata string, documents bigint, bytes bigint, batch bigint"
)
DELETION_SCHEMA = "session_id string, window_number bigint, batch bigint, run bigint"


def _folders(spark: SparkSession, path: str, prefix: str, whole: bool = True) -> list[int]:
    """Numbers of the sub-folders that were written to their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    numbers = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
    return sorted(n for n in numbers if not whole or system.exists(hadoop.Path(root, f"{prefix}{n}/_SUCCESS")))


def write_window_documents(documents: DataFrame, root: str, batch: int) -> None:
    """The first half of :func:`write_window_set`; without a manifest nobody sees what it wrote."""
    documents.select(*KEYS, "document").write.mode("overwrite").partitionBy(*KEYS).text(f"{root}/windows/batch={batch}")


def write_window_set(documents: DataFrame, root: str, batch: int) -> None:
    """Stores window documents (session_id, window_number, document, window_metadata) as batch ``batch`` of ``root``.

    Batches are written again as a whole, with the same number.
    """
    kept = cut_lineage(documents.select(*KEYS, "document", "window_metadata"))
    # a window is a file, and a task opens one after the other
    write_window_documents(spread(kept), root, batch)
    manifest = kept.groupBy(*KEYS).agg(
        F.first("window_metadata", ignorenulls=True).alias("window_metadata"),
        F.count("*").alias("documents"),
        F.sum(F.octet_length("document").cast("bigint")).alias("bytes"),
    )
    manifest.write.mode("overwrite").parquet(f"{root}/manifests/batch={batch}")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    numbers = _folders(spark, f"{root}/manifests", "batch=")
    if not numbers:
        return literal_table(spark, [], MANIFEST_SCHEMA)
    reader = spark.read.schema(MANIFEST_SCHEMA).option("basePath", f"{root}/manifests")
    return reader.parquet(*[f"{root}/manifests/batch={n}" for n in numbers])


def _deletions(spark: SparkSession, root: str) -> DataFrame:
    runs = _folders(spark, f"{root}/deletions", "run=")
    if not runs:
        return literal_table(spark, [], DELETION_SCHEMA)
    reader = spark.read.schema(DELETION_SCHEMA).option("basePath", f"{root}/deletions")
    return reader.parquet(*[f"{root}/deletions/run={n}" for n in runs])


def stored_windows(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of the windows that are there."""
    gone = _deletions(spark, root).select(*KEYS, "batch").distinct()
    return join_with_nulls(_manifests(spark, root), gone, [*KEYS, "batch"], "left_anti")


def read_window_set(spark: SparkSession, root: str) -> DataFrame:
    """Windows that are there, as ingest takes them: window_path, document, window_metadata, ingest_seq, and their keys."""
    numbers = _folders(spark, f"{root}/manifests", "batch=")
    schema = "value string, batch bigint, session_id string, window_number bigint"
    if not numbers:
        lines = literal_table(spark, [], f"{schema}, path string")
    else:
        reader = spark.read.schema(schema).option("basePath", f"{root}/windows")
        lines = reader.text([f"{root}/windows/batch={n}" for n in numbers]).withColumn("path", F.col("_metadata.file_path"))
    there = stored_windows(spark, root).select(*KEYS, "batch", "window_metadata")
    return join_with_nulls(lines, there, [*KEYS, "batch"]).select(
        F.col("path").alias("window_path"),
        F.col("value").alias("document"),
        "window_metadata",
        F.struct("batch", "window_number", "path").alias("ingest_seq"),
        *KEYS,
    )


def window_set_faults(spark: SparkSession, root: str) -> DataFrame:
    """Windows of which fewer or other documents are stored than their manifest says."""
    found = read_window_set(spark, root).groupBy(*KEYS, F.col("ingest_seq.batch").alias("batch")).agg(
        F.count("*").alias("_documents"), F.sum(F.octet_length("document").cast("bigint")).alias("_bytes")
    )
    both = join_with_nulls(stored_windows(spark, root), found, [*KEYS, "batch"], "left")
    same = F.col("documents").eqNullSafe(F.col("_documents")) & F.col("bytes").eqNullSafe(F.col("_bytes"))
    return both.where(~same).select(*KEYS, "batch", "documents", "bytes", F.col("_documents").alias("found_documents"))


def mark_deletions(
    spark: SparkSession, root: str, byte_budget: int, keys: Sequence[str] = ("session_id",), block_rows: int = BLOCK_ROWS
) -> int:
    """First phase: names the windows beyond the budget, oldest first; the newest of a key always stays.

    Gives the number of the run.  Once its manifest is written, readers no longer see these windows.
    """
    runs = _folders(spark, f"{root}/deletions", "run=", whole=False)
    run = runs[-1] + 1 if runs else 0
    kept = windows.retention(stored_windows(spark, root), byte_budget, keys, block_rows)
    kept.where("NOT keep").select(*KEYS, "batch").write.mode("overwrite").parquet(f"{root}/deletions/run={run}")
    return run


def finish_deletions(spark: SparkSession, root: str) -> None:
    """Second phase: removes the files of all windows that some manifest names; those that are gone already stay so.

    Tasks remove folders, through ``pyarrow.fs``.  Manifests of deletions stay, as the manifests of windows do.
    """
    plain = root if "://" in root else f"file://{root.removeprefix('file:')}"

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(plain)
        for pdf in batches:
            for path in pdf["path"]:
                if system.get_file_info(f"{folder}/{path}").type == fs.FileType.Directory:
                    system.delete_dir(f"{folder}/{path}")
            yield pdf

    named = _deletions(spark, root).distinct()
    session = text.folder_value(F.col("session_id"))
    path = F.format_string("windows/batch=%d/session_id=%s/window_number=%d", "batch", session, "window_number")
    # a number of its own, as names take few bytes and would be put in one task
    tasks = spark.sparkContext.defaultParallelism
    gone = named.select(path.alias("path")).repartition(tasks).mapInPandas(remove, "path string")
    gone.write.format("noop").mode("overwrite").save()


def apply_retention(
    spark: SparkSession, root: str, byte_budget: int, keys: Sequence[str] = ("session_id",), block_rows: int = BLOCK_ROWS
) -> None:
    """Leaves the newest windows within ``byte_budget`` bytes for each key; also finishes what a lost run has named."""
    mark_deletions(spark, root, byte_budget, keys, block_rows)
    finish_deletions(spark, root)
