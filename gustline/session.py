"""Session helpers: checkpoint location and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    and nothing was set on the context, a temporary folder is used; outside
    local mode that is refused, since executors could not share it.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="gustline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that later steps read more than once; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows that a scan or checkpoint gives, over all cores, where their partitions would leave most of them idle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def at_once(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Runs steps of which none reads what another writes, each from a thread of its own.

    Their jobs belong to the caller's (a stream's batch, a job group).  If some fail, the first one's error is raised when
    all have ended.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for step in running:
        step.result()


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder that is there to be removed when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


class StagedTable:
    """A frame written once as Parquet in the shared folder; readers see its columns and partitions alone.

    It survives lost executors.  ``drop`` removes it when what was made of it has been written.
    """

    def __init__(self, df: DataFrame, partition_by: Sequence[str] = ()):
        spark = df.sparkSession
        self._spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(self.path)
        delete_on_exit(spark, self.path)
        kinds = {f.name: f for f in df.schema}
        fields = [f for f in df.schema if f.name not in partition_by] + [kinds[c] for c in partition_by]
        self.table = spark.read.schema(T.StructType(fields)).parquet(self.path)

    def drop(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only when the frame is counted to be small; otherwise Spark picks a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def refuse_duplicates(table: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raises if a dimension has two rows for one key."""
    twice = table.groupBy(*keys).count().where("count > 1").select(*keys).limit(5).collect()
    if twice:
        raise ValueError(f"{what} have more than one row for {[tuple(r) for r in twice]}")


def join_with_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of both sides in which null keys meet null keys."""
    own = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(own[f"_right_{k}"]) for k in keys])
    return left.join(own, same, how).drop(*[f"_right_{k}" for k in keys])


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written out in code, kept in the plan itself (no Python worker, no job to read it)."""
    parsed = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in parsed]
    arrays = [pa.array(list(column), type=to_arrow_type(f.dataType)) for column, f in zip(columns, parsed)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=parsed.names), parsed)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run."""
    import pathlib
    import shutil

    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.gettempdir()) / f"gustline-{spark.sparkContext.applicationId}"
    archive = target.with_suffix(".zip")
    if not archive.exists():
        shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
        spark.sparkContext.addPyFile(str(archive))
