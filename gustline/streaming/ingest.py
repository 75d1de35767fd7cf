"""Window files into the warehouse as they appear."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gustline.plans.ingest import CAMPAIGN_SCHEMA, CONFIGURATION_SCHEMA, PART_KEYS, ingest_windows, unsent_windows
from gustline.session import at_once, broadcast_if_small, cut_lineage, join_with_nulls, literal_table
from gustline.sources import sinks
from gustline.sources.windows import (
    METADATA_SUFFIX, as_windows, is_mounted, metadata_beside, not_named, read_window_metadata, read_windows,
)
from gustline.streaming.batches import for_each_batch


#: Files of a micro-batch: each batch costs some hundred small jobs, whatever its size.
FILES_PER_TRIGGER = 10_000
#: Batches of at most so many rows are broadcast without being counted again.
SMALL_ROWS = 100_000
#: Windows whose metadata files are named one by one; of more, all in their folders are read.
NAMED_SIDECARS = 2 * FILES_PER_TRIGGER
#: State partitions a core of a paired stream: each has four stores that every batch opens and commits, rows or none.
STATE_PER_CORE = 2
_SHUFFLED = "spark.sql.shuffle.partitions"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def new_windows(spark: SparkSession, windows_path: str, max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Each window file once, as it is finalised.  ``windows_path`` may be a glob over nested folders."""
    # metadata files are left out when files are listed: they don't fill batches, nor are they opened
    stream = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = stream.option("pathGlobFilter", not_named(METADATA_SUFFIX))
    return as_windows(stream.option("recursiveFileLookup", "true").schema("value string").text(windows_path))


def new_sidecars(spark: SparkSession, windows_path: str, max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Each metadata file beside the windows once, as it appears: window_path, window_metadata, modified."""
    stream = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).option("wholetext", "true")
    files = stream.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{METADATA_SUFFIX}")
    stem = F.regexp_replace(F.col("_metadata.file_path"), r"\.metadata\.json$", "")
    return files.schema("value string").text(windows_path).select(
        stem.alias("window_path"),
        F.col("value").alias("window_metadata"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def paired_windows(
    windows: DataFrame, sidecars: DataFrame, delay: str = "1 hour", time: Column | None = None
) -> DataFrame:
    """Streams of windows and of their metadata, in whatever order they come, as one stream.

    A window waits for its metadata, and metadata for its window, until event time has passed by ``delay``; then the
    window comes without.  Neither folders nor files that came before are listed or read again.  ``time`` is an
    expression over ``window_path`` for event time; by default it is the files' modification time.
    """
    at = time if time is not None else F.col("ingest_seq.modified")
    left = windows.withColumn("_at", at).withWatermark("_at", delay)
    beside = time if time is not None else F.col("modified")
    right = sidecars.select(F.col("window_path"), "window_metadata", beside.alias("_told_at"))
    right = right.withColumnRenamed("window_path", "_told_path").withWatermark("_told_at", delay)
    near = F.expr(f"_told_at >= _at - INTERVAL {delay} AND _told_at <= _at + INTERVAL {delay}")
    paired = left.join(right, (F.col("window_path") == F.col("_told_path")) & near, "left_outer")
    return paired.select("window_path", "document", "ingest_seq", "window_metadata")


def _described(spark: SparkSession, batch: DataFrame, mounted: bool) -> DataFrame:
    """The windows of a batch with the metadata beside them.

    On mounted folders tasks open just those files, so a batch costs the same however many windows lie there.  Elsewhere
    the folders of the batch are listed, and only its files opened.
    """
    if mounted:
        return batch.withColumn("window_metadata", metadata_beside(F.col("window_path")))
    return batch.join(_sidecars(spark, batch), "window_path", "left")


def _sidecars(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """Metadata beside the windows of a batch: only the folders that they lie in are listed, only their files opened."""
    # file paths come percent-encoded; in them a plus sign is just that
    plain = F.url_decode(F.replace(F.col("window_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(plain, "/[^/]*$", "")
    # a micro-batch holds at most maxFilesPerTrigger files
    folders = [r[0] for r in batch.select(folder).distinct().collect()]
    if not folders:
        return batch.select("window_path", F.lit(None).cast("string").alias("window_metadata"))
    paths = [r[0] for r in batch.select("window_path").distinct().limit(NAMED_SIDECARS + 1).collect()]
    return read_window_metadata(spark, folders, paths if len(paths) <= NAMED_SIDECARS else None)


#: Buckets of the ledger.  Windows of one folder share a bucket, so a batch of few folders reads few of them.
BUCKETS = 1024
LEDGER_SCHEMA = "window_path string, node_id string, sensor_name string, query string, batch bigint, bucket int"


def _bucket() -> Column:
    folder = F.regexp_replace("window_path", "/[^/]*$", "")
    return F.pmod(F.xxhash64(folder), F.lit(BUCKETS)).cast("int").alias("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _kept(batch: DataFrame) -> DataFrame:
    """A batch whose files are opened once, and not in a task for every few small ones."""
    return batch.coalesce(4 * batch.sparkSession.sparkContext.defaultParallelism).persist()


@dataclass(frozen=True)
class _Extent:
    """What the steps of a batch ask of its paths, found in one pass."""

    buckets: list[int]
    rows: int
    mounted: bool


def _extent(batch: DataFrame) -> _Extent:
    elsewhere = F.max(~is_mounted(F.col("window_path")))
    found = batch.groupBy(_bucket()).agg(F.count("*").alias("n"), elsewhere.alias("elsewhere")).collect()
    return _Extent([r.bucket for r in found], sum(r.n for r in found), not any(r.elsewhere for r in found))


def _loaded(
    spark: SparkSession, batch: DataFrame, warehouse: str, query: str, number: int, extent: _Extent | None = None
) -> DataFrame:
    """What other batches, of whatever query, have loaded of the windows of this one.  Only their buckets are read."""
    path = f"{warehouse}/loaded_windows"
    if not _exists(spark, path):  # nothing was ever loaded
        return literal_table(spark, [], LEDGER_SCHEMA)
    extent = extent or _extent(batch)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path).where(F.col("bucket").isin(extent.buckets))
    others = ledger.where((F.col("query") != query) | (F.col("batch") != number))
    own = batch.select("window_path").distinct()
    return others.join(F.broadcast(own) if extent.rows <= SMALL_ROWS else broadcast_if_small(own), "window_path", "left_semi")


def ingest_batch(
    warehouse: str, metadata: Callable[[SparkSession], DataFrame] | None = None, query: str = "ingest"
):
    """Writer for one micro-batch of windows.  Dimensions get a snapshot per batch, facts a folder per query and batch.

    Batches that have ``window_metadata`` (see :func:`paired_windows`) bring it along; else ``metadata`` reads the
    table (window_path, window_metadata), and by default sidecar files are read.  ``query`` names the query whose
    batches these are: another query, or the same one with a new checkpoint, needs a name of its own.

    ``loaded_windows`` is the ledger: a row for each sensor of a window that was loaded, and one without node and
    sensor where that is all of it.  What is not in it can be replayed, a bad sensor too once its file is mended; its
    row is written last, so what a lost batch left behind is replaced when it runs again.  One query writes to a
    warehouse at a time.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = _kept(batch)
        try:
            extent = _extent(batch)
            # of a stream, a batch that only moves the watermark has nothing to load
            if number and not extent.rows and _exists(spark, f"{warehouse}/loaded_windows"):
                return
            loaded = cut_lineage(_loaded(spark, batch, warehouse, query, number, extent))
            _load(batch, number, loaded, extent.mounted, warehouse, metadata, query)
        finally:
            batch.unpersist()

    return handle


def _load(
    batch: DataFrame,
    number: int,
    loaded: DataFrame,
    mounted: bool,
    warehouse: str,
    metadata: Callable[[SparkSession], DataFrame] | None,
    query: str,
) -> None:
    """Loads what ``loaded`` doesn't have of a batch's windows."""
    spark = batch.sparkSession
    whole = loaded.where("node_id IS NULL AND sensor_name IS NULL").select("window_path").distinct()
    batch_left = join_with_nulls(batch, whole, ["window_path"], "left_anti")
    if "window_metadata" in batch.columns:
        described = batch_left
    elif metadata:
        described = batch_left.join(metadata(spark), "window_path", "left")
    else:
        described = _described(spark, batch_left, mounted)
    folder, writer = f"query={query}/batch={number}", f"{query}-{number}"
    table = lambda name, schema: sinks.read_table(spark, f"{warehouse}/{name}", schema, writer=writer)
    campaigns = table("measurement_campaign", CAMPAIGN_SCHEMA)
    known = table("configuration", CONFIGURATION_SCHEMA)
    result = ingest_windows(described, campaigns, known, loaded.where("node_id IS NOT NULL"))
    try:
        configurations = known.unionByName(result.new_configurations)
        # most take a second, whatever the batch: apart from one another they would be most of a small batch's time
        at_once(
            spark,
            lambda: sinks.write_sensor_data(result.sensor_data, f"{warehouse}/sensor_data", folder),
            lambda: sinks.write_rows(result.microphone_data, f"{warehouse}/microphone_data", folder),
            lambda: sinks.write_microphone_samples(result.microphone_samples, warehouse),
            lambda: sinks.write_rows(result.rejects, f"{warehouse}/rejects", folder),
            lambda: sinks.write_table(result.campaigns, f"{warehouse}/measurement_campaign", writer=writer),
            lambda: sinks.write_table(configurations, f"{warehouse}/configuration", writer=writer),
        )
        entries = result.accepted.select(*PART_KEYS, F.lit(query).alias("query"), F.lit(number).alias("batch"), _bucket())
        # a batch that runs again replaces its own partitions of the ledger, and no others
        entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "query", "batch"
        ).parquet(f"{warehouse}/loaded_windows")
    finally:
        result.staged.drop()


def ingest_stream(
    spark: SparkSession, windows_path: str, warehouse: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Loads windows as they appear.  The checkpoint's path names the query, so a new one can't replace older facts."""
    query = query_name(checkpoint)
    _list_in_few_tasks(spark)
    return for_each_batch(new_windows(spark, windows_path), ingest_batch(warehouse, query=query), checkpoint, trigger)


def _list_in_few_tasks(spark: SparkSession) -> None:
    """Files of a batch are looked up in some tasks a core, not in a task for each file; set in the session."""
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))


def query_name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def ingest_paired_stream(
    spark: SparkSession,
    windows_path: str,
    warehouse: str,
    checkpoint: str,
    delay: str = "1 hour",
    time: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Loads windows as soon as both they and their metadata are there; see :func:`paired_windows`."""
    """Loads windows as soon as both they and their metadata are there; see :func:`paired_windows`.

    A new checkpoint has at most STATE_PER_CORE state partitions a core, and keeps their number as any checkpoint does.
    """
    paired = paired_windows(new_windows(spark, windows_path), new_sidecars(spark, windows_path), delay, time)
    _list_in_few_tasks(spark)
    usual = spark.conf.get(_SHUFFLED)
    fewer = min(int(usual), STATE_PER_CORE * spark.sparkContext.defaultParallelism)
    spark.conf.set(_SHUFFLED, str(fewer))  # a query takes the session's settings along when it starts
    try:
        return for_each_batch(paired, ingest_batch(warehouse, query=query_name(checkpoint)), checkpoint, trigger)
    finally:
        spark.conf.set(_SHUFFLED, usual)


def replay(
    spark: SparkSession,
    windows_path: str,
    warehouse: str,
    query: str,
    metadata: Callable[[SparkSession], DataFrame] | None = None,
) -> int:
    """Sends what no other query has loaded of the stored windows; gives how many have nothing loaded.

    ``query`` is new for each replay; a replay that failed runs again under its name.
    """
    return replay_windows(read_windows(spark, windows_path), warehouse, query, metadata)


def replay_windows(
    stored: DataFrame, warehouse: str, query: str, metadata: Callable[[SparkSession], DataFrame] | None = None
) -> int:
    """:func:`replay` of windows that are read already."""
    spark = stored.sparkSession
    stored = _kept(stored)
    try:
        extent = _extent(stored)
        loaded = cut_lineage(_loaded(spark, stored, warehouse, query, 0, extent))
        missing = unsent_windows(stored, loaded.select("window_path").distinct()).select("window_path").distinct().count()
        _load(stored, 0, loaded, extent.mounted, warehouse, metadata, query)
    finally:
        stored.unpersist()
    return missing
