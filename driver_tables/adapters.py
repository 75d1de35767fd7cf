"""Telemetry inputs derived from the supplied tables, whole table by whole table.

The tables hold no packets, so each event becomes one: its user picks the node,
its type the packet type, hashes of its id the payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import binary
from gustline.session import ensure_checkpoint_dir

NODES = [str(n) for n in range(6)]
SENSOR_OF_EVENT = {"click": "Acc", "view": "Mics", "purchase": "Constat", "error": "Baros_P", "signup": "Door"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(packets: DataFrame) -> DataFrame:
    """Stores derived packets as the packet table a real run would read, in the shared folder."""
    spark = packets.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/packets-{uuid.uuid4().hex}"
    packets.write.parquet(path)
    return spark.read.schema(packets.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where a small file would leave most of them idle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def micros(column: str = "ts") -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _byte(value: Column) -> Column:
    return binary.little_endian_bytes(value.cast("bigint"), 1)


def _hashes(identifier: str, count: int) -> Column:
    """Sixteen pseudo-random bytes per count, the same for the same identifier."""
    pieces = f"transform(sequence(0, {count - 1}), i -> md5(cast(concat({identifier}, ':', i) AS binary)))"
    return F.expr(f"unhex(array_join({pieces}, ''))")


def packets_from_events(events: DataFrame) -> DataFrame:
    """One packet per event; event_id is the arrival order.  Control columns are stored as a packet table would."""
    user, kind, event = F.col("user_id"), F.col("event_type"), F.col("event_id")
    start = F.when(user % 8 == 0, 34).otherwise(32)
    end = start + F.when(F.col("value") > 100, 28).otherwise(30)
    packet_type = (
        F.when(kind == "signup", 255)
        .when(kind == "error", F.when(user % 5 == 0, 54).otherwise(52))
        .when(kind == "click", F.when(user % 3 == 0, 34).when(user % 3 == 1, 36).otherwise(44))
        .when(kind == "view", 38)
        .otherwise(F.when(user % 7 == 0, 56).when(user % 7 == 1, 58).otherwise(42))
    )
    # integer division: the product stays below 2^63 but not below 2^53
    ticks = F.expr(
        "((timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000) * 65536 div 1000"
        " + user_id * 7) % 4294967296"
    )
    packet = (
        F.when(F.col("packet_type") == 255, F.concat(_byte(start), _byte(F.lit(0)), _byte(end)))
        .when(F.col("packet_type") == 56, _byte(event % 3))
        .when(
            F.col("packet_type") == 58,
            F.concat(_byte(F.lit(0)), F.substring(_hashes("event_id", 1), F.lit(1), F.when(event % 11 == 0, 5).otherwise(12))),
        )
        .otherwise(F.concat(_hashes("event_id", 15), binary.little_endian_bytes(F.col("ticks"), 4)))
    )
    length = (
        F.when(F.col("packet_type") == 255, 3)
        .when(F.col("packet_type") == 56, 1)
        .when(F.col("packet_type") == 58, F.when(event % 11 == 0, 6).otherwise(13))
        .otherwise(244)
    )
    return stage(
        spread(events).withColumn("packet_type", packet_type)
        .withColumn("ticks", ticks)
        .select(
            F.lit("events").alias("session_id"),
            event.alias("seq"),
            (user % 6).cast("string").alias("packet_origin"),
            "packet_type",
            packet.alias("packet"),
            (micros() / 1e6).alias("packet_timestamp"),
            length.alias("packet_length"),
            F.when(length == 244, F.col("ticks")).alias("node_ticks"),
        )
    )


def write_files(files: DataFrame, root: str) -> None:
    """Stores ``files`` (path below the root, content) as they are, from the tasks that hold them."""
    plain = root if "://" in root else f"file://{root.removeprefix('file:')}"

    def store(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(plain)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                system.create_dir(f"{folder}/{path}".rsplit("/", 1)[0])
                with system.open_output_stream(f"{folder}/{path}") as out:
                    out.write(bytes(content))
            yield pdf[["path"]]

    files.select("path", "content").mapInPandas(store, "path string").write.format("noop").mode("overwrite").save()


def samples_from_events(events: DataFrame) -> DataFrame:
    """One two-channel sample per event, in ten-minute windows of its session."""
    sensor = F.element_at(F.create_map(*[F.lit(x) for pair in SENSOR_OF_EVENT.items() for x in pair]), F.col("event_type"))
    return events.select(
        F.lit("events").alias("session_id"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 6).cast("string").alias("node_id"),
        sensor.alias("sensor_name"),
        F.lit(0).alias("position"),
        (micros() / 1e6).alias("sample_time"),
        (micros() / 1e6).alias("packet_timestamp"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("sensor_value"),
    )


def sensor_packets_from_events(events: DataFrame) -> DataFrame:
    """Clocked sensor packets of known spacing, for the gap operators."""
    return events.select(
        F.lit("events").alias("session_id"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 6).cast("string").alias("packet_origin"),
        F.element_at(
            F.create_map(*[F.lit(x) for pair in SENSOR_OF_EVENT.items() for x in pair]), F.col("event_type")
        ).alias("sensor_name"),
        F.expr(
            "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000) * 65536 div 1000"
        ).alias("node_ticks"),
        F.lit(40).alias("samples_in_packet"),
        F.lit(100.0).alias("period"),
    )
