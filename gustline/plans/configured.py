"""Packets of many gateways to samples, each read as its own configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.functions import binary
from gustline.operators import clock, decode, routing, sensors
from gustline.operators.ordered import BLOCK_ROWS
from gustline.operators.setup import Setup, with_setup
from gustline.plans.telemetry import SAMPLE_COLUMNS, Telemetry


def classify_configured(packets: DataFrame, setup: Setup, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Aligned and routed packets, with what their configuration says of them."""
    placed = with_setup(packets, setup, block_rows)
    aligned = clock.align_packets(placed, setup.handles, F.col("endian"), block_rows=block_rows)
    return routing.classify(aligned, configured=setup.layouts)


def read_configured(
    packets: DataFrame, setup: Setup, block_rows: int = BLOCK_ROWS, classified: DataFrame | None = None
) -> Telemetry:
    """The whole reader, with byte order, initial handles, layouts, codes and periods out of the setup's tables.

    A packet table must not store ``node_ticks`` read in another byte order.  Each output is its own plan; to write
    several, store ``classify_configured`` first and pass it in.
    """
    if classified is None:
        classified = classify_configured(packets, setup, block_rows)
    endian = F.col("endian")
    events = routing.node_events(classified, setup.codes, endian=endian)
    is_sensor = F.col("route") == routing.SENSOR
    is_battery = (
        (F.col("route") == routing.REMOTE_INFO)
        & (F.col("packet_type_name") == "Remote Info Message")
        & (F.col("packet_length") >= routing.BATTERY_BYTES)
        & F.array_contains("battery_codes", binary.unsigned_int(F.col("packet"), 0, 1))
    )
    kept = ["session_id", "seq", "packet_origin", clock.CONFIGURATION, "packet_type_name", "timestamp", "packet_timestamp"]
    shape = ["endian", "channels", "samples", "packet", "route", "packet_length", "battery_codes"]
    unfolded = decode.decode_configured(
        classified.where(is_sensor | is_battery).select(*kept, *shape),
        decodable=is_sensor,
        instead=F.when(is_battery, decode.battery_sample(endian)),
    )
    timed = decode.sample_times(sensors.with_sensor_facts(unfolded, setup.sensors, ["period"]), "timestamp", "period")
    sync = events.where((F.col("event") == cat.TIME_SYNC_INFO) & F.col("reject_reason").isNull())
    base = ["session_id", "seq", "packet_origin", "timestamp", "packet", "endian"]
    rejected = ["session_id", "seq", "packet_origin", "packet_type", "packet_type_name", "packet_timestamp", "reject_reason"]
    ticks = classified.where(F.col("route") == routing.TICKS).select(*base, "packet_type_name")
    return Telemetry(
        samples=timed.withColumnRenamed("packet_origin", "node_id").select(*SAMPLE_COLUMNS),
        events=events.where(F.col("reject_reason").isNull()).select(
            "session_id", "seq", "packet_origin", "timestamp", "packet_type_name", "code", "event"
        ),
        time_sync=decode.decode_time_sync(sync.select(*base), endian).drop("endian"),
        ticks=decode.decode_ticks(ticks, endian).drop("endian"),
        rejects=routing.rejects(classified)
        .select(*rejected)
        .unionByName(events.where(F.col("reject_reason").isNotNull()).select(*rejected))
        .unionByName(decode.time_sync_faults(sync, endian).select(*rejected)),
    )
