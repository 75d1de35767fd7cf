"""What was configured where and when, as tables that packets are joined with.

One job may read many gateways, and the same node id means another node in each;
a gateway may also be reconfigured within a session.  A packet therefore finds
its configuration as of its place in the session, and everything that depends on
it (byte order, initial handles, layouts, message codes, periods, constants) by
equality on that configuration and its origin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.operators import decode
from gustline.operators.clock import CONFIGURATION, ORIGIN_KEYS
from gustline.operators.ordered import BLOCK_ROWS, asof_join
from gustline.session import broadcast_if_small, cut_lineage, literal_table, refuse_duplicates
from gustline.sources.configuration import Configuration

_MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Setup:
    """Validity (session_id, from_seq, configuration_path), and per configuration and origin what follows from it."""

    validity: DataFrame
    origins: DataFrame
    handles: DataFrame
    layouts: DataFrame
    codes: DataFrame
    sensors: DataFrame


def _numbered(column: str, name: str, value: str) -> Column:
    return F.explode(column).alias(name, value)


def _layout_rows(nodes: DataFrame) -> DataFrame:
    """Counts and shortest payload of every packet type of every node."""
    pairs = F.explode(F.create_map(*[F.lit(x) for pair in decode.SHAPED_BY.items() for x in pair]))
    shaped = nodes.select(*ORIGIN_KEYS, "number_of_sensors", "samples_per_packet", pairs.alias("packet_type_name", "_sensor"))
    count = lambda given, table: F.coalesce(
        F.try_element_at(given, F.col("_sensor")),
        F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("_sensor")),
    )
    counted = shaped.select(
        *ORIGIN_KEYS,
        "packet_type_name",
        count("number_of_sensors", cat.NUMBER_OF_SENSORS).alias("channels"),
        count("samples_per_packet", cat.SAMPLES_PER_PACKET).alias("samples"),
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = zip(pdf["packet_type_name"], pdf["channels"], pdf["samples"])
            needed = [max(x.min_bytes for x in decode.shaped_layouts(n, int(c), int(s), "little")) for n, c, s in shapes]
            yield pdf.assign(needed=needed)

    return counted.mapInPandas(
        measure, f"{CONFIGURATION} string, packet_origin string, packet_type_name string, channels int, samples int, needed int"
    )


def setup_of(configuration: Configuration, assignments: DataFrame) -> Setup:
    """Tables of the configurations that sessions ran with.

    ``assignments``: session_id, from_seq (the first packet that a configuration holds for) and path.  Two
    configurations for one place, or two nodes or sensors of one name in one configuration, are refused.
    """
    refuse_duplicates(assignments, ["session_id", "from_seq"], "assignments")
    refuse_duplicates(configuration.gateways, ["path"], "gateways")
    refuse_duplicates(configuration.nodes, ["path", "node_id"], "nodes")
    refuse_duplicates(configuration.node_sensors, ["path", "node_id", "sensor_name"], "node sensors")
    spark = assignments.sparkSession
    gateways = configuration.gateways.withColumnRenamed("path", CONFIGURATION)
    base = gateways.withColumn("packet_origin", F.lit(cat.BASE_STATION_ID))
    nodes = configuration.nodes.withColumnsRenamed({"path": CONFIGURATION, "node_id": "packet_origin"})
    battery = F.transform(
        F.map_keys(F.map_filter("remote_info_type", lambda _, v: v == cat.BATTERY_INFO)), lambda k: k.cast("bigint")
    )
    origins = nodes.join(gateways.select(CONFIGURATION, "endian"), CONFIGURATION).select(
        *ORIGIN_KEYS, "endian", battery.alias("battery_codes")
    )
    no_codes = F.array().cast("array<bigint>").alias("battery_codes")
    handles = nodes.select(*ORIGIN_KEYS, _numbered("initial_node_handles", "packet_type", "packet_type_name"))
    handles = handles.unionByName(
        base.select(*ORIGIN_KEYS, _numbered("initial_gateway_handles", "packet_type", "packet_type_name"))
    )

    def coded(table: DataFrame, column: str, message: str) -> DataFrame:
        rows = table.select(*ORIGIN_KEYS, F.lit(message).alias("packet_type_name"), _numbered(column, "code", "event"))
        return rows.withColumn("code", F.col("code").cast("bigint"))

    # no configuration changes what the flash memory reports
    flash = literal_table(spark, [("Mic 1", c, e) for c, e in sorted(cat.FLASH_STATES.items())], "packet_type_name string, code bigint, event string")
    codes = (
        coded(nodes, "decline_reason", "Cmd Decline")
        .unionByName(coded(nodes, "sleep_state", "Sleep State"))
        .unionByName(coded(nodes, "remote_info_type", "Remote Info Message"))
        .unionByName(coded(base, "local_info_types", cat.LOCAL_INFO_PACKET))
        .unionByName(nodes.select(*ORIGIN_KEYS, F.lit("Mic 1").alias("packet_type_name")).join(F.broadcast(flash), "packet_type_name").select(*ORIGIN_KEYS, "packet_type_name", "code", "event"))
    )
    kept = lambda df: cut_lineage(df)  # noqa: E731  parsed once, joined by several steps
    return Setup(
        validity=kept(assignments.select("session_id", "from_seq", F.col("path").alias(CONFIGURATION))),
        origins=kept(origins.unionByName(base.select(*ORIGIN_KEYS, "endian", no_codes))),
        handles=kept(handles.withColumn("packet_type", F.col("packet_type").cast("int"))),
        layouts=kept(_layout_rows(nodes)),
        codes=kept(codes),
        sensors=kept(configuration.node_sensors),
    )


def with_setup(packets: DataFrame, setup: Setup, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``configuration_path``, ``endian`` and ``battery_codes`` as configured when the packet arrived.

    They are null where no configuration holds or it has no such origin; such packets get no name and are rejected.
    """
    until = F.lead("from_seq").over(Window.partitionBy("session_id").orderBy("from_seq"))
    spans = setup.validity.withColumn("_until", until)
    if spans.limit(_MOST_BROADCAST + 1).count() <= _MOST_BROADCAST:
        ranges = F.broadcast(spans.withColumnRenamed("session_id", "_session"))
        after = (F.col("seq") >= F.col("from_seq")) & (F.col("_until").isNull() | (F.col("seq") < F.col("_until")))
        placed = packets.join(ranges, F.col("session_id").eqNullSafe(F.col("_session")) & after, "left")
        placed = placed.drop("_session", "from_seq", "_until")
    else:
        starts = setup.validity.withColumnRenamed("from_seq", "seq")
        placed = asof_join(packets, starts, ["session_id"], "seq", [CONFIGURATION], block_rows)
    return placed.join(broadcast_if_small(setup.origins), ORIGIN_KEYS, "left").select(
        *packets.columns, CONFIGURATION, "endian", "battery_codes"
    )
