"""Where each aligned packet goes, and why some go nowhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.functions import binary
from gustline.operators.clock import ORIGIN_KEYS
from gustline.operators.decode import Layout, layouts, min_bytes
from gustline.session import broadcast_if_small, literal_table

SENSOR, TICKS, REMOTE_INFO, LOCAL_INFO, REJECT = "sensor", "ticks", "remote_info", "local_info", "reject"
UNSUPPORTED = "unsupported"
BATTERY_BYTES = 13


def _destinations(spark: SparkSession, needed: dict) -> DataFrame:
    """Packet names and where they go; a few dozen rows."""
    rows = {name: (UNSUPPORTED, 0) for name in cat.UNSUPPORTED_PACKETS}
    rows |= {name: (TICKS, 0) for name in cat.TICK_PACKETS}
    rows |= {name: (REMOTE_INFO, 1) for name in cat.REMOTE_INFO_PACKETS}
    rows |= {cat.LOCAL_INFO_PACKET: (LOCAL_INFO, 1)}
    rows |= {name: (SENSOR, size) for (name, node), size in needed.items() if node is None}
    return literal_table(
        spark,
        [(name, route, size) for name, (route, size) in sorted(rows.items())],
        "packet_type_name string, _route string, _needed int",
    )


def classify(
    aligned: DataFrame, chosen: Sequence[Layout] | None = None, configured: DataFrame | None = None
) -> DataFrame:
    """Adds ``route`` and ``reject_reason``.  A bad packet is a row with a reason; it never fails the job.

    A payload is short if its layout needs more, or if the capture ended inside it.  ``configured`` (ORIGIN_KEYS,
    packet_type_name, channels, samples, needed) has the layouts of each configured node, whose shape comes along.
    """
    spark = aligned.sparkSession
    needed = min_bytes(list(chosen) if chosen is not None else layouts())
    placed = aligned.join(F.broadcast(_destinations(spark, needed)), "packet_type_name", "left")
    size = F.col("_needed")
    overrides = [(name, node, n) for (name, node), n in needed.items() if node is not None]
    if configured is not None:
        shapes = broadcast_if_small(configured.withColumnRenamed("needed", "_own"))
        placed = placed.join(shapes, [*ORIGIN_KEYS, "packet_type_name"], "left")
        size = F.coalesce("_own", "_needed")
    elif overrides:
        own = literal_table(spark, overrides, "packet_type_name string, packet_origin string, _own int")
        placed = placed.join(F.broadcast(own), ["packet_type_name", "packet_origin"], "left")
        size = F.coalesce("_own", "_needed")
    short = F.col("packet_length") < size
    if "frame_length" in aligned.columns:
        short = short | (F.col("packet_length") < F.coalesce("frame_length", F.lit(0)))
    reason = (
        F.when(F.col("packet_type_name").isNull(), "unknown_packet_type")
        .when(F.col("timestamp").isNull(), "no_time_offset")
        .when(F.col("_route").isNull(), "unprocessed_packet_type")
        .when(F.col("_route") == UNSUPPORTED, "unsupported_packet_type")
        .when(short, "short_payload")
    )
    return placed.withColumn("reject_reason", reason).select(
        *aligned.columns,
        *(["channels", "samples"] if configured is not None else []),
        F.when(F.col("reject_reason").isNull(), F.col("_route")).otherwise(REJECT).alias("route"),
        "reject_reason",
    )


def rejects(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("route") == REJECT)


def default_codes() -> dict[str, dict[int, str]]:
    return {
        "Mic 1": cat.FLASH_STATES,
        "Cmd Decline": cat.DECLINE_REASONS,
        "Sleep State": cat.SLEEP_STATES,
        "Remote Info Message": cat.REMOTE_INFO_TYPES,
        cat.LOCAL_INFO_PACKET: cat.LOCAL_INFO_TYPES,
    }


def _code_table(spark: SparkSession, codes: dict[str, dict[int, str]], node_codes: dict) -> DataFrame:
    """Code tables as rows; a code is one byte or a short number, so a few thousand rows at most."""
    rows = [("", m, c, text) for m, table in codes.items() for c, text in table.items()]
    rows += [(n, m, c, t) for n, own in node_codes.items() for m, table in own.items() for c, t in table.items()]
    return literal_table(spark, rows, "_owner string, packet_type_name string, code bigint, event string")


def node_events(
    classified: DataFrame,
    codes: dict[str, dict[int, str]] | DataFrame | None = None,
    node_codes: dict[str, dict[str, dict[int, str]]] | None = None,
    endian: str | Column = "little",
) -> DataFrame:
    """Info messages with their meaning; unknown codes and cut-off battery records carry a reject reason.

    ``node_codes`` replaces whole code tables for single origins.  ``codes`` as a table (ORIGIN_KEYS,
    packet_type_name, code, event) has those of each configured node.
    """
    message, payload = F.col("packet_type_name"), F.col("packet")
    whole = message.isin("Cmd Decline", "Sleep State")
    code = F.when(whole, binary.whole_unsigned(payload, endian)).otherwise(binary.unsigned_int(payload, 0, 1, endian))
    replaced = F.lit(False)
    for node, tables in (node_codes or {}).items():
        replaced = replaced | ((F.col("packet_origin") == node) & message.isin(sorted(tables)))
    coded = classified.where(F.col("route").isin(REMOTE_INFO, LOCAL_INFO)).select(
        *[c for c in classified.columns if c != "reject_reason"],
        code.alias("code"),
        F.when(replaced, F.col("packet_origin")).otherwise("").alias("_owner"),
    )
    if isinstance(codes, DataFrame):
        table, own = broadcast_if_small(codes), [*ORIGIN_KEYS, "packet_type_name", "code"]
    else:
        table = F.broadcast(_code_table(classified.sparkSession, codes or default_codes(), node_codes or {}))
        own = ["_owner", "packet_type_name", "code"]
    cut_off = (F.col("event") == cat.BATTERY_INFO) & (F.col("packet_length") < BATTERY_BYTES)
    return (
        coded.join(table, own, "left")
        .drop("_owner")
        .withColumn(
            "reject_reason",
            F.when(F.col("event").isNull(), "unknown_code").when(cut_off, "short_payload"),
        )
    )


def is_battery_record(endian: str = "little", remote_types: dict[int, str] | None = None) -> Column:
    """Whole battery records among the info messages of :func:`classify`."""
    codes = [code for code, name in (remote_types or cat.REMOTE_INFO_TYPES).items() if name == cat.BATTERY_INFO]
    return (
        (F.col("route") == REMOTE_INFO)
        & (F.col("packet_type_name") == "Remote Info Message")
        & (F.col("packet_length") >= BATTERY_BYTES)
        & binary.unsigned_int(F.col("packet"), 0, 1, endian).isin(codes)
    )


def packet_progress(packets: DataFrame, keys: Sequence[str] = ("packet_origin", "packet_type")) -> DataFrame:
    """Packets read so far per key."""
    return packets.groupBy(*keys).agg(F.count("*").alias("packets"))


def progress_markers(packets: DataFrame, keys: Sequence[str], every: int = 200) -> DataFrame:
    """Every ``every``-th packet of a key, in arrival order."""
    from gustline.operators.ordered import ordinals

    return ordinals(packets, list(keys), "seq", "packets_read").where(F.col("packets_read") % every == 0)
