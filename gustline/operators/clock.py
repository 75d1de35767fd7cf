"""Clock alignment and packet naming: which packet is it, and when was it measured.

Both depend on what arrived before, per (session, origin): the latest handle
definition names the packet types, and the median of up to ten clock offsets
turns node ticks into wall time.  Only control packets (handle definitions and
connection statistics, a tiny share of the traffic) change that state, so the
state is worked out on those alone and then looked up as-of by every packet.
Packets with their payloads are shuffled exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.functions import binary
from gustline.operators.ordered import BLOCK_ROWS, asof_join, last_rows, ordinals, rolling, running_totals
from gustline.session import broadcast_if_small, cut_lineage, literal_table

KEYS = ["session_id", "packet_origin"]
#: What names a configured node, beside the session: the same node differs between configurations.
CONFIGURATION = "configuration_path"
ORIGIN_KEYS = [CONFIGURATION, "packet_origin"]
_NO_DEFINITION = -1
# names of handle maps that belong to no single origin
_DEFAULT, _DEFINED = "(default)", "(defined)"
CONTROL_COLUMNS = [*KEYS, "seq", "definition_seq", "handle_start", "entry"]


@dataclass(frozen=True)
class HandleMaps:
    """Packet type numbers known before the first handle definition, per origin.

    ``nodes`` overrides single origins; any other origin but the base station
    uses ``default``.
    """

    default: dict[int, str] | None = None
    gateway: dict[int, str] | None = None
    nodes: dict[str, dict[int, str]] | None = None

    def tables(self) -> dict[str | None, dict[int, str]]:
        return {
            None: self.default or cat.DEFAULT_NODE_HANDLES,
            cat.BASE_STATION_ID: self.gateway or cat.DEFAULT_GATEWAY_HANDLES,
            **(self.nodes or {}),
        }

    def constat_types(self) -> list[int]:
        return sorted({t for table in self.tables().values() for t, name in table.items() if name == cat.CONSTAT})


def _handle_table(spark: SparkSession, handles: HandleMaps) -> DataFrame:
    """All maps as rows (map, number, name); bounded by 256 type numbers per map."""
    rows = [(_DEFINED, 2 * (i + 1), name) for i, name in enumerate(cat.PACKET_NAMES)]
    for origin, table in handles.tables().items():
        rows += [(_DEFAULT if origin is None else origin, number, name) for number, name in sorted(table.items())]
    return literal_table(spark, rows, "_map string, _number int, packet_type_name string")


def _with_configured_name(packets: DataFrame, handles: DataFrame) -> DataFrame:
    distance = (F.col("packet_type") - F.col("handle_start")).cast("int")
    defined = literal_table(
        packets.sparkSession, [(2 * (i + 1), name) for i, name in enumerate(cat.PACKET_NAMES)], "_number int, _defined string"
    )
    own = handles.select(*ORIGIN_KEYS, "packet_type", F.col("packet_type_name").alias("_initial"))
    named = packets.withColumn("_number", distance).join(F.broadcast(defined), "_number", "left")
    named = named.join(broadcast_if_small(own), [*ORIGIN_KEYS, "packet_type"], "left")
    name = F.when(F.col("handle_start").isNotNull(), F.col("_defined")).otherwise(F.col("_initial"))
    return named.select(*packets.columns, name.alias("packet_type_name"))


def with_type_name(packets: DataFrame, handles: HandleMaps | DataFrame = HandleMaps()) -> DataFrame:
    """Adds ``packet_type_name``, null for unknown types.

    Under a handle definition the names sit at even distances above its start;
    before the first one, the origin's initial map applies.  With ``handles`` as
    a table (ORIGIN_KEYS, packet_type, packet_type_name) that is the map of the
    configuration that each packet names.
    """
    if isinstance(handles, DataFrame):
        return _with_configured_name(packets, handles)
    own = sorted(origin for origin in handles.tables() if origin is not None)
    initial = F.when(F.col("packet_origin").isin(own), F.col("packet_origin")).otherwise(_DEFAULT)
    defined = F.col("handle_start").isNotNull()
    keyed = packets.select(
        "*",
        F.when(defined, _DEFINED).otherwise(initial).alias("_map"),
        F.when(defined, F.col("packet_type") - F.col("handle_start"))
        .otherwise(F.col("packet_type"))
        .cast("int")
        .alias("_number"),
    )
    table = F.broadcast(_handle_table(packets.sparkSession, handles))
    return keyed.join(table, ["_map", "_number"], "left").drop("_map", "_number")


def node_ticks(endian: str | Column = "little") -> Column:
    """Node clock of full-length packets, in 2^-16 s; null for other lengths."""
    ticks = binary.unsigned_int(F.col("packet"), cat.NODE_CLOCK_OFFSET, 4, endian)
    return F.when(F.octet_length("packet") == cat.FULL_PACKET_BYTES, ticks)


def with_control_columns(packets: DataFrame, endian: str | Column = "little") -> DataFrame:
    """Adds ``packet_length`` and ``node_ticks`` unless the table already stores them.

    A packet table that stores them lets the control passes skip the payload column.
    """
    if "packet_length" not in packets.columns:
        packets = packets.withColumn("packet_length", F.octet_length("packet"))
    if "node_ticks" not in packets.columns:
        packets = packets.withColumn("node_ticks", node_ticks(endian))
    return packets


def unwrap_ticks(packets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Optional: continues the 32-bit node clock across its wrap (every 65,536 s) by adding 2^32 per wrap seen.

    Wraps are counted per origin among full-length packets; a handle definition does not restart the count.
    """
    from gustline.operators.ordered import previous_row

    clocked = previous_row(
        packets.where(F.col("node_ticks").isNotNull()).select(*KEYS, "seq", "node_ticks"),
        KEYS, "seq", {"node_ticks": "_before"}, block_rows,
    )
    wrapped = F.when(F.col("_before") - F.col("node_ticks") > F.lit(1 << 31), F.lit(1)).otherwise(F.lit(0))
    wraps = running_totals(clocked, KEYS, "seq", {"_wraps": wrapped}, block_rows).select(*KEYS, "seq", "_wraps")
    changes = asof_join(packets, wraps, KEYS, "seq", ["_wraps"], block_rows)
    return changes.withColumn(
        "node_ticks", F.col("node_ticks") + F.coalesce("_wraps", F.lit(0)) * F.lit(1 << 32)
    ).drop("_wraps")


def handle_definitions(packets: DataFrame, endian: str | Column = "little") -> DataFrame:
    """Start and end handle of every (re)connect; ``handle_error`` flags an unexpected span."""
    start = binary.unsigned_int(F.col("packet"), 0, 1, endian)
    end = binary.unsigned_int(F.col("packet"), 2, 1, endian)
    return packets.where(F.col("packet_type") == cat.HANDLE_DEFINITION_TYPE).select(
        *KEYS,
        "seq",
        F.coalesce(start, F.lit(0)).alias("handle_start"),
        F.coalesce(end, F.lit(0)).alias("handle_end"),
        (F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0)) != cat.EXPECTED_HANDLE_SPAN).alias("handle_error"),
        "packet_timestamp",
    )


def control_entries(
    packets: DataFrame,
    handles: HandleMaps | DataFrame = HandleMaps(),
    endian: str | Column = "little",
    carried: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Clock entries in arrival order: one per handle definition and per full-length connection statistic.

    ``carried`` is what :func:`control_state` kept of earlier packets; its rows
    are returned too, ahead of the new ones.
    """
    packets = with_control_columns(packets, endian)
    fresh = handle_definitions(packets, endian).select(
        *KEYS, "seq", F.col("seq").alias("definition_seq"), "handle_start", F.col("packet_timestamp").alias("entry")
    )
    definitions = cut_lineage(fresh)
    if carried is None:
        known = definitions
    else:
        remembered = carried.where(F.col("definition_seq") != _NO_DEFINITION)
        known = remembered.groupBy(*KEYS).agg(
            F.max("definition_seq").alias("definition_seq"), F.max_by("handle_start", "seq").alias("handle_start")
        )
        known = known.withColumn("seq", F.col("definition_seq")).unionByName(definitions.drop("entry"))

    # a packet type is one byte, so this side has at most 256 rows
    possible = known.select((F.col("handle_start") + cat.CONSTAT_HANDLE_DISTANCE).cast("int").alias("packet_type"))
    if isinstance(handles, DataFrame):
        initial = handles.where(F.col("packet_type_name") == cat.CONSTAT).select("packet_type")
    else:
        initial = literal_table(packets.sparkSession, [(t,) for t in handles.constat_types()], "packet_type int")
    named_by = [c for c in ORIGIN_KEYS if c not in KEYS and c in packets.columns]
    candidates = (
        packets.where((F.col("packet_type") != cat.HANDLE_DEFINITION_TYPE) & F.col("node_ticks").isNotNull())
        .select(*KEYS, *named_by, "seq", "packet_type", "packet_timestamp", "node_ticks")
        .join(F.broadcast(possible.unionByName(initial).distinct()), "packet_type", "left_semi")
    )
    placed = asof_join(candidates, known, KEYS, "seq", ["definition_seq", "handle_start"], block_rows)
    named = with_type_name(placed, handles).where(F.col("packet_type_name") == cat.CONSTAT)
    constats = named.select(
        *KEYS,
        "seq",
        F.coalesce("definition_seq", F.lit(_NO_DEFINITION)).alias("definition_seq"),
        "handle_start",
        (F.col("packet_timestamp") - F.col("node_ticks") / F.lit(cat.NODE_CLOCK_HZ)).alias("entry"),
    )
    entries = definitions.unionByName(constats)
    return entries if carried is None else entries.unionByName(carried.select(*CONTROL_COLUMNS))


def offset_timeline(entries: DataFrame, history: int = cat.CLOCK_HISTORY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Median of the latest ``history`` entries since the last (re)connect, at each entry."""
    return rolling(
        entries,
        [*KEYS, "definition_seq"],
        "seq",
        history,
        {"time_offset": F.percentile("entry", 0.5)},
        block_rows,
    )


def control_state(
    entries: DataFrame, history: int = cat.CLOCK_HISTORY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All that later packets need of earlier ones: the last entries since the last (re)connect, per origin."""
    latest = last_rows(entries, KEYS, "seq", history, block_rows)
    current = latest.groupBy(*KEYS).agg(F.max("definition_seq").alias("definition_seq"))
    return latest.join(current, [*KEYS, "definition_seq"], "left_semi").select(*CONTROL_COLUMNS)


def align_with_entries(
    packets: DataFrame,
    entries: DataFrame,
    handles: HandleMaps | DataFrame = HandleMaps(),
    endian: str | Column = "little",
    history: int = cat.CLOCK_HISTORY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    timeline = offset_timeline(entries, history, block_rows)
    data = with_control_columns(packets, endian).where(F.col("packet_type") != cat.HANDLE_DEFINITION_TYPE)
    aligned = asof_join(data, timeline, KEYS, "seq", ["handle_start", "time_offset"], block_rows)
    on_node_clock = F.col("node_ticks") / F.lit(cat.NODE_CLOCK_HZ) + F.col("time_offset")
    full = F.col("packet_length") == cat.FULL_PACKET_BYTES
    return with_type_name(aligned, handles).select(
        *data.columns,
        "handle_start",
        "time_offset",
        "packet_type_name",
        F.when(full, on_node_clock).otherwise(F.col("packet_timestamp")).alias("timestamp"),
    )


def align_packets(
    packets: DataFrame,
    handles: HandleMaps | DataFrame = HandleMaps(),
    endian: str | Column = "little",
    history: int = cat.CLOCK_HISTORY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Packets with ``packet_type_name`` (null if unknown) and absolute ``timestamp`` (null without an offset).

    ``seq`` is the arrival order, unique within the session.  Handle definitions themselves are consumed.
    """
    entries = cut_lineage(control_entries(packets, handles, endian, None, block_rows))
    return align_with_entries(packets, entries, handles, endian, history, block_rows)


def free_running_times(
    packets: DataFrame, keys: list[str], samples: str, period: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Clock of sensors that run free: first node time plus whole packets; never re-anchored (seconds)."""
    starts = packets.groupBy(*keys).agg(F.min("seq").alias("seq"), F.min_by("node_ticks", "seq").alias("first_ticks"))
    numbered = ordinals(packets, keys, "seq", "packet_ordinal", block_rows)
    placed = asof_join(numbered, starts, keys, "seq", ["first_ticks"], block_rows)
    return placed.withColumn(
        "free_time",
        F.col("first_ticks") / F.lit(cat.NODE_CLOCK_HZ)
        + (F.col("packet_ordinal") - 1) * F.col(samples) * F.col(period),
    )
