"""Clock, naming, routing, decoding and framing on packets derived from the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_tables.adapters import (
    NODES,
    _hashes,
    packets_from_events,
    sensor_packets_from_events,
    spread,
    stage,
    table,
    write_files,
)
from driver_tables.registry import query
from gustline import catalogue as cat
from gustline.functions import binary
from gustline.operators import clock, decode, gaps, routing, sensors, setup
from gustline.plans import configured, telemetry
from gustline.session import cut_lineage, ensure_checkpoint_dir, literal_table
from gustline.sources import captures, configuration, ranges
from gustline.streaming import batches, keyed
from gustline.streaming import captures as open_captures

# small enough that the test tables span several blocks
BLOCK_ROWS = 1 << 14

# fixed values, written out once more so that the SQL does not lean on what it checks: packet names in handle order, and
# the meanings of codes that the default node handles can lead to
_NAMES = (
    "['Abs. baros', 'Diff. baros', 'Mic 0', 'Mic 1', 'IMU Accel', 'IMU Gyro', 'IMU Magnetometer', 'Analog1', 'Analog2', "
    "'Constat', 'Cmd Decline', 'Sleep State', 'Remote Info Message', 'Timestamp Packet 0', 'Timestamp Packet 1', "
    "'Local Info Message']"
)
_CODES = """('Mic 1', 1, 'Sensor reading from flash done'), ('Mic 1', 2, 'Flash erasing done'), ('Mic 1', 3, 'Sensor started'),
  ('Cmd Decline', 0, 'Bad block detection ongoing'), ('Cmd Decline', 1, 'Task already registered, cannot register again'),
  ('Cmd Decline', 2, 'Task is not registered, cannot de-register'), ('Cmd Decline', 3, 'Connection parameter update unfinished'),
  ('Cmd Decline', 4, 'Not ready to sleep'), ('Cmd Decline', 5, 'Not in sleep'),
  ('Sleep State', 0, 'Exiting sleep'), ('Sleep State', 1, 'Entering sleep'),
  ('Remote Info Message', 0, 'Battery info'), ('Remote Info Message', 1, 'Status feedback')"""
_BODY = " || ".join(f"md5(event_id || ':{i}')" for i in range(15))

PACKETS = f"""
raw AS (
  SELECT event_id AS seq, CAST(user_id % 6 AS VARCHAR) AS packet_origin, epoch_us(ts) / 1e6 AS packet_timestamp,
    CASE event_type WHEN 'signup' THEN 255
      WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 54 ELSE 52 END
      WHEN 'click' THEN CASE user_id % 3 WHEN 0 THEN 34 WHEN 1 THEN 36 ELSE 44 END
      WHEN 'view' THEN 38
      ELSE CASE user_id % 7 WHEN 0 THEN 56 WHEN 1 THEN 58 ELSE 42 END END AS packet_type,
    ((epoch_us(ts) // 1000) * 65536 // 1000 + user_id * 7) % 4294967296 AS clock_ticks,
    CASE WHEN user_id % 8 = 0 THEN 34 ELSE 32 END AS def_start,
    CASE WHEN value > 100 THEN 28 ELSE 30 END AS def_span,
    event_id, {_BODY} AS body
  FROM events),
packets AS (
  SELECT *, CASE packet_type WHEN 255 THEN 3 WHEN 56 THEN 1
      WHEN 58 THEN CASE WHEN event_id % 11 = 0 THEN 6 ELSE 13 END ELSE 244 END AS packet_length,
    CASE packet_type WHEN 255 THEN printf('%02x', def_start) || '00' || printf('%02x', def_start + def_span)
      WHEN 56 THEN printf('%02x', event_id % 3)
      WHEN 58 THEN '00' || substr(body, 1, CASE WHEN event_id % 11 = 0 THEN 10 ELSE 24 END)
      ELSE body || substr(printf('%08x', clock_ticks), 7, 2) || substr(printf('%08x', clock_ticks), 5, 2)
        || substr(printf('%08x', clock_ticks), 3, 2) || substr(printf('%08x', clock_ticks), 1, 2) END AS payload
  FROM raw)"""

ALIGNED = f"""{PACKETS},
started AS (
  SELECT *, coalesce(last_value(CASE WHEN packet_type = 255 THEN def_start END IGNORE NULLS) OVER w, 32) AS hs,
    count_if(packet_type = 255) OVER w AS seg
  FROM packets WINDOW w AS (PARTITION BY packet_origin ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
named AS (
  SELECT *, CASE WHEN packet_type <> 255 AND (packet_type - hs) % 2 = 0 AND packet_type - hs BETWEEN 2 AND 32
      THEN {_NAMES}[(packet_type - hs) // 2] END AS packet_type_name
  FROM started),
entered AS (
  SELECT *, CASE WHEN packet_type = 255 THEN packet_timestamp
      WHEN packet_type_name = 'Constat' AND packet_length = 244 THEN packet_timestamp - clock_ticks / 65536e0 END AS entry
  FROM named),
medians AS (
  SELECT * EXCLUDE (l), (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS m0
  FROM (SELECT *, CASE WHEN entry IS NOT NULL THEN list_sort(list(entry) OVER (PARTITION BY packet_origin, seg, entry IS NOT NULL
      ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) END AS l
  FROM entered)),
offsets AS (
  SELECT *, last_value(m0 IGNORE NULLS) OVER (PARTITION BY packet_origin, seg ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_offset
  FROM medians),
aligned AS (
  SELECT *, CASE WHEN packet_length = 244 THEN clock_ticks / 65536e0 + time_offset ELSE packet_timestamp END AS abs_time
  FROM offsets WHERE packet_type <> 255),
classified AS (
  SELECT *, CASE WHEN packet_type_name IS NULL THEN 'unknown_packet_type'
      WHEN abs_time IS NULL THEN 'no_time_offset'
      WHEN packet_type_name IN ('Abs. baros', 'Diff. baros', 'Mic 0', 'IMU Accel', 'IMU Gyro', 'IMU Magnetometer', 'Constat')
        THEN CASE WHEN packet_length < 240 THEN 'short_payload' END
      WHEN packet_type_name IN ('Analog1', 'Analog2') THEN 'unsupported_packet_type' END AS reject_reason
  FROM aligned)"""


def _aligned(spark, sf_dir):
    return clock.align_packets(packets_from_events(table(spark, sf_dir, "events")), block_rows=BLOCK_ROWS)


def _classified(spark, sf_dir):
    return routing.classify(_aligned(spark, sf_dir))


@query(
    f"""WITH events AS (SELECT * REPLACE (CASE event_type WHEN 'signup' THEN 'error' ELSE event_type END AS event_type) FROM events),
{PACKETS},
entered AS (SELECT *, CASE WHEN packet_type = 52 THEN packet_timestamp - clock_ticks / 65536e0 END AS entry FROM packets),
medians AS (SELECT * EXCLUDE (l), (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS m0 FROM (
  SELECT *, CASE WHEN entry IS NOT NULL THEN list_sort(list(entry) OVER (PARTITION BY packet_origin, entry IS NOT NULL
  ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) END AS l FROM entered)),
offsets AS (SELECT *, last_value(m0 IGNORE NULLS) OVER (PARTITION BY packet_origin ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_offset FROM medians)
SELECT packet_origin, seq, time_offset,
  CASE WHEN packet_length = 244 THEN clock_ticks / 65536e0 + time_offset ELSE packet_timestamp END AS abs_time
FROM offsets"""
)
def q_offset_median(spark, sf_dir):
    """Median clock offset of the last ten connection statistics, without reconnects."""
    # no event defines handles: those that would are connection statistics
    kind = F.when(F.col("event_type") == "signup", "error").otherwise(F.col("event_type"))
    packets = packets_from_events(table(spark, sf_dir, "events").withColumn("event_type", kind))
    aligned = clock.align_packets(packets, block_rows=BLOCK_ROWS)
    return aligned.select(
        "packet_origin", "seq", "time_offset", F.col("timestamp").alias("abs_time")
    )


@query(
    f"""WITH {ALIGNED}
SELECT packet_origin, seq, time_offset, abs_time FROM aligned
WHERE packet_type_name IS NOT NULL"""
)
def q_offset_reset(spark, sf_dir):
    """Offsets that start afresh at every reconnect."""
    return (
        _aligned(spark, sf_dir)
        .where("packet_type_name IS NOT NULL")
        .select(
            "packet_origin",
            "seq",
            "time_offset",
            F.col("timestamp").alias("abs_time"),
        )
    )


@query(f"WITH {ALIGNED} SELECT seq, packet_origin, packet_type, packet_type_name FROM aligned")
def q_handles_asof(spark, sf_dir):
    """Packet names under the latest handle definition."""
    return _aligned(spark, sf_dir).select("seq", "packet_origin", "packet_type", "packet_type_name")


@query(
    f"""WITH {PACKETS} SELECT seq, packet_origin, def_start AS handle_start, def_start + def_span AS handle_end,
  def_span <> 30 AS handle_error FROM packets WHERE packet_type = 255"""
)
def q_handle_definitions(spark, sf_dir):
    packets = packets_from_events(table(spark, sf_dir, "events"))
    return clock.handle_definitions(packets).select(
        "seq", "packet_origin", "handle_start", "handle_end", "handle_error"
    )


@query(
    f"""WITH {PACKETS} SELECT seq, packet_origin, clock_ticks AS node_ticks, clock_ticks / 65536e0 AS node_time
FROM packets WHERE packet_length = 244"""
)
def q_node_clock(spark, sf_dir):
    """Node clock read from the payload's last four bytes."""
    packets = packets_from_events(table(spark, sf_dir, "events")).drop("packet_length", "node_ticks")
    clocked = clock.with_control_columns(packets).where("packet_length = 244")
    return clocked.select(
        "seq", "packet_origin", "node_ticks", (F.col("node_ticks") / cat.NODE_CLOCK_HZ).alias("node_time")
    )


@query(
    """WITH p AS (SELECT event_id AS seq, CAST(user_id % 6 AS VARCHAR) AS packet_origin,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 65536 // 1000000 % 4294967296 AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY packet_origin ORDER BY seq) AS b FROM p),
w AS (SELECT *, sum(CASE WHEN b - t > 2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY packet_origin ORDER BY seq) AS wraps FROM l)
SELECT seq, packet_origin, CAST(t + wraps * 4294967296 AS BIGINT) AS node_ticks FROM w"""
)
def q_clock_unwrap(spark, sf_dir):
    """Node clock continued across its 18-hour wraps."""
    ticks = F.expr(
        "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) * 65536 div 1000000) % 4294967296"
    )
    packets = table(spark, sf_dir, "events").select(
        F.lit("events").alias("session_id"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 6).cast("string").alias("packet_origin"),
        ticks.alias("node_ticks"),
    )
    return clock.unwrap_ticks(packets, BLOCK_ROWS).select("seq", "packet_origin", "node_ticks")


@query(
    f"""WITH {ALIGNED}
SELECT coalesce(packet_type_name, 'none') AS packet_type_name,
  CASE WHEN reject_reason IS NOT NULL THEN 'reject' WHEN packet_type_name LIKE 'Timestamp%' THEN 'ticks'
    WHEN packet_type_name = 'Local Info Message' THEN 'local_info'
    WHEN packet_type_name IN ('Mic 1', 'Cmd Decline', 'Sleep State', 'Remote Info Message') THEN 'remote_info'
    ELSE 'sensor' END AS route,
  coalesce(reject_reason, 'none') AS reject_reason, count(*) AS packets
FROM classified GROUP BY ALL"""
)
def q_route_types(spark, sf_dir):
    """Packets per name, route and reject reason."""
    return (
        _classified(spark, sf_dir)
        .groupBy(
            F.coalesce("packet_type_name", F.lit("none")).alias("packet_type_name"),
            "route",
            F.coalesce("reject_reason", F.lit("none")).alias("reject_reason"),
        )
        .agg(F.count("*").alias("packets"))
    )


@query(
    f"""WITH {ALIGNED} SELECT seq, packet_origin, packet_type, reject_reason FROM classified
WHERE reject_reason IS NOT NULL"""
)
def q_rejects(spark, sf_dir):
    """Each rejected packet with its reason."""
    return routing.rejects(_classified(spark, sf_dir)).select("seq", "packet_origin", "packet_type", "reject_reason")


@query(
    f"""WITH {ALIGNED},
coded AS (SELECT *, CASE WHEN packet_type_name IN ('Cmd Decline', 'Sleep State')
      THEN CASE packet_length WHEN 1 THEN CAST('0x' || payload AS BIGINT) WHEN 6 THEN CAST('0x' || substr(payload, 11, 2)
        || substr(payload, 9, 2) || substr(payload, 7, 2) || substr(payload, 5, 2) || substr(payload, 3, 2) || substr(payload, 1, 2) AS BIGINT) END
      ELSE CAST('0x' || substr(payload, 1, 2) AS BIGINT) END AS code
  FROM classified WHERE reject_reason IS NULL
    AND packet_type_name IN ('Mic 1', 'Cmd Decline', 'Sleep State', 'Remote Info Message')),
codes AS (SELECT * FROM (VALUES {_CODES}) v(message, code, event))
SELECT seq, packet_origin, packet_type_name, coded.code AS code, event,
  CASE WHEN event IS NULL THEN 'unknown_code' WHEN event = 'Battery info' AND packet_length < 13 THEN 'short_payload' END AS reject_reason
FROM coded LEFT JOIN codes ON packet_type_name = message AND coded.code = codes.code"""
)
def q_enum_decode(spark, sf_dir):
    """Info messages with the meaning of their code."""
    events = routing.node_events(_classified(spark, sf_dir))
    return events.select("seq", "packet_origin", "packet_type_name", "code", "event", "reject_reason")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 250 >= 6 THEN NULL
  WHEN c_custkey % 7 = 0 THEN c_custkey % 5 + (1::BIGINT << (8 * (c_custkey % 250 + 1))::INTEGER) ELSE c_custkey % 5 END AS code FROM customer"""
)
def q_whole_codes(spark, sf_dir):
    """Codes that fill a payload of any length: high bytes of zero don't count, a value beyond 56 bits is none."""
    key = F.col("c_custkey")
    zeros = F.unhex(F.repeat(F.lit("00"), (key % 250).cast("int")))
    high = F.when(key % 7 == 0, F.lit(bytes([1]))).otherwise(F.lit(bytes([0])))
    payload = F.concat(binary.little_endian_bytes(key % 5, 1), zeros, high)
    return table(spark, sf_dir, "customer").select("c_custkey", binary.whole_unsigned(payload).alias("code"))


@query(
    """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 > 4 THEN 'unknown_time_sync_kind' ELSE 'short_payload' END AS reject_reason
FROM orders WHERE o_orderkey % 7 > 4 OR o_orderkey % 63 < CASE o_orderkey % 7 WHEN 0 THEN 18 WHEN 1 THEN 60 ELSE 61 END"""
)
def q_time_sync_rejects(spark, sf_dir):
    """Time synchronisation dumps that are cut off or of an unknown kind."""
    key = F.col("o_orderkey")
    words = F.unhex(F.repeat(F.lit("01020304"), (key % 63).cast("int")))
    packets = table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.concat(F.lit(bytes([1])), binary.little_endian_bytes(key % 7, 4), words).alias("packet")
    )
    return decode.time_sync_faults(packets).select("seq", "reject_reason")


def _unsigned(payload: str, offset: str, width: int, big: bool = False) -> str:
    order = range(width) if big else reversed(range(width))
    digits = " || ".join(f"substr({payload}, 2 * ({offset} + {k}) + 1, 2)" for k in order)
    return f"CAST('0x' || {digits} AS BIGINT)"


def _signed(payload: str, offset: str, width: int, big: bool = False) -> str:
    value = _unsigned(payload, offset, width, big)
    return f"(CASE WHEN {value} >= {1 << (8 * width - 1)} THEN {value} - {1 << (8 * width)} ELSE {value} END)"


def _decoded_sql(packet_name: str, sensor: str, samples: int, channels: int, value: str) -> str:
    return f"""SELECT seq, '{sensor}' AS sensor_name, CAST(s AS INTEGER) AS position, count(*) AS channels,
  CAST(arg_min(v, c) AS DOUBLE) AS first_value, CAST(arg_max(v, c) AS DOUBLE) AS last_value, CAST(sum(v * (c + 1)) AS DOUBLE) AS weighted
FROM (SELECT seq, s, c, {value} AS v FROM classified, range({samples}) a(s), range({channels}) b(c)
  WHERE reject_reason IS NULL AND packet_type_name = '{packet_name}')
GROUP BY seq, s"""


def _decoded(spark, sf_dir, names):
    kept = ["seq", "packet_origin", "packet_type_name", "packet"]
    packets = _classified(spark, sf_dir).where((F.col("route") == "sensor") & F.col("packet_type_name").isin(names))
    values = F.col("sensor_value")
    weighted = F.aggregate(
        F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda total, v: total + v
    )
    return decode.decode_packets(packets.select(*kept)).select(
        "seq",
        "sensor_name",
        "position",
        F.size(values).cast("bigint").alias("channels"),
        F.element_at(values, 1).alias("first_value"),
        F.element_at(values, -1).alias("last_value"),
        weighted.alias("weighted"),
    )


@query(
    f"WITH {ALIGNED} "
    + _decoded_sql("Abs. baros", "Baros_P", 1, 40, _unsigned("payload", "6 * c", 4))
    + " UNION ALL "
    + _decoded_sql("Abs. baros", "Baros_T", 1, 40, _signed("payload", "6 * c + 4", 2))
)
def q_decode_baros(spark, sf_dir):
    return _decoded(spark, sf_dir, ["Abs. baros"])


@query(
    f"WITH {ALIGNED} " + _decoded_sql("Diff. baros", "Diff_Baros", 24, 5, _unsigned("payload", "2 * (5 * s + c)", 2))
)
def q_decode_diff_baros(spark, sf_dir):
    return _decoded(spark, sf_dir, ["Diff. baros"])


@query(
    f"WITH {ALIGNED} "
    + _decoded_sql(
        "Mic 0",
        "Mics",
        8,
        10,
        _signed("payload", "3 * (20 * (s // 2) + 5 * (s % 2) + 10 * (c // 5) + c % 5)", 3, big=True),
    )
)
def q_decode_mics(spark, sf_dir):
    return _decoded(spark, sf_dir, ["Mic 0"])


@query(
    f"WITH {ALIGNED} "
    + " UNION ALL ".join(
        _decoded_sql(packet, sensor, 40, 3, _signed("payload", "6 * s + 2 * c", 2))
        for packet, sensor in [("IMU Accel", "Acc"), ("IMU Gyro", "Gyro")]
    )
)
def q_decode_imu(spark, sf_dir):
    return _decoded(spark, sf_dir, ["IMU Accel", "IMU Gyro", "IMU Magnetometer"])


_BITS = _unsigned("payload", "10 * s", 4)


@query(
    f"""WITH {ALIGNED},
words AS (SELECT seq, s, {_BITS} AS bits, {_signed("payload", "10 * s + 4", 1)} AS raw_rssi,
    {_signed("payload", "10 * s + 5", 1)} AS tx_power, {_unsigned("payload", "10 * s + 6", 4)} AS heap
  FROM classified, range(24) a(s) WHERE reject_reason IS NULL AND packet_type_name = 'Constat'),
parts AS (SELECT *, (bits >> 23) & 255 AS e, (bits & 8388607) / 8388608e0 AS m, CASE WHEN bits >= 2147483648 THEN -1e0 ELSE 1e0 END AS sign FROM words)
SELECT seq, CAST(s AS INTEGER) AS position, e = 255 AS not_finite,
  CASE WHEN e = 255 THEN NULL WHEN e = 0 THEN sign * m * pow(2e0, -126) ELSE sign * (1 + m) * pow(2e0, e - 127) END AS filtered_rssi,
  CAST(raw_rssi AS DOUBLE) AS raw_rssi, CAST(tx_power AS DOUBLE) AS tx_power, CAST(heap AS DOUBLE) AS heap FROM parts"""
)
def q_decode_constat(spark, sf_dir):
    """Connection statistics: a 32-bit float, two signed bytes and a word per sample."""
    kept = ["seq", "packet_origin", "packet_type_name", "packet"]
    packets = _classified(spark, sf_dir).where("route = 'sensor' AND packet_type_name = 'Constat'").select(*kept)
    value = lambda i: F.col("sensor_value")[i]
    not_finite = F.isnan(value(0)) | F.abs(value(0)).isin(float("inf"))
    return decode.decode_packets(packets).select(
        "seq",
        "position",
        not_finite.alias("not_finite"),
        F.when(~not_finite, value(0)).alias("filtered_rssi"),
        value(1).alias("raw_rssi"),
        value(2).alias("tx_power"),
        value(3).alias("heap"),
    )


@query(
    f"""WITH {ALIGNED}
SELECT seq, packet_origin, abs_time, {_unsigned("payload", "1", 4)} / 1e6 AS voltage,
  {_unsigned("payload", "5", 4)} / 100e0 AS cycles, {_unsigned("payload", "9", 4)} / 256e0 AS charge
FROM classified WHERE reject_reason IS NULL AND packet_type_name = 'Remote Info Message' AND packet_length >= 13
  AND substr(payload, 1, 2) = '00'"""
)
def q_battery(spark, sf_dir):
    events = routing.node_events(_classified(spark, sf_dir)).where(
        (F.col("event") == cat.BATTERY_INFO) & F.col("reject_reason").isNull()
    )
    value = F.col("sensor_value")
    return decode.decode_battery(events.select("seq", "packet_origin", "timestamp", "packet")).select(
        "seq",
        "packet_origin",
        F.col("timestamp").alias("abs_time"),
        value[0].alias("voltage"),
        value[1].alias("cycles"),
        value[2].alias("charge"),
    )


_SAMPLE_COUNTS = "(VALUES ('Abs. baros', 'Baros_P', 1, 1 / 100e0), ('Abs. baros', 'Baros_T', 1, 1 / 100e0), ('Diff. baros', 'Diff_Baros', 24, 1 / 1000e0), ('Mic 0', 'Mics', 8, 1 / 15625e0), ('IMU Accel', 'Acc', 40, 1 / 100e0), ('IMU Gyro', 'Gyro', 40, 1 / 100e0), ('IMU Magnetometer', 'Mag', 40, 1 / 12.5e0), ('Constat', 'Constat', 24, 45 / 1000e0)) k(packet_name, sensor_name, samples, period)"


@query(
    f"""WITH {ALIGNED},
stamped AS (SELECT packet_origin AS node_id, sensor_name, packet_timestamp, abs_time + s * CAST(period AS DOUBLE) AS sample_time
  FROM classified JOIN {_SAMPLE_COUNTS} ON packet_type_name = packet_name, range(40) r(s)
  WHERE reject_reason IS NULL AND s < samples
  UNION ALL
  SELECT packet_origin, 'battery_info', packet_timestamp, abs_time FROM classified
  WHERE reject_reason IS NULL AND packet_type_name = 'Remote Info Message' AND packet_length >= 13 AND substr(payload, 1, 2) = '00')
SELECT node_id, sensor_name, CAST(floor(packet_timestamp / 600) AS BIGINT) AS window_index, count(*) AS samples,
  min(sample_time) AS first_time, max(sample_time) AS last_time
FROM stamped GROUP BY ALL"""
)
def q_telemetry(spark, sf_dir):
    """The whole reader: packets to stamped samples, summed up per node, sensor and ten minutes."""
    packets = packets_from_events(table(spark, sf_dir, "events"))
    facts = sensors.default_node_sensors(spark, NODES)
    samples = telemetry.read_telemetry(packets, facts, block_rows=BLOCK_ROWS).samples
    return samples.groupBy(
        "node_id", "sensor_name", F.floor(F.col("packet_timestamp") / 600).alias("window_index")
    ).agg(
        F.count("*").alias("samples"),
        F.min("sample_time").alias("first_time"),
        F.max("sample_time").alias("last_time"),
    )


_SYNC_WORDS = " || ".join(f"md5(o_orderkey || ':{i}')" for i in range(16))


@query(
    f"""WITH p AS (SELECT o_orderkey AS seq, o_orderkey % 6 AS kind, {_SYNC_WORDS} AS h FROM orders),
w AS (SELECT seq, kind, i, {_unsigned("h", "4 * i", 4)} AS v FROM p, range(61) r(i)
  WHERE i < CASE WHEN kind = 0 THEN 18 WHEN kind = 1 THEN 60 WHEN kind <= 4 THEN 61 ELSE 0 END)
SELECT kind, CAST(i AS INTEGER) AS position, count(*) AS n,
  CAST(sum(CASE WHEN kind = 0 AND i >= 15 AND v >= 2147483648 THEN v - 4294967296 ELSE v END) AS BIGINT) AS total
FROM w GROUP BY ALL"""
)
def q_time_sync(spark, sf_dir):
    """Time synchronisation dumps, decoded to words and summed per kind and position."""
    kind = binary.little_endian_bytes(F.col("o_orderkey") % 6, 4)
    packets = stage(
        spread(table(spark, sf_dir, "orders")).select(
            F.col("o_orderkey").alias("seq"),
            F.concat(F.lit(bytes([1])), kind, _hashes("o_orderkey", 16)).alias("packet"),
        )
    )
    return (
        decode.decode_time_sync(packets)
        .groupBy("kind", "position")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


@query(
    f"""WITH p AS (SELECT o_orderkey AS seq, o_custkey % 3 AS device, {_SYNC_WORDS} AS h FROM orders WHERE o_orderkey % 6 = 1),
w AS (SELECT seq, device, i, {_unsigned("h", "4 * i", 4)} AS v FROM p, range(60) r(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq, i) AS rn FROM w)
SELECT seq, device, CAST(i AS INTEGER) AS position, v AS value FROM n WHERE rn <= 187"""
)
def q_time_sync_cut(spark, sf_dir):
    """The central dump's first 187 words per device."""
    kind = binary.little_endian_bytes(F.col("o_orderkey") % 6, 4)
    packets = stage(
        spread(table(spark, sf_dir, "orders")).select(
            F.col("o_orderkey").alias("seq"),
            (F.col("o_custkey") % 3).alias("device"),
            F.concat(F.lit(bytes([1])), kind, _hashes("o_orderkey", 16)).alias("packet"),
        )
    )
    words = decode.decode_time_sync(packets, central_limit=187, keys=["device"])
    return words.where("kind = 1").select("seq", "device", "position", "value")


@query(
    f"""WITH p AS (SELECT c_custkey AS seq, c_custkey % 9 AS n, md5(c_custkey || ':0') || md5(c_custkey || ':1') || md5(c_custkey || ':2') AS h FROM customer)
SELECT seq, CAST(i AS INTEGER) AS position, {_unsigned("h", "4 * i", 4)} AS tick FROM p, range(9) r(i) WHERE i < n"""
)
def q_ticks(spark, sf_dir):
    """Timestamp packets: whole words of payloads of different length, a trailing part word ignored."""
    size = (F.col("c_custkey") % 9 * 4 + 3).cast("int")
    packets = stage(
        spread(table(spark, sf_dir, "customer")).select(
            F.col("c_custkey").alias("seq"), F.substring(_hashes("c_custkey", 3), F.lit(1), size).alias("packet")
        )
    )
    return decode.decode_ticks(packets).select("seq", "position", "tick")


@query(
    """SELECT vec_id, CAST(i AS INTEGER) AS position, vec_id * 0.5e0 + i * 0.01e0 AS forward_time,
  vec_id * 0.5e0 - (64 - i) * 0.01e0 AS backward_time, CAST(embedding[i + 1] AS DOUBLE) AS value
FROM embeddings, range(64) r(i)"""
)
def q_sample_times(spark, sf_dir):
    """Sample times within a packet, counted forward from its start and backward from its end."""
    samples = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") * 0.5).alias("timestamp"),
        F.lit(0.01).alias("period"),
        F.size("embedding").alias("samples_in_packet"),
        F.posexplode("embedding").alias("position", "value"),
    )
    forward = decode.sample_times(samples, "timestamp", "period").withColumnRenamed("sample_time", "forward_time")
    both = decode.sample_times(forward, "timestamp", "period", anchor="end")
    return both.select(
        "vec_id",
        "position",
        "forward_time",
        F.col("sample_time").alias("backward_time"),
        F.col("value").cast("double").alias("value"),
    )


GAP_PACKETS = """
p AS (SELECT event_id AS seq, CAST(user_id % 6 AS VARCHAR) AS packet_origin,
  CASE event_type WHEN 'click' THEN 'Acc' WHEN 'view' THEN 'Mics' WHEN 'purchase' THEN 'Constat' WHEN 'error' THEN 'Baros_P' ELSE 'Door' END AS sensor_name,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 * 65536 // 1000 AS t FROM events),
n AS (SELECT *, row_number() OVER w AS k, lag(t) OVER w AS b FROM p WINDOW w AS (PARTITION BY packet_origin, sensor_name ORDER BY seq))"""
_STEP = "(40 * 100e0 * 65536)"
SLACK_SECONDS = 3000.0


@query(
    f"""WITH {GAP_PACKETS}
SELECT seq, packet_origin, sensor_name, t AS node_ticks, (t - b - {_STEP}) / 65536e0 AS gap_seconds FROM n"""
)
def q_gap_lag(spark, sf_dir):
    """Plain gaps between consecutive packets."""
    packets = sensor_packets_from_events(table(spark, sf_dir, "events"))
    expected = F.col("samples_in_packet") * F.col("period") * cat.NODE_CLOCK_HZ
    found = gaps.lag_gaps(packets.withColumn("expected", expected), gaps.PACKET_KEYS, "node_ticks", "expected", BLOCK_ROWS)
    return found.select(
        "seq",
        "packet_origin",
        "sensor_name",
        "node_ticks",
        (F.col("gap") / cat.NODE_CLOCK_HZ).alias("gap_seconds"),
    )


LOST = f"""{GAP_PACKETS},
f AS (
  SELECT n.*, CAST(t AS DOUBLE) AS ideal, false AS lost, CAST(NULL AS DOUBLE) AS gap_ms FROM n WHERE k = 1
  UNION ALL
  SELECT n.*, CASE WHEN n.sensor_name <> 'Mics' AND abs(f.ideal + {_STEP} - n.t) > {SLACK_SECONDS} * 65536 THEN CAST(n.t AS DOUBLE) ELSE f.ideal + {_STEP} END,
    n.sensor_name <> 'Mics' AND abs(f.ideal + {_STEP} - n.t) > {SLACK_SECONDS} * 65536,
    CASE WHEN n.sensor_name <> 'Mics' AND abs(f.ideal + {_STEP} - n.t) > {SLACK_SECONDS} * 65536 THEN (n.t - f.ideal - {_STEP}) / 65536e0 * 1000 END
  FROM f JOIN n ON n.packet_origin = f.packet_origin AND n.sensor_name = f.sensor_name AND n.k = f.k + 1)"""


def _lost(spark, sf_dir):
    packets = sensor_packets_from_events(table(spark, sf_dir, "events"))
    return gaps.lost_sets(packets, SLACK_SECONDS, BLOCK_ROWS)


@query(
    f"""WITH RECURSIVE {LOST}
SELECT seq, packet_origin, sensor_name, k AS packet_ordinal, k = 1 AS is_first, lost, round(gap_ms, 3) AS gap_ms,
  round(ideal / 65536e0, 4) AS ideal_time FROM f"""
)
def q_gap_fold(spark, sf_dir):
    """Lost packets against a re-anchored ideal clock."""
    return _lost(spark, sf_dir).select(
        "seq",
        "packet_origin",
        "sensor_name",
        "packet_ordinal",
        "is_first",
        "lost",
        F.round("gap_ms", 3).alias("gap_ms"),
        F.round("ideal_time", 4).alias("ideal_time"),
    )


@query(
    f"""WITH RECURSIVE {LOST}
SELECT packet_origin, sensor_name, count(*) AS packets, CAST(count_if(lost) AS BIGINT) AS lost_packets,
  round(coalesce(sum(gap_ms), 0), 2) AS total_gap_ms FROM f GROUP BY ALL"""
)
def q_gap_report(spark, sf_dir):
    """Losses per node and sensor."""
    report = gaps.gap_report(_lost(spark, sf_dir))
    return report.select(
        "packet_origin", "sensor_name", "packets", "lost_packets", F.round("total_gap_ms", 2).alias("total_gap_ms")
    )


MAX_DRIFT = 0.5
_MEASURED = "((n.t - n.b) / 40e0 / 65536e0)"


@query(
    f"""WITH RECURSIVE {GAP_PACKETS},
f AS (
  SELECT n.*, 100e0 AS period, false AS lost FROM n WHERE k = 1
  UNION ALL
  SELECT n.*, CASE WHEN abs({_MEASURED} - f.period) < {MAX_DRIFT} * f.period THEN {_MEASURED} ELSE f.period END,
    NOT abs({_MEASURED} - f.period) < {MAX_DRIFT} * f.period
  FROM f JOIN n ON n.packet_origin = f.packet_origin AND n.sensor_name = f.sensor_name AND n.k = f.k + 1)
SELECT seq, packet_origin, sensor_name, k = 1 AS is_first, round((t - b) / 40e0 / 65536e0, 6) AS measured_period,
  round(period, 6) AS current_period, lost, CASE WHEN lost THEN round((t - b) / 65536e0 * 1000, 3) END AS gap_ms FROM f"""
)
def q_period_drift(spark, sf_dir):
    """Sample period that follows measured ones close to it."""
    packets = sensor_packets_from_events(table(spark, sf_dir, "events"))
    return gaps.period_drift(packets, MAX_DRIFT, BLOCK_ROWS).select(
        "seq",
        "packet_origin",
        "sensor_name",
        "is_first",
        F.round("measured_period", 6).alias("measured_period"),
        F.round("current_period", 6).alias("current_period"),
        "lost",
        F.round("gap_ms", 3).alias("gap_ms"),
    )


@query(
    f"""WITH {GAP_PACKETS}
SELECT seq, packet_origin, sensor_name, k AS packet_ordinal,
  round(first_value(t) OVER (PARTITION BY packet_origin, sensor_name ORDER BY seq) / 65536e0 + (k - 1) * 40 * 100e0, 4) AS free_time FROM n"""
)
def q_free_running(spark, sf_dir):
    """Clock that only counts packets."""
    packets = sensor_packets_from_events(table(spark, sf_dir, "events"))
    timed = clock.free_running_times(packets, gaps.PACKET_KEYS, "samples_in_packet", "period", BLOCK_ROWS)
    return timed.select(
        "seq", "packet_origin", "sensor_name", "packet_ordinal", F.round("free_time", 4).alias("free_time")
    )


@query(
    f"WITH {PACKETS} SELECT packet_origin, packet_type, count(*) AS packets FROM packets GROUP BY ALL"
)
def q_progress(spark, sf_dir):
    return routing.packet_progress(packets_from_events(table(spark, sf_dir, "events")))


@query(
    f"""WITH {PACKETS}, n AS (SELECT seq, packet_origin, row_number() OVER (PARTITION BY packet_origin ORDER BY seq) AS packets_read FROM packets)
SELECT seq, packet_origin, packets_read FROM n WHERE packets_read % 200 = 0"""
)
def q_progress_markers(spark, sf_dir):
    packets = packets_from_events(table(spark, sf_dir, "events"))
    return routing.progress_markers(packets, clock.KEYS).select("seq", "packet_origin", "packets_read")


PACKETS_PER_FILE = 500


def capture_files(events):
    """Capture files of the events' packets: noise in between, and packets that run over from file to file."""
    packets = packets_from_events(events)
    origin = F.col("packet_origin").cast("int") + cat.PACKET_KEY_OFFSET
    noise = F.when(F.col("seq") % 13 == 0, F.lit("0701FF")).otherwise("")
    header = F.hex(
        F.concat(*[F.unhex(F.lpad(F.hex(c), 2, "0")) for c in (origin, F.col("packet_type"), F.col("packet_length"))])
    )
    # the last packet of a file leaves all but five characters (two and a half bytes' worth, rounded) to the next
    whole = F.concat(noise, header, F.hex("packet"))
    kept = F.when(F.col("seq") % PACKETS_PER_FILE == PACKETS_PER_FILE - 1, F.length(noise) + 4).otherwise(F.length(whole))
    file = F.floor(F.col("seq") / PACKETS_PER_FILE)
    pieces = packets.select(
        "seq",
        F.explode(
            F.array(
                F.struct(file.alias("file"), F.lit(0).alias("part"), whole.substr(F.lit(1), kept).alias("digits")),
                F.struct((file + 1).alias("file"), F.lit(1).alias("part"), whole.substr(kept + 1, F.lit(1000)).alias("digits")),
            )
        ).alias("piece"),
    ).select("seq", "piece.*")
    return (
        pieces.where("digits <> ''")
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "part", "digits"))).alias("pieces"))
        .select(
            F.lit("events").alias("session_id"),
            F.format_string("capture-%08d.bin", "file").alias("path"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("file")).alias("modificationTime"),
            F.unhex(F.array_join("pieces.digits", "")).alias("content"),
        )
    )


@query(
    f"""WITH {PACKETS} SELECT packet_origin, packet_type, CAST(packet_length AS INTEGER) AS frame_length, upper(payload) AS payload,
  count(*) AS n FROM packets GROUP BY ALL"""
)
def q_frame_captures(spark, sf_dir):
    """Capture files back to the packets they were made of."""
    files = capture_files(table(spark, sf_dir, "events"))
    framed = captures.frame_captures(files, captures.leading_bytes(spark, NODES))
    return framed.groupBy(
        "packet_origin", "packet_type", "frame_length", F.hex("packet").alias("payload")
    ).agg(F.count("*").alias("n"))


SECONDS_PER_BYTE = 1e-4
RANGE_BYTES = 1 << 18


@query(
    f"""WITH {PACKETS},
placed AS (SELECT *, seq // {PACKETS_PER_FILE} AS file,
    sum(CASE WHEN seq % 13 = 0 THEN 6 ELSE 3 END + packet_length) OVER (ORDER BY seq) AS upto FROM packets),
files AS (SELECT file, coalesce(max(upto - packet_length - 1) FILTER (seq % {PACKETS_PER_FILE} = {PACKETS_PER_FILE - 1}), max(upto)) AS upto
  FROM placed GROUP BY file)
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, packet_origin, packet_type, CAST(packet_length AS INTEGER) AS frame_length,
  md5(upper(payload)) AS payload_md5, round(1704067200e0 + file + (p.upto - f.since) * {SECONDS_PER_BYTE}, 4) AS packet_timestamp
FROM placed p JOIN (SELECT file, lag(upto, 1, 0) OVER (ORDER BY file) AS since FROM files) f USING (file)"""
)
def q_frame_stream(spark, sf_dir):
    """One open session whose files grow over three micro-batches, followed in byte ranges."""
    root = f"{ensure_checkpoint_dir(spark)}/followed-{uuid.uuid4().hex}"
    files = cut_lineage(capture_files(table(spark, sf_dir, "events")))
    size = F.octet_length("content").cast("bigint")
    ends = F.sum("size").over(Window.partitionBy("session_id").orderBy("path"))
    sizes = cut_lineage(files.select("session_id", "path", size.alias("size")).withColumn("upto", ends))
    total = sizes.agg(F.max("upto")).first()[0] or 0
    origins = captures.leading_bytes(spark, NODES)
    write = lambda packets, number: packets.write.mode("overwrite").parquet(f"{root}/packets/batch={number}")
    follow = open_captures.frame_stream(f"{root}/state", write, origins, SECONDS_PER_BYTE)
    for third in (1, 2, 3):
        seen, before = (F.least("size", F.lit(total * n // 3) - (F.col("upto") - F.col("size"))) for n in (third, third - 1))
        grown = sizes.withColumn("seen", seen).where(F.col("seen") > F.greatest(before, F.lit(0)))
        shown = files.join(grown.select("path", "seen"), "path")
        named = F.concat_ws("/", "session_id", F.regexp_replace("path", r"capture-(\d+)", r"capture-$1-at"))
        second = F.unix_seconds("modificationTime").cast("string")
        path = F.regexp_replace(named, r"-at\.bin$", F.concat(F.lit("-at"), second, F.lit(".bin")))
        write_files(shown.select(path.alias("path"), F.substring("content", F.lit(1), F.col("seen").cast("int")).alias("content")), f"{root}/captures")
        stream = ranges.stream_ranges(spark, f"{root}/captures", RANGE_BYTES, r"-at(\d+)\.bin$", "start")
        batches.for_each_batch(stream, follow, f"{root}/checkpoint").awaitTermination()
    packets = spark.read.parquet(f"{root}/packets")
    cut_off = open_captures.close_sessions(
        spark, f"{root}/state", origins, packets.select("session_id").distinct(), 1 << 20, SECONDS_PER_BYTE
    )
    every = packets.select(*cut_off.columns).unionByName(cut_off)
    return every.select(
        "seq",
        "packet_origin",
        "packet_type",
        "frame_length",
        F.md5(F.hex("packet").cast("binary")).alias("payload_md5"),
        F.round("packet_timestamp", 4).alias("packet_timestamp"),
    )


_SOUTH_HANDLES = {34: "Diff. baros", 36: "Abs. baros", 38: "Mic 0", 42: "IMU Gyro", 52: "Constat", 54: "Cmd Decline", 56: "Sleep State", 58: "Remote Info Message"}
GATEWAYS = {
    "north": {
        "gateway": {"endian": "little"},
        "nodes": {str(n): {} for n in range(6)} | {"0": {"baros_freq": 50, "number_of_sensors": cat.NUMBER_OF_SENSORS | {"Baros_P": 20, "Baros_T": 20}}},
        "measurement_campaign": {},
    },
    "south": {
        "gateway": {"endian": "big"},
        "nodes": {str(n): {} for n in range(6)}
        | {
            "0": {
                "acc_freq": 25,
                "gyro_freq": 25,
                "diff_baros_freq": 500,
                "samples_per_packet": cat.SAMPLES_PER_PACKET | {"Acc": 20},
                "initial_node_handles": {str(k): v for k, v in _SOUTH_HANDLES.items()},
                "sleep_state": {"0": "Waking", "2": "Dozing"},
                "remote_info_type": {"0": "Status feedback", "1": "Battery info"},
            }
        },
        "measurement_campaign": {},
    },
}
_DEFAULTS_AGAIN = "SELECT number, name FROM (VALUES " + ", ".join(
    f"({34 + 2 * i}, '{name}')"
    for i, name in enumerate(
        ["Abs. baros", "Diff. baros", "Mic 0", "Mic 1", "IMU Accel", "IMU Gyro", "IMU Magnetometer", "Analog1", "Analog2",
         "Constat", "Cmd Decline", "Sleep State", "Remote Info Message", "Timestamp Packet 0", "Timestamp Packet 1",
         "Local Info Message"]
    )
) + ") n(number, name)"


def _either(offset: str, width: int, read) -> str:
    return f"(CASE WHEN big THEN {read('payload', offset, width, True)} ELSE {read('payload', offset, width)} END)"


#: Sensors of each packet name: samples, seconds between them, and the last channel, with what the gateways change.
_CONFIGURED_SENSORS = f"""
  SELECT seq, 'Baros_P' AS sensor_name, 1 AS samples, CASE WHEN special AND NOT big THEN 1 / 50e0 ELSE 1 / 100e0 END AS period, 0 AS s,
    {_either("6 * (CASE WHEN special AND NOT big THEN 19 ELSE 39 END)", 4, _unsigned)} AS v FROM good WHERE packet_type_name = 'Abs. baros'
  UNION ALL SELECT seq, 'Baros_T', 1, CASE WHEN special AND NOT big THEN 1 / 50e0 ELSE 1 / 100e0 END, 0,
    {_either("6 * (CASE WHEN special AND NOT big THEN 19 ELSE 39 END) + 4", 2, _signed)} FROM good WHERE packet_type_name = 'Abs. baros'
  UNION ALL SELECT seq, 'Diff_Baros', 24, CASE WHEN special AND big THEN 1 / 500e0 ELSE 1 / 1000e0 END, s,
    {_either("2 * (5 * s + 4)", 2, _unsigned)} FROM good, range(24) r(s) WHERE packet_type_name = 'Diff. baros'
  UNION ALL SELECT seq, 'Mics', 8, 1 / 15625e0, s, {_signed("payload", "3 * (20 * (s // 2) + 5 * (s % 2) + 14)", 3, True)}
    FROM good, range(8) r(s) WHERE packet_type_name = 'Mic 0'
  UNION ALL SELECT seq, CASE packet_type_name WHEN 'IMU Accel' THEN 'Acc' WHEN 'IMU Gyro' THEN 'Gyro' ELSE 'Mag' END, 40,
    CASE WHEN packet_type_name = 'IMU Magnetometer' THEN 1 / 12.5e0 WHEN special AND big THEN 1 / 25e0 ELSE 1 / 100e0 END, s,
    {_either("6 * s + 4", 2, _signed)} FROM good, range(40) r(s)
    WHERE packet_type_name IN ('IMU Accel', 'IMU Gyro', 'IMU Magnetometer') AND s < CASE WHEN special AND big THEN 20 ELSE 40 END
  UNION ALL SELECT seq, 'Constat', 24, 45 / 1000e0, s, {_either("10 * s + 6", 4, _unsigned)} FROM good, range(24) r(s)
    WHERE packet_type_name = 'Constat'
  UNION ALL SELECT seq, 'battery_info', 1, 3600e0, 0, {_either("9", 4, _unsigned)} / 256e0 FROM good
    WHERE packet_type_name = 'Remote Info Message' AND packet_length >= 13
      AND substr(payload, 1, 2) = CASE WHEN special AND big THEN '01' ELSE '00' END"""


@query(
    f"""WITH {PACKETS},
placed AS (SELECT * EXCLUDE (clock_ticks), CASE WHEN seq % 2 = 0 THEN 'north' ELSE 'south' END AS session_id,
    seq % 2 = 1 AND seq >= 40 AS big, packet_origin = '0' AS special, CASE WHEN packet_length = 244 THEN
      CASE WHEN seq % 2 = 1 AND seq >= 40 THEN {_unsigned("payload", "240", 4, True)} ELSE {_unsigned("payload", "240", 4)} END END AS ticks
  FROM packets),
started AS (SELECT *, last_value(CASE WHEN packet_type = 255 THEN def_start END IGNORE NULLS) OVER w AS hs, count_if(packet_type = 255) OVER w AS seg
  FROM placed WINDOW w AS (PARTITION BY session_id, packet_origin ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
named AS (SELECT p.*, CASE WHEN packet_type = 255 THEN NULL WHEN hs IS NOT NULL THEN d.name
      WHEN special AND big THEN CASE packet_type {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _SOUTH_HANDLES.items())} END ELSE i.name END AS packet_type_name
  FROM started p LEFT JOIN ({_DEFAULTS_AGAIN}) d ON d.number = p.packet_type - p.hs + 32 LEFT JOIN ({_DEFAULTS_AGAIN}) i ON i.number = p.packet_type),
entered AS (SELECT *, CASE WHEN packet_type = 255 THEN packet_timestamp
      WHEN packet_type_name = 'Constat' AND packet_length = 244 THEN packet_timestamp - ticks / 65536e0 END AS entry FROM named),
medians AS (SELECT * EXCLUDE (l), (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS m0
  FROM (SELECT *, CASE WHEN entry IS NOT NULL THEN list_sort(list(entry) OVER (PARTITION BY session_id, packet_origin, seg, entry IS NOT NULL
      ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) END AS l FROM entered)),
offsets AS (SELECT *, last_value(m0 IGNORE NULLS) OVER (PARTITION BY session_id, packet_origin, seg ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_offset FROM medians),
good AS (SELECT *, CASE WHEN packet_length = 244 THEN ticks / 65536e0 + time_offset ELSE packet_timestamp END AS abs_time
  FROM offsets WHERE packet_type <> 255 AND packet_type_name IS NOT NULL AND (packet_length <> 244 OR time_offset IS NOT NULL)
    AND (packet_length >= 240 OR packet_type_name IN ('Remote Info Message', 'Sleep State', 'Cmd Decline', 'Mic 1'))),
codes AS (SELECT session_id, packet_origin, CASE
      WHEN packet_type_name = 'Sleep State' AND packet_length = 1 THEN CASE WHEN special AND big THEN CASE substr(payload, 1, 2) WHEN '00' THEN 'Waking' WHEN '02' THEN 'Dozing' END
        ELSE CASE substr(payload, 1, 2) WHEN '00' THEN 'Exiting sleep' WHEN '01' THEN 'Entering sleep' END END
      WHEN packet_type_name = 'Remote Info Message' AND substr(payload, 1, 2) IN ('00', '01') THEN
        CASE WHEN (substr(payload, 1, 2) = '00') = (special AND big) THEN 'Status feedback' WHEN packet_length >= 13 THEN 'Battery info' END END AS event
  FROM good),
samples AS ({_CONFIGURED_SENSORS})
SELECT session_id, packet_origin AS node_id, sensor_name AS name, count(*) AS n, sum(v)::DOUBLE AS total,
  round(min(abs_time + s * period), 3) AS first_time, round(max(abs_time + s * period), 3) AS last_time
FROM samples JOIN good USING (seq) GROUP BY ALL
UNION ALL SELECT session_id, packet_origin, event, count(*), NULL, NULL, NULL FROM codes WHERE event IS NOT NULL GROUP BY ALL"""
)
def q_configured_telemetry(spark, sf_dir):
    """Two gateways in one job, whose nodes "0" differ in rates, counts, handles, codes and byte order.

    The south gateway runs with the north's configuration until its fortieth event.
    """
    session = F.when(F.col("seq") % 2 == 0, "north").otherwise("south")
    packets = packets_from_events(table(spark, sf_dir, "events")).drop("node_ticks").withColumn("session_id", session)
    documents = [(name, json.dumps(document)) for name, document in GATEWAYS.items()]
    loaded = configuration.load(literal_table(spark, documents, "path string, document string"))
    places = [("north", 0, "north"), ("south", 0, "north"), ("south", 40, "south")]
    assigned = literal_table(spark, places, "session_id string, from_seq bigint, path string")
    telemetry_of = configured.read_configured(packets, setup.setup_of(loaded, assigned), BLOCK_ROWS)
    last = F.element_at("sensor_value", -1)
    samples = telemetry_of.samples.groupBy("session_id", "node_id", F.col("sensor_name").alias("name")).agg(
        F.count("*").alias("n"),
        F.sum(last).alias("total"),
        F.round(F.min("sample_time"), 3).alias("first_time"),
        F.round(F.max("sample_time"), 3).alias("last_time"),
    )
    named = telemetry_of.events.where(F.col("packet_type_name").isin("Sleep State", "Remote Info Message"))
    events = named.groupBy("session_id", F.col("packet_origin").alias("node_id"), F.col("event").alias("name")).agg(F.count("*").alias("n"))
    return samples.unionByName(events, allowMissingColumns=True)


_SESSIONS = 8
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(
    f"""WITH RECURSIVE size AS (SELECT (max(event_id) + {_SESSIONS}) // {_SESSIONS} AS l, max(event_id) AS latest FROM events),
{GAP_PACKETS},
m AS (SELECT p.*, seq // l AS session, l, latest, row_number() OVER w AS k, lag(t) OVER w AS b FROM p, size
  WINDOW w AS (PARTITION BY seq // l, packet_origin, sensor_name ORDER BY seq)),
f AS (
  SELECT m.*, 100e0 AS period, false AS lost FROM m WHERE k = 1
  UNION ALL
  SELECT m.*, CASE WHEN abs((m.t - m.b) / 40e0 / 65536e0 - f.period) < {MAX_DRIFT} * f.period THEN (m.t - m.b) / 40e0 / 65536e0 ELSE f.period END,
    NOT abs((m.t - m.b) / 40e0 / 65536e0 - f.period) < {MAX_DRIFT} * f.period
  FROM f JOIN m ON m.session = f.session AND m.packet_origin = f.packet_origin AND m.sensor_name = f.sensor_name AND m.k = f.k + 1)
SELECT 's' || session AS session_id, packet_origin, sensor_name, seq, round(period, 6) AS current_period, lost, NULL AS packets, NULL AS lost_packets,
  NULL AS total_gap_ms, NULL AS latest_losses FROM f
UNION ALL
SELECT 's' || session, packet_origin, sensor_name, NULL, round(arg_max(period, seq), 6), NULL, count(*), CAST(count_if(lost) AS BIGINT),
  round(coalesce(sum((t - b) / 65536e0 * 1000) FILTER (lost), 0), 2),
  coalesce(array_to_string(list_slice(list(seq ORDER BY seq) FILTER (lost), -5, -1), ','), '')
FROM f GROUP BY session, packet_origin, sensor_name, l, latest HAVING max(seq) + l + 20.5 <= latest - 10"""
)
def q_stream_drift(spark, sf_dir):
    """Adaptive periods in Spark's state store over three runs of a stream, and the totals of sessions that have ended."""
    packets = sensor_packets_from_events(table(spark, sf_dir, "events"))
    latest = packets.agg(F.max("seq")).first()[0] or 0
    length = (latest + _SESSIONS) // _SESSIONS
    session = F.concat(F.lit("s"), F.floor(F.col("seq") / length).cast("string"))
    packets = packets.withColumn("session_id", session).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    base = f"{ensure_checkpoint_dir(spark)}/drift-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, _ROCKS)
    try:
        for i in range(3):
            low, high = (latest + 1) * i // 3, (latest + 1) * (i + 1) // 3
            packets.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(packets.schema).parquet(f"{base}/in")
            found = keyed.drift_with_end(stream, "at", length + 20.5, MAX_DRIFT, 10.0)
            write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
            batches.for_each_batch(found, write, f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{base}/out").select(
        *gaps.PACKET_KEYS,
        "seq",
        F.round("current_period", 6).alias("current_period"),
        "lost",
        "packets",
        "lost_packets",
        F.round("total_gap_ms", 2).alias("total_gap_ms"),
        F.array_join("latest_losses", ",").alias("latest_losses"),
    )
