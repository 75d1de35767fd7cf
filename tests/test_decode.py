import struct

import pytest
from pyspark.sql import functions as F

from gustline.operators import decode

NAMES = ["Abs. baros", "Diff. baros", "Mic 0", "IMU Accel", "IMU Gyro", "IMU Magnetometer", "Constat", "Analog Vbat"]


@pytest.fixture(scope="module")
def packets(spark, golden_payload):
    rows = [("0", n, bytearray(golden_payload)) for n in NAMES + ["Mic 0"]]
    return spark.createDataFrame(rows, "packet_origin string, packet_type_name string, packet binary")


@pytest.fixture(scope="module")
def decoded(packets):
    return {(r.sensor_name, r.position): r.sensor_value for r in decode.decode_packets(packets).collect()}


# --- fixed values: decoded by an independent program from the golden payload ---
GOLDEN = [
    ("Baros_P", 0, 0, 2052403211),
    ("Baros_P", 0, 39, 1277625053),
    ("Baros_T", 0, 0, -15201),
    ("Baros_T", 0, 39, -27023),
    ("Diff_Baros", 0, 0, 12299),
    ("Diff_Baros", 23, 4, 38513),
    ("Mics", 0, 0, 733269),
    ("Mics", 1, 0, 3562368),
    ("Mics", 0, 5, 6391467),
    ("Mics", 7, 9, 5009814),
    ("Acc", 0, 0, 12299),
    ("Acc", 39, 2, -27023),
    ("Constat", 0, 0, 2.767334145096703e35),
    ("Constat", 0, 1, -97),
    ("Constat", 0, 2, -60),
    ("Constat", 0, 3, 1479741161),
    ("Constat", 23, 3, 2524007463),
]


@pytest.mark.parametrize("sensor,sample,channel,value", GOLDEN)
def test_golden_values(decoded, sensor, sample, channel, value):
    assert decoded[sensor, sample][channel] == value


def test_shapes(decoded):
    shapes = {}
    for (sensor, _), values in decoded.items():
        count, channels = shapes.get(sensor, (0, len(values)))
        shapes[sensor] = (count + 1, channels)
    assert shapes == {
        "Baros_P": (1, 40), "Baros_T": (1, 40), "Diff_Baros": (24, 5), "Mics": (8, 10), "Acc": (40, 3),
        "Gyro": (40, 3), "Mag": (40, 3), "Constat": (24, 4), "Analog Vbat": (60, 2),
    }
    assert decoded["Analog Vbat", 0][1] == 0.0


def test_native_decode_agrees(packets):
    arrow = decode.decode_packets(packets.dropDuplicates(["packet_type_name"]))
    for layout in decode.layouts():
        if layout.sensor_name in ("Gyro", "Mag"):
            continue
        native = decode.decode_natively(packets.dropDuplicates(["packet_type_name"]), layout)
        same = arrow.where(F.col("sensor_name") == layout.sensor_name).select(native.columns)
        assert sorted(map(str, native.collect())) == sorted(map(str, same.collect()))


def test_big_endian_gateway_and_node_override(spark, golden_payload):
    chosen = decode.layouts(endian="big") + decode.layouts({"Diff_Baros": 4}, {"Diff_Baros": 30}, "big", node_id="7")
    rows = [("0", "Diff. baros", bytearray(golden_payload)), ("7", "Diff. baros", bytearray(golden_payload))]
    frame = spark.createDataFrame(rows, "packet_origin string, packet_type_name string, packet binary")
    got = {(r.packet_origin, r.position): r.sensor_value for r in decode.decode_packets(frame, chosen).collect()}
    word = lambda i: float(int.from_bytes(golden_payload[2 * i : 2 * i + 2], "big"))
    assert got["0", 1] == [word(5 + j) for j in range(5)]
    assert got["7", 1] == [word(4 + j) for j in range(4)]
    assert max(p for o, p in got if o == "7") == 29


def test_payloads_of_mixed_length(spark, golden_payload):
    rows = [("0", "IMU Accel", bytearray(golden_payload[: 240 + i % 5])) for i in range(50)]
    frame = spark.createDataFrame(rows, "packet_origin string, packet_type_name string, packet binary").coalesce(1)
    values = {tuple(r.sensor_value) for r in decode.decode_packets(frame).where("position = 39").collect()}
    assert len(values) == 1 and next(iter(values))[2] == -27023


def test_battery(spark):
    packet = bytearray([0]) + struct.pack("<III", 3_700_000, 1250, 128)
    row = decode.decode_battery(spark.createDataFrame([(packet,)], "packet binary")).first()
    assert (row.sensor_name, row.sensor_value) == ("battery_info", [3.7, 12.5, 0.5])


def test_time_sync_kinds(spark):
    words = list(range(4_294_967_290, 4_294_967_296)) * 11
    payloads = [bytearray([1]) + struct.pack("<I", kind) + struct.pack("<61I", *words[:61]) for kind in range(6)]
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "id int, packet binary")
    rows = decode.decode_time_sync(frame).collect()
    counts = {k: sum(r.kind == k for r in rows) for k in range(6)}
    assert counts == {0: 18, 1: 60, 2: 61, 3: 61, 4: 61, 5: 0}
    by = {(r.kind, r.position): r.value for r in rows}
    assert by[0, 14] == words[14] and by[0, 15] == words[15] - 2**32 and by[2, 15] == words[15]


def test_ticks_ignore_a_part_word(spark):
    frame = spark.createDataFrame([(bytearray(struct.pack("<2I", 5, 2**32 - 1)) + b"\x01",), (bytearray(),)], "packet binary")
    assert [(r.position, r.tick) for r in decode.decode_ticks(frame).collect()] == [(0, 5), (1, 2**32 - 1)]


def test_sample_times_and_calibration(spark):
    frame = spark.createDataFrame(
        [(10.0, 0.5, 4, 1, [40.96, 81.92], [40.96, 2.0])],
        "timestamp double, period double, samples_in_packet int, position int, sensor_value array<double>, conversion_constants array<double>",
    )
    assert decode.sample_times(frame, "timestamp", "period").first().sample_time == 10.5
    assert decode.sample_times(frame, "timestamp", "period", "end").first().sample_time == 8.5
    assert decode.calibrate(frame).first().sensor_value == [1.0, 40.96]


def test_central_dump_ends_after_its_limit(spark):
    payload = lambda kind: bytearray([1]) + struct.pack("<I", kind) + struct.pack("<61I", *range(61))
    rows = [("a", i, payload(1)) for i in range(5)] + [("b", 9, payload(1)), ("a", 7, payload(2))]
    frame = spark.createDataFrame(rows, "packet_origin string, seq bigint, packet binary")
    words = decode.decode_time_sync(frame, central_limit=187)
    counts = {(r.packet_origin, r.seq): r["count"] for r in words.groupBy("packet_origin", "seq").count().collect()}
    assert counts == {("a", 0): 60, ("a", 1): 60, ("a", 2): 60, ("a", 3): 7, ("b", 9): 60, ("a", 7): 61}
