import random
import statistics
import struct

import pytest

from gustline import catalogue as cat
from gustline.operators import clock, routing

SCHEMA = "session_id string, seq bigint, packet_origin string, packet_type int, packet binary, packet_timestamp double"


def full(node_time):
    return bytearray(240) + struct.pack("<I", int(node_time * 65536) % 2**32)


def frame(spark, rows):
    return spark.createDataFrame([("s", *row) for row in rows], SCHEMA)


def times(aligned):
    return {r.seq: r.timestamp for r in aligned.collect()}


def test_offsets_of_a_short_sequence(spark):
    rows = [
        (1, "0", 34, full(5.0), 100.0),
        (2, "0", 52, full(6.0), 106.0),
        (3, "0", 52, full(7.0), 109.0),
        (4, "0", 34, full(8.0), 120.0),
        (5, "0", 56, bytearray([1]), 121.0),
        (6, "0", 255, bytearray([32, 0, 62]), 130.0),
        (7, "0", 34, full(1.0), 131.5),
        (8, "0", 52, full(2.0), 134.0),
    ]
    got = times(clock.align_packets(frame(spark, rows)))
    assert got == {1: None, 2: 106.0, 3: 108.0, 4: 109.0, 5: 121.0, 7: 131.0, 8: 133.0}


def test_history_keeps_ten_entries(spark):
    offsets = [float(2**i) for i in range(12)]
    rows = [(i, "0", 52, full(1.0), 1.0 + o) for i, o in enumerate(offsets)]
    got = times(clock.align_packets(frame(spark, rows), block_rows=5))
    for i in range(12):
        assert got[i] == 1.0 + statistics.median(offsets[max(0, i - 9) : i + 1])


def reader(rows):
    """The reader's rules, one packet after the other."""
    offsets, starts, result = {}, {}, {}
    for seq, origin, kind, packet, arrived in rows:
        if kind == 255:
            starts[origin], offsets[origin] = packet[0], [arrived]
            continue
        start = starts.get(origin, 32)
        distance = kind - start
        name = cat.PACKET_NAMES[distance // 2 - 1] if distance % 2 == 0 and 2 <= distance <= 32 else None
        if name is None:
            result[seq] = (None, None)
            continue
        when = arrived
        if len(packet) == 244:
            node = struct.unpack("<I", packet[240:])[0] / 65536
            if name == "Constat":
                offsets[origin] = (offsets.get(origin, []) + [arrived - node])[-10:]
            when = node + statistics.median(offsets[origin]) if offsets.get(origin) else None
        result[seq] = (name, when)
    return result


def traffic(count, seed):
    rng, rows, seq, starts = random.Random(seed), [], 0, {}
    for i in range(count):
        seq += rng.choice([1, 1, 1, 7, 90])
        origin, arrived, dice = rng.choice("0001"), 1000 + i * 0.5, rng.random()
        start = starts.get(origin, 32)
        if dice < 0.01:
            starts[origin] = rng.choice([32, 40])
            rows.append((seq, origin, 255, bytearray([starts[origin], 0, starts[origin] + 30]), arrived))
        elif dice < 0.4:
            rows.append((seq, origin, start + 20, full(i * 0.5 + rng.random()), arrived))
        elif dice < 0.5:
            rows.append((seq, origin, start + 24, bytearray([1]), arrived))
        else:
            rows.append((seq, origin, rng.choice([start + 2, start + 2, 33]), full(i * 0.5 + rng.random()), arrived))
    return rows


@pytest.mark.parametrize("block_rows", [100, 1 << 18])
def test_matches_the_sequential_reader(spark, block_rows):
    rows = traffic(1500, 3)
    aligned = clock.align_packets(frame(spark, rows), block_rows=block_rows).collect()
    got = {r.seq: (r.packet_type_name, r.timestamp if r.packet_type_name else None) for r in aligned}
    assert got == reader(rows)


def test_carried_state_continues(spark):
    rows = traffic(900, 11)
    carried, got = None, {}
    for low in range(0, 900, 300):
        part = frame(spark, rows[low : low + 300])
        entries = clock.cut_lineage(clock.control_entries(part, carried=carried, block_rows=50))
        for r in clock.align_with_entries(part, entries, block_rows=50).collect():
            got[r.seq] = (r.packet_type_name, r.timestamp if r.packet_type_name else None)
        carried = clock.cut_lineage(clock.control_state(entries, block_rows=50))
        assert carried.groupBy("packet_origin").count().agg({"count": "max"}).first()[0] <= 10
    assert got == reader(rows)


def test_handle_definition_with_wrong_span_still_counts(spark):
    rows = [(1, "0", 255, bytearray([0, 0, 255]), 5.0), (2, "0", 2, full(1.0), 6.0), (3, "0", 34, full(1.0), 7.0)]
    packets = frame(spark, rows)
    assert clock.handle_definitions(packets).first().handle_error
    names = {r.seq: r.packet_type_name for r in clock.align_packets(packets).collect()}
    assert names == {2: "Abs. baros", 3: None}


def test_routes_and_reasons(spark):
    rows = [
        (1, "0", 0, bytearray(), 1.0),
        (2, "0", 34, full(1.0), 2.0),
        (3, "0", 52, full(2.0), 3.0),
        (4, "0", 34, bytearray(200), 4.0),
        (5, "0", 48, full(3.0), 5.0),
        (6, "0", 60, full(4.0), 6.0),
        (7, "0", 58, bytearray([0]), 7.0),
        (8, "0", 58, bytearray([9]), 8.0),
        (9, "0", 40, bytearray([2]), 9.0),
        (10, "0", 54, bytearray([3]), 10.0),
        (11, "base-station", 64, bytearray([64]), 11.0),
        (12, "0", 70, bytearray([1]), 12.0),
        (13, "0", 56, bytearray([]), 13.0),
    ]
    handles = clock.HandleMaps(default={**cat.DEFAULT_NODE_HANDLES, 70: "Info Message"})
    classified = clock.cut_lineage(routing.classify(clock.align_packets(frame(spark, rows), handles)))
    got = {r.seq: (r.route, r.reject_reason) for r in classified.collect()}
    assert got == {
        1: ("reject", "unknown_packet_type"),
        2: ("reject", "no_time_offset"),
        3: ("sensor", None),
        4: ("reject", "short_payload"),
        5: ("reject", "unsupported_packet_type"),
        6: ("ticks", None),
        7: ("remote_info", None),
        8: ("remote_info", None),
        9: ("remote_info", None),
        10: ("remote_info", None),
        11: ("local_info", None),
        12: ("reject", "unprocessed_packet_type"),
        13: ("reject", "short_payload"),
    }
    events = {r.seq: (r.event, r.reject_reason) for r in routing.node_events(classified).collect()}
    assert events == {
        7: ("Battery info", "short_payload"),
        8: (None, "unknown_code"),
        9: ("Flash erasing done", None),
        10: ("Connection parameter update unfinished", None),
        11: ("Select message destination successful", None),
    }
    own = {"0": {"Cmd Decline": {3: "own words"}}}
    assert {r.seq: r.event for r in routing.node_events(classified, node_codes=own).collect()}[10] == "own words"


def test_initial_maps_per_origin(spark):
    rows = [(1, "0", 90, bytearray([1]), 1.0), (2, "1", 90, bytearray([1]), 1.0), (3, "base-station", 34, full(1.0), 1.0)]
    handles = clock.HandleMaps(nodes={"1": {90: "Sleep State"}})
    names = {r.seq: r.packet_type_name for r in clock.align_packets(frame(spark, rows), handles).collect()}
    assert names == {1: None, 2: "Sleep State", 3: None}


def test_unwrap_and_free_running(spark):
    ticks = [2**32 - 10, 5, 20, 2**31, 2**32 - 1, 3]
    rows = [("s", i, "0", t, 24, 0.001) for i, t in enumerate(ticks)]
    packets = spark.createDataFrame(
        rows, "session_id string, seq bigint, packet_origin string, node_ticks bigint, samples int, period double"
    )
    got = [r.node_ticks for r in clock.unwrap_ticks(packets, 2).orderBy("seq").collect()]
    assert got == [ticks[0], *[t + 2**32 for t in ticks[1:5]], ticks[5] + 2 * 2**32]
    free = clock.free_running_times(packets, clock.KEYS, "samples", "period", 2).orderBy("seq").collect()
    assert [round(r.free_time - ticks[0] / 65536, 6) for r in free] == [round(0.024 * k, 6) for k in range(6)]


def test_progress(spark):
    packets = frame(spark, [(i, "01"[i % 2], 34, bytearray(), 0.0) for i in range(25)])
    marks = routing.progress_markers(packets, clock.KEYS, 5).collect()
    assert sorted((r.packet_origin, r.seq) for r in marks) == [("0", 8), ("0", 18), ("1", 9), ("1", 19)]
    assert {r.packet_origin: r.packets for r in routing.packet_progress(packets).collect()} == {"0": 13, "1": 12}
