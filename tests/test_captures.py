import os
import random

from gustline import catalogue as cat
from gustline.operators import clock, routing, sensors
from gustline.plans import telemetry
from gustline.sources import captures, ranges
from gustline.streaming import batches, state
from gustline.streaming import captures as open_captures

LEADERS = frozenset([245, 246, 254])


def plain_framing(stream):
    packets, at = [], 0
    while at < len(stream):
        if stream[at] not in LEADERS:
            at += 1
        elif at + 2 >= len(stream):
            packets.append((stream[at], -1, None, b""))
            break
        else:
            length = stream[at + 2]
            packets.append((stream[at], stream[at + 1], length, stream[at + 3 : at + 3 + length]))
            at += 3 + length
    return packets


def test_files_framed_apart_give_the_packets_of_the_whole_stream():
    rng = random.Random(1)
    for _ in range(800):
        size = rng.choice([0, 1, 5, 50, 600, 3000])
        stream = bytes(rng.choice([245, 254, 3, 7, rng.randrange(256)]) for _ in range(size))
        cuts = [0, *sorted(rng.randrange(size + 1) for _ in range(rng.choice([0, 1, 3, 9]))), size]
        parts = [stream[a:b] for a, b in zip(cuts, cuts[1:])]
        state, found = 0, []
        for i, part in enumerate(parts):
            tail = b"".join(parts[i + 1 :])[: captures.HEAD_BYTES]
            ends, counts = captures.transfer(part, LEADERS)
            begun = len(found)
            found += [packet[:4] for packet in captures.frame(part, tail, state, LEADERS)]
            assert len(found) - begun == counts[state]
            state = ends[state]
        assert found == plain_framing(stream)


def packet(node, kind, payload, length=None):
    return bytes([245 + node, kind, len(payload) if length is None else length]) + payload


def write(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)


def full(fill, ticks):
    return bytes([fill]) * 240 + ticks.to_bytes(4, "little")


def read(spark, root):
    origins = captures.leading_bytes(spark, ["0", "1"])
    return clock.cut_lineage(captures.frame_captures(captures.read_captures(spark, root), origins))


def test_sessions_of_several_files(spark, tmp_path):
    first = (
        b"\x07\x01"
        + packet(0, 52, full(1, 65536))
        + b"\x00"
        + packet(1, 52, full(2, 65536))
        + bytes([254, 64, 1, 64])
        + packet(0, 34, full(3, 131072))
        + packet(1, 38, full(4, 131072))
    )
    for i, (a, b) in enumerate([(0, 300), (300, 301), (301, 498), (498, len(first))]):
        write(tmp_path / "20240101T000000", f"capture-{i}.bin", first[a:b])
    write(tmp_path / "other", "capture-0.bin", packet(0, 34, full(9, 65536)))
    packets = read(spark, str(tmp_path))
    rows = packets.orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.packet_origin, r.packet_type, len(r.packet)) for r in rows] == [
        ("20240101T000000", "0", 52, 244),
        ("20240101T000000", "1", 52, 244),
        ("20240101T000000", cat.BASE_STATION_ID, 64, 1),
        ("20240101T000000", "0", 34, 244),
        ("20240101T000000", "1", 38, 244),
        ("other", "0", 34, 244),
    ]
    assert all(r.packet_timestamp > 1e9 for r in rows)

    result = telemetry.read_telemetry(packets, sensors.default_node_sensors(spark, ["0", "1"]))
    counts = {(r.node_id, r.sensor_name): r["count"] for r in result.samples.groupBy("node_id", "sensor_name").count().collect()}
    assert counts == {
        ("0", "Constat"): 24, ("1", "Constat"): 24, ("0", "Baros_P"): 1, ("0", "Baros_T"): 1, ("1", "Mics"): 8,
    }
    assert [(r.session_id, r.reject_reason) for r in result.rejects.collect()] == [("other", "no_time_offset")]
    assert [r.event for r in result.events.collect()] == ["Select message destination successful"]


def test_a_packet_cut_off_by_the_end_is_rejected(spark, tmp_path):
    write(tmp_path / "s", "a.bin", packet(0, 52, full(1, 65536)) + packet(0, 34, full(1, 65537)[:242], 244))
    write(tmp_path / "t", "a.bin", bytes([245, 34]))
    classified = routing.classify(clock.align_packets(read(spark, str(tmp_path))))
    got = {(r.session_id, r.packet_type): r.reject_reason for r in classified.collect()}
    assert got == {("s", 52): None, ("s", 34): "short_payload", ("t", -1): "unknown_packet_type"}


def test_arrival_time_runs_back_from_the_end_of_the_file(spark, tmp_path):
    write(tmp_path / "s", "a.bin", packet(0, 56, b"\x01") * 3)
    origins = captures.leading_bytes(spark, ["0"])
    framed = captures.frame_captures(captures.read_captures(spark, str(tmp_path)), origins, seconds_per_byte=1.0)
    times = [r.packet_timestamp for r in framed.orderBy("seq").collect()]
    assert [round(times[2] - t, 6) for t in times] == [8.0, 4.0, 0.0]


def test_leading_bytes(spark):
    rows = captures.leading_bytes(spark, ["0", "3"], packet_key=248).collect()
    assert {(r.leading_byte, r.packet_origin) for r in rows} == {(245, "0"), (248, "3")}


def test_captures_stream_session_by_session(spark, tmp_path):
    root, out = tmp_path / "captures", str(tmp_path / "packets")
    origins = captures.leading_bytes(spark, ["0"])

    def frame_batch(batch, number):
        framed = captures.frame_captures(batch.persist(), origins)
        framed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for session in ("one", "two"):
        stream_bytes = packet(0, 56, b"\x01") * 5
        write(root / session, "a.bin", stream_bytes[:10])
        write(root / session, "b.bin", stream_bytes[10:])
        query = batches.for_each_batch(captures.stream_captures(spark, str(root)), frame_batch, str(tmp_path / "cp"))
        query.awaitTermination()
    counts = spark.read.parquet(out).groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in counts} == {"one": 5, "two": 5}


def noisy_session(rng, packets):
    out = []
    for _ in range(packets):
        if rng.random() < 0.2:
            out.append(bytes(rng.choice([0, 7, 254]) if rng.random() < 0.9 else 3 for _ in range(rng.randrange(4))))
        out.append(packet(rng.randrange(2), rng.choice([34, 56, 245]), rng.randbytes(rng.choice([0, 1, 13, 244]))))
    return b"".join(out)


def rows_of(packets):
    return sorted(
        (r.session_id, r.seq, r.packet_origin, r.packet_type, bytes(r.packet), r.frame_length, round(r.packet_timestamp, 6))
        for r in packets.collect()
    )


def write_session(folder, content, cuts, arrivals, upto=None):
    """Files of a session that hold its bytes up to ``upto``, named by their arrival."""
    ends = [*cuts, len(content)]
    for i, (a, b) in enumerate(zip([0, *cuts], ends)):
        seen = b if upto is None else min(b, upto)
        if seen > a:
            write(folder, f"f{i:03d}-at{arrivals + 10 * i}.bin", content[a:seen])


def test_ranges_of_any_size_give_the_packets_of_whole_files(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    origins = captures.leading_bytes(spark, ["0", "1"])
    for name in ("a", "b", "c"):
        content = noisy_session(rng, 60)[: -rng.randrange(1, 200)]
        write_session(tmp_path / "s" / name, content, sorted(rng.sample(range(len(content)), 4)), 1000)
    write(tmp_path / "s" / "empty", "f-at1.bin", b"")
    arrival = r"-at(\d+)"
    whole = rows_of(captures.frame_chunks(ranges.read_ranges(spark, str(tmp_path / "s"), 1 << 20, arrival), origins, 0.5))
    assert {r[0] for r in whole} == {"a", "b", "c"} and whole[0][1] == 0
    assert captures.FAN == 256
    monkeypatch.setattr(captures, "FAN", 3)  # a tree of several levels
    for size in (700, 300):
        chunks = ranges.read_ranges(spark, str(tmp_path / "s"), size, arrival)
        assert chunks.count() > 25
        assert rows_of(captures.frame_chunks(chunks, origins, 0.5)) == whole


def test_open_sessions_are_followed(spark, tmp_path):
    """A session spread over micro-batches, in files that grow, gives numbers and times of the whole."""
    rng = random.Random(4)
    origins = captures.leading_bytes(spark, ["0", "1"])
    contents = {n: noisy_session(rng, 40) for n in ("a", "b")}
    for n in contents:
        while (last := plain_framing(contents[n])[-1])[2] == len(last[3]):
            contents[n] += packet(0, 34, b"", 200)
    cuts = {n: sorted(rng.sample(range(len(c)), 3)) for n, c in contents.items()}
    follow = open_captures.frame_stream(str(tmp_path / "state"), lambda p, n: out.append(rows_of(p)), origins, 0.25)
    out, root = [], tmp_path / "s"
    for upto in (1, 900, 1700, None):
        write_session(root / "a", contents["a"], cuts["a"], 1000, upto)
        if upto != 900:  # a batch without a byte of this session
            write_session(root / "b", contents["b"], cuts["b"], 2000, upto)
        stream = ranges.stream_ranges(spark, str(root), 350, r"-at(\d+)", "start")
        batches.for_each_batch(stream, follow, str(tmp_path / "cp")).awaitTermination()
    assert len(out) == 4
    ended = spark.createDataFrame([("a",), ("b",)], "session_id string")
    closed = rows_of(open_captures.close_sessions(spark, str(tmp_path / "state"), origins, ended, 99, 0.25))
    assert len(closed) == 2 and open_captures.read_state(spark, str(tmp_path / "state"), open_captures.STATE_SCHEMA, ["session_id"], 100).isEmpty()
    whole = captures.frame_chunks(ranges.read_ranges(spark, str(root), 1 << 20, r"-at(\d+)", "start"), origins, 0.25)
    assert sorted(sum(out, closed)) == rows_of(whole)


def test_state_reads_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SNAPSHOT_EVERY", 3)
    path, schema = str(tmp_path / "state"), "k string, v bigint"
    held = {}
    for number in range(11):
        rows = [(k, number, number == 5 and k == "a") for k in ("a", "b", "c")[number % 2 : number % 3 + 1]]
        change = spark.createDataFrame(rows, f"{schema}, finished boolean")
        state.write_state(change, path, schema, ["k"], number)
        state.write_state(change, path, schema, ["k"], number)  # a batch that runs again
        for k, v, finished in rows:
            held[k] = v
            if finished:
                del held[k]
        got = {r.k: r.v for r in state.read_state(spark, path, schema, ["k"], number + 1).collect()}
        assert got == held
    assert sorted(n for n in os.listdir(path) if n.startswith("snapshot")) == ["snapshot=2", "snapshot=5", "snapshot=8"]


def test_small_ranges_share_a_task(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for i in range(3):
        (tmp_path / "s" / f"{i}.bin").write_bytes(bytes([i]) * 10_000)
    chunks = ranges.read_ranges(spark, str(tmp_path), 20)
    assert chunks.count() == 1500 and chunks.rdd.getNumPartitions() <= 2 * ranges.TASKS
    whole = [r.content for r in chunks.orderBy("path", "offset").collect()]
    assert b"".join(map(bytes, whole)) == b"".join(bytes([i]) * 10_000 for i in range(3))
    large = [ranges.ByteRange("s", "p", 0, ranges.TASK_BYTES, 0, 0.0)] * 200
    assert [len(d.ranges) for d in ranges._deals(large)] == [1] * 200 and ranges._deals([]) == []
