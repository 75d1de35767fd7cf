"""Packets read as their own gateway's configuration says."""

import json

import pytest

from gustline.operators import sensors, setup
from gustline.plans import configured, telemetry
from gustline.session import literal_table
from gustline.sources import configuration

NODE = {"number_of_sensors": {"Acc": 3, "Diff_Baros": 2, "Constat": 4, "Baros_P": 2, "Baros_T": 2, "battery_info": 3}}


def loaded(spark, **documents):
    rows = [(k, json.dumps({"gateway": {}, "nodes": {"0": {}}, "measurement_campaign": {}} | v)) for k, v in documents.items()]
    return configuration.load(literal_table(spark, rows, "path string, document string"))


def packets(spark, rows):
    schema = "session_id string, seq bigint, packet_origin string, packet_type int, packet binary, packet_timestamp double"
    return spark.createDataFrame([(s, i, o, t, bytes(p), 100.0 + i) for s, i, o, t, p in rows], schema)


def full(body, ticks, order):
    return body + bytes(240 - len(body)) + ticks.to_bytes(4, order)


def test_node_0_of_two_gateways(spark):
    known = loaded(
        spark,
        small={
            "gateway": {"endian": "big"},
            "nodes": {
                "0": {
                    "acc_freq": 10,
                    "samples_per_packet": {"Acc": 2, "Constat": 1, "battery_info": 1, "Diff_Baros": 1, "Baros_P": 1, "Baros_T": 1},
                    "sensor_conversion_constants": {"Acc": 1, "Constat": 1, "battery_info": 1},
                    "initial_node_handles": {"1": "IMU Accel", "2": "Constat", "3": "Remote Info Message"},
                    "remote_info_type": {"7": "Battery info"},
                    **NODE,
                }
            },
        },
        usual={},
    )
    assigned = literal_table(spark, [("a", 0, "small"), ("b", 0, "usual"), ("b", 10, "small")], "session_id string, from_seq bigint, path string")
    built = setup.setup_of(known, assigned)
    acc = bytes([1, 2, 3, 4, 5, 6] * 2)
    battery = bytes([7, 0, 30, 132, 128, 0, 0, 0, 200, 0, 0, 1, 0])
    rows = []
    for session, start, order, types in (("a", 0, "big", (2, 1, 3)), ("b", 0, "little", (52, 42, 58)), ("b", 10, "big", (2, 1, 3))):
        rows += [
            (session, start, "0", types[0], full(b"", 65536, order)),
            (session, start + 1, "0", types[1], full(acc, 131072, order)),
            (session, start + 2, "0", types[2], battery),
        ]
    rows += [("c", 0, "0", 52, full(b"", 65536, "little")), ("a", 9, "5", 2, full(b"", 65536, "big"))]
    read = configured.read_configured(packets(spark, rows), built)
    found = {}
    for r in read.samples.collect():
        found.setdefault((r.session_id, r.seq, r.sensor_name), []).append((r.position, round(r.sample_time, 6), r.sensor_value))
    little = [float(x) for x in (0x0201, 0x0403, 0x0605)]
    big = [float(x) for x in (0x0102, 0x0304, 0x0506)]
    assert sorted(found[("a", 1, "Acc")]) == [(0, 101.0, big), (1, 101.1, big)]
    assert sorted(found[("b", 11, "Acc")])[0][2] == big and len(found[("b", 11, "Acc")]) == 2
    usual = sorted(found[("b", 1, "Gyro")]) if ("b", 1, "Gyro") in found else sorted(found[("b", 1, "Acc")])
    assert len(usual) == 40 and usual[1] == (1, 101.01, little)
    assert found[("a", 2, "battery_info")] == [(0, 102.0, [2.0, 2.0, 1.0])]
    assert len(found[("a", 0, "Constat")]) == 1 and len(found[("b", 0, "Constat")]) == 24
    events = {(r.session_id, r.seq): r.event for r in read.events.collect()}
    assert events[("a", 2)] == events[("b", 12)] == "Battery info"
    rejects = {(r.session_id, r.seq): r.reject_reason for r in read.rejects.collect()}
    assert rejects[("b", 2)] == "unknown_code"  # code 7 is the other gateway's
    assert rejects[("c", 0)] == rejects[("a", 9)] == "unknown_packet_type"  # no configuration, and no such node


def test_two_rows_for_one_key_are_refused(spark):
    known = loaded(spark, one={}, two={})
    schema = "session_id string, from_seq bigint, path string"
    with pytest.raises(ValueError, match="assignments"):
        setup.setup_of(known, literal_table(spark, [("a", 0, "one"), ("a", 0, "two")], schema))
    facts = sensors.default_node_sensors(spark, ["0"])
    samples = spark.createDataFrame([("0", "Acc")], "packet_origin string, sensor_name string")
    assert sensors.with_sensor_facts(samples, facts, ["period"]).count() == 1
    with pytest.raises(ValueError, match="node sensors"):
        sensors.with_sensor_facts(samples, facts.union(facts), ["period"])


def test_defaults_read_as_without_a_setup(spark):
    body = bytes(range(240))
    rows = [("s", 0, "0", 52, full(body, 65536, "little"))]
    rows += [("s", 1 + i, "0", t, full(body, 65536 + i, "little")) for i, t in enumerate((34, 36, 38, 42, 44, 46, 52, 60, 62, 48, 50))]
    rows += [("s", 40, "0", 255, bytes([32, 0, 62])), ("s", 41, "0", 56, b"\x01"), ("s", 42, "base-station", 64, b"\x40")]
    frame = packets(spark, rows)
    built = setup.setup_of(loaded(spark, usual={}), literal_table(spark, [("s", 0, "usual")], "session_id string, from_seq bigint, path string"))
    one = configured.read_configured(frame, built)
    other = telemetry.read_telemetry(frame, sensors.default_node_sensors(spark, ["0"]))
    for name in ("samples", "events", "time_sync", "ticks", "rejects"):
        a, b = getattr(one, name), getattr(other, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name
