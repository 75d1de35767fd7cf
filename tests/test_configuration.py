import json

from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.sources import configuration


def documents(spark, **named):
    rows = [(path, d if isinstance(d, str) else json.dumps(d)) for path, d in named.items()]
    return spark.createDataFrame(rows, "path string, document string")


def whole(nodes, **gateway):
    return {"gateway": gateway, "nodes": nodes, "measurement_campaign": {}}


def test_defaults(spark):
    loaded = configuration.load(configuration.default_configuration(spark))
    node = loaded.nodes.first()
    assert (node.node_id, node.acc_freq, node.mag_freq, node.blade_id) == ("0", 100.0, 12.5, "unknown")
    assert node.sensor_names == cat.SENSOR_NAMES and node.initial_node_handles["52"] == "Constat"
    gateway = loaded.gateways.first()
    assert (gateway.baudrate, gateway.endian, gateway.packet_key, gateway.latitude) == (2300000, "little", 254, 0.0)
    facts = {r.sensor_name: r for r in loaded.node_sensors.collect()}
    assert {n: r.period for n, r in facts.items()} == cat.default_periods()
    assert facts["Baros_P"].conversion_constants == [40.96] * 40 and facts["Mics"].samples_in_packet == 8
    assert loaded.rejects.count() == 0


def test_given_values_and_empty_maps(spark):
    nodes = {
        "1": {"constat_period": 50, "decline_reason": {}, "sensor_names": ["Acc"], "periods": {"Acc": 1}},
        "2": {"number_of_sensors": {"Acc": 2}, "sensor_conversion_constants": {"Acc": [2, 3]}},
    }
    loaded = configuration.load(documents(spark, a=whole(nodes, latitude=1.5, endian="big")))
    assert loaded.rejects.count() == 0
    assert loaded.gateways.first().latitude == 1.5 and loaded.gateways.first().endian == "big"
    first = loaded.nodes.where("node_id = '1'").first()
    assert first.constat_period == 50.0 and first.decline_reason["5"] == "Not in sleep"
    facts = {(r.node_id, r.sensor_name): r for r in loaded.node_sensors.collect()}
    assert facts["1", "Constat"].period == 0.05
    assert facts["1", "Acc"].installed and not facts["1", "Mics"].installed
    assert facts["2", "Acc"].conversion_constants == [2.0, 3.0]


def test_rejects(spark):
    loaded = configuration.load(
        documents(
            spark,
            missing={"gateway": {}, "nodes": {}},
            garbage="not json",
            node=whole({"0": {"speed": 1}}),
            gateway=whole({"0": {}}, speed=1),
            length=whole({"0": {"sensor_conversion_constants": {"Acc": [1]}}}),
            kind=whole({"0": {"sensor_conversion_constants": {"Acc": "x"}}}),
            old={**whole({"0": {}}), "session": {}},
        )
    )
    assert {r.path: r.reject_reason for r in loaded.rejects.collect()} == {
        "missing": "missing_section: measurement_campaign",
        "garbage": "not_a_configuration",
        "node": "unknown_node_field: speed",
        "gateway": "unknown_gateway_field: speed",
        "length": "bad_conversion_constants: Acc",
        "kind": "bad_conversion_constants: Acc",
    }
    strict = configuration.load(documents(spark, old={**whole({"0": {}}), "session": {}}), strict=True)
    assert strict.rejects.first().reject_reason == "unknown_section: session"
    lenient = configuration.load(documents(spark, a={"gateway": {}}), require_sections=False)
    assert lenient.nodes.first().node_id == "0" and lenient.rejects.count() == 0


def test_campaign_metadata_and_round_trip(spark, tmp_path):
    source = documents(spark, a={**whole({"7": {"acc_freq": 50}}), "measurement_campaign": {"label": "l"}})
    loaded = configuration.load(source)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = configuration.campaign_metadata(loaded, start).first()
    assert len(row.reference) == 36 and row.label == "l" and row.nodes == {"7": cat.SENSOR_NAMES}

    back = configuration.to_documents(loaded).first().document
    parsed = json.loads(back)
    assert parsed["nodes"]["7"]["periods"]["Acc"] == 0.02 and parsed["gateway"]["packet_key"] == 254
    assert parsed["nodes"]["7"]["sensor_conversion_constants"]["Acc"] == [1.0, 1.0, 1.0]
    (tmp_path / "configuration.json").write_text(back)
    again = configuration.load(configuration.read_configurations(spark, str(tmp_path)))
    assert again.rejects.count() == 0 and again.nodes.first().acc_freq == 50.0
