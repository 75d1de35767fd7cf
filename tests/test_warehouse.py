import datetime
import json

import pytest
from pyspark.sql import functions as F

from gustline.operators import registry, windows
from gustline.plans import ingest
from gustline.session import literal_table
from gustline.sources import sinks
from gustline.sources.windows import describe_windows, read_window_metadata, read_windows, window_samples
from gustline.streaming import batches
from gustline.streaming.ingest import ingest_batch, ingest_stream, replay

TYPES = "ingest_seq bigint, reference string, name string, description string, measuring_unit string, metadata string"
PLACES = (
    "ingest_seq bigint, reference string, turbine_id string, receiver_firmware_version string, longitude string, latitude string"
)


def test_register_sensor_types(spark):
    rows = [
        (1, "my-sensor-name", "My sensor_Name", None, None, None),
        (2, "not slugified", "n", None, None, None),
        (3, None, "n", None, None, None),
        (4, "x", " ", None, None, None),
        (5, "taken", "n", None, None, None),
        (6, "my-sensor-name", "again", "d", "u", "{}"),
    ]
    result = registry.register_sensor_types(
        spark.createDataFrame(rows, TYPES), spark.createDataFrame([("taken",)], "reference string")
    )
    assert [tuple(r) for r in result.accepted.collect()] == [("my-sensor-name", "My sensor_Name", None, None, "{}")]
    assert sorted(r.ingest_seq for r in result.conflicts.collect()) == [5, 6]
    errors = {r.ingest_seq: list(r.field_errors) for r in result.invalid.collect()}
    assert errors == {2: ["reference"], 3: ["reference"], 4: ["name"]}


def test_register_installations(spark):
    rows = [
        (1, "my-installation", "my-turbine", "1.0.0", None, None),
        (2, "a", "t", None, None, None),
        (3, "b", "t", "1", "not-a-number", "1"),
        (4, "c", "t", "1", "1", "0"),
        (5, "d", "t", "1", "2.5", "1.5"),
        (6, "e", "", "1", "", "nonsense"),
    ]
    result = registry.register_installations(
        spark.createDataFrame(rows, PLACES), spark.createDataFrame([], "reference string")
    )
    assert {r.reference: r.location for r in result.accepted.collect()} == {
        "my-installation": None,
        "c": None,
        "d": "POINT (1.5000000000000000 2.5000000000000000)",
    }
    errors = {r.ingest_seq: sorted(r.field_errors) for r in result.invalid.collect()}
    assert errors == {2: ["receiver_firmware_version"], 3: ["longitude"], 6: ["latitude", "turbine_id"]}


def test_configurations_are_equal_by_their_nodes(spark):
    schema = "ingest_seq bigint, nodes_configuration string, gateway_configuration string"
    incoming = spark.createDataFrame(
        [(2, '{"0": {"blah": "blah"}}', '{"stuff": "other"}'), (1, '{"0": {"blah": "blah"}}', '{"stuff": "data"}')], schema
    )
    empty = literal_table(spark, [], ingest.CONFIGURATION_SCHEMA)
    first = registry.deduplicate_configurations(incoming, empty)
    row = first.new.first()
    assert first.new.count() == 1 and len(row.id) == 36 and row.gateway_configuration == '{"stuff": "data"}'
    assert row.nodes_configuration_hash == "1aea08f4603f76a55d3267dd40c310e14787a8d64663a72cfc62f58152e44504"
    assert row.gateway_configuration_hash == "6076cf0f824bcf1a887a96c75c1a33ec720ea271776f03e8168df3feed983c91"
    known = first.new.withColumn("id", F.lit("older-id"))
    second = registry.deduplicate_configurations(incoming, known)
    assert second.new.count() == 0 and second.ids.first().configuration_id == "older-id"


def moment(hour):
    return datetime.datetime(2022, 11, 2, hour)


def test_campaigns(spark):
    schema = "ingest_seq bigint, " + ingest.CAMPAIGN_SCHEMA
    updates = [
        (1, "a", moment(1), moment(9), "i", "{}", "first", None),
        (2, "a", moment(2), moment(3), "j", "{}", "second", None),
        (3, "b", moment(2), moment(4), "j", "{}", None, None),
    ]
    stored = [("b", moment(0), moment(1), "old", "{}", "kept", None), ("c", moment(0), moment(1), "old", "{}", None, None)]
    table = registry.upsert_campaigns(
        spark.createDataFrame(stored, ingest.CAMPAIGN_SCHEMA), spark.createDataFrame(updates, schema)
    )
    got = {r.reference: (r.start_time.hour, r.end_time.hour, r.installation_reference, r.label) for r in table.collect()}
    assert got == {"a": (1, 3, "i", "first"), "b": (0, 4, "old", "kept"), "c": (0, 1, "old", None)}


def metadata(node="0", reference="effervescent-slug-of-doom", end="2022-11-02 16:14:44.896294"):
    campaign = {"reference": reference, "start_time": "2022-11-02 16:14:40.896294", "end_time": end, "nodes": {node: ["Acc"]}}
    return json.dumps(
        {"gateway": {"installation_reference": "site"}, "nodes": {node: {"x": 1}}, "measurement_campaign": campaign}
    )


# --- fixed values: one sample time, as posix seconds and as a date ---
SAMPLE_TIME, SAMPLE_DATE = 1636559720.639327, datetime.datetime(2021, 11, 10, 15, 55, 20, 639327)


def test_window_rows(spark):
    document = json.dumps(
        {
            "0": {"Mics": [[0.0, 1.0, 2.0], [0.5, 3.0, 4.0]], "Baros_P": [[SAMPLE_TIME, 1.0, 2.0, 3.0]]},
            "1": {"Constat": [[SAMPLE_TIME, 5.0]], "Unheard": [[1.0, 1.0]]},
            "2": {},
        }
    )
    frame = spark.createDataFrame(
        [("out/window-0.json", document, metadata(), 1), ("out/window-1.json", "{}", "{}", 2)],
        "window_path string, document string, window_metadata string, ingest_seq bigint",
    )
    result = ingest.ingest_windows(
        frame, literal_table(spark, [], ingest.CAMPAIGN_SCHEMA), literal_table(spark, [], ingest.CONFIGURATION_SCHEMA)
    )
    rows = sorted(result.sensor_data.collect(), key=lambda r: r.node_id)
    assert [(r.datetime, r.node_id, r.sensor_type_reference, r.sensor_value) for r in rows] == [
        (SAMPLE_DATE, "0", "barometer", [1.0, 2.0, 3.0]),
        (SAMPLE_DATE, "1", "connection_statistics", [5.0]),
    ]
    assert rows[0].installation_reference == "site" and rows[0].measurement_campaign_reference == "effervescent-slug-of-doom"
    assert rows[0].configuration_id == result.new_configurations.first().id
    microphone = result.microphone_data.first()
    assert (microphone.path, microphone.samples) == ("microphone/window_id=cb578f123af7a55e/node_id=0", 2)
    assert microphone.datetime == datetime.datetime(1970, 1, 1)
    assert [r["sample"] for r in result.microphone_samples.orderBy("position").collect()] == [[0.0, 1.0, 2.0], [0.5, 3.0, 4.0]]
    assert {(r.window_path, r.reject_reason) for r in result.rejects.collect()} == {
        ("out/window-0.json", "unknown_sensor: Unheard"),
        ("out/window-1.json", "no_campaign"),
    }
    loaded = window_samples(frame.select("window_path", "document"))
    counts = {r.node_id: (r.rows, r.empty) for r in ingest.inserted_per_node(frame, loaded).collect()}
    assert counts == {"0": (3, False), "1": (2, False), "2": (0, True)}


SAMPLES = (
    "session_id string, node_id string, sensor_name string, seq bigint, position int, sample_time double, "
    "packet_timestamp double, sensor_value array<double>"
)


def samples(spark):
    rows = [
        ("s", "0", "Constat", i, p, 100.0 + 10 * i + p, 100.0 + 10 * i, [float(i), float(p)])
        for i in range(4)
        for p in range(2)
    ] + [("s", "1", "Acc", 9, 0, 101.0, 101.0, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, SAMPLES)


def test_window_files_keep_order_and_parts(spark, tmp_path):
    numbered = windows.with_window_number(samples(spark), "packet_timestamp", 20.0)
    documents = windows.window_documents(numbered, packets_per_part=2)
    sinks.write_windows(documents, str(tmp_path / "w"))
    read = read_windows(spark, str(tmp_path / "w"))
    assert read.count() == 3
    assert {p.name.split("=")[0] for p in (tmp_path / "w").glob("*/*")} == {"window_number"}
    back = window_samples(read).where("node_id = '0'").orderBy(F.col("sample")[0]).collect()
    assert [r["sample"] for r in back] == [[100.0 + 10 * i + p, float(i), float(p)] for i in range(4) for p in range(2)]
    assert {json.loads(r.document).keys().__len__() for r in read.collect()} == {1}


def test_csv_keeps_nodes_and_windows_apart(spark, tmp_path):
    numbered = samples(spark).withColumn("window_number", F.lit(0))
    both = numbered.unionByName(numbered.withColumn("node_id", F.lit("5")))
    sinks.write_sensor_csv(both, str(tmp_path / "c"), header=True)
    rows = spark.read.option("header", True).csv(str(tmp_path / "c" / "node_id=1" / "sensor_name=Acc" / "window_number=0"))
    assert rows.columns == ["time", "x", "y", "z"] and [tuple(r) for r in rows.collect()] == [("101.0", "1.0", "2.0", "3.0")]
    assert spark.read.option("header", True).csv(str(tmp_path / "c" / "node_id=5" / "sensor_name=Constat")).count() == 8


def test_retention_and_replay(spark):
    stored = spark.createDataFrame(
        [("s", i, f"window-{i}.json", 40) for i in range(5)], "session_id string, window_number bigint, path string, bytes bigint"
    )
    kept = lambda budget: [r.window_number for r in windows.retention(stored, budget, block_rows=2).where("keep").orderBy("window_number").collect()]
    assert kept(1) == [4] and kept(80) == [3, 4] and kept(10**9) == [0, 1, 2, 3, 4]
    totals = windows.stored_totals(stored).first()
    assert (totals.stored_bytes, totals.oldest_path) == (200, "window-0.json")
    staged = spark.createDataFrame([("a",), ("b",)], "window_path string")
    assert [r.window_path for r in ingest.unsent_windows(staged, staged.where("window_path = 'a'")).collect()] == ["b"]


def test_table_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path, "x bigint").count() == 0
    for value in (1, 2):
        sinks.write_table(spark.range(value, value + 1).select(F.col("id").alias("x")), path)
    assert sinks.read_table(spark, path, "x bigint").first().x == 2
    assert sinks.read_table(spark, path, "x bigint", before=1).first().x == 1


def write_window(folder, name, document, meta):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(document))
    (folder / f"{name}.metadata.json").write_text(meta)


def test_windows_stream_into_the_warehouse_once(spark, tmp_path):
    source, warehouse, checkpoint = tmp_path / "windows", str(tmp_path / "warehouse"), str(tmp_path / "checkpoint")
    run = lambda: ingest_stream(spark, str(source), warehouse, checkpoint).awaitTermination()
    write_window(source, "window-0.json", {"0": {"Acc": [[SAMPLE_TIME, 1.0]], "Mics": [[1.0, 2.0]]}}, metadata())
    run()
    later = metadata(end="2022-11-02 17:00:00")
    write_window(source, "window-1.json", {"0": {"Acc": [[SAMPLE_TIME, 2.0]]}}, later)
    run()
    run()
    data = spark.read.parquet(f"{warehouse}/sensor_data")
    assert sorted(r.sensor_value for r in data.collect()) == [[1.0], [2.0]]
    assert data.select("configuration_id").distinct().count() == 1
    campaign = sinks.read_table(spark, f"{warehouse}/measurement_campaign", ingest.CAMPAIGN_SCHEMA).collect()
    assert len(campaign) == 1 and campaign[0].end_time == datetime.datetime(2022, 11, 2, 17)
    assert spark.read.parquet(f"{warehouse}/microphone_data").count() == 1
    loaded = spark.read.parquet(f"{warehouse}/loaded_windows")
    assert ingest.unsent_windows(read_windows(spark, str(source)), loaded).count() == 0
    # a retried batch replaces its own output
    again = read_windows(spark, str(source)).where(F.col("window_path").endswith("window-1.json"))
    query = loaded.first()["query"]
    ingest_batch(warehouse, query=query)(again, 1)
    assert spark.read.parquet(f"{warehouse}/sensor_data").count() == 2
    # the catalogue says where the microphone rows are
    listed = spark.read.parquet(f"{warehouse}/microphone_data").collect()
    for row in listed:
        assert spark.read.parquet(f"{warehouse}/{row.path}").count() == row.samples == 1
    # a query with a new checkpoint replaces and repeats nothing, and finds the campaigns and configurations of the first
    write_window(source, "window-2.json", {"0": {"Acc": [[SAMPLE_TIME, 3.0]]}}, metadata())
    ingest_stream(spark, str(source), warehouse, checkpoint + "-2").awaitTermination()
    data = spark.read.parquet(f"{warehouse}/sensor_data")
    assert sorted(r.sensor_value[0] for r in data.collect()) == [1.0, 2.0, 3.0]
    assert data.select("configuration_id").distinct().count() == 1
    assert read_window_metadata(spark, str(source)).count() == 3


def test_ingest_rejects_what_it_cannot_load_and_replays_it(spark, tmp_path):
    source, warehouse = tmp_path / "a+b windows", str(tmp_path / "warehouse")
    write_window(source, "good.json", {"0": {"Acc": [[SAMPLE_TIME, 1.0], [], [None, 2.0]], "Nope": [[1.0]]}}, metadata())
    (source / "cut.json").write_text('{"0": {"Acc": [[1.0, 2')
    (source / "cut.json.metadata.json").write_text(metadata())
    (source / "partly.json").write_text('{"0": {"Acc": "oops", "Gyro": [[%s, 7.0]]}}' % SAMPLE_TIME)
    (source / "partly.json.metadata.json").write_text(metadata())
    (source / "late.json").write_text('{"0": {"Acc": [[%s, 9.0]]}}' % SAMPLE_TIME)
    (source / "odd.json").write_text("{}")
    (source / "odd.json.metadata.json").write_text(metadata() + "}")
    ingest_stream(spark, str(source), warehouse, str(tmp_path / "checkpoint")).awaitTermination()
    name = F.element_at(F.split("window_path", "/"), -1).alias("name")
    table = lambda t: spark.read.parquet(f"{warehouse}/{t}")
    rejects = {tuple(r) for r in table("rejects").select(name, "reject_reason").collect()}
    assert ("late.json", "no_campaign") in rejects and ("cut.json", "malformed_document") in rejects
    assert ("partly.json", "malformed_samples: 0 Acc") in rejects and ("good.json", "unknown_sensor: Nope") in rejects
    assert ("good.json", "samples_without_time: 0 Acc 2") in rejects
    assert any(n == "odd.json" for n, _ in rejects) and len(rejects) == 6
    assert sorted(r.sensor_value for r in table("sensor_data").collect()) == [[1.0], [7.0]]
    assert {r.name for r in table("loaded_windows").select(name).collect()} == {"good.json", "partly.json"}
    # the sidecar comes after its window; a replay loads that window once, whoever runs it again
    (source / "late.json.metadata.json").write_text(metadata())
    assert replay(spark, str(source), warehouse, "replay-1") == 3
    assert replay(spark, str(source), warehouse, "replay-1") == 3
    assert replay(spark, str(source), warehouse, "replay-2") == 2
    assert sorted(r.sensor_value for r in table("sensor_data").collect()) == [[1.0], [7.0], [9.0]]


def test_csv_has_all_channels_and_sensors(spark, tmp_path):
    wide = [("s", "0", "Mics", 0, 0, 1.5, 1.0, [float(i) for i in range(12)]), ("s", "0", "New sensor", 0, 0, 2.5, 1.0, [4.0])]
    rows = spark.createDataFrame(wide, SAMPLES).withColumn("window_number", F.lit(0))
    for header in (False, True):
        path = str(tmp_path / str(header))
        sinks.write_sensor_csv(rows, path, header=header)
        read = spark.read.option("header", header).csv(f"{path}/node_id=0/sensor_name=Mics/window_number=0")
        assert len(read.columns) == 13 and [float(x) for x in read.first()] == [1.5, *map(float, range(12))]
        assert [float(x) for x in spark.read.option("header", header).csv(f"{path}/node_id=0/sensor_name=New sensor").first()[:2]] == [2.5, 4.0]


def test_retention_keeps_only_the_newest_of_empty_windows(spark):
    stored = spark.createDataFrame([("s", i, b) for i, b in enumerate([5, 90, 0])], "session_id string, window_number bigint, bytes bigint")
    kept = windows.retention(stored, 50, block_rows=2).where("keep")
    assert sorted(r.window_number for r in kept.collect()) == [2]


def test_late_rows_are_kept_apart(spark, tmp_path):
    base = str(tmp_path)
    handle = batches.window_totals_stream(
        f"{base}/totals", f"{base}/late", f"{base}/state", "ts", "v", "10 seconds", 5.0, ["k"]
    )
    second = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    schema = "ts timestamp, k string, v bigint"
    handle(spark.createDataFrame([(second(1), "a", 1), (second(20), "a", 2)], schema), 0)
    handle(spark.createDataFrame([(second(2), "a", 4), (second(16), "a", 8), (second(21), "a", 16)], schema), 1)
    merged = batches.merged_totals(spark.read.parquet(f"{base}/totals"), ["k"])
    assert {(r.window_start.second, r.n, r.total) for r in merged.collect()} == {(0, 1, 1), (10, 1, 8), (20, 2, 18)}
    assert [r.v for r in spark.read.parquet(f"{base}/late").collect()] == [4]


def test_fan_out(spark, tmp_path):
    spark.range(10).selectExpr("timestamp_seconds(id) AS ts", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id bigint").parquet(str(tmp_path / "in"))
    seen = []
    write = batches.fan_out(lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.where("id > 6").count()))
    batches.for_each_batch(stream, write, str(tmp_path / "cp")).awaitTermination()
    assert seen == [10, 3]


def test_metadata_table_stamps_the_end_time(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "window_path string")
    rows = describe_windows(frame, F.lit(metadata()), F.lit("2023-01-01 00:00:00").cast("timestamp")).collect()
    assert sorted(r.window_path for r in rows) == ["a", "b"]
    campaign = json.loads(rows[0].window_metadata)["measurement_campaign"]
    assert campaign["end_time"] == "2023-01-01 00:00:00" and campaign["reference"] == "effervescent-slug-of-doom"


@pytest.mark.parametrize("header", [True, False])
def test_small_csv_parts_share_a_file(spark, tmp_path, header):
    rows = [("s", "0", "Constat", seq, p, float(seq), float(seq), [float(seq), float(p)]) for seq in range(40) for p in (0, 1)]
    rows += [("s", "0", "Constat", sinks.FILE_PACKETS + 1, 0, 0.5, 0.5, [7.0, 0.0]), ("s", "0", "Constat", sinks.FILE_PACKETS + 2, 0, 0.6, 0.6, None)]
    path = tmp_path / "c"
    frame = spark.createDataFrame(rows, SAMPLES).withColumn("window_number", F.lit(0)).repartition(3)
    sinks.write_sensor_csv(frame, str(path), header=header, packets_per_part=2)
    folders = sorted(p.name for p in path.glob("node_id=0/sensor_name=Constat/window_number=0/*"))
    assert folders == ["parts=0", "parts=1"]
    read = spark.read.option("header", header).csv(str(path / "node_id=0/sensor_name=Constat/window_number=0/parts=0"))
    got = [tuple(float(x) for x in r) for r in read.collect()]
    expected = [(seq // 2, float(seq), float(seq), float(p)) for seq in range(40) for p in (0, 1)]
    assert (got if header else sorted(got)) == expected
    if header:
        assert read.columns == ["part", "time", "value0", "value1"] and len(list((path / "node_id=0").rglob("part-*"))) == 2
