"""Window sets, their removal, paired streams, laboratory times, and sections of configurations."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from gustline.functions import text
from gustline.operators import ordered
from gustline.plans import ingest, lab
from gustline.session import at_once, literal_table
from gustline.sources import sinks, window_sets
from gustline.sources import windows as windows_source
from gustline.sources.windows import read_window_metadata
from gustline.streaming import ingest as loading

SCHEMA = "session_id string, window_number bigint, document string, window_metadata string"


def documents(spark, rows):
    return spark.createDataFrame([(s, n, d, m) for s, n, d, m in rows], SCHEMA)


def seen(spark, root):
    rows = window_sets.read_window_set(spark, root).collect()
    return sorted(((r.session_id, r.window_number, r.document) for r in rows), key=str)


def test_a_set_is_seen_when_its_manifest_is(spark, tmp_path):
    root = str(tmp_path / "sets")
    assert seen(spark, root) == [] and window_sets.stored_windows(spark, root).isEmpty()
    first = [("a:b/c%", 0, "{}", "m0"), ("a:b/c%", 0, '{"1": {}}', "m0"), (None, 1, "{} ", None)]
    window_sets.write_window_set(documents(spark, first), root, 0)
    window_sets.write_window_documents(documents(spark, [("x", 5, "lost", "m")]), root, 1)
    assert len(seen(spark, root)) == 3 and window_sets.window_set_faults(spark, root).isEmpty()
    # a manifest that was not written to its end doesn't count
    os.makedirs(f"{root}/manifests/batch=1")
    assert len(seen(spark, root)) == 3
    window_sets.write_window_set(documents(spark, [("x", 5, "whole", "m")]), root, 1)
    window_sets.write_window_set(documents(spark, [("x", 5, "whole", "m")]), root, 1)
    assert ("x", 5, "whole") in seen(spark, root) and len(seen(spark, root)) == 4
    stored = {(r.session_id, r.window_number): r for r in window_sets.stored_windows(spark, root).collect()}
    assert (stored["a:b/c%", 0].documents, stored["a:b/c%", 0].bytes, stored["x", 5].window_metadata) == (2, 11, "m")
    folder = f"{root}/windows/batch=1/session_id=x/window_number=5"
    for name in os.listdir(folder):
        if name.endswith(".txt"):
            os.remove(f"{folder}/{name}")
    assert [r.window_number for r in window_sets.window_set_faults(spark, root).collect()] == [5]


def test_removal_is_finished_by_the_next_run(spark, tmp_path):
    root = str(tmp_path / "sets")
    rows = [("a=1", n, "x" * 10, "m") for n in range(6)] + [("b", 0, "y" * 500, "m"), ("b", 1, "z" * 400, "m")]
    window_sets.write_window_set(documents(spark, rows), root, 3)
    window_sets.mark_deletions(spark, root, 35)
    assert [(s, n) for s, n, _ in seen(spark, root)] == [("a=1", 3), ("a=1", 4), ("a=1", 5), ("b", 1)]

    def on_disk():
        found = []
        for session in sorted(os.listdir(f"{root}/windows/batch=3")):
            if session.startswith("session_id="):
                found += sorted((session, w) for w in os.listdir(f"{root}/windows/batch=3/{session}") if w.startswith("window"))
        return found

    assert len(on_disk()) == 8
    window_sets.apply_retention(spark, root, 25)
    expected = [("session_id=a%3D1", "window_number=4"), ("session_id=a%3D1", "window_number=5"), ("session_id=b", "window_number=1")]
    assert on_disk() == expected
    window_sets.finish_deletions(spark, root)
    window_sets.apply_retention(spark, root, 10_000)
    assert on_disk() == expected and len(seen(spark, root)) == 3


def metadata(reference="c"):
    return json.dumps({"gateway": {"installation_reference": "i"}, "nodes": {"0": {}}, "measurement_campaign": {"reference": reference}})


def test_a_mended_sensor_is_replayed_alone(spark, tmp_path):
    source, warehouse = tmp_path / "windows", str(tmp_path / "warehouse")
    os.makedirs(source)
    (source / "w.json").write_text('{"0": {"Acc": [[1.0, 2.0]], "Gyro": "oops"}}')
    (source / "w.json.metadata.json").write_text(metadata())
    loading.ingest_stream(spark, str(source), warehouse, str(tmp_path / "cp")).awaitTermination()
    rows = lambda: sorted(r.sensor_value for r in spark.read.parquet(f"{warehouse}/sensor_data").collect())
    assert rows() == [[2.0]]
    (source / "w.json").write_text('{"0": {"Acc": [[1.0, 2.0]], "Gyro": [[1.0, 3.0]]}}')
    assert loading.replay(spark, str(source), warehouse, "r1") == 0
    assert rows() == [[2.0], [3.0]]
    loading.replay(spark, str(source), warehouse, "r2")
    assert rows() == [[2.0], [3.0]]
    ledger = spark.read.parquet(f"{warehouse}/loaded_windows").collect()
    assert {(r.query == "r1", r.sensor_name) for r in ledger} >= {(False, "Acc"), (True, "Gyro"), (True, None)}


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    rows = [(f"/s{i}/w.json", "0", "Acc", "q", 0) for i in range(50)]
    ledger = spark.createDataFrame(rows, "window_path string, node_id string, sensor_name string, query string, batch bigint")
    path = str(tmp_path / "warehouse")
    ledger.withColumn("bucket", loading._bucket()).write.partitionBy("bucket", "query", "batch").parquet(f"{path}/loaded_windows")
    batch = spark.createDataFrame([("/s7/w.json",), ("/s7/other.json",)], "window_path string")
    found = loading._loaded(spark, batch, path, "other", 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert [r.window_path for r in found.collect()] == ["/s7/w.json"]
    assert loading._loaded(spark, batch, path, "q", 0).isEmpty()


def test_documents_are_parsed_once(spark):
    windows = spark.createDataFrame([("w", '{"0": {"Acc": [[1.0, 2.0]], "Mics": [[1.0, 2.0]]}}', metadata(), 0)], "window_path string, document string, window_metadata string, ingest_seq bigint")
    result = ingest.ingest_windows(windows, literal_table(spark, [], ingest.CAMPAIGN_SCHEMA), literal_table(spark, [], ingest.CONFIGURATION_SCHEMA))
    for frame in (result.sensor_data, result.microphone_data, result.microphone_samples, result.rejects, result.accepted, result.campaigns):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "json_section" not in plan and "Python" not in plan
    folder = result.staged.path.removeprefix("file:")
    assert os.path.isdir(folder)
    result.staged.drop()
    assert not os.path.isdir(folder)


SECTIONS = [
    '{"nodes": {"0": {"acc_freq": 5}}, "gateway": {}}',
    '{ "gateway" : {"nodes": [1,2]},\n "nodes":{"a":[1 , {"b" : "x, y: {z}\\" \\\\"}],"c":null , "d" : 1.5} }',
    '{"nodes": null}', '{"nodes": 5, "x": 1}', '{"nodes": "s:,{"}', "[1]", '{"a": {"nodes": 1}}', '{"nodes": 1, "nodes": [2, 3]}',
    "garbage", '{"x": "nodes", "nodes": {}}', '{"nodes": {}}}', '{"k": ":", "nodes": [[[]], {}, ""]}', "", None, '{"nodes": {"é": "ü"}}',
]


def test_section_text_is_native_and_as_dumped(spark):
    frame = spark.createDataFrame([(d,) for d in SECTIONS], "d string").withColumn("s", text.section_text(F.col("d"), "nodes"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    for row in frame.collect():
        try:
            part = json.loads(row.d).get("nodes")
        except (TypeError, ValueError, AttributeError):
            part = None
        assert row.s == (None if part is None else json.dumps(part, ensure_ascii=False)), row.d


@pytest.mark.parametrize("block_rows", [2, 1 << 18])
def test_next_row(spark, block_rows):
    rows = [(k, i * 3, float(i)) for k in ("a", None) for i in range(7)]
    frame = spark.createDataFrame(rows, "k string, seq bigint, v double")
    got = ordered.next_row(frame, ["k"], "seq", {"v": "after"}, block_rows).collect()
    assert all(r.after == (None if r.v == 6 else r.v + 1) for r in got) and len(got) == 14


def test_lab_times_of_each_kind(spark):
    hz = 65536
    rows = [("s", "0", "Acc", i, t * hz, 10, 0.1) for i, t in enumerate([1, 2, 3, 5])]
    rows += [("s", "0", "Mics", 10 + i, t * hz, 10, 0.1) for i, t in enumerate([1, 2, 9])]
    rows += [("s", "0", "Baros_P", 20 + i, t * hz, 10, 0.1) for i, t in enumerate([1, 2, 9])]
    schema = "session_id string, packet_origin string, sensor_name string, seq bigint, node_ticks bigint, samples_in_packet int, period double"
    ends = {r.seq: r for r in lab.packet_ends(spark.createDataFrame(rows, schema)).collect()}
    assert [round(ends[i].end_time, 6) for i in range(4)] == [2, 3, 5, 6]  # the next packet, and its own end
    assert [ends[i].lost for i in range(4)] == [False, False, False, True]
    assert [round(ends[10 + i].end_time, 6) for i in range(3)] == [2, 3, 4]  # whole packets since the first
    assert [round(ends[20 + i].end_time, 6) for i in range(3)] == [1, 2, 9]  # the ideal clock, set anew
    assert [ends[20 + i].lost for i in range(3)] == [False, False, True]


def test_window_waits_for_metadata(spark, tmp_path):
    source, warehouse, checkpoint = tmp_path / "windows", str(tmp_path / "warehouse"), str(tmp_path / "cp")
    os.makedirs(source)
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.regexp_extract("window_path", r"w-(\d+)\.json", 1).cast("bigint"))
    run = lambda: loading.ingest_paired_stream(spark, str(source), warehouse, checkpoint, "100 seconds", time).awaitTermination()
    write = lambda n: (source / f"w-{n}.json").write_text('{"0": {"Acc": [[%d.0, %d.0]]}}' % (n, n))
    beside = lambda n: (source / f"w-{n}.json.metadata.json").write_text(metadata())
    write(1), write(2), beside(1), beside(30)
    run()
    write(30), beside(2)
    run()
    write(40)
    run()
    write(900), beside(900)
    run()
    data = spark.read.parquet(f"{warehouse}/sensor_data").collect()
    assert sorted(r.sensor_value[0] for r in data) == [1.0, 2.0, 30.0, 900.0]
    assert all(r["datetime"] < datetime.datetime(2000, 1, 1) for r in data)
    rejects = spark.read.parquet(f"{warehouse}/rejects").collect()
    assert [(r.window_path.rsplit("/", 1)[-1], r.reject_reason) for r in rejects] == [("w-40.json", "no_campaign")]


def _tasks(folder):
    """Numbers of the tasks that wrote the files below a folder."""
    return {n.split("-")[1] for _, _, names in os.walk(folder) for n in names if n.startswith("part-")}


def test_windows_of_one_partition_are_written_by_many_tasks(spark, tmp_path):
    root = str(tmp_path / "sets")
    rows = [("s", n, "{}", "m") for n in range(40)]
    window_sets.write_window_set(documents(spark, rows).coalesce(1), root, 0)
    assert len(_tasks(f"{root}/windows")) > 1 and len(seen(spark, root)) == 40
    window_sets.apply_retention(spark, root, 6)
    assert [n for _, n, _ in seen(spark, root)] == [37, 38, 39]


def test_documents_of_one_partition_are_parsed_by_many_tasks(spark):
    rows = [(f"w{i}", '{"0": {"Acc": [[1.0, 2.0]]}}', metadata() if i % 2 else None, i) for i in range(200)]
    windows = spark.createDataFrame(rows, "window_path string, document string, window_metadata string, ingest_seq bigint").coalesce(1)
    result = ingest.ingest_windows(windows, literal_table(spark, [], ingest.CAMPAIGN_SCHEMA), literal_table(spark, [], ingest.CONFIGURATION_SCHEMA))
    assert len(_tasks(result.staged.path.removeprefix("file:"))) > 4
    assert result.sensor_data.count() == 100 and result.rejects.count() == 100
    result.staged.drop()


def test_microphone_files_are_replaced_and_metadata_named(spark, tmp_path):
    schema = "window_path string, node_id string, position int, sample array<double>"
    for value in (1.0, 2.0):
        rows = [("w'1", "a:b", i, [float(i), value]) for i in range(3)] + [("w2", None, 0, [0.0, value])]
        sinks.write_microphone_samples(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "w"))
    files = [p for p in (tmp_path / "w" / "microphone").rglob("*") if p.is_file()]
    assert [p.name for p in files] == ["part-0.parquet"] * 2
    got = spark.read.parquet(str(tmp_path / "w" / "microphone")).collect()
    assert sorted((r.window_path, r.node_id or "", r.position, r["sample"][1]) for r in got) == [("w'1", "a:b", i, 2.0) for i in range(3)] + [("w2", "", 0, 2.0)]
    os.makedirs(tmp_path / "in")
    for name in ("a'b.json", "c d.json", "e.json"):
        (tmp_path / "in" / f"{name}.metadata.json").write_text(name)
    every = read_window_metadata(spark, str(tmp_path / "in"))
    for row in every.collect():
        only = read_window_metadata(spark, str(tmp_path / "in"), [row.window_path])
        assert [r.window_metadata for r in only.collect()] == [row.window_metadata]


def _stored(folder, number):
    """Windows in a folder, each with its metadata beside it."""
    os.makedirs(folder, exist_ok=True)
    for n in range(number):
        (folder / f"w {n}+.json").write_text('{"0": {"Acc": [[1.0, %d.0]]}}' % n)
        (folder / f"w {n}+.json.metadata.json").write_text(metadata())


def test_a_replay_opens_windows_once_and_lists_no_metadata(spark, tmp_path, monkeypatch):
    source, warehouse = tmp_path / "windows", str(tmp_path / "warehouse")
    _stored(source, 3)
    loading.ingest_stream(spark, str(source), warehouse, str(tmp_path / "cp")).awaitTermination()
    _stored(source, 5)
    (source / "w 4+.json.metadata.json").write_text("")  # an empty file is none

    def unsent(stored, loaded):
        for path in source.glob("w ?+.json"):
            path.unlink()
        return ingest.unsent_windows(stored, loaded)

    monkeypatch.setattr(loading, "unsent_windows", unsent)
    monkeypatch.setattr(loading, "_sidecars", None)
    assert loading.replay(spark, str(source), warehouse, "r1") == 2
    assert sorted(r.sensor_value[0] for r in spark.read.parquet(f"{warehouse}/sensor_data").collect()) == [0, 1, 2, 3]
    rejects = spark.read.parquet(f"{warehouse}/rejects").collect()
    assert [(r.window_path.rsplit("/", 1)[-1], r.reject_reason) for r in rejects] == [("w%204+.json", "no_campaign")]


def test_metadata_beside_is_what_a_listing_finds(spark, tmp_path):
    _stored(tmp_path / "a+b c", 2)
    for name, content in (("é%41.json", b"x"), ("b.json", b"\xff{"), ("c.json", b""), ("d.json", None)):
        (tmp_path / "a+b c" / name).write_text("{}")
        if content is not None:
            (tmp_path / "a+b c" / f"{name}.metadata.json").write_bytes(content)
    os.makedirs(tmp_path / "a+b c" / "d.json.metadata.json")
    windows = windows_source.read_windows(spark, str(tmp_path)).select("window_path")
    pairs = lambda frame: sorted((r.window_path, bytes(r.m)) for r in frame.where("m IS NOT NULL").collect())
    listed = windows.join(read_window_metadata(spark, str(tmp_path)), "window_path").select("window_path", F.col("window_metadata").cast("binary").alias("m"))
    opened = windows.select("window_path", windows_source.metadata_beside(F.col("window_path")).cast("binary").alias("m"))
    assert opened.count() == 6 and pairs(opened) == pairs(listed) and len(pairs(opened)) == 4
    assert windows.where(windows_source.is_mounted(F.col("window_path"))).count() == 6


def test_metadata_files_fill_no_batches(spark, tmp_path):
    names = ["n", "on", "json", ".json"[1:], "a.json", "metadata.json", "a.metadata.jsonx", "a.metadata_json", "ametadata.json", "a.etadata.json"]
    beside = ["a.metadata.json", "b.c.metadata.json", "a.json.metadata.json"]
    os.makedirs(tmp_path / "in")
    for name in {*names, *beside}:
        (tmp_path / "in" / name).write_text("{}")
    sizes = []
    stream = loading.new_windows(spark, str(tmp_path / "in"), len(set(names)))
    seen_names = lambda batch, n: sizes.append(sorted(r.window_path.rsplit("/", 1)[-1] for r in batch.collect()))
    loading.for_each_batch(stream, seen_names, str(tmp_path / "cp")).awaitTermination()
    assert sizes == [sorted(set(names))]


def test_sections_come_from_one_scan(spark):
    names = ["nodes", "gateway", "x", "a"]
    frame = spark.createDataFrame([(d,) for d in SECTIONS], "d string")
    frame = frame.select("d", text.section_texts(F.col("d"), names).alias("s"), *[text.section_text(F.col("d"), n).alias(n) for n in names])
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 + len(names)
    for row in frame.collect():
        assert ([None] * 4 if row.s is None else list(row.s)) == [row[n] for n in names], row.d


def test_steps_at_once(spark):
    done = []
    spark.sparkContext.setLocalProperty("test.step", "x")
    note = lambda: done.append(spark.sparkContext.getLocalProperty("test.step"))
    with pytest.raises(ZeroDivisionError):
        at_once(spark, note, lambda: 1 / 0, note)
    spark.sparkContext.setLocalProperty("test.step", None)
    assert done == ["x", "x"]


def test_paired_streams_keep_few_states_and_skip_empty_batches(spark, tmp_path):
    source, warehouse, checkpoint = tmp_path / "windows", str(tmp_path / "warehouse"), tmp_path / "cp"
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.regexp_extract("window_path", r"w%20(\d+)", 1).cast("bigint"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for number in (2, 4):
            _stored(source, number)
            loading.ingest_paired_stream(spark, str(source), warehouse, str(checkpoint), "1 second", time).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    states = [d for d in os.listdir(checkpoint / "state" / "0") if d.isdigit()]
    assert len(states) == loading.STATE_PER_CORE * spark.sparkContext.defaultParallelism < 50
    batches, loaded = len(os.listdir(checkpoint / "commits")) // 2, [*(tmp_path / "warehouse" / "rejects").rglob("batch=*")]
    assert len(loaded) < batches
    assert sorted(r.sensor_value[0] for r in spark.read.parquet(f"{warehouse}/sensor_data").collect()) == [0, 1, 2, 3]
