"""Physical plans of the main path, as they have to be at scale."""

import pytest

from gustline.operators import clock, decode, sensors
from gustline.plans import telemetry

SCHEMA = (
    "session_id string, seq bigint, packet_origin string, packet_type int, packet binary, packet_timestamp double, "
    "packet_length int, node_ticks bigint"
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def packet_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packets") / "t")
    rows = [("s", i, "0", 52 if i % 5 == 0 else 38, bytearray(244), float(i), 244, i) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_control_pass_reads_no_payload(spark, packet_table):
    entries = clock.control_entries(packet_table)
    scans = [line for line in plan_of(entries).split("\n") if "FileScan parquet" in line]
    assert scans and all("packet#" not in line and "IsNotNull(node_ticks)" in line for line in scans)


def test_payload_moves_once_and_is_decoded_once(spark, packet_table):
    result = telemetry.read_telemetry(packet_table, sensors.default_node_sensors(spark, ["0"]))
    plan = plan_of(result.samples)
    assert plan.count("ArrowEvalPython") == 1
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "packet#" in line]
    assert len(scans) == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert result.samples.where("sensor_name = 'Mics'").count() == 40 * 8


def test_words_are_unpacked_once(spark, packet_table):
    assert plan_of(decode.decode_ticks(packet_table)).count("ArrowEvalPython") == 1
