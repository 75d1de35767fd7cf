"""Readers, writers and decoders that the other queries pass by: each on whole tables, through its files where it has some."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_tables.adapters import _hashes, samples_from_events, spread, stage, table, write_files
from driver_tables.packets import _SYNC_WORDS, PACKETS, _signed, _unsigned
from driver_tables.registry import query
from driver_tables.warehouse import _START, SENSOR_CASE, _configurations
from gustline.functions import binary
from gustline.operators import decode, registry, windows
from gustline.session import ensure_checkpoint_dir
from gustline.sources import configuration, sinks
from gustline.streaming import batches


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""WITH s AS (SELECT event_id, CAST(user_id % 6 AS VARCHAR) AS node_id, {SENSOR_CASE} AS sensor_name, event_id // 256 AS part,
  CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 864000e0) AS BIGINT) AS window_number, epoch_us(ts) / 1e6 AS t, value, user_id FROM events)
SELECT node_id, sensor_name, window_number, part, row_number() OVER (PARTITION BY node_id, sensor_name, window_number, part ORDER BY event_id) AS line,
  round(t, 3) AS sample_time, round(value, 6) AS v0, CAST(user_id AS DOUBLE) AS v1 FROM s"""
)
def q_csv_files(spark, sf_dir):
    """Samples as CSV files with a heading, cut into parts of whole packets, read back in the order of their lines."""
    path = _folder(spark, "csv")
    samples = windows.with_window_number(samples_from_events(table(spark, sf_dir, "events")), "packet_timestamp", 864000)
    sinks.write_sensor_csv(samples, path, header=True, packets_per_part=256)
    schema = "value string, node_id string, sensor_name string, window_number bigint, parts bigint"
    lines = spark.read.schema(schema).text(path, wholetext=True)
    rows = lines.select(
        "node_id", "sensor_name", "window_number", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("at", "text")
    )
    cells = F.split("text", ",")
    number = lambda i, digits: F.round(F.get(cells, F.lit(i)).cast("double"), digits)
    placed = rows.where("at > 0").withColumn("part", F.get(cells, F.lit(0)).try_cast("bigint"))
    place = Window.partitionBy("node_id", "sensor_name", "window_number", "part").orderBy("at")
    return placed.select(
        "node_id",
        "sensor_name",
        "window_number",
        "part",
        F.row_number().over(place).alias("line"),
        number(1, 3).alias("sample_time"),
        number(2, 6).alias("v0"),
        number(3, 6).alias("v1"),
    )


@query(
    f"""WITH {PACKETS}, magnetometer AS (SELECT seq, s, c, {_signed("payload", "6 * s + 2 * c", 2)} AS v FROM packets, range(40) a(s), range(3) b(c)
  WHERE packet_type = 38), volts AS (SELECT seq, s, {_unsigned("payload", "4 * s", 4)} / 1e6 AS v FROM packets, range(60) a(s) WHERE packet_type = 52)
SELECT seq, 'Mag' AS sensor_name, CAST(s AS INTEGER) AS position, 3 AS channels, CAST(sum(v * (c + 1)) AS DOUBLE) AS weighted FROM magnetometer GROUP BY seq, s
UNION ALL SELECT seq, 'Analog Vbat', CAST(s AS INTEGER), 2, round(v, 6) FROM volts"""
)
def q_decode_custom(spark, sf_dir):
    """Magnetometer and battery voltmeter packets, which only handle maps of one's own name."""
    from driver_tables.adapters import packets_from_events

    named = F.when(F.col("packet_type") == 38, "IMU Magnetometer").when(F.col("packet_type") == 52, "Analog Vbat")
    packets = packets_from_events(table(spark, sf_dir, "events")).withColumn("packet_type_name", named).where("packet_type_name IS NOT NULL")
    weighted = F.aggregate(
        F.transform("sensor_value", lambda v, i: v * (i + 1)), F.lit(0.0), lambda total, v: total + v
    )
    decoded = decode.decode_packets(packets.select("seq", "packet_origin", "packet_type_name", "packet"))
    return decoded.select("seq", "sensor_name", "position", F.size("sensor_value").alias("channels"), F.round(weighted, 6).alias("weighted"))


@query(
    """SELECT s_name AS path, '7' AS node_id, round(1e0 / (s_nationkey + 1), 9) AS baros_period, (s_nationkey + 10) / 1000e0 AS constat_period,
  'Constat' AS name_of_52, 'little' AS endian FROM supplier WHERE s_suppkey % 10 > 2"""
)
def q_config_documents(spark, sf_dir):
    """Configurations written out as documents with every default and the computed periods, and scanned again."""
    path = _folder(spark, "configurations")
    source = _configurations(spark, sf_dir)
    write_files(source.select(F.concat("path", F.lit(".json")).alias("path"), F.encode("document", "UTF-8").alias("content")), path)
    loaded = configuration.load(configuration.read_configurations(spark, path))
    documents = configuration.to_documents(loaded)
    sinks.write_documents(documents.select(F.to_json(F.struct("path", "document")).alias("document")), f"{path}-written")
    back = spark.read.text(f"{path}-written").select(F.from_json("value", "path string, document string").alias("r")).select("r.*")
    node = lambda field: F.get_json_object("document", f"$.nodes.7.{field}")
    name = F.replace(F.regexp_extract("path", r"([^/]*)\.json$", 1), F.lit("%23"), F.lit("#"))
    again = configuration.load(back.select("path", "document"))
    assert again.rejects.isEmpty()
    return back.where(node("baros_freq").isNotNull()).select(
        name.alias("path"),
        F.lit("7").alias("node_id"),
        F.round(node("periods.Baros_P").cast("double"), 9).alias("baros_period"),
        node("periods.Constat").cast("double").alias("constat_period"),
        F.get_json_object("document", "$.nodes.7.initial_node_handles.52").alias("name_of_52"),
        F.get_json_object("document", "$.gateway.endian").alias("endian"),
    )


@query(
    """SELECT s_name AS path, length(s_name) > 0 AS named, '2024-01-01 00:00:00' AS started,
  CASE WHEN s_suppkey % 10 > 2 THEN '0,7' WHEN s_suppkey % 10 = 2 THEN '1' END AS nodes FROM supplier WHERE s_suppkey % 10 >= 1"""
)
def q_campaign_metadata(spark, sf_dir):
    """Campaigns ready to run: a reference where none was given, the start, the sensors of each node."""
    loaded = configuration.load(_configurations(spark, sf_dir))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    found = configuration.campaign_metadata(loaded, start)
    return found.select(
        "path",
        (F.length("reference") > 0).alias("named"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.array_join(F.array_sort(F.map_keys("nodes")), ",").alias("nodes"),
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_exists(spark, sf_dir):
    """Rows whose key a table knows."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return registry.exists_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "c_custkey")


@query(
    f"""WITH p AS (SELECT o_orderkey AS seq, o_orderkey % 6 AS kind, {_SYNC_WORDS} AS h FROM orders)
SELECT seq, kind, CAST(i AS INTEGER) AS position, CASE WHEN kind = 0 AND i >= 15 AND v >= 2147483648 THEN v - 4294967296 ELSE v END AS value
FROM (SELECT seq, kind, i, {_unsigned("h", "4 * i", 4)} AS v FROM p, range(61) r(i)
  WHERE i < CASE WHEN kind = 0 THEN 18 WHEN kind = 1 THEN 60 WHEN kind <= 4 THEN 61 ELSE 0 END)"""
)
def q_dump_files(spark, sf_dir):
    """Time synchronisation dumps of two batches appended to their table, one of them written twice, and read back."""
    path = _folder(spark, "time-sync")
    kind = binary.little_endian_bytes(F.col("o_orderkey") % 6, 4)
    packets = stage(
        spread(table(spark, sf_dir, "orders")).select(
            F.col("o_orderkey").alias("seq"), F.concat(F.lit(bytes([1])), kind, _hashes("o_orderkey", 16)).alias("packet")
        )
    )
    words = decode.decode_time_sync(packets)
    for batch in (0, 1, 1):
        sinks.write_rows(words.where(F.col("seq") % 2 == batch), path, f"batch={batch}")
    return spark.read.parquet(path).select("seq", "kind", "position", "value")


@query(
    """SELECT user_id % 6 AS origin, 'all' AS writer, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT user_id % 6, 'errors', count(*) FROM events WHERE event_type = 'error' GROUP BY ALL"""
)
def q_fan_out(spark, sf_dir):
    """One stream to two writers of one's own, each batch computed once."""
    base = _folder(spark, "fan-out")
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).alias("origin"), "event_type")
    events.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    every = lambda batch, number: sinks.write_rows(batch.select("origin", F.lit("all").alias("writer")), f"{base}/out", f"all={number}")
    errors = lambda batch, number: sinks.write_rows(
        batch.where("event_type = 'error'").select("origin", F.lit("errors").alias("writer")), f"{base}/out", f"errors={number}"
    )
    batches.for_each_batch(stream, batches.fan_out(every, errors), f"{base}/checkpoint").awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return found.groupBy("origin", "writer").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS (SELECT c_custkey AS seq, c_custkey % 9 AS n, md5(c_custkey || ':0') || md5(c_custkey || ':1') || md5(c_custkey || ':2') AS h FROM customer)
SELECT seq, CAST(i AS INTEGER) AS position, {_unsigned("h", "4 * i", 4, True)} AS tick FROM p, range(9) r(i) WHERE i < n AND seq % 2 = 0
UNION ALL SELECT seq, CAST(i AS INTEGER), {_unsigned("h", "4 * i", 4)} FROM p, range(9) r(i) WHERE i < n AND seq % 2 = 1"""
)
def q_ticks_by_endian(spark, sf_dir):
    """Words of payloads whose byte order differs from row to row."""
    size = (F.col("c_custkey") % 9 * 4 + 3).cast("int")
    packets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.substring(_hashes("c_custkey", 3), F.lit(1), size).alias("packet"),
        F.when(F.col("c_custkey") % 2 == 0, "big").otherwise("little").alias("endian"),
    )
    return decode.decode_ticks(packets, F.col("endian")).select("seq", "position", "tick")
