"""Windows, ingest, dimension tables, configuration and streams on the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driver_tables.adapters import micros, packets_from_events, samples_from_events, table
from driver_tables.packets import ALIGNED, BLOCK_ROWS, LOST, SLACK_SECONDS
from driver_tables.registry import query
from gustline import catalogue as cat
from gustline.functions import text
from gustline.operators import decode, gaps, registry, sensors, validation, windows
from gustline.plans import ingest, telemetry
from gustline.session import ensure_checkpoint_dir, literal_table
from gustline.sources import configuration
from gustline.sources.windows import window_samples
from gustline.streaming import batches

SENSOR_CASE = """CASE event_type WHEN 'click' THEN 'Acc' WHEN 'view' THEN 'Mics' WHEN 'purchase' THEN 'Constat'
  WHEN 'error' THEN 'Baros_P' ELSE 'Door' END"""
REFERENCE_CASE = """CASE event_type WHEN 'click' THEN 'accelerometer' WHEN 'view' THEN 'microphone'
  WHEN 'purchase' THEN 'connection_statistics' WHEN 'error' THEN 'barometer' END"""
_START = "(SELECT min(epoch_us(ts)) / 1e6 FROM events)"


@query(
    """SELECT epoch_us(ts) // 600000000 * 600000000 AS window_start_us, CAST(user_id % 6 AS VARCHAR) AS node_id, event_type,
  count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM events GROUP BY ALL"""
)
def q_window_batch(spark, sf_dir):
    """Ten-minute windows per node and type."""
    events = table(spark, sf_dir, "events").select(
        "ts", (F.col("user_id") % 6).cast("string").alias("node_id"), "event_type", "value"
    )
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_cents")
    totals = windows.window_totals(
        events, F.col("ts"), "600 seconds", ["node_id", "event_type"], [F.count("*").alias("n"), cents]
    )
    return totals.select(micros("window_start").alias("window_start_us"), "node_id", "event_type", "n", "total_cents")


@query(
    f"""SELECT CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 600e0) AS BIGINT) AS window_number, count(*) AS n
FROM events GROUP BY ALL"""
)
def q_window_numbers(spark, sf_dir):
    """Windows numbered from the session's start."""
    numbered = windows.with_window_number(
        samples_from_events(table(spark, sf_dir, "events")), "packet_timestamp", 600
    )
    return numbered.groupBy("window_number").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE p AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS t, user_id % 50 AS gateway FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY seq) AS k FROM p),
f AS (SELECT seq, gateway, k, t AS start_time, 0 AS window_number FROM n WHERE k = 1
  UNION ALL
  SELECT n.seq, n.gateway, n.k, CASE WHEN n.t - f.start_time >= 20000 THEN n.t ELSE f.start_time END,
    f.window_number + CASE WHEN n.t - f.start_time >= 20000 THEN 1 ELSE 0 END
  FROM f JOIN n ON n.gateway = f.gateway AND n.k = f.k + 1)
SELECT seq, gateway, CAST(window_number AS BIGINT) AS window_number FROM f"""
)
def q_arrival_windows(spark, sf_dir):
    """Windows that close on the first arrival after their length and start anew there."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (micros() / 1e6).alias("arrival"), (F.col("user_id") % 50).alias("gateway")
    )
    return windows.arrival_windows(events, "arrival", 20000, ["gateway"], BLOCK_ROWS).select(
        "seq", "gateway", "window_number"
    )


def _documents(spark, sf_dir):
    return telemetry.samples_to_documents(samples_from_events(table(spark, sf_dir, "events")), 86400, packets_per_part=64)


@query(
    f"""WITH s AS (SELECT CAST(user_id % 6 AS VARCHAR) AS node_id, {SENSOR_CASE} AS sensor_name, event_id, epoch_us(ts) / 1e6 AS t, value,
  CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 86400e0) AS BIGINT) AS window_number, CAST(user_id AS DOUBLE) AS u FROM events),
n AS (SELECT *, event_id // 64 AS part, row_number() OVER (PARTITION BY window_number, node_id, sensor_name, event_id // 64 ORDER BY event_id) - 1 AS rn FROM s)
SELECT window_number, part, node_id, sensor_name, CAST(rn AS INTEGER) AS position, t AS sample_time, value AS v0, u AS v1 FROM n"""
)
def q_window_json(spark, sf_dir):
    """Window documents, written out as JSON and read back."""
    sample = F.col("sample")
    return window_samples(_documents(spark, sf_dir)).select(
        "window_number",
        "part",
        "node_id",
        "sensor_name",
        "position",
        sample[0].alias("sample_time"),
        sample[1].alias("v0"),
        sample[2].alias("v1"),
    )


@query(
    f"""SELECT {SENSOR_CASE} AS sensor_name, {REFERENCE_CASE} AS sensor_type_reference,
  CASE WHEN event_type = 'signup' THEN 'unknown_sensor' ELSE 'none' END AS reject_reason, count(*) AS n FROM events GROUP BY ALL"""
)
def q_sensor_type_map(spark, sf_dir):
    samples = samples_from_events(table(spark, sf_dir, "events")).withColumn(
        "sensor_type_reference", sensors.sensor_type_reference()
    )
    known = ingest.is_known_sensor()
    return samples.groupBy(
        "sensor_name",
        "sensor_type_reference",
        F.when(known, "none").otherwise("unknown_sensor").alias("reject_reason"),
    ).agg(F.count("*").alias("n"))


@query(
    f"""SELECT epoch_us(ts) AS datetime_us, CAST(user_id % 6 AS VARCHAR) AS node_id, {REFERENCE_CASE} AS sensor_type_reference,
  value AS v0, CAST(user_id AS DOUBLE) AS v1, CAST(2 AS INTEGER) AS channels FROM events WHERE event_type <> 'signup'"""
)
def q_sensor_data_long(spark, sf_dir):
    """Window documents to rows of the long table."""
    samples = window_samples(_documents(spark, sf_dir)).where(ingest.is_known_sensor())
    value = F.col("sensor_value")
    return ingest.to_sensor_data(samples).select(
        F.unix_micros("datetime").alias("datetime_us"),
        "node_id",
        "sensor_type_reference",
        value[0].alias("v0"),
        value[1].alias("v1"),
        F.size(value).alias("channels"),
    )


_MIC_ROWS = f"""n AS (SELECT epoch_us(ts) AS us, value, CAST(user_id % 6 AS VARCHAR) AS node_id, event_id,
  CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 86400e0) AS BIGINT) AS window_number FROM events WHERE event_type = 'view'),
r AS (SELECT *, event_id // 64 AS part, row_number() OVER (PARTITION BY window_number, node_id, event_id // 64 ORDER BY event_id) - 1 AS rn FROM n),
m AS (SELECT *, 'events/window-' || window_number || '-' || part || '.json' AS window_path FROM r)"""


def _microphones(spark, sf_dir):
    path = F.concat(
        F.lit("events/window-"), F.col("window_number").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit(".json")
    )
    documents = _documents(spark, sf_dir).withColumn("window_path", path)
    return window_samples(documents).where(F.col("sensor_name") == cat.MICROPHONE)


@query(
    f"""WITH {_MIC_ROWS} SELECT window_path, node_id, CAST(rn AS INTEGER) AS position, us / 1e6 AS sample_time, value AS v0 FROM m"""
)
def q_mic_split(spark, sf_dir):
    """Microphone rows split off their windows."""
    return _microphones(spark, sf_dir).select(
        "window_path", "node_id", "position", F.col("sample")[0].alias("sample_time"), F.col("sample")[1].alias("v0")
    )


@query(
    f"""WITH {_MIC_ROWS} SELECT min(us) AS datetime_us, 'microphone/window_id=' || substr(sha256(window_path), 1, 16) || '/node_id=' || node_id AS path,
  node_id, count(*) AS samples FROM m GROUP BY window_path, node_id"""
)
def q_mic_catalog(spark, sf_dir):
    """Where each window's microphone rows lie and when they start."""
    catalogue = ingest.microphone_catalogue(_microphones(spark, sf_dir))
    return catalogue.select(F.unix_micros("datetime").alias("datetime_us"), "path", "node_id", "samples")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 40.96e0 AS v0, l_extendedprice / 40.96e0 AS v1,
  l_discount / 2e0 AS d0, l_tax / 4e0 AS d1 FROM lineitem"""
)
def q_calibrate(spark, sf_dir):
    """Channels divided by their constants: one constant for all, or one each."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.withColumn("sensor_value", F.array("l_quantity", "l_extendedprice")).withColumn(
        "conversion_constants", sensors.expand_constants(F.lit("40.96"), F.lit(2))
    )
    same = decode.calibrate(one).withColumnRenamed("sensor_value", "_same")
    each = same.withColumn("sensor_value", F.array("l_discount", "l_tax")).withColumn(
        "conversion_constants", sensors.expand_constants(F.lit("[2, 4]"), F.lit(2))
    )
    value, first = F.col("sensor_value"), F.col("_same")
    return decode.calibrate(each).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        first[0].alias("v0"),
        first[1].alias("v1"),
        value[0].alias("d0"),
        value[1].alias("d1"),
    )


# --- registration ---------------------------------------------------------------------------------------------

_TYPE_CANDIDATES = """
c AS (SELECT p_partkey AS ingest_seq, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN NULL
    ELSE trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') END AS reference,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name, p_type AS description,
  nullif(CASE WHEN p_size > 25 THEN 'mm' ELSE '' END, '') AS measuring_unit,
  CASE WHEN p_size % 2 = 0 THEN '{"size": ' || p_size || '}' END AS metadata FROM part),
existing AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS reference FROM part WHERE p_size = 7),
checked AS (SELECT *, name IS NULL OR trim(name) = '' AS no_name, reference IS NULL OR trim(reference) = '' AS no_reference,
  NOT regexp_full_match(reference, '[a-z0-9]+(-[a-z0-9]+)*') AS no_slug FROM c),
valid AS (SELECT * FROM checked WHERE NOT no_name AND NOT no_reference AND NOT no_slug),
firsts AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY reference ORDER BY ingest_seq) = 1),
accepted AS (SELECT * FROM firsts WHERE reference NOT IN (SELECT reference FROM existing))"""


def _sensor_types(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    slug = text.slugify(F.concat_ws(" ", "p_name", "p_brand"))
    size = F.col("p_size")
    candidates = part.select(
        F.col("p_partkey").alias("ingest_seq"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_name"))
        .when(F.col("p_partkey") % 5 == 1, F.lit(None))
        .otherwise(slug)
        .alias("reference"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"),
        F.col("p_type").alias("description"),
        text.if_truthy_text(F.when(size > 25, "mm").otherwise("")).alias("measuring_unit"),
        F.when(size % 2 == 0, F.concat(F.lit('{"size": '), size.cast("string"), F.lit("}"))).alias("metadata"),
    )
    existing = part.where("p_size = 7").select(slug.alias("reference")).distinct()
    return registry.register_sensor_types(candidates, existing)


@query(
    f"""WITH {_TYPE_CANDIDATES} SELECT reference, name, description, measuring_unit AS unit, coalesce(metadata, '{{}}') AS metadata FROM accepted"""
)
def q_register_types(spark, sf_dir):
    """Sensor types accepted from a batch of candidates."""
    return _sensor_types(spark, sf_dir).accepted


@query(
    f"""WITH {_TYPE_CANDIDATES} SELECT ingest_seq, reference, name FROM valid WHERE ingest_seq NOT IN (SELECT ingest_seq FROM accepted)"""
)
def q_register_conflicts(spark, sf_dir):
    """Valid candidates whose reference was taken."""
    return _sensor_types(spark, sf_dir).conflicts.select("ingest_seq", "reference", "name")


@query(
    f"""WITH {_TYPE_CANDIDATES} SELECT ingest_seq, CASE WHEN no_name THEN '{validation.REQUIRED}' END AS name_error,
  CASE WHEN no_reference THEN '{validation.REQUIRED}' WHEN no_slug THEN '{validation.SLUGIFIED}' END AS reference_error
FROM checked WHERE no_name OR no_reference OR no_slug"""
)
def q_validate_rows(spark, sf_dir):
    """Invalid candidates with one message per field."""
    return _sensor_types(spark, sf_dir).invalid.select(
        "ingest_seq",
        F.col("field_errors")["name"].alias("name_error"),
        F.col("field_errors")["reference"].alias("reference_error"),
    )


_INSTALLATIONS = r"""
c AS (SELECT c_custkey AS ingest_seq, lower(c_mktsegment) || '-' || (c_custkey % 400) AS reference, 'turbine-' || c_nationkey AS turbine_id,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE '1.' || (c_custkey % 4) END AS receiver_firmware_version,
  CASE c_custkey % 10 WHEN 0 THEN 'not-a-number' WHEN 1 THEN NULL WHEN 2 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) || '.25' END AS longitude,
  CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN '1e' ELSE CAST(c_custkey % 90 AS VARCHAR) || '.5' END AS latitude FROM customer),
checked AS (SELECT *, trim(receiver_firmware_version) = '' AS no_version,
  longitude IS NOT NULL AND trim(longitude) <> '' AND try_cast(longitude AS DOUBLE) IS NULL AS bad_longitude,
  latitude IS NOT NULL AND trim(latitude) <> '' AND try_cast(latitude AS DOUBLE) IS NULL AS bad_latitude FROM c),
valid AS (SELECT * FROM checked WHERE NOT no_version AND NOT bad_longitude AND NOT bad_latitude),
existing AS (SELECT DISTINCT lower(c_mktsegment) || '-' || (c_custkey % 400) AS reference FROM customer WHERE c_nationkey = 3),
accepted AS (SELECT *, try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lon FROM valid
  WHERE reference NOT IN (SELECT reference FROM existing) QUALIFY row_number() OVER (PARTITION BY reference ORDER BY ingest_seq) = 1)"""


@query(
    f"""WITH {_INSTALLATIONS} SELECT reference, turbine_id, receiver_firmware_version,
  CASE WHEN lat <> 0 AND lon <> 0 THEN 'POINT (' || printf('%.16f', lat) || ' ' || printf('%.16f', lon) || ')' END AS location FROM accepted"""
)
def q_register_installations(spark, sf_dir):
    """Installations accepted from a batch, with their location."""
    customer = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    reference = F.concat(F.lower("c_mktsegment"), F.lit("-"), (key % 400).cast("string"))
    candidates = customer.select(
        key.alias("ingest_seq"),
        reference.alias("reference"),
        F.concat(F.lit("turbine-"), nation).alias("turbine_id"),
        F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit("1."), (key % 4).cast("string"))).alias(
            "receiver_firmware_version"
        ),
        F.when(key % 10 == 0, "not-a-number")
        .when(key % 10 == 1, F.lit(None))
        .when(key % 10 == 2, "0")
        .otherwise(F.concat(nation, F.lit(".25")))
        .alias("longitude"),
        F.when(key % 11 == 0, "")
        .when(key % 11 == 1, "1e")
        .otherwise(F.concat((key % 90).cast("string"), F.lit(".5")))
        .alias("latitude"),
    )
    existing = customer.where("c_nationkey = 3").select(reference.alias("reference"))
    return registry.register_installations(candidates, existing).accepted


_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


@query(
    f"""WITH h AS (SELECT event_id, props, event_type, sha256(props) AS hash FROM events),
f AS (SELECT hash, min(props) AS props, arg_min(event_type, event_id) AS gateway FROM h GROUP BY hash),
known AS (SELECT DISTINCT sha256(props) AS hash FROM events WHERE props LIKE '%1%')
SELECT {_UUID.format(h="sha256(hash)")} AS id, props AS nodes_configuration, hash AS nodes_configuration_hash,
  gateway AS gateway_configuration, sha256(gateway) AS gateway_configuration_hash
FROM f WHERE hash NOT IN (SELECT hash FROM known)"""
)
def q_config_dedupe(spark, sf_dir):
    """Configurations not stored yet, one per distinct nodes text."""
    events = table(spark, sf_dir, "events")
    incoming = events.select(
        F.col("event_id").alias("ingest_seq"),
        F.col("props").alias("nodes_configuration"),
        F.col("event_type").alias("gateway_configuration"),
    )
    known = events.where("props LIKE '%1%'").select(text.content_hash(F.col("props")).alias("nodes_configuration_hash"))
    existing = known.distinct().withColumn("id", F.lit("known"))
    return registry.deduplicate_configurations(incoming, existing).new


_CAMPAIGN_SPLIT = "o_orderdate < TIMESTAMP '1997-01-01'"


@query(
    f"""WITH old AS (SELECT CAST(o_custkey AS VARCHAR) AS reference, arg_min(o_orderdate, o_orderkey) AS start_time, arg_max(o_orderdate, o_orderkey) AS end_time,
    arg_min(o_orderpriority, o_orderkey) AS label FROM orders WHERE {_CAMPAIGN_SPLIT} GROUP BY o_custkey),
new AS (SELECT CAST(o_custkey AS VARCHAR) AS reference, arg_min(o_orderdate, o_orderkey) AS start_time, arg_max(o_orderdate, o_orderkey) AS end_time,
    arg_min(o_orderpriority, o_orderkey) AS label FROM orders WHERE NOT ({_CAMPAIGN_SPLIT}) GROUP BY o_custkey)
SELECT coalesce(old.reference, new.reference) AS reference, epoch_us(coalesce(old.start_time, new.start_time)) AS start_us,
  epoch_us(coalesce(new.end_time, old.end_time)) AS end_us, CASE WHEN old.reference IS NOT NULL THEN old.label ELSE new.label END AS label
FROM old FULL JOIN new USING (reference)"""
)
def q_campaign_upsert(spark, sf_dir):
    """A campaign table after a batch of updates."""
    orders = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'")
    updates = orders.select(
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_custkey").cast("string").alias("reference"),
        F.col("o_orderdate").alias("start_time"),
        F.col("o_orderdate").alias("end_time"),
        F.lit("site").alias("installation_reference"),
        F.lit("{}").alias("nodes"),
        F.col("o_orderpriority").alias("label"),
        F.lit(None).cast("string").alias("description"),
        early.alias("_early"),
    )
    nothing = updates.where("false").select(*registry.CAMPAIGN_COLUMNS)
    stored = registry.upsert_campaigns(nothing, updates.where("_early"))
    result = registry.upsert_campaigns(stored, updates.where("NOT _early"))
    return result.select(
        "reference", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "label"
    )


def _window_batch(spark, sf_dir):
    """Window documents with a configuration: three campaigns, nodes texts that repeat."""
    number = F.col("window_number")
    metadata = F.format_string(
        '{"gateway": {"installation_reference": "site-%d"}, "nodes": {"0": {"acc_freq": %d}}, "measurement_campaign": '
        '{"reference": "campaign-%d", "start_time": "2024-01-01 00:00:00", "end_time": "2024-02-%02d 00:00:00", '
        '"label": null, "description": null, "nodes": {"0": ["Acc"]}}}',
        number % 2,
        number % 4,
        number % 3,
        number % 28 + 1,
    )
    path = F.format_string("events/window-%d-%d.json", "window_number", "part")
    return _documents(spark, sf_dir).select(
        path.alias("window_path"),
        "document",
        metadata.alias("window_metadata"),
        (number * 100000 + F.col("part")).alias("ingest_seq"),
    )


def _ingested(spark, sf_dir):
    windows_ = _window_batch(spark, sf_dir)
    from gustline.session import literal_table

    return ingest.ingest_windows(
        windows_,
        literal_table(spark, [], ingest.CAMPAIGN_SCHEMA),
        literal_table(spark, [], ingest.CONFIGURATION_SCHEMA),
    )


_NODES_HASH = """sha256('{"0": {"acc_freq": ' || (window_number % 4) || '}}')"""


@query(
    f"""WITH s AS (SELECT *, CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 86400e0) AS BIGINT) AS window_number FROM events WHERE event_type NOT IN ('signup', 'view'))
SELECT epoch_us(ts) AS datetime_us, CAST(user_id % 6 AS VARCHAR) AS node_id, {REFERENCE_CASE} AS sensor_type_reference, value AS v0,
  {_UUID.format(h=f"sha256({_NODES_HASH})")} AS configuration_id, 'site-' || (window_number % 2) AS installation_reference,
  'campaign-' || (window_number % 3) AS measurement_campaign_reference FROM s"""
)
def q_ingest_windows(spark, sf_dir):
    """A batch of windows into the long table, with configuration, installation and campaign."""
    return _ingested(spark, sf_dir).sensor_data.select(
        F.unix_micros("datetime").alias("datetime_us"),
        "node_id",
        "sensor_type_reference",
        F.col("sensor_value")[0].alias("v0"),
        *ingest.OWNER_COLUMNS,
    )


@query(
    f"""WITH s AS (SELECT DISTINCT CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 86400e0) AS BIGINT) AS window_number FROM events)
SELECT 'campaign-' || (window_number % 3) AS reference, '2024-02-' || printf('%02d', arg_max(window_number, window_number) % 28 + 1) AS end_day,
  'site-' || (arg_min(window_number, window_number) % 2) AS installation_reference, '{{"0":["Acc"]}}' AS nodes FROM s GROUP BY window_number % 3"""
)
def q_ingest_campaigns(spark, sf_dir):
    """The campaign table that a batch of windows leaves."""
    return _ingested(spark, sf_dir).campaigns.select(
        "reference", F.date_format("end_time", "yyyy-MM-dd").alias("end_day"), "installation_reference", "nodes"
    )


@query(
    f"""WITH s AS (SELECT CAST(user_id % 6 AS VARCHAR) AS node_id, {SENSOR_CASE} AS sensor_name, event_id,
  CAST(floor((epoch_us(ts) / 1e6 - {_START}) / 86400e0) AS BIGINT) AS window_number FROM events),
n AS (SELECT *, event_id // 64 AS part FROM s)
SELECT 'events/window-' || window_number || '-' || part || '.json' AS window_path, node_id,
  CAST(count_if(sensor_name IN ('Acc', 'Baros_P')) AS BIGINT) AS rows, count_if(sensor_name IN ('Acc', 'Baros_P')) = 0 AS empty FROM n GROUP BY ALL"""
)
def q_inserted_per_node(spark, sf_dir):
    """Rows per window and node, nodes without any included."""
    batch = _window_batch(spark, sf_dir)
    loaded = window_samples(batch.select("window_path", "document")).where(F.col("sensor_name").isin("Acc", "Baros_P"))
    return ingest.inserted_per_node(batch, loaded)


_STORED = "stored AS (SELECT o_orderkey AS window_number, 'session-' || (o_custkey % 20) AS session_id, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)"


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("window_number"),
        F.concat(F.lit("session-"), (F.col("o_custkey") % 20).cast("string")).alias("session_id"),
        F.floor("o_totalprice").alias("bytes"),
        F.format_string("window-%d.json", "o_orderkey").alias("path"),
    )


@query(
    f"""WITH {_STORED}, r AS (SELECT *, sum(bytes) OVER (PARTITION BY session_id ORDER BY window_number DESC) AS kept,
  row_number() OVER (PARTITION BY session_id ORDER BY window_number DESC) AS rn FROM stored)
SELECT session_id, window_number, bytes, CAST(kept AS BIGINT) AS bytes_kept, rn = 1 OR kept <= 10000000 AS keep, kept >= 9000000 AS near_limit FROM r"""
)
def q_retention(spark, sf_dir):
    """Stored windows within a byte budget, newest first."""
    kept = windows.retention(_stored(spark, sf_dir), 10_000_000, block_rows=BLOCK_ROWS)
    return kept.select("session_id", "window_number", "bytes", "bytes_kept", "keep", "near_limit")


@query(
    f"""WITH {_STORED} SELECT session_id, CAST(sum(bytes) AS BIGINT) AS stored_bytes, count(*) AS windows,
  'window-' || min(window_number) || '.json' AS oldest_path FROM stored GROUP BY session_id"""
)
def q_stored_totals(spark, sf_dir):
    return windows.stored_totals(_stored(spark, sf_dir))


@query(
    """SELECT 'window-' || o_orderkey AS window_path, o_totalprice AS bytes FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def q_unsent(spark, sf_dir):
    """Staged windows that were never loaded."""
    path = lambda key: F.concat(F.lit("window-"), F.col(key).cast("string")).alias("window_path")
    staged = table(spark, sf_dir, "orders").select(path("o_orderkey"), F.col("o_totalprice").alias("bytes"))
    loaded = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(path("l_orderkey"))
    return ingest.unsent_windows(staged, loaded)


# --- configuration --------------------------------------------------------------------------------------------

# fixed values, written out once more: sensor, samples in a packet, channels; and seconds between samples
_SENSOR_ROWS = """('Mics', 8, 10), ('Baros_P', 1, 40), ('Baros_T', 1, 40), ('Diff_Baros', 24, 5), ('Acc', 40, 3), ('Gyro', 40, 3),
  ('Mag', 40, 3), ('Analog Vbat', 60, 2), ('Constat', 24, 4), ('battery_info', 1, 3)"""
_DEFAULT_PERIODS = """('Mics', 1 / 15625e0), ('Baros_P', 1 / 100e0), ('Baros_T', 1 / 100e0), ('Diff_Baros', 1 / 1000e0), ('Acc', 1 / 100e0),
  ('Gyro', 1 / 100e0), ('Mag', 1 / 12.5e0), ('Analog Vbat', 1 / 16384e0), ('Constat', 45 / 1000e0), ('battery_info', 3600e0)"""


def _configurations(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    node = F.format_string(
        '{"baros_freq": %d, "constat_period": %d, "sensor_conversion_constants": {"Acc": [1, 2, %d], "Mics": %d}}',
        nation + 1,
        nation + 10,
        nation + 3,
        nation + 2,
    )
    document = (
        F.when(key % 10 == 0, F.lit('{"gateway": {}, "nodes": {}}'))
        .when(key % 10 == 1, F.lit('{"gateway": {}, "nodes": {"1": {"speed": 3}}, "measurement_campaign": {}}'))
        .when(
            key % 10 == 2,
            F.lit(
                '{"gateway": {}, "nodes": {"1": {"sensor_conversion_constants": {"Acc": [1]}}}, "measurement_campaign": {}}'
            ),
        )
        .otherwise(
            F.concat(F.lit('{"gateway": {"turbine_id": "t"}, "nodes": {"0": {}, "7": '), node, F.lit('}, "measurement_campaign": {}}'))
        )
    )
    return supplier.select(F.col("s_name").alias("path"), document.alias("document"))


@query(
    f"""WITH sensors(sensor_name, samples, channels) AS (VALUES {_SENSOR_ROWS}), periods(sensor_name, period) AS (VALUES {_DEFAULT_PERIODS}),
s AS (SELECT * FROM supplier WHERE s_suppkey % 10 > 2)
SELECT s_name AS path, '0' AS node_id, sensor_name, CAST(period AS DOUBLE) AS period, CAST(samples AS INTEGER) AS samples_in_packet,
  CAST(channels AS INTEGER) AS channels, CASE sensor_name WHEN 'Baros_P' THEN 40.96e0 WHEN 'Baros_T' THEN 100e0 ELSE 1e0 END AS last_constant
FROM s, sensors JOIN periods USING (sensor_name)
UNION ALL
SELECT s_name, '7', sensor_name, CAST(period AS DOUBLE), CAST(samples AS INTEGER), CAST(channels AS INTEGER),
  CASE sensor_name WHEN 'Acc' THEN s_nationkey + 3 ELSE s_nationkey + 2 END
FROM s, sensors JOIN periods USING (sensor_name) WHERE sensor_name IN ('Acc', 'Mics')"""
)
def q_node_sensors(spark, sf_dir):
    """Sensor facts of configured nodes, with defaults filled in."""
    loaded = configuration.load(_configurations(spark, sf_dir))
    constants = F.col("conversion_constants")
    return loaded.node_sensors.select(
        "path",
        "node_id",
        "sensor_name",
        "period",
        "samples_in_packet",
        F.size(constants).alias("channels"),
        F.element_at(constants, -1).alias("last_constant"),
    )


@query(
    """SELECT s_name AS path, CASE s_suppkey % 10 WHEN 0 THEN 'missing_section: measurement_campaign' WHEN 1 THEN 'unknown_node_field: speed'
  ELSE 'bad_conversion_constants: Acc' END AS reject_reason FROM supplier WHERE s_suppkey % 10 <= 2"""
)
def q_config_rejects(spark, sf_dir):
    """Configurations that break a rule."""
    return configuration.load(_configurations(spark, sf_dir)).rejects.select("path", "reject_reason")


@query(
    """SELECT s_name AS path, node_id, CASE WHEN node_id = '0' THEN 100e0 ELSE s_nationkey + 1 END AS baros_freq,
  CASE WHEN node_id = '0' THEN 45e0 ELSE s_nationkey + 10 END AS constat_period, 15625e0 AS mics_freq, 'unknown' AS blade_id, 16 AS handles
FROM supplier, (VALUES ('0'), ('7')) n(node_id) WHERE s_suppkey % 10 > 2
UNION ALL SELECT s_name, '1', 100e0, 45e0, 15625e0, 'unknown', 16 FROM supplier WHERE s_suppkey % 10 = 2"""
)
def q_config_defaults(spark, sf_dir):
    """Node configurations with every default filled in."""
    nodes = configuration.load(_configurations(spark, sf_dir)).nodes
    return nodes.select(
        "path", "node_id", "baros_freq", "constat_period", "mics_freq", "blade_id", F.size("initial_node_handles").alias("handles")
    )


# --- streams --------------------------------------------------------------------------------------------------

SLICES = 3


def _stream_in_slices(spark, rows, name, handler):
    """Feeds all rows to a stream in ``seq`` order: a slice is written, drained, and the query stops and resumes."""
    base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    handle = handler(base)
    bounds = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(SLICES):
        low, high = bounds * i // SLICES, bounds * (i + 1) // SLICES
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        batches.for_each_batch(stream, handle, f"{base}/checkpoint").awaitTermination()
    return base


def _keep(base):
    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    return write


@query(f"WITH {ALIGNED} SELECT seq, packet_origin, packet_type_name, time_offset, abs_time FROM aligned")
def q_stream_offsets(spark, sf_dir):
    """Clock and handle tracking over micro-batches."""
    base = _stream_in_slices(
        spark,
        packets_from_events(table(spark, sf_dir, "events")),
        "align",
        lambda base: batches.align_stream(f"{base}/state", _keep(base), block_rows=BLOCK_ROWS),
    )
    return spark.read.parquet(f"{base}/out").select(
        "seq", "packet_origin", "packet_type_name", "time_offset", F.col("timestamp").alias("abs_time")
    )


@query(
    f"""WITH RECURSIVE {LOST} SELECT seq, packet_origin, sensor_name, k AS packet_ordinal, lost, round(gap_ms, 3) AS gap_ms FROM f"""
)
def q_stream_gaps(spark, sf_dir):
    """Lost packets over micro-batches."""
    from driver_tables.adapters import sensor_packets_from_events

    base = _stream_in_slices(
        spark,
        sensor_packets_from_events(table(spark, sf_dir, "events")),
        "gaps",
        lambda base: batches.lost_sets_stream(f"{base}/state", _keep(base), SLACK_SECONDS, BLOCK_ROWS),
    )
    return spark.read.parquet(f"{base}/out").select(
        "seq", "packet_origin", "sensor_name", "packet_ordinal", "lost", F.round("gap_ms", 3).alias("gap_ms")
    )


@query(
    """SELECT epoch_us(ts) // 600000000 * 600000000 AS window_start_us, CAST(user_id % 6 AS VARCHAR) AS node_id, count(*) AS n,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL"""
)
def q_stream_windows(spark, sf_dir):
    """Ten-minute windows over micro-batches, merged."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 6).cast("string").alias("node_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    base = _stream_in_slices(
        spark,
        rows,
        "windows",
        lambda base: batches.window_totals_stream(
            f"{base}/totals", f"{base}/late", f"{base}/state", "ts", "cents", "600 seconds", 3600.0, ["node_id"]
        ),
    )
    merged = batches.merged_totals(spark.read.parquet(f"{base}/totals"), ["node_id"])
    return merged.select(F.unix_micros("window_start").alias("window_start_us"), "node_id", "n", "total")


@query(
    """SELECT 'w' || c_custkey AS window_path, CASE c_custkey % 6 WHEN 1 THEN 'malformed_document' WHEN 2 THEN 'malformed_samples: 0 Acc'
  WHEN 3 THEN 'no_campaign' WHEN 4 THEN 'no_campaign' WHEN 5 THEN 'samples_without_time: 0 Acc 2' END AS reject_reason
FROM customer WHERE c_custkey % 6 > 0"""
)
def q_ingest_rejects(spark, sf_dir):
    """Windows that are cut off, hold text for numbers, have no campaign or samples without a time; each is told."""
    kind = F.col("c_custkey") % 6
    document = (
        F.when(kind == 1, F.lit('{"0": {"Acc": [[1.0, 2'))
        .when(kind == 2, F.lit('{"0": {"Acc": "oops", "Gyro": [[1.0, 7.0]]}}'))
        .when(kind == 5, F.lit('{"0": {"Acc": [[], [null, 2.0], [1.0, 3.0]]}}'))
        .otherwise(F.lit('{"0": {"Acc": [[1.0, 2.0]]}}'))
    )
    metadata = '{"nodes": {"0": {}}, "gateway": {}, "measurement_campaign": {"reference": "%s"}}'
    described = (
        F.when(kind == 3, F.lit(None).cast("string"))
        .when(kind == 4, F.lit('{"nodes": {}, "measurement_campaign": {"label": "x"}}'))
        .otherwise(F.lit(metadata % "campaign"))
    )
    given = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("w"), "c_custkey").alias("window_path"),
        document.alias("document"),
        described.alias("window_metadata"),
        F.col("c_custkey").alias("ingest_seq"),
    )
    none = lambda schema: literal_table(spark, [], schema)
    return ingest.ingest_windows(given, none(ingest.CAMPAIGN_SCHEMA), none(ingest.CONFIGURATION_SCHEMA)).rejects
