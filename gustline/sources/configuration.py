"""Gateway configuration documents to tables: gateways, nodes, node sensors, campaigns.

Documents are parsed with explicit schemas; absent or empty fields take the
catalogue's defaults; documents that break a rule become reject rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.functions import text
from gustline.operators.sensors import expand_constants
from gustline.session import literal_table

SECTIONS = ["gateway", "nodes", "measurement_campaign"]
GATEWAY_SCHEMA = (
    "baudrate int, endian string, installation_reference string, latitude double, longitude double, packet_key int, "
    "packet_key_offset int, receiver_firmware_version string, serial_buffer_rx_size int, serial_buffer_tx_size int, "
    "turbine_id string, initial_gateway_handles map<string,string>, local_info_types map<string,string>"
)
NODE_SCHEMA = (
    "acc_freq double, acc_range double, analog_freq double, baros_bm int, baros_freq double, blade_id string, "
    "constat_period double, battery_info_period double, diff_baros_freq double, gyro_freq double, gyro_range double, "
    "mag_freq double, mics_freq double, mics_bm int, max_timestamp_slack double, max_period_drift double, "
    "node_firmware_version string, decline_reason map<string,string>, initial_node_handles map<string,string>, "
    "remote_info_type map<string,string>, number_of_sensors map<string,int>, samples_per_packet map<string,int>, "
    "sensor_commands map<string,array<string>>, sensor_conversion_constants map<string,string>, "
    "sensor_coordinates map<string,string>, sensor_names array<string>, sleep_state map<string,string>"
)
CAMPAIGN_SCHEMA = "reference string, label string, description string, start_time string, end_time string"
_COMPUTED = ["periods"]


def _map(table: dict, value=F.lit) -> Column:
    return F.create_map(*[part for key, entry in table.items() for part in (F.lit(str(key)), value(entry))])


def _or_default_map(column: Column, table: dict, value=F.lit) -> Column:
    return F.when(F.size(column) > 0, column).otherwise(_map(table, value))


def read_configurations(spark: SparkSession, path: str) -> DataFrame:
    """Raw configuration documents, one per file: path, document."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def default_configuration(spark: SparkSession) -> DataFrame:
    """What stands in for an absent configuration file: every default, one node ``0``."""
    document = '{"gateway": {}, "nodes": {"0": {}}, "measurement_campaign": {}}'
    return literal_table(spark, [("default", document)], "path string, document string")


@dataclass(frozen=True)
class Configuration:
    gateways: DataFrame
    nodes: DataFrame
    node_sensors: DataFrame
    campaigns: DataFrame
    rejects: DataFrame


def _node_fields() -> list[str]:
    return [field.split(" ")[0] for field in NODE_SCHEMA.split(", ")]


def _gateway_fields() -> list[str]:
    return [field.split(" ")[0] for field in GATEWAY_SCHEMA.split(", ")]


def load(documents: DataFrame, strict: bool = False, require_sections: bool = True) -> Configuration:
    """Tables of parsed configurations, each keyed by ``path``.

    ``strict`` also rejects documents with other top-level keys.  Without
    ``require_sections`` an absent section takes its defaults.
    """
    sections = F.from_json("document", "map<string,string>")
    opened = documents.withColumn("_sections", sections)
    keys = F.map_keys("_sections")
    missing = F.array_except(F.array(*[F.lit(s) for s in SECTIONS]), keys)
    extra = F.array_except(keys, F.array(*[F.lit(s) for s in SECTIONS]))
    gateway_keys = F.json_object_keys(F.try_element_at("_sections", F.lit("gateway")))
    unknown_gateway = F.array_except(
        F.coalesce(gateway_keys, F.array().cast("array<string>")), F.array(*[F.lit(f) for f in _gateway_fields()])
    )
    reason = F.when(F.col("_sections").isNull() | (F.size("_sections") == 0), "not_a_configuration")
    if require_sections:
        reason = reason.when(F.size(missing) > 0, F.concat(F.lit("missing_section: "), F.array_join(missing, ", ")))
    if strict:
        reason = reason.when(F.size(extra) > 0, F.concat(F.lit("unknown_section: "), F.array_join(extra, ", ")))
    reason = reason.when(
        F.size(unknown_gateway) > 0, F.concat(F.lit("unknown_gateway_field: "), F.array_join(unknown_gateway, ", "))
    )
    opened = opened.withColumn("reject_reason", reason)
    good = opened.where(F.col("reject_reason").isNull())

    nodes = _nodes(good)
    node_rejects = nodes.where(F.col("reject_reason").isNotNull()).select("path", "reject_reason")
    nodes = nodes.where(F.col("reject_reason").isNull()).drop("reject_reason")
    sensors = _node_sensors(nodes)
    bad_constants = sensors.where(F.col("conversion_constants").isNull()).select(
        "path", F.concat(F.lit("bad_conversion_constants: "), "sensor_name").alias("reject_reason")
    )
    return Configuration(
        gateways=_gateways(good),
        nodes=nodes,
        node_sensors=sensors.where(F.col("conversion_constants").isNotNull()),
        campaigns=_campaigns(good),
        rejects=opened.where(F.col("reject_reason").isNotNull())
        .select("path", "reject_reason")
        .unionByName(node_rejects)
        .unionByName(bad_constants),
    )


def _gateways(good: DataFrame) -> DataFrame:
    parsed = good.select(
        "path", F.from_json(F.try_element_at("_sections", F.lit("gateway")), GATEWAY_SCHEMA).alias("_g")
    )
    scalars = [
        F.coalesce(F.col(f"_g.{name}"), F.lit(default)).alias(name) for name, default in cat.GATEWAY_DEFAULTS.items()
    ]
    return parsed.select(
        "path",
        *scalars,
        _or_default_map(F.col("_g.initial_gateway_handles"), cat.DEFAULT_GATEWAY_HANDLES).alias(
            "initial_gateway_handles"
        ),
        _or_default_map(F.col("_g.local_info_types"), cat.LOCAL_INFO_TYPES).alias("local_info_types"),
    )


def _nodes(good: DataFrame) -> DataFrame:
    given = F.from_json(F.try_element_at("_sections", F.lit("nodes")), "map<string,string>")
    exploded = good.select(
        "path", F.explode(F.coalesce(given, F.create_map(F.lit("0"), F.lit("{}")))).alias("node_id", "_document")
    )
    allowed = F.array(*[F.lit(f) for f in [*_node_fields(), *_COMPUTED]])
    unknown = F.array_except(F.coalesce(F.json_object_keys("_document"), F.array().cast("array<string>")), allowed)
    parsed = exploded.withColumn("_n", F.from_json("_document", NODE_SCHEMA))
    list_of = lambda names: F.array(*[F.lit(n) for n in names])
    scalars = [
        F.coalesce(F.col(f"_n.{name}"), F.lit(default)).alias(name) for name, default in cat.NODE_DEFAULTS.items()
    ]
    maps = {
        "decline_reason": (cat.DECLINE_REASONS, F.lit),
        "initial_node_handles": (cat.DEFAULT_NODE_HANDLES, F.lit),
        "remote_info_type": (cat.REMOTE_INFO_TYPES, F.lit),
        "number_of_sensors": (cat.NUMBER_OF_SENSORS, F.lit),
        "samples_per_packet": (cat.SAMPLES_PER_PACKET, F.lit),
        "sensor_commands": (cat.SENSOR_COMMANDS, list_of),
        "sensor_conversion_constants": (cat.CONVERSION_CONSTANTS, lambda v: F.lit(str(v))),
        "sleep_state": (cat.SLEEP_STATES, F.lit),
    }
    return parsed.select(
        "path",
        "node_id",
        *scalars,
        *[_or_default_map(F.col(f"_n.{name}"), table, value).alias(name) for name, (table, value) in maps.items()],
        F.col("_n.sensor_coordinates").alias("sensor_coordinates"),
        F.when(F.size("_n.sensor_names") > 0, F.col("_n.sensor_names"))
        .otherwise(list_of(cat.SENSOR_NAMES))
        .alias("sensor_names"),
        F.when(
            F.size(unknown) > 0, F.concat(F.lit("unknown_node_field: "), F.array_join(unknown, ", "))
        ).alias("reject_reason"),
    )


def period_of(sensor: str) -> Column:
    field, unit = cat.PERIOD_FIELDS[sensor]
    return {"hertz": 1 / F.col(field), "milliseconds": F.col(field) / 1000, "seconds": F.col(field)}[unit]


def _node_sensors(nodes: DataFrame) -> DataFrame:
    periods = F.create_map(*[part for s in cat.PERIOD_FIELDS for part in (F.lit(s), period_of(s))])
    exploded = nodes.select("*", F.explode("sensor_conversion_constants").alias("sensor_name", "_constant"))
    count = F.try_element_at("number_of_sensors", F.col("sensor_name"))
    return exploded.select(
        "path",
        "node_id",
        "sensor_name",
        F.try_element_at(periods, F.col("sensor_name")).alias("period"),
        F.try_element_at("samples_per_packet", F.col("sensor_name")).alias("samples_in_packet"),
        count.alias("number_of_sensors"),
        expand_constants(F.col("_constant"), count).alias("conversion_constants"),
        F.array_contains("sensor_names", F.col("sensor_name")).alias("installed"),
    )


def _campaigns(good: DataFrame) -> DataFrame:
    section = F.try_element_at("_sections", F.lit("measurement_campaign"))
    return good.select("path", F.from_json(section, CAMPAIGN_SCHEMA).alias("_c")).select("path", "_c.*")


def campaign_metadata(configuration: Configuration, start: Column) -> DataFrame:
    """Campaign rows ready to run: a reference where none is given, the start stamp, node to sensor names."""
    nodes = configuration.nodes.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "sensor_names")))).alias("nodes")
    )
    named = F.coalesce("reference", text.content_uuid(F.concat_ws("|", "path", start.cast("string"))))
    return configuration.campaigns.join(nodes, "path", "left").select(
        "path", named.alias("reference"), "label", "description", start.alias("start_time"), "nodes"
    )


def to_documents(configuration: Configuration) -> DataFrame:
    """Configurations back as JSON documents, with every default filled in and the computed periods."""
    gateway_fields = [c for c in configuration.gateways.columns if c != "path"]
    node_fields = [c for c in configuration.nodes.columns if c not in ("path", "node_id")]
    periods = F.create_map(*[part for s in cat.PERIOD_FIELDS for part in (F.lit(s), period_of(s))])
    # constants go back as numbers and lists, expanded to one per channel
    constants = configuration.node_sensors.groupBy("path", "node_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sensor_name", "conversion_constants")))).alias(
            "sensor_conversion_constants"
        )
    )
    nodes = (
        configuration.nodes.drop("sensor_conversion_constants")
        .join(constants, ["path", "node_id"], "left")
        .select("path", "node_id", F.struct(*node_fields, periods.alias("periods")).alias("node"))
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("node_id", "node"))).alias("nodes"))
    )
    gateways = configuration.gateways.select("path", F.struct(*gateway_fields).alias("gateway"))
    campaigns = configuration.campaigns.select(
        "path", F.struct(*[c for c in configuration.campaigns.columns if c != "path"]).alias("measurement_campaign")
    )
    return (
        gateways.join(nodes, "path")
        .join(campaigns, "path")
        .select("path", F.to_json(F.struct("gateway", "nodes", "measurement_campaign")).alias("document"))
    )
