"""Dimension tables: register if absent, deduplicate configurations, upsert campaigns.

Each operator takes a whole batch of changes with an ``ingest_seq`` and gives
what applying them one by one in that order would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.functions import text
from gustline.operators import validation
from gustline.session import cut_lineage


@dataclass(frozen=True)
class Registration:
    accepted: DataFrame
    conflicts: DataFrame
    invalid: DataFrame


def exists_by_key(rows: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    """Rows whose key is in the table."""
    return rows.join(table.select(F.col(table_key or key).alias(key)), key, "left_semi")


def absent_by_key(rows: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the table: inserts still to do, windows still to load."""
    return rows.join(table.select(F.col(table_key or key).alias(key)), key, "left_anti")


def register(candidates: DataFrame, existing: DataFrame, rules: dict) -> Registration:
    """First valid candidate per new reference is accepted; later ones and existing references conflict.

    The first per reference comes from a map-side combined aggregate, so a
    reference repeated over much of the batch does not gather in one task.
    """
    checked = validation.with_field_errors(candidates, rules)
    valid = checked.where(validation.is_valid()).drop("field_errors")
    fields = [c for c in candidates.columns if c != "reference"]
    firsts = (
        valid.groupBy("reference")
        .agg(F.min_by(F.struct(*fields), "ingest_seq").alias("_first"))
        .select("reference", "_first.*")
        .select(*candidates.columns)
    )
    accepted = absent_by_key(firsts, existing, "reference")
    # (reference, ingest_seq) spreads a repeated reference over all tasks
    conflicts = valid.join(accepted.select("reference", "ingest_seq"), ["reference", "ingest_seq"], "left_anti")
    return Registration(accepted, conflicts, checked.where(~validation.is_valid()))


def register_sensor_types(candidates: DataFrame, existing: DataFrame) -> Registration:
    """Candidates: ingest_seq, reference, name, description, measuring_unit, metadata (JSON text or null)."""
    result = register(candidates, existing, validation.SENSOR_TYPE_RULES)
    accepted = result.accepted.select(
        "reference",
        "name",
        "description",
        F.col("measuring_unit").alias("unit"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )
    return Registration(accepted, result.conflicts, result.invalid)


def register_installations(candidates: DataFrame, existing: DataFrame) -> Registration:
    """Candidates: ingest_seq, reference, turbine_id, receiver_firmware_version, longitude, latitude (raw text)."""
    result = register(candidates, existing, validation.INSTALLATION_RULES)
    latitude, longitude = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    accepted = result.accepted.select(
        "reference", "turbine_id", "receiver_firmware_version", text.point_wkt(latitude, longitude).alias("location")
    )
    return Registration(accepted, result.conflicts, result.invalid)


@dataclass(frozen=True)
class Configurations:
    new: DataFrame
    ids: DataFrame


def deduplicate_configurations(incoming: DataFrame, existing: DataFrame) -> Configurations:
    """Configurations are equal when the JSON text of their nodes is; the gateway's does not count.

    ``incoming``: ingest_seq, nodes_configuration, gateway_configuration.
    ``new`` are rows to append; ``ids`` maps every nodes hash to its id, old or
    new.  A new id derives from the hash, so a retried task gives the same one.
    """
    hashed = incoming.withColumn("nodes_configuration_hash", text.content_hash(F.col("nodes_configuration")))
    firsts = hashed.groupBy("nodes_configuration_hash").agg(
        F.min_by("nodes_configuration", "ingest_seq").alias("nodes_configuration"),
        F.min_by("gateway_configuration", "ingest_seq").alias("gateway_configuration"),
    )
    known = existing.groupBy("nodes_configuration_hash").agg(F.min("id").alias("_known"))
    resolved = cut_lineage(
        firsts.join(known, "nodes_configuration_hash", "left").withColumn(
            "id", F.coalesce("_known", text.content_uuid(F.col("nodes_configuration_hash")))
        )
    )
    new = resolved.where(F.col("_known").isNull()).select(
        "id",
        "nodes_configuration",
        "nodes_configuration_hash",
        "gateway_configuration",
        text.content_hash(F.col("gateway_configuration")).alias("gateway_configuration_hash"),
    )
    return Configurations(new, resolved.select("nodes_configuration_hash", F.col("id").alias("configuration_id")))


CAMPAIGN_COLUMNS = [
    "reference",
    "start_time",
    "end_time",
    "installation_reference",
    "nodes",
    "label",
    "description",
]


def upsert_campaigns(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """The whole campaign table after the updates: new references are inserted, known ones only get a new end time.

    Of several updates to one campaign the first gives the inserted columns and
    the last processed one the end time, even if it is earlier.
    """
    inserted = [c for c in CAMPAIGN_COLUMNS if c not in ("reference", "end_time")]
    batch = updates.groupBy("reference").agg(
        *[F.min_by(c, "ingest_seq").alias(f"_new_{c}") for c in inserted],
        F.max_by("end_time", "ingest_seq").alias("_new_end_time"),
    )
    joined = existing.select(*CAMPAIGN_COLUMNS, F.lit(True).alias("_known")).join(batch, "reference", "full_outer")
    return joined.select(
        "reference",
        *[
            F.coalesce(F.col("_new_end_time"), F.col("end_time")).alias(c)
            if c == "end_time"
            else F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
            for c in CAMPAIGN_COLUMNS[1:]
        ],
    )
