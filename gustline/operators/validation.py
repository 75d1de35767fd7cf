"""Row validation of registration candidates: bad rows are kept, with one message per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions import text

# --- fixed values: messages and number syntax ---
REQUIRED = "This field is required."
SLUGIFIED = "This field must be slugified."
NOT_A_NUMBER = "Not a valid float value."
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def required(field: str) -> Column:
    return F.when(is_blank(F.col(field)), F.lit(REQUIRED))


def required_slug(field: str) -> Column:
    return F.coalesce(required(field), F.when(~text.is_slug(F.col(field)), F.lit(SLUGIFIED)))


def optional_number(field: str) -> Column:
    return F.when(~is_blank(F.col(field)) & ~F.col(field).rlike(NUMBER_PATTERN), F.lit(NOT_A_NUMBER))


SENSOR_TYPE_RULES = {"name": required, "reference": required_slug}
INSTALLATION_RULES = {
    "reference": required_slug,
    "turbine_id": required,
    "receiver_firmware_version": required,
    "longitude": optional_number,
    "latitude": optional_number,
}


def with_field_errors(candidates: DataFrame, rules: dict) -> DataFrame:
    """Adds ``field_errors``, a map of field to first message; empty for valid rows."""
    checks = F.create_map(*[part for field, rule in rules.items() for part in (F.lit(field), rule(field))])
    return candidates.withColumn("field_errors", F.map_filter(checks, lambda _, message: message.isNotNull()))


def is_valid() -> Column:
    return F.size("field_errors") == 0
