"""Schemas of the four tables, joined with the columns of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

_RECORD = "id string, created_at timestamp, updated_at timestamp"
CORE = {
    "resources": f"{_RECORD}, url string, modality string, local_path string, caption string, embedding array<float>",
    "memory_items": f"{_RECORD}, resource_id string, memory_type string, summary string, embedding array<float>, happened_at string, extra string",
    "memory_categories": f"{_RECORD}, name string, description string, embedding array<float>, summary string",
    "category_items": f"{_RECORD}, item_id string, category_id string",
}
MEMORY_TYPES = ("profile", "event", "knowledge", "behavior", "skill", "tool")
DEFAULT_SCOPE = StructType([StructField("user_id", StringType())])


def memory_schema(entity: str, scope: StructType = DEFAULT_SCOPE) -> StructType:
    """The table's columns and the scope's; an error if they share a name."""
    core = StructType.fromDDL(CORE[entity])
    shared = set(core.fieldNames()) & set(scope.fieldNames())
    if shared:
        raise TypeError(f"scope columns that {entity} has itself: {sorted(shared)}")
    return StructType([*core.fields, *scope.fields])


def validate(df: DataFrame, entity: str, scope: StructType = DEFAULT_SCOPE) -> None:
    """An error unless every column is there with its type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f.name for f in memory_schema(entity, scope) if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{entity}: missing or of another type: {wrong}")
