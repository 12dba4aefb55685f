"""Scope filters, score filters and projections."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memloom.session import all_of


def normalise_where(where: Mapping[str, Any] | None, scope: StructType) -> dict[str, Any]:
    """Conditions on scope columns without the empty ones; an error for any other column or operator."""
    out = {}
    for name, value in (where or {}).items():
        if value is None:
            continue
        field, _, op = name.partition("__")
        if field not in scope.fieldNames():
            raise ValueError(f"unknown scope field {field!r}")
        if op not in ("", "in"):
            raise ValueError(f"unknown operator {op!r}")
        out[name] = value
    return out


def condition(where: Mapping[str, Any] | None) -> Column:
    """All of field = value and field in values; a text given for ``__in`` means equality, null rows never match."""
    parts = []
    for name, value in (where or {}).items():
        if value is None:
            continue
        field, _, op = name.partition("__")
        if op not in ("", "in"):
            raise ValueError(f"unknown operator {op!r}")
        several = op == "in" and not isinstance(value, str)
        parts.append(F.col(field).isin(list(value)) if several else F.col(field) == F.lit(value))
    return all_of(parts)


def where(df: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    """Rows that meet the conditions; an unknown column is an error, as in SQL."""
    for name in conditions or {}:
        if name.partition("__")[0] not in df.columns:
            raise ValueError(f"unknown column {name!r}")
    return df.filter(condition(conditions))


def split(df: DataFrame, conditions: Mapping[str, Any] | None) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the conditions, and the others; nulls are among the others."""
    met = condition(conditions)
    return df.filter(met), df.filter(~F.coalesce(met, F.lit(False)))


def without_embedding(df: DataFrame) -> DataFrame:
    return df.drop("embedding")


def by_reference(items: DataFrame, ids: DataFrame | list[str], extra: str = "extra") -> DataFrame:
    """Items whose ``extra.ref_id`` is among the ids (a list, or a table with the column ref_id)."""
    cited = items.withColumn("ref_id", F.get_json_object(extra, "$.ref_id"))
    if isinstance(ids, list):
        return cited.filter(F.col("ref_id").isin(ids)) if ids else cited.limit(0)
    return cited.join(ids.select("ref_id").distinct(), "ref_id", "left_semi")


def with_hash(items: DataFrame, value: str, extra: str = "extra") -> DataFrame:
    return items.filter(F.get_json_object(extra, "$.content_hash") == value)


def with_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.filter(F.coalesce(F.size(vector), F.lit(0)) > 0)


def with_summary(df: DataFrame) -> DataFrame:
    return df.filter(F.length("summary") > 0)


def at_least(hits: DataFrame, score: float = 0.0, limit: int = 5) -> DataFrame:
    """The first hits by rank that reach the score; a missing score counts as 1."""
    kept = hits.filter(F.coalesce(F.col("score"), F.lit(1.0)) >= score) if score > 0 else hits
    return kept.orderBy("rank").limit(limit)


def call_filter(operations: Any = None, step_ids: Any = None, providers: Any = None, models: Any = None, statuses: Any = None) -> Column:
    """Rows of a call log; names are compared without case but for steps."""

    def among(column: str, values: Any, fold: bool = True) -> Column:
        some = [values] if isinstance(values, str) else list(values)
        return F.lower(column).isin([v.lower() for v in some]) if fold else F.col(column).isin(some)

    given = (("operation", operations, True), ("step_id", step_ids, False), ("provider", providers, True), ("model", models, True), ("status", statuses, True))
    return F.coalesce(all_of([among(c, v, fold) for c, v, fold in given if v]), F.lit(False))
