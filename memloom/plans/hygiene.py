"""Queries of the general problems (p1, p6) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import instants, references
from memloom.session import load


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    links, items = load(spark, d, "category_items"), load(spark, d, "memory_items")
    ref = references.Reference
    return references.dangling(
        [ref(links, "category_items", "item_id", "item"), ref(links, "category_items", "category_id", "category"), ref(items, "memory_items", "resource_id", "resource")],
        {"item": items, "category": load(spark, d, "memory_categories"), "resource": load(spark, d, "resources")},
        load(spark, d, "tombstones"),
        {"item": "memory_item", "resource": "resource"},
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every dangling reference."""
    return _dangling(spark, d).select("tbl", "field", "rec_id")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, field and month."""
    return references.by_period(_dangling(spark, d))


def _instants(spark: SparkSession, d: str, found_only: bool) -> DataFrame:
    turns = load(spark, d, "conv3").select(F.lit("conv3").alias("tbl"), F.expr("conv_id || ':' || turn").alias("rec_id"), F.col("created_at").alias("raw"), "tz")
    items = load(spark, d, "memory_items").select(F.lit("memory_items").alias("tbl"), F.col("id").alias("rec_id"), F.col("happened_at").alias("raw"), "tz")
    return instants.normalise(turns.unionByName(items), "raw", "tz", found_only=found_only)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every text that denotes an instant, with that instant."""
    got = _instants(spark, d, True)
    return got.select("tbl", "rec_id", instants.utc_text(F.col("utc_us")).alias("utc")).distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per table and zone: rows with a text, and those that denote an instant."""
    got = _instants(spark, d, False)
    return got.groupBy("tbl", "tz").agg(F.count("raw").alias("n_texts"), F.count("utc_us").alias("n_instants"))


_SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
_ID = "lower(replace(regexp_replace(@, '^" + _SPACES + "|" + _SPACES + "$', '', 'g'), '-', ''))"


def _key(c: str) -> str:
    return _ID.replace("@", c)


_P1 = f"""
WITH gone AS (SELECT entity, {_key("record_id")} AS k, max(deleted_at) AS gone FROM tombstones GROUP BY 1, 2),
made AS (
  SELECT 'item_id' AS field, {_key("id")} AS k, created_at, 'memory_item' AS entity FROM memory_items
  UNION ALL SELECT 'category_id', {_key("id")}, created_at, 'none' FROM memory_categories
  UNION ALL SELECT 'resource_id', {_key("id")}, created_at, 'resource' FROM resources),
alive AS (SELECT field, k, min(created_at) AS since FROM made LEFT JOIN gone USING (entity, k) WHERE gone IS NULL OR created_at > gone GROUP BY 1, 2),
refs AS (
  SELECT 'category_items' AS tbl, 'item_id' AS field, id AS rec_id, item_id AS ref, created_at FROM category_items
  UNION ALL SELECT 'category_items', 'category_id', id, category_id, created_at FROM category_items
  UNION ALL SELECT 'memory_items', 'resource_id', id, resource_id, created_at FROM memory_items),
lost AS (
  SELECT DISTINCT tbl, r.field, rec_id, r.created_at FROM (SELECT *, {_key("ref")} AS k FROM refs WHERE length(regexp_replace(ref, '{_SPACES}', '', 'g')) > 0) r
  LEFT JOIN alive a ON a.field = r.field AND a.k = r.k WHERE a.since IS NULL OR a.since > r.created_at)
"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month, "p6_found": p6_found, "p6_rates": p6_rates}
SQL = {
    "p1_found": _P1 + "SELECT tbl, field, rec_id FROM lost",
    "p1_by_month": _P1 + "SELECT tbl, field, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_dangling FROM lost GROUP BY 1, 2, 3",
}
