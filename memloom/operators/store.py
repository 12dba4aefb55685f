"""A store of the four tables under one path: append-only logs, read as their state."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memloom.operators import filters, mutations, schema
from memloom.session import cut


class MemoryStore:
    """Tables resources, memory_items, memory_categories and category_items of one scope model.

    Every write appends one directory to a table's log; nothing is rewritten, so writers
    never wait for each other. ``compact`` folds a log into its state.
    """

    def __init__(self, spark: SparkSession, path: str, scope: StructType = schema.DEFAULT_SCOPE) -> None:
        self.spark, self.path, self.scope = spark, path.rstrip("/"), scope

    def log_schema(self, entity: str) -> StructType:
        return StructType([*schema.memory_schema(entity, self.scope).fields, *StructType.fromDDL("seq bigint, op string").fields])

    def _log(self, entity: str) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{entity}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.log_schema(entity))
        return self.spark.read.schema(self.log_schema(entity)).parquet(f"{self.path}/{entity}")

    def append(self, entity: str, rows: DataFrame, op: str = "put") -> None:
        """Log rows; columns the table has and the rows lack are null. ``seq`` is the time of the write unless the rows have it."""
        want = self.log_schema(entity)
        unknown = set(rows.columns) - set(want.fieldNames())
        if unknown:
            raise ValueError(f"{entity} has no columns {sorted(unknown)}")
        seq = F.col("seq") if "seq" in rows.columns else F.unix_micros(F.current_timestamp())
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want if f.name not in ("seq", "op")]
        rows.select(*columns, seq.alias("seq"), F.lit(op).alias("op")).write.mode("append").parquet(f"{self.path}/{entity}")

    def table(self, entity: str, where: Mapping[str, Any] | None = None) -> DataFrame:
        """The table's rows of a scope."""
        merged = ("extra",) if entity == "memory_items" else ()
        state = mutations.state_of(self._log(entity), merged=merged)
        return filters.where(state, filters.normalise_where(where, self.scope)) if where else state

    def get(self, entity: str, key: str) -> DataFrame:
        """One row by id; the filter reaches the log's files before the fold."""
        merged = ("extra",) if entity == "memory_items" else ()
        return mutations.state_of(self._log(entity).filter(F.col("id") == key), merged=merged)

    def links_of(self, item_id: str) -> DataFrame:
        return self.table("category_items").filter(F.col("item_id") == item_id)

    def update(self, entity: str, rows: DataFrame) -> None:
        """Change the non-null columns of records; an error if one doesn't exist."""
        missing = rows.select("id").join(self.table(entity).select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0].id)
        self.append(entity, rows.withColumn("updated_at", F.current_timestamp()), "patch")

    def delete(self, entity: str, ids: DataFrame) -> None:
        """End records; ids that don't exist are no error. Links of deleted items and categories go with them."""
        ids = cut(ids.select("id"), "deleted")  # the ids may be read from the very tables that change now
        self.append(entity, ids, "delete")
        field = {"memory_items": "item_id", "memory_categories": "category_id"}.get(entity)
        if field:
            self.append("category_items", self.table("category_items").join(ids.select(F.col("id").alias(field)), field, "left_semi").select("id"), "delete")

    def clear(self, entity: str, where: Mapping[str, Any] | None = None) -> DataFrame:
        """Remove a scope's rows, all without conditions, and return them."""
        gone = cut(self.table(entity, where), "cleared")
        self.delete(entity, gone)
        return gone

    def clear_all(self, where: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
        return {e: self.clear(e, where) for e in ("memory_categories", "memory_items", "resources")}

    def compact(self, entity: str, to: str) -> None:
        """Write the state as a log of puts under another path."""
        state = self.table(entity)
        state.withColumns({"seq": F.unix_micros(F.coalesce("updated_at", "created_at", F.current_timestamp())), "op": F.lit("put")}).select(*self.log_schema(entity).fieldNames()).write.parquet(f"{to}/{entity}")

    def validate(self) -> None:
        for entity in schema.CORE:
            schema.validate(self._log(entity), entity, self.scope)

    def preload(self) -> dict[str, DataFrame]:
        """All tables, kept in the cluster's memory."""
        return {e: self.table(e).cache() for e in schema.CORE}
