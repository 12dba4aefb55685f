"""Writes as folds: a table is a log of inserts, patches and deletions, its state one aggregation over it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions import text
from memloom.operators import filters


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])))
def json_members(objects: pd.Series) -> pd.Series:
    """Keys and values of JSON objects, both as JSON; nothing for what is no object."""

    def members(raw: str | None) -> list[dict[str, str]]:
        try:
            value = json.loads(raw) if raw else {}
        except ValueError:
            return []
        return [{"k": json.dumps(k), "v": json.dumps(v)} for k, v in value.items()] if isinstance(value, dict) else []

    return objects.map(members)


def reinforced(items: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """One row per content hash and scope: the first row's columns, how often it came, and when last.

    Null scopes are equal to each other; tool items are never merged. The aggregation
    combines on the map side, so a text that comes a billion times is one row a task.
    """
    rows = items.withColumn("content_hash", text.content_hash(F.col("summary"), F.col("memory_type")))
    own = F.when(F.col("memory_type") == "tool", F.col("id"))
    kept = [c for c in rows.columns if c not in (*scope, "content_hash")]
    first = F.min_by(F.struct(*kept), F.struct(*order)).alias("first")
    folded = rows.withColumn("__own", own).groupBy("content_hash", *scope, "__own").agg(first, F.count("*").alias("reinforcement_count"), F.max(order[0]).alias("last_reinforced_at"))
    return folded.select("first.*", *scope, "content_hash", "reinforcement_count", "last_reinforced_at")


def reinforce_into(state: DataFrame, new: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The state with new rows folded in; ``state`` has the columns ``reinforced`` gives."""
    fresh = reinforced(new, scope, order)
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("content_hash", *scope)]
    # tool items meet nothing: their rows are only ever added
    met = keys[0] & (F.col("n.memory_type") != "tool") & (F.col("s.memory_type") != "tool")
    for k in keys[1:]:
        met &= k
    both = state.alias("s").join(fresh.alias("n"), met, "full")
    own = [F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in state.columns if c not in ("reinforcement_count", "last_reinforced_at")]
    count = (F.coalesce("s.reinforcement_count", F.lit(0)) + F.coalesce("n.reinforcement_count", F.lit(0))).alias("reinforcement_count")
    return both.select(*own, count, F.greatest("s.last_reinforced_at", "n.last_reinforced_at").alias("last_reinforced_at"))


def state_of(log: DataFrame, key: str = "id", order: str = "seq", op: str = "op", merged: tuple[str, ...] = ()) -> DataFrame:
    """The state a log leaves. Rows have ``op`` put, patch or delete.

    A put starts a record anew, a patch changes its non-null columns, a delete ends it;
    ``merged`` columns hold JSON objects that patches merge key by key.
    """
    columns = [c for c in log.columns if c not in (key, order, op, *merged)]
    start = F.max(F.when(F.col(op) != "patch", F.struct(order, op))).alias("__start")
    # the last value of a column counts if it isn't older than the last start: one aggregation, combined on the map side
    last = [F.max_by(F.struct(order, c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    folded = log.groupBy(key).agg(start, *last).filter(F.col(f"__start.{op}") == "put")
    since = F.col(f"__start.{order}")
    state = folded.select(key, since.alias("__since"), *[F.when(F.col(f"{c}.{order}") >= since, F.col(f"{c}.{c}")).alias(c) for c in columns])
    for c in merged:
        # JSON is merged key by key the same way, so a record with many patches is as small as its keys
        parts = log.filter(F.col(c).isNotNull()).select(key, order, F.explode(json_members(F.col(c))).alias("m"))
        newest = parts.groupBy(key, F.col("m.k").alias("__k")).agg(F.max_by(F.struct(order, "m.v"), order).alias("__v"))
        alive = newest.join(state.select(key, "__since"), key).filter(F.col(f"__v.{order}") >= F.col("__since"))
        text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v.v"))), lambda x: F.concat(x["__k"], F.lit(": "), x["v"])), ", ")
        state = state.join(alive.groupBy(key).agg(F.concat(F.lit("{"), text_of, F.lit("}")).alias(c)), key, "left")
    return state.select(key, *[c for c in log.columns if c not in (key, order, op)])


def without_deleted(rows: DataFrame, deletions: DataFrame, key: str = "id", deleted: str = "record_id") -> DataFrame:
    return rows.join(deletions.select(F.col(deleted).alias(key)), key, "left_anti")


def cleared(df: DataFrame, conditions: Mapping[str, Any] | None) -> tuple[DataFrame, DataFrame]:
    """Rows that a clear removes, and those it leaves; no conditions remove everything."""
    return filters.split(df, conditions)


def without_dangling(links: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Links whose item and category both exist."""
    kept = links.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return kept.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")


def with_categories(have: DataFrame, wanted: DataFrame, scope: list[str], made_at: Column) -> DataFrame:
    """Categories by name and scope: those there, blanks filled in, and those that were missing."""
    key = ["__name", *scope]
    fold = lambda d: d.withColumn("__name", text.normalise(F.col("name")))
    old = fold(have)
    new = fold(wanted).groupBy(*key).agg(F.min("name").alias("name"), F.max_by("description", F.length("description")).alias("new_description"), F.first("embedding", True).alias("new_embedding"))
    filled = old.join(new.drop("name"), key, "left")
    filled = filled.withColumn("description", F.when(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0, F.col("description")).otherwise(F.coalesce("new_description", "description")))
    filled = filled.withColumn("embedding", F.coalesce("embedding", "new_embedding")).select(*have.columns)
    ident = F.sha2(F.concat_ws("|", F.lit("category"), "__name", *scope), 256)
    fresh = new.join(old.select(*key), key, "left_anti")
    made = fresh.select(
        *[
            {"id": ident, "created_at": made_at, "updated_at": made_at, "description": F.col("new_description"), "embedding": F.col("new_embedding")}.get(c, F.col(c) if c in fresh.columns else F.lit(None)).cast(have.schema[c].dataType).alias(c)
            for c in have.columns
        ]
    )
    return filled.unionByName(made)


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones added, each pair once; the pair that is there stays."""
    fresh = new.dropDuplicates(["item_id", "category_id"]).join(links.select("item_id", "category_id"), ["item_id", "category_id"], "left_anti")
    return links.unionByName(fresh, allowMissingColumns=True)


def unlinked(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("item_id", "category_id"), ["item_id", "category_id"], "left_anti")
