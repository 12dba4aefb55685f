"""Joins between hits, items, categories, links, resources and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text

#: Items of one category that one prompt lists, about.
UPDATES = 1_000


def materialise(hits: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """Hits (key, score, rank) with the pool's columns but the vector; hits without a row are dropped."""
    return hits.select(key, "score", "rank").join(pool.drop("embedding", "score", "rank"), key)


def items_of_categories(links: DataFrame, categories: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct items linked to the categories, by their first link."""
    mine = links.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    first = mine.groupBy(F.col("item_id").alias("id")).agg(F.min(F.struct("created_at", "id")).alias("first_link"))
    return items.drop("embedding").join(first, "id")


def resources_of_items(items: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources that the items came from, each once."""
    return resources.drop("embedding").join(items.select(F.col("resource_id").alias("id")), "id", "left_semi")


def in_model_order(ids: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """A ranked list of ids (an array column ``ids``) with the pool's rows, in the list's order; unknown ids are dropped, repeats kept."""
    return ids.select(F.posexplode("ids").alias("pos", key)).join(pool.drop("embedding"), key)


def category_ids(names: DataFrame, categories: DataFrame, scope: list[str], owner: str = "id") -> DataFrame:
    """(owner, category_id, pos): ids of an array column ``names`` of category names, in order and each once."""
    asked = names.select(owner, *scope, F.posexplode("names").alias("pos", "name")).withColumn("name", text.normalise(F.col("name")))
    known = categories.select(F.col("id").alias("category_id"), *scope, text.normalise(F.col("name")).alias("name"))
    return asked.join(known, ["name", *scope]).groupBy(owner, "category_id").agg(F.min("pos").alias("pos"))


def cited_items(texts: DataFrame, items: DataFrame, key: str = "id", column: str = "summary") -> DataFrame:
    """(key, pos, item_id, ...) items cited by full id, in the order of citation."""
    cited = texts.select(F.col(key).alias("cited_by"), F.posexplode(text.references(F.col(column))).alias("pos", "item_id"))
    return cited.join(items.select(F.col("id").alias("item_id"), F.col("summary").alias("item_summary"), "memory_type"), "item_id")


def cited_ids(texts: DataFrame, column: str = "summary") -> DataFrame:
    """Ids cited in any of the texts."""
    return texts.select(F.explode(text.references(F.col(column))).alias("ref_id")).distinct()


def write_back(updates: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, ref_id) of updated items (category_id, item_id, pos) that their category's text cites by short id; the last wins a collision."""
    short = updates.withColumn("ref_id", text.short_reference(F.col("item_id")))
    cited = texts.select("category_id", F.explode(text.references(F.col("summary"))).alias("ref_id"))
    met = short.join(cited, ["category_id", "ref_id"], "left_semi")
    return met.groupBy("category_id", "ref_id").agg(F.max_by("item_id", F.struct("pos", "item_id")).alias("item_id")).select("item_id", "ref_id").distinct()


def membership_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item_id, category_id, change) with change one of unlink, link, keep."""
    a, b = old.select("item_id", "category_id").distinct().withColumn("o", F.lit(True)), new.select("item_id", "category_id").distinct().withColumn("n", F.lit(True))
    both = a.join(b, ["item_id", "category_id"], "full")
    change = F.when(F.col("n").isNull(), "unlink").when(F.col("o").isNull(), "link").otherwise("keep")
    return both.select("item_id", "category_id", change.alias("change"))


def category_updates(links: DataFrame, items: DataFrame, size: int = UPDATES) -> DataFrame:
    """(category_id, part, updates): items of every category as (item_id, summary) in order of their making.

    A category of more than ``size`` links is spread over so many parts, by a hash of the item, that each holds about
    ``size``: a category that holds a third of all links is many small arrays in many tasks, never one.
    Links without an item or a category are none.
    """
    links = links.filter("category_id IS NOT NULL")
    parts = links.groupBy("category_id").agg(F.ceil(F.count("*") / size).cast("bigint").alias("parts")).filter("parts > 1")
    met = links.select("category_id", "item_id").distinct().join(items.select(F.col("id").alias("item_id"), "created_at", "summary"), "item_id")
    place = F.conv(F.substring(F.md5("item_id"), 1, 8), 16, 10).cast("bigint") % F.coalesce("parts", F.lit(1))
    rows = F.array_sort(F.collect_list(F.struct("created_at", "item_id", "summary")))
    in_order = F.transform(rows, lambda x: F.struct(x["item_id"].alias("item_id"), x["summary"].alias("summary")))
    return met.join(parts, "category_id", "left").groupBy("category_id", place.alias("part")).agg(in_order.alias("updates"))


def joined_lines(df: DataFrame, scope: list[str], line: str, order: list[str], separator: str = "\n") -> DataFrame:
    """One text per scope out of its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__line"))))
    return df.groupBy(*scope).agg(F.array_join(F.transform(rows, lambda x: x["__line"]), separator).alias("text"))


def last_per(df: DataFrame, scope: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of every scope."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*scope).orderBy(*[F.desc(c) for c in order]))).filter(F.col("__r") <= n).drop("__r")
