"""Top-k by similarity or salience, for one query or one per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vectors


def scored(df: DataFrame, query: list[float] | Column, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector and their ``score``; NaN scores are dropped."""
    score = vectors.cosine_to(F.col(vector), query) if isinstance(query, list) else vectors.cosine(F.col(vector), query)
    return df.withColumn("score", score).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def top_k(df: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best by score, ties by key; only k rows a task ever leave it."""
    best = df.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def top_k_per(df: DataFrame, k: int, scope: list[str], key: str = "id") -> DataFrame:
    """The k best of every scope; Spark drops rows beyond k before the shuffle."""
    order = Window.partitionBy(*scope).orderBy(F.desc("score"), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine_top_k(df: DataFrame, query: list[float] | Column, k: int = 5, key: str = "id", vector: str = "embedding") -> DataFrame:
    return top_k(scored(df, query, vector), k, key)


def all_ranked(df: DataFrame, query: list[float] | Column, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Every row with its score, best first; the sort is spread over ranges."""
    return scored(df, query, vector).orderBy(F.desc("score"), key)


def salience_scored(df: DataFrame, query: list[float] | Column, as_of: Column, count: str = "reinforcement_count", last: str = "last_reinforced_at", half_life_days: float = 30.0, vector: str = "embedding") -> DataFrame:
    similar = scored(df, query, vector)
    return similar.withColumn("score", vectors.salience(F.col("score"), F.coalesce(F.col(count), F.lit(1)), F.col(last), as_of, half_life_days))


def search(df: DataFrame, query: list[float] | Column, k: int = 5, ranking: str = "similarity", as_of: Column | None = None, half_life_days: float = 30.0, key: str = "id") -> DataFrame:
    """One entry point for both rankings."""
    if ranking == "salience":
        return top_k(salience_scored(df, query, as_of if as_of is not None else F.current_timestamp(), half_life_days=half_life_days), k, key)
    if ranking != "similarity":
        raise ValueError(f"unknown ranking {ranking!r}")
    return cosine_top_k(df, query, k, key)


def last_user_message(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "content") -> DataFrame:
    """The latest text of the user in every conversation."""
    asked = turns.filter((F.lower(F.trim(role)) == "user") & (F.length(F.trim(text)) > 0))
    return asked.groupBy(conversation).agg(F.max_by(text, turn).alias("query"))
