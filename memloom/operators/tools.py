"""Tool calls kept with items, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.links import last_per

CALL = "struct<tool_name:string,input:string,output:string,success:boolean,time_cost:double,score:double,token_cost:int,call_hash:string>"


def calls(extra: Column) -> Column:
    """The calls kept in an item's extra JSON."""
    return F.from_json(F.get_json_object(extra, "$.tool_calls"), f"array<{CALL}>")


def with_hash(call: Column) -> Column:
    """The call with its hash, if it has none."""
    own = F.md5(F.concat_ws("|", call["tool_name"], call["input"], call["output"]))
    return call.withField("call_hash", F.coalesce(F.nullif(call["call_hash"], F.lit("")), own))


def append_call(memory_type: Column, kept: Column, call: Column) -> Column:
    """Calls with one more, for tool items only."""
    old = F.coalesce(kept, F.array().cast(f"array<{CALL}>"))
    return F.when(memory_type == "tool", F.array_append(old, with_hash(call))).otherwise(kept)


def statistics_of(kept: Column, recent: int = 20) -> Column:
    """Statistics of an array of calls over its last ``recent``."""
    n = F.coalesce(F.size(kept), F.lit(0))
    some = F.when(n > 0, F.slice(kept, F.greatest(F.lit(1), n - recent + 1), F.lit(recent)))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)
    ok = F.transform(some, lambda c: F.coalesce(c["success"], F.lit(True)).cast("int").cast("double"))
    tokens = F.filter(F.transform(some, lambda c: F.coalesce(c["token_cost"], F.lit(-1)).cast("double")), lambda t: t >= 0)
    return F.struct(
        n.cast("bigint").alias("total_calls"), F.coalesce(F.size(some), F.lit(0)).cast("bigint").alias("recent_calls_analyzed"),
        F.round(F.coalesce(mean(F.transform(some, lambda c: F.coalesce(c["time_cost"], F.lit(0.0)))), F.lit(0.0)), 3).alias("avg_time_cost"),
        F.round(F.coalesce(mean(ok), F.lit(0.0)), 4).alias("success_rate"),
        F.round(F.coalesce(mean(F.transform(some, lambda c: F.coalesce(c["score"], F.lit(0.0)))), F.lit(0.0)), 3).alias("avg_score"),
        F.round(F.coalesce(mean(tokens), F.lit(0.0)), 2).alias("avg_token_cost"),
    )


def statistics(log: DataFrame, scope: list[str], order: list[str], recent: int | None = 20) -> DataFrame:
    """The same over a log of calls (success, time_cost, score, token_cost), per scope; unrounded. ``recent`` None: over all calls."""
    success = F.coalesce(F.col("success"), F.lit(True)).cast("int")
    means = (
        F.count("*").alias("recent_calls_analyzed"), F.avg(F.coalesce("time_cost", F.lit(0.0))).alias("avg_time_cost"), F.avg(success).alias("success_rate"),
        F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"), F.coalesce(F.avg(F.when(F.coalesce("token_cost", F.lit(-1)) >= 0, F.col("token_cost"))), F.lit(0.0)).alias("avg_token_cost"),
    )
    if recent is None:
        return log.dropna(subset=scope).groupBy(*scope).agg(F.count("*").alias("total_calls"), *means)
    total = log.groupBy(*scope).agg(F.count("*").alias("total_calls"))
    return total.join(last_per(log, scope, order, recent).groupBy(*scope).agg(*means), scope)
