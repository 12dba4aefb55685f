"""Conversations as streams: a batch of messages leaves as soon as enough have come, or when time is up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = "conv_id bigint, batch bigint, n bigint, first_turn bigint, last_turn bigint, text string"
_STATE = "batch bigint, turns array<bigint>, lines array<string>"


def message_batches(messages: DataFrame, least: int = 2, idle_ms: int | None = 60_000) -> DataFrame:
    """Batches of at least ``least`` messages (conv_id, turn, role, content) of one conversation; what is left goes after ``idle_ms`` without a new one.

    With ``idle_ms`` None it waits in the state for the next message, also across runs; a stream that is to end when it
    has read what there is needs that, since time never runs out by itself.

    The state of a conversation is what hasn't left yet, so it stays small however long the conversation is.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, turns, lines = state.get if state.exists else (0, [], [])
        turns, lines = list(turns), list(lines)
        idle = state.hasTimedOut
        for f in frames:
            f = f.sort_values("turn")
            turns += [int(t) for t in f["turn"]]
            lines += [f"[{r or 'user'}]: {c or ''}" for r, c in zip(f["role"], f["content"], strict=True)]
        if len(turns) >= least or (idle and turns):
            yield pd.DataFrame({"conv_id": [key[0]], "batch": [number], "n": [len(turns)], "first_turn": [min(turns)], "last_turn": [max(turns)], "text": ["\n".join(lines)]})
            number, turns, lines = number + 1, [], []
        state.update((number, turns, lines))
        if turns and idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.select("conv_id", "turn", "role", "content").groupBy("conv_id").applyInPandasWithState(run, BATCH, _STATE, "append", timeout)


def memorise_stream(messages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, least: int = 2, once: bool = True) -> StreamingQuery:
    """Every micro-batch of message batches goes to ``sink``; with ``once`` the stream ends when it has read what there is."""
    writer = message_batches(messages, least, None if once else 60_000).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_tolerant_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; those later than ``late`` no longer count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), kind, "n", "value")
