"""Long-lived feeds: the change feed into the record table, and sessions that end when idle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.functions import constants as C
from cardloom.operators.change_feed import RecordTable


def apply_feed(changes: DataFrame, table: RecordTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes batch by batch. A batch that is delivered again after a failure changes nothing: its keys have receipts."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: table.apply(df) if not df.isEmpty() else None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_of_key(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream without repeats of an idempotency key within `late` of event time; the state is bounded by the watermark."""
    return changes.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def sessions(events: DataFrame, key: str, ts: str, ttl: str = C.SESSION_TTL, late: str = "1 hour") -> DataFrame:
    """A stream of closed sessions: (key, start, end, n). A session ends when its key was idle for `ttl`."""
    s = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, ttl)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    """A stream of (conv, turn, text) to the text of each conversation's last `n` turns so far; the state is those turns alone."""

    def step(key, frames, state):
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in frames:
            kept += [(int(t), x) for t, x in zip(pdf["turn"], pdf["text"]) if isinstance(x, str) and x.strip()]
        kept = sorted(set(kept))[-n:]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"conv": [key[0]], "text": ["\n".join(x for _, x in kept)], "n_turns": [len(kept)]})

    return turns.groupBy("conv").applyInPandasWithState(step, "conv string, text string, n_turns bigint", "turns array<bigint>, texts array<string>", "update", "NoTimeout")
