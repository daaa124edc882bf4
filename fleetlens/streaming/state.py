"""Decisions that depend on earlier decisions: keyed state over a stream.

Rows of one key are taken in order of time within a micro-batch; the batch size
is set at the source. State leaves when the watermark passes its use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from fleetlens import reference as ref
from fleetlens.functions import fuzzy


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["at", "id"], kind="stable")


def rephrased(turns: DataFrame, window_s: float = ref.REPHRASE_WINDOW_S, similarity: float = ref.REPHRASE_SIMILARITY,
              late: str = "1 minute") -> DataFrame:
    """ST6: flags the previous turn of a session when the next question comes soon
    and says nearly the same. turns: key (session), id (turn), ts, ended (timestamp), question."""
    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows, out = _ordered(frames), []
        for id_, at, ended, question in zip(rows["id"], rows["at"], rows["ended_at"], rows["question"]):
            if last is not None and 0 <= at - last[1] <= window_s:
                score = fuzzy.token_set(last[2].lower(), question.lower())
                if score >= similarity:
                    out.append((key[0], last[0], at - last[1], score))
            last = (id_, ended, question)
        state.update(last)
        state.setTimeoutTimestamp(max(int((last[1] + window_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "gap_s", "similarity"])

    rows = turns.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1_000_000).withColumn(
        "ended_at", F.unix_micros(F.coalesce("ended", "ts")) / 1_000_000)
    return rows.groupBy("key").applyInPandasWithState(
        step, "session_id string, turn_id long, gap_s double, similarity double",
        "turn_id long, ended_at double, question string", "append", "EventTimeTimeout")


def paired(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ST9: each start with its end; a start without one comes out when the
    watermark shows that none will come. starts: key, started; ends: key, ended."""
    s = starts.withWatermark("started", late)
    e = ends.withWatermark("ended", late).withColumnRenamed("key", "_key")
    on = F.expr(f"key = _key AND ended >= started AND ended <= started + INTERVAL {within}")
    return s.join(e, on, "leftOuter").drop("_key")
