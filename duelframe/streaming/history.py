"""Streaming form of the prior totals and streaks: each side of a contest is emitted with its state once its day is closed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
OUTPUT = "entity bigint, bout_id bigint, side string, day int, total_fights bigint, total_wins bigint, total_losses bigint, win_streak bigint, loss_streak bigint, days_since_last_fight int"


def stream_states(long: DataFrame, delay: str = "7 days", entity: str = "entity") -> DataFrame:
    """A stream of long rows (``entity, bout_id, side, day, won, lost``) with the state before each contest's day.

    The watermark closes days: rows of a day are emitted together, in order, when no row of it can come any more, so
    contests of one day never see each other and the result equals the batch form. Later rows than the delay are dropped by
    the watermark. A state holds an entity's totals and its rows of open days.
    """
    rows = long.select(F.col(entity).cast("bigint").alias("entity"), F.col("bout_id").cast("bigint"), "side", F.col("day").cast("int"), F.col("won").cast("int"), F.col("lost").cast("int"), F.timestamp_seconds(F.col("day").cast("bigint") * 86_400).alias("ts"))
    timed = rows.withWatermark("ts", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, wins, losses, up, down, last, waiting = json.loads(state.get[0]) if state.exists else (0, 0, 0, 0, 0, None, [])
        for b in batches:
            waiting += [[int(d), int(i), s, int(w), int(lo)] for d, i, s, w, lo in zip(b["day"], b["bout_id"], b["side"], b["won"], b["lost"])]
        closed = state.getCurrentWatermarkMs() // DAY_MS  # days before this one are complete
        waiting.sort()
        out, at = [], 0
        while at < len(waiting) and waiting[at][0] < closed:
            upto = at
            while upto < len(waiting) and waiting[upto][0] == waiting[at][0]:
                upto += 1
            today = waiting[at][0]
            out += [(key[0], i, s, today, n, wins, losses, up, down, None if last is None else today - last) for _, i, s, _, _ in waiting[at:upto]]
            for _, _, _, w, lo in waiting[at:upto]:
                n, wins, losses = n + 1, wins + w, losses + lo
                up, down = (up + 1, 0) if w else (0, down + 1) if lo else (up, down)
            last, at = today, upto
        waiting = waiting[at:]
        state.update((json.dumps([n, wins, losses, up, down, last, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max((waiting[0][0] + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["entity", "bout_id", "side", "day", "total_fights", "total_wins", "total_losses", "win_streak", "loss_streak", "days_since_last_fight"])
        yield frame.astype({"days_since_last_fight": "Int32"})

    return timed.groupBy("entity").applyInPandasWithState(step, OUTPUT, "packed string", "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Count and sum of a value per tumbling window and kind of a stream (or table) of events."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
