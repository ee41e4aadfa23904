"""Elo ratings before each contest.

A rating depends on the opponent's rating at the time, so contests must be folded in order; no window expresses that. The
fold reads five narrow columns from one sorted partition (an external sort), streams them, and holds one number per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.runtime import parallelism


def elo(contests: DataFrame, k: float = 32.0, initial: float = 500.0) -> DataFrame:
    """``bout_id, red_elo, blue_elo, elo_diff, red_elo_win_prob, blue_elo_win_prob`` before each contest.

    Contests of one day see the ratings of the day before and are then applied in order of ``bout_id``; a draw or no
    contest scores one half for either side. The input needs ``bout_id, day, red_id, blue_id, outcome``. The fold is one
    task by its nature: it streams the sorted rows (they are never held together) and keeps a rating per entity.
    """
    score = F.when(F.col("outcome") == "red_win", 1.0).when(F.col("outcome") == "blue_win", 0.0).otherwise(0.5)
    rows = contests.select("bout_id", "day", F.col("red_id").alias("r"), F.col("blue_id").alias("b"), score.alias("s"))
    ordered = rows.repartition(1).sortWithinPartitions("day", "bout_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict = {}
        today, waiting = None, []
        for batch in batches:
            ids, days, reds, blues, scores = (batch.column(i).to_pylist() for i in range(5))
            red, blue = np.empty(len(ids)), np.empty(len(ids))
            for i, day in enumerate(days):
                if today is not None and day < today:
                    raise RuntimeError("the contests are out of order")
                if day != today:
                    for x, y, s in waiting:
                        a, b = ratings.get(x, initial), ratings.get(y, initial)
                        expected = 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0))
                        ratings[x], ratings[y] = a + k * (s - expected), b + k * ((1.0 - s) - (1.0 - expected))
                    today, waiting = day, []
                red[i], blue[i] = ratings.get(reds[i], initial), ratings.get(blues[i], initial)
                waiting.append((reds[i], blues[i], scores[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(red), pa.array(blue)], names=["bout_id", "red_elo", "blue_elo"])

    rated = ordered.mapInArrow(fold, "bout_id bigint, red_elo double, blue_elo double").repartition(parallelism(contests.sparkSession), "bout_id")
    p = N.expected_score(F.col("red_elo"), F.col("blue_elo"))
    return rated.select("*", (F.col("red_elo") - F.col("blue_elo")).alias("elo_diff"), p.alias("red_elo_win_prob"), (1 - p).alias("blue_elo_win_prob"))
