"""Folds over streams of timed segments: state is what the fold would look back on, keyed by video, and a window goes out once it is closed.

Segments arrive in any order within a micro-batch and in order of start between them, up to the watermark on their arrival time `at`; when the watermark passes a video's
last arrival by the patience, its open window is closed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "video_id long, start double, end double"


def merge_windows(segments: DataFrame, gap: float = 2.5, short: float = 2.5, most: float = 6.0, lateness: str = "10 seconds", patience: int = 60_000) -> DataFrame:
    """operators.folds.merge_windows() of a stream of video_id, start, end and at."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=["video_id", "start", "end"])
            return
        out, rows = [], sorted((r.start, r.end) for b in batches for r in b[["start", "end"]].itertuples())
        for start, end in rows:
            if held and start - held[1] <= gap and held[1] - held[0] < short and end - held[0] <= most:
                held = (held[0], end)
            else:
                out += [(key[0], *held)] if held else []
                held = (start, end)
        state.update(held)
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + patience)
        yield pd.DataFrame(out, columns=["video_id", "start", "end"])

    return segments.withWatermark("at", lateness).groupBy("video_id").applyInPandasWithState(run, KIND, "start double, end double", "append", "EventTimeTimeout")


def sessions(segments: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of segments of a video that arrive within a gap of each other: their span, and how many there are."""
    w = segments.withWatermark("at", lateness).groupBy("video_id", F.session_window("at", gap).alias("w"))
    return w.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("segments")).select("video_id", "start", "end", "segments")


def drained(stream: Callable[[DataFrame], DataFrame], source: DataFrame, out: str, checkpoint: str) -> None:
    """Pass all that a stream's source holds now through it, into parquet files; a restart with the same checkpoint goes on where it ended."""
    query = stream(source).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
