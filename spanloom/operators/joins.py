"""Joins of timed segments. All have the video as an equi-key, so they hash or merge; the interval is a residual filter, or a time bucket where videos are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps_inclusive(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Touching counts."""
    return (a_start <= b_end) & (a_end >= b_start)


def overlaps_half_open(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def interval_join(segments: DataFrame, clips: DataFrame, predicate=overlaps_inclusive, bucket: float | None = None) -> DataFrame:
    """Segments (video_id, start, end, ...) with the clips (video_id, clip, clip_start, clip_end) that they overlap.

    With bucket, both sides are cut at multiples of it and joined on the cell too; a pair is kept in its first common cell only."""
    on, left, right = ["video_id"], segments, clips
    if bucket:
        cells = lambda s, e: F.sequence(F.floor(s / bucket), F.floor(e / bucket))
        left = left.withColumn("cell", F.explode(cells(F.col("start"), F.col("end"))))
        right = right.withColumn("cell", F.explode(cells(F.col("clip_start"), F.col("clip_end"))))
        on = ["video_id", "cell"]
    out = left.join(right, on).filter(predicate(F.col("start"), F.col("end"), F.col("clip_start"), F.col("clip_end")))
    if bucket:
        out = out.filter(F.col("cell") == F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("clip_start") / bucket))).drop("cell")
    return out


def clip_subset(segments: DataFrame, clips: DataFrame, bucket: float | None = None) -> DataFrame:
    """A clip's segments, cut to it and with times from its start."""
    both = interval_join(segments, clips, bucket=bucket)
    start = F.greatest(F.lit(0.0), F.col("start") - F.col("clip_start"))
    end = F.least(F.col("clip_end") - F.col("clip_start"), F.col("end") - F.col("clip_start"))
    return both.select("video_id", "clip", "seq", start.alias("start"), end.alias("end"), "text")


def with_speech(segments: DataFrame, clips: DataFrame, bucket: float) -> DataFrame:
    """Clips with the seconds that segments fill of them, in one pass over both: clips go in as segments without speech, so none is lost."""
    none = F.lit(None).cast("double")
    own = segments.select("video_id", "start", "end", F.lit(1).alias("n")).unionByName(clips.select("video_id", F.col("clip_start").alias("start"), F.col("clip_end").alias("end"), F.lit(0).alias("n")))
    both = interval_join(own, clips, bucket=bucket).withColumn("s", F.least("end", "clip_end") - F.greatest("start", "clip_start"))
    return both.groupBy("video_id", "clip", "clip_start", "clip_end").agg(F.sum(F.when(F.col("n") == 1, F.col("s")).otherwise(none)).alias("speech"))


def nearest_point(events: DataFrame, scenes: DataFrame, half: float) -> DataFrame:
    """For each event the scene strictly before it that is nearest to half earlier, and the one after it nearest to half later; the earlier one on a tie.

    One window over scenes and points in order of time finds the neighbours of each: nothing is paired."""
    t, none = F.col("time"), F.lit(None).cast("double")
    s = scenes.select("video_id", F.lit(None).cast("long").alias("seq"), F.col("time").alias("at"), F.lit(0).alias("kind"), t.alias("scene"), none.alias("time"))
    # scenes are of kind 0: a point of a lesser kind comes before those at its time, one of a greater kind after them
    rows = s
    for kind, at in ((-1, t), (1, t), (2, t - half), (3, t + half)):
        rows = rows.unionByName(events.select("video_id", "seq", at.alias("at"), F.lit(kind).alias("kind"), none.alias("scene"), "time"))
    w = Window.partitionBy("video_id").orderBy("at", "kind")
    low, high = F.last("scene", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("scene", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = rows.select("*", low.alias("low"), high.alias("high")).filter("kind <> 0")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    got = found.groupBy("video_id", "seq").agg(
        F.max("time").alias("time"), pick(-1, "low").alias("last"), pick(1, "high").alias("first"), pick(2, "low").alias("b1"), pick(2, "high").alias("b2"), pick(3, "low").alias("a1"), pick(3, "high").alias("a2")
    )
    near = lambda x, y, ideal: F.when(x.isNull() | (F.abs(y - ideal) < F.abs(x - ideal)), y).otherwise(x)
    ideal = F.col("time") - half
    b2 = F.when(F.col("b2") < F.col("time"), F.col("b2"))
    before = F.when(F.col("last").isNull(), F.greatest(F.lit(0.0), ideal)).otherwise(near(F.col("b1"), F.coalesce(b2, F.col("b1")), ideal))
    a1 = F.when(F.col("a1") > F.col("time"), F.col("a1"))
    after = F.when(F.col("first").isNull(), F.col("time") + half).otherwise(near(a1, F.coalesce("a2", a1), F.col("time") + half))
    return got.select("video_id", "seq", before.alias("start"), after.alias("end"))


def last_wins(rows: DataFrame, key: list[str], order: Column, value: str) -> DataFrame:
    """One row for each key: the last."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def positional_full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of the same place, with the span of both; a row without partner stays."""
    num = lambda d, n: d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", "seq"))).select(
        key, "place", F.col("start").alias(f"{n}_start"), F.col("end").alias(f"{n}_end"), F.col("text").alias(f"{n}_text")
    )
    both = num(a, "a").join(num(b, "b"), [key, "place"], "full")
    return both.select(key, "place", F.least("a_start", "b_start").alias("start"), F.greatest("a_end", "b_end").alias("end"), "a_text", "b_text")
