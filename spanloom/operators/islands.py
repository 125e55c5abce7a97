"""Windows and gaps-and-islands: decisions from neighbouring input rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list, new: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows; new is true where a row doesn't continue the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunk_windows(totals: DataFrame, duration: float, overlap: float) -> DataFrame:
    """video_id and total to overlapping windows; the last is cut, and none starts after one that reaches the end."""
    step = duration - overlap
    n = F.greatest(F.lit(0), F.ceil((F.col("total") - duration) / step)).cast("int")
    w = totals.filter("total > 0").select("video_id", "total", F.explode(F.sequence(F.lit(0), n)).alias("clip"))
    start = F.col("clip") * F.lit(step)
    return w.select("video_id", F.col("clip").cast("long").alias("clip"), start.alias("clip_start"), F.least(start + duration, F.col("total")).alias("clip_end"))


def change_windows(times: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs of consecutive points that are far enough apart."""
    w = Window.partitionBy("video_id").orderBy("time")
    return times.withColumn("end", F.lead("time").over(w)).filter(F.col("end") - F.col("time") >= least).select("video_id", F.col("time").alias("start"), "end")


def prefix_by_chars(rows: DataFrame, keys: list[str], order: list, text: Column, most: int) -> DataFrame:
    """Rows while their lines, with one character each for the break, fit; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    used = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("_n", F.row_number().over(w)).filter((F.col("used") <= most) | (F.col("_n") == 1)).drop("_n")


def zscores(rows: DataFrame, value: str) -> DataFrame:
    """(value - mean) / (population deviation + 1e-8) within a video."""
    w = Window.partitionBy("video_id")
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8))


def weighted_zscores(rows: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """The weighted sum of several columns' zscores."""
    w = Window.partitionBy("video_id")
    parts = [(F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8) * by for c, by in weights.items()]
    return rows.withColumn(name, sum(parts[1:], parts[0]))
