"""Relations of timed segments, read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a transcript; a turn lasts a tenth of a second for each character."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf_dir, "conversations").withColumn("sum", F.sum(F.length("text")).over(w))
    return t.select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), ((F.col("sum") - F.length("text")) / 10.0).alias("start"),
        (F.col("sum") / 10.0).alias("end"), "text", "role",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored segments."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.col("value") * 60.0).alias("end"),
        F.col("value").alias("score"), F.col("event_type").alias("topic"),
    )


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of one type as points in time."""
    return candidates(spark, sf_dir).filter(F.col("topic") == kind).select("video_id", "seq", F.col("start").alias("time"), "score")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as topics of a video, some overlapping, with opinions that may be missing."""
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    start = F.expr("n * 40.0D + event_id % 7 * 5.0D")
    text = lambda s: F.expr(s)
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.expr("20.0D + event_id % 60")).alias("end"),
        text("concat('t', n div 3, ' ', event_type, ' a', event_id % 5)").alias("topic"), text("concat(event_type, ' point ', event_id % 4, '. Then ', event_id % 3, '.')").alias("summary"),
        F.expr("CAST(event_id % 101 AS DOUBLE)").alias("score"), text("concat('because ', event_type, '.')").alias("reason"),
        text("CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'for it' ELSE concat('strongly against ', event_type) END").alias("stance"),
        text("array(concat('k', event_id % 3), concat('m', event_id % 2))").alias("key_sentences"),
        F.expr("CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 11 AS DOUBLE) END").alias("conclusion_clarity"), F.expr("CAST(event_id % 7 AS DOUBLE)").alias("self_contained"),
        F.expr("CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 8 AS DOUBLE) END").alias("info_density"), F.expr("CAST(event_id % 9 AS DOUBLE)").alias("viral_fit"),
        F.expr("CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 100 AS DOUBLE) END").alias("publishability"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text read in sampled frames: each role is a region; some turns lack text, some name parts of a user interface."""
    region = F.expr("CASE role WHEN 'user' THEN '0.80-0.95' WHEN 'assistant' THEN '0.10-0.30' ELSE '0.55-0.75' END")
    text = F.expr("CASE WHEN turn % 5 = 4 THEN ' ' WHEN conv_id % 7 = 3 THEN concat('Button panel ', text) ELSE text END")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), region.alias("region"), F.col("turn").cast("long").alias("frame"), text.alias("text"), F.expr("0.5D + turn / 100.0D").alias("top")
    )
