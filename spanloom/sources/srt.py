"""SubRip text: scan and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fmt_srt, parse_srt


TIMES = {"regex": "^\\s*(\\d+:\\d+:\\d+[,.]\\d+)\\s*-->\\s*(\\d+:\\d+:\\d+[,.]\\d+)", "strict": "^\\s*(\\d+:\\d+:\\d+,\\d+)\\s*-->\\s*(\\d+:\\d+:\\d+,\\d+)"}


def scan_srt(files: DataFrame, text: str = "value", style: str = "tolerant") -> DataFrame:
    """Rows of whole files to segments: blocks of three lines or more with an arrow. A bad time is 0 in the tolerant style; in the others (regex: comma or point, strict: comma) its block goes."""
    blocks = files.select("*", F.posexplode(F.split(F.regexp_replace(F.col(text), "\\r", ""), "\\n\\s*\\n")).alias("block", "_b"))
    lines = blocks.withColumn("_l", F.split(F.regexp_replace("_b", "^\\n+|\\n+$", ""), "\\n")).filter(F.size("_l") >= 3)
    if style == "tolerant":
        lines, stamp = lines.filter(F.col("_l")[1].contains(" --> ")), F.split(F.col("_l")[1], " --> ")
    else:
        lines, stamp = lines.filter(F.col("_l")[1].rlike(TIMES[style])), F.array(*[F.regexp_extract(F.col("_l")[1], TIMES[style], i) for i in (1, 2)])
    return lines.select(
        *[c for c in files.columns if c != text], F.col("block").alias("seq"), parse_srt(stamp[0]).alias("start"), parse_srt(stamp[1]).alias("end"),
        F.array_join(F.slice("_l", 3, F.size("_l")), " ").alias("text"),
    )


def srt_blocks(segments: DataFrame) -> DataFrame:
    """video_id, seq and the block of each segment, numbered from 1 in order of start."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "seq"))
    body = F.concat_ws("\n", n.cast("string"), F.concat(fmt_srt(F.col("start")), F.lit(" --> "), fmt_srt(F.col("end"))), "text", F.lit(""))
    return segments.select("video_id", "seq", body.alias("block"))
