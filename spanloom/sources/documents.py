"""Relations from documents: JSON, subtitle tracks, files and the cache of transcribed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.strings import env_line

TRACK = "struct<streams:array<struct<index:int,codec_type:string,tags:struct<language:string,title:string>>>>"


def json_rows(documents: DataFrame, column: str, schema: str, field: str) -> DataFrame:
    """The rows of an array in JSON documents, numbered from 0; documents that don't parse have none, and members that are no objects go."""
    parsed = documents.withColumn("_d", F.from_json(column, f"struct<{field}:array<{schema}>>")).select("*", F.posexplode(f"_d.{field}").alias("seq", "_r"))
    return parsed.filter("_r IS NOT NULL").select(*[c for c in documents.columns if c != column], "seq", "_r.*")


def subtitle_tracks(probes: DataFrame, column: str) -> DataFrame:
    """The subtitle tracks in probes' JSON."""
    found = probes.withColumn("_t", F.explode(F.from_json(column, TRACK)["streams"])).filter("_t.codec_type = 'subtitle'")
    return found.select(*[c for c in probes.columns if c != column], F.col("_t.index").alias("index"), F.col("_t.tags.language").alias("language"), F.col("_t.tags.title").alias("title"))


def duration(probed: Column, size_mb: Column, policy: str = "guess") -> Column:
    """A medium's seconds: where they aren't known, guessed from its size and then an hour; or 0; or null."""
    return {"guess": F.coalesce(probed, size_mb * 60.0, F.lit(3600.0)), "zero": F.coalesce(probed, F.lit(0.0)), "null": probed}[policy]


def download_format(quality: Column) -> Column:
    """What to ask a site for: the best, at most a height, or as it is written."""
    height = F.regexp_extract(quality, "^(\\d+)p$", 1)
    return F.when(quality == "best", "bestvideo+bestaudio/best").when(
        height != "", F.concat(F.lit("bestvideo[height<="), height, F.lit("]+bestaudio/best[height<="), height, F.lit("]"))
    ).otherwise(quality)


def resolved(reported: DataFrame, files: DataFrame) -> DataFrame:
    """video_id and path: the first reported path (video_id, rank, path) that is a file, else the newest file (video_id, path, mtime) that isn't partial."""
    have = reported.join(files.select("video_id", "path"), ["video_id", "path"], "left_semi").groupBy("video_id").agg(F.min_by("path", "rank").alias("first"))
    newest = files.filter(~F.col("path").endswith(".part")).groupBy("video_id").agg(F.max_by("path", F.struct("mtime", "path")).alias("newest"))
    ids = reported.select("video_id").unionByName(files.select("video_id")).distinct()
    return ids.join(have, "video_id", "left").join(newest, "video_id", "left").select("video_id", F.coalesce("first", "newest").alias("path"))


def discovered(videos: DataFrame, files: DataFrame, lang: str) -> DataFrame:
    """video_id and subtitle of videos (video_id, explicit, stem): the file that is named, or else one beside the video; a named one that isn't there is not replaced."""
    near = [F.concat("stem", F.lit(f"{glue}{lang}.srt")) for glue in ("_", ".")]
    asked = videos.withColumn("_c", F.when(F.col("explicit").isNotNull(), F.array("explicit")).otherwise(F.array(*near))).select("video_id", F.posexplode("_c").alias("rank", "path"))
    found = asked.join(files.select("path"), "path", "left_semi").groupBy("video_id").agg(F.min_by("path", "rank").alias("subtitle"))
    return videos.select("video_id").join(found, "video_id", "left")


def cache_key(content: Column, engine: Column, model: Column, language: Column, chunk: Column) -> Column:
    """A cached chunk's name: engine, digest of the medium's first MiB, model, language and the chunk's number."""
    digest = F.substring(F.md5(F.substring(content, 1, 1 << 20)), 1, 16)
    return F.concat_ws("_", F.nullif(engine, F.lit("")), digest, model, language, F.format_string("chunk%03d", chunk))


def cached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Each chunk (video_id, clip) with its cached segments, and whether it hits: an empty or missing list misses, and is to be deleted if it is there."""
    both = chunks.join(cache.select("video_id", "clip", "segments", F.lit(True).alias("there")), ["video_id", "clip"], "left")
    hit = F.coalesce(F.size("segments") > 0, F.lit(False))
    return both.select("video_id", "clip", F.when(hit, F.col("segments")).alias("segments"), hit.alias("hit"), (F.coalesce("there", F.lit(False)) & ~hit).alias("stale"))


def resumed(chunks: DataFrame, cache: DataFrame, recompute) -> DataFrame:
    """The segments of all chunks: cached ones, and those of recompute(misses) for the others."""
    found = cached(chunks, cache)
    return found.filter("hit").select("video_id", "clip", "segments").unionByName(recompute(found.filter("NOT hit").select("video_id", "clip")).select("video_id", "clip", "segments"))


def rebased(segments: DataFrame) -> DataFrame:
    """Segments (video_id, clip, start, end, words, chunk_start, chunk_duration) with times from the video's start: a chunk whose times all lie within its length counts from its own start."""
    w = Window.partitionBy("video_id", "clip")
    relative = (F.col("chunk_start") > 0) & (F.max("end").over(w) <= F.col("chunk_duration") + 1.0) & (F.min("start").over(w) >= -1.0)
    by = F.when(relative, F.col("chunk_start")).otherwise(0.0)
    shift = lambda t: F.when(F.col("_by") > 0, F.round(t + F.col("_by"), 3)).otherwise(t)
    out = segments.withColumn("_by", by).withColumn("start", shift(F.col("start"))).withColumn("end", shift(F.col("end")))
    if "words" in segments.columns:
        moved = F.transform("words", lambda x: F.struct(x["word"].alias("word"), shift(x["start"]).alias("start"), shift(x["end"]).alias("end")))
        out = out.withColumn("words", moved)
    return out.drop("_by")


def settings(lines: list[str], environment: dict[str, str], force: bool = False) -> dict[str, str]:
    """The settings of a file's lines; those of the environment win unless forced."""
    found = dict(p for p in map(env_line, lines) if p)
    return environment | found if force else found | environment
