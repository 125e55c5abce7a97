"""The engine's queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import scoring, text
from spanloom.operators import detect, folds, islands, joins
from spanloom.operators import topics as topic_ops
from spanloom.plans.registry import QUERIES, Query, query
from spanloom.sources import srt
from spanloom.sources.relations import asr_segments, candidates, frames, points, table, topics

DURATION, OVERLAP = 60.0, 10.0


def queries() -> dict[str, Query]:
    from spanloom.plans import media, subtitles  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = asr_segments(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("total"))
    return islands.chunk_windows(totals, DURATION, OVERLAP)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asr_segments(spark, sf_dir).drop("role")


@query
def chunk_windows(spark, sf_dir):
    """ISL06."""
    return _clips(spark, sf_dir)


@query
def asr_subset(spark, sf_dir):
    """JN01; cells as long as a window keep a long video's pairs few."""
    return joins.clip_subset(_segments(spark, sf_dir), _clips(spark, sf_dir), DURATION)


@query
def window_transcript(spark, sf_dir):
    """JN02, AGG13."""
    both = joins.interval_join(_segments(spark, sf_dir), _clips(spark, sf_dir), joins.overlaps_half_open, DURATION)
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return both.groupBy("video_id", "clip").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("transcript"))


@query
def word_alignment(spark, sf_dir):
    """JN03: words by their midpoint in half-open windows, as the window's text; cells as long as a window make it an equi-join."""
    split = _segments(spark, sf_dir).select("video_id", "seq", "start", "end", F.split("text", " ").alias("ws"), F.size(F.split("text", " ")).alias("n"))
    words = split.select("video_id", "seq", "start", "end", "n", F.posexplode("ws").alias("pos", "word"))  # counted before: not again for each word
    mid = F.col("start") + (F.col("end") - F.col("start")) * (F.col("pos") + 0.5) / F.col("n")
    cell = lambda t: F.floor(t / DURATION)
    clips = _clips(spark, sf_dir).withColumn("cell", F.explode(F.sequence(cell(F.col("clip_start")), cell(F.col("clip_end")))))
    w = words.withColumn("mid", mid).withColumn("cell", cell(F.col("mid"))).join(clips, ["video_id", "cell"]).filter("mid >= clip_start AND mid < clip_end")
    held = F.array_sort(F.collect_list(F.struct("mid", "seq", "pos", "word")))
    return w.groupBy("video_id", "clip").agg(F.count("*").alias("words"), text.join_cleanup(F.array_join(F.transform(held, lambda x: x["word"]), " ")).alias("text"))


@query
def nearest_scene(spark, sf_dir):
    """JN04."""
    return joins.nearest_point(points(spark, sf_dir, "purchase"), points(spark, sf_dir, "error"), 43200.0)


@query
def topic_summary_lookup(spark, sf_dir):
    """JN06: the last summary of a trimmed key, empty ones counting as missing. Spark broadcasts the summaries where they are small."""
    c = candidates(spark, sf_dir)
    summary = c.select(F.trim("topic").alias("topic"), "seq", F.when(F.col("seq") % 7 == 0, "").otherwise(F.concat("topic", F.lit("-"), F.col("seq") % 10)).alias("summary"))
    last = joins.last_wins(summary, ["topic"], F.col("seq"), "summary")
    return c.join(last, "topic", "left").select("video_id", "seq", F.coalesce(F.nullif(F.col("summary"), F.lit("")), "topic").alias("summary"))


@query
def first_match_join(spark, sf_dir):
    """JN07."""
    c = candidates(spark, sf_dir)
    first = c.groupBy("video_id", "topic").agg(F.min("seq").alias("first_seq"))
    return c.join(first, ["video_id", "topic"], "left").select("video_id", "seq", "first_seq")


@query
def positional_full_join(spark, sf_dir):
    """JN08."""
    s = asr_segments(spark, sf_dir)
    return joins.positional_full(s.filter("role = 'user'"), s.filter("role = 'assistant'"), "video_id")


@query
def cache_anti_join(spark, sf_dir):
    """JN14: windows that aren't cached."""
    w = _clips(spark, sf_dir)
    return w.join(w.filter("(video_id + clip) % 3 = 0").select("video_id", "clip"), ["video_id", "clip"], "left_anti").select("video_id", "clip")


def _raw(spark, sf_dir):
    raw = F.expr("CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN CAST(seq % 13 AS STRING) WHEN 3 THEN CAST((seq % 100) / 100.0D AS STRING) ELSE CAST(seq % 150 AS STRING) END")
    return candidates(spark, sf_dir).select("video_id", "seq", raw.alias("raw"))


@query
def score_coerce(spark, sf_dir):
    """PRJ01."""
    return _raw(spark, sf_dir).select("seq", F.round(scoring.score_coerce(F.col("raw")), 6).alias("score"))


@query
def speech_coverage(spark, sf_dir):
    """AGG10."""
    d = F.col("clip_end") - F.col("clip_start")
    return joins.with_speech(_segments(spark, sf_dir), _clips(spark, sf_dir), DURATION).select("video_id", "clip", F.round(F.least(F.lit(1.0), F.coalesce("speech", F.lit(0.0)) / d), 4).alias("coverage"))


@query
def clip_fit(spark, sf_dir):
    """PRJ24 over JN01."""
    d = F.col("clip_end") - F.col("clip_start")
    return joins.with_speech(_segments(spark, sf_dir), _clips(spark, sf_dir), DURATION).select("video_id", "clip", F.round(scoring.clip_fit(d, F.coalesce("speech", F.lit(0.0)), 45.0), 1).alias("fit"))


@query
def text_norm(spark, sf_dir):
    """PRJ07."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("norm_md5"))


@query
def token_jaccard(spark, sf_dir):
    """PRJ08, PRJ09, JN10: consecutive turns."""
    s = asr_segments(spark, sf_dir).withColumn("tok", text.tokens(F.col("text")))
    w = Window.partitionBy("video_id").orderBy("seq")
    return s.withColumn("prev", F.lag("tok").over(w)).filter("prev IS NOT NULL").select("video_id", "seq", F.round(text.jaccard(F.col("prev"), F.col("tok")), 6).alias("jaccard"))


@query
def token_union(spark, sf_dir):
    """SET02, SET03."""
    s = asr_segments(spark, sf_dir).select("video_id", F.explode(text.tokens(F.col("text"))).alias("tok"))
    return s.groupBy("video_id").agg(F.countDistinct("tok").alias("tokens"), F.min("tok").alias("lo"), F.max("tok").alias("hi"))


@query
def language_status(spark, sf_dir):
    """PRJ12 over whole texts, with a CJK tail for every third document, up to as long as the text."""
    tail = F.repeat(F.lit("中"), (F.length("text") * (F.col("doc_id") % 40) / 40).cast("int"))
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, tail).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.language_status(t).alias("status"))


@query
def meta_output(spark, sf_dir):
    """PRJ17, with remarks put before some turns."""
    t = F.concat(F.expr("CASE turn % 6 WHEN 0 THEN 'Translator NOTE ' WHEN 1 THEN '此处应为空行' WHEN 2 THEN '原文第12行 ' WHEN 3 THEN 'Note: ' ELSE '' END"), "text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(text.meta_output(t)).alias("meta"), F.coalesce(F.bool_or(text.meta_output(t)), F.lit(False)).alias("any_meta"))


@query
def lang_drift(spark, sf_dir):
    """PRJ15, PRJ16 for both targets; blank texts don't count."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.expr("CASE WHEN turn % 4 = 1 THEN '  ' WHEN conv_id % 9 = turn THEN concat(text, '中') ELSE text END"))
    zh, en = text.drift(text.looks_english(F.col("text")), F.col("text")), text.drift(F.col("text").rlike(text.CJK), F.col("text"))
    return c.groupBy("conv_id").agg(zh.alias("drift_zh"), en.alias("drift_en"))


@query
def json_extract(spark, sf_dir):
    """PRJ18, PRJ48: a number from fenced, prefixed or plain JSON."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result: "), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.fenced_json(raw), "$.k").cast("long").alias("k"))


@query
def transcript_prefix(spark, sf_dir):
    """ISL05."""
    out = islands.prefix_by_chars(_segments(spark, sf_dir), ["video_id"], ["seq"], F.col("text"), 1500)
    return out.groupBy("video_id").agg(F.count("*").alias("lines"), F.max("used").alias("chars"))


@query
def change_windows(spark, sf_dir):
    """ISL03, FLT08."""
    return islands.change_windows(points(spark, sf_dir, "error").select("video_id", "time"))


@query
def srt_lines(spark, sf_dir):
    """SNK05, PRJ05."""
    return srt.srt_blocks(_segments(spark, sf_dir))


@query
def chunk_clusters(spark, sf_dir):
    """ISL02."""
    return topic_ops.chunk_clusters(topics(spark, sf_dir)).select("video_id", "seq", "cluster")


@query
def cluster_collapse(spark, sf_dir):
    """AGG01, PRJ22, PRJ25, PRJ47, TOP05: each run of chunk_clusters as one topic."""
    c = topic_ops.chunk_clusters(topics(spark, sf_dir))
    out = folds.fold(c, lambda rows: topic_ops.merge_clusters(rows, "opinion"), "cluster long, " + topic_ops.SCHEMA)
    return out.withColumn("key_sentences", F.array_join("key_sentences", "|"))


@query
def zscore(spark, sf_dir):
    """AGG04."""
    return islands.zscores(candidates(spark, sf_dir), "score").select("seq", F.round("z", 4).alias("z"))


@query
def nearest_rank_pct(spark, sf_dir):
    """AGG08."""
    s = F.array_sort(F.collect_list("score"))
    return candidates(spark, sf_dir).groupBy("video_id").agg(s.alias("s")).select("video_id", F.element_at("s", F.bround((F.size("s") - 1) * 0.8).cast("int") + 1).alias("p80"))


@query
def failure_reason(spark, sf_dir):
    """AGG11, AGG12."""
    c = candidates(spark, sf_dir).groupBy("video_id").agg(F.countDistinct("topic").alias("k"), F.min("topic").alias("one"), F.bool_or(F.col("topic") == "signup").alias("ok"))
    return c.select("video_id", F.when(F.col("k") == 1, F.col("one")).when(F.col("ok"), "llm_empty_segments").otherwise("all_topic_windows_failed").alias("reason"))


@query
def frame_vote(spark, sf_dir):
    """AGG14."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("zh"), F.count_if(F.col("role") == "assistant").alias("en"))
    return c.select("conv_id", F.when(F.col("zh") + F.col("en") == 0, "uncertain").when(F.col("zh") >= F.col("en"), "zh").otherwise("en").alias("lang"))


@query
def stream_score(spark, sf_dir):
    """AGG07, AGG16, FLT06, FLT07, PRJ28: a region's points for change, length, place, wordiness and frames, less those for words of user interfaces. (SQL, which has no sequence ratio, counts any change.)"""
    return detect.stream_scores(frames(spark, sf_dir)).select("video_id", "region", "score", "frames", "heavy")


@query
def strategy_filter(spark, sf_dir):
    """FLT05."""
    c = candidates(spark, sf_dir).withColumn("s", scoring.score_coerce(F.col("score").cast("string")))
    w = Window.partitionBy("video_id")
    r = c.withColumn("rn", F.row_number().over(w.orderBy(F.desc("s"), "start", "seq"))).withColumn("n", F.count("*").over(w))
    r = r.withColumn("at", F.max(F.when(F.col("rn") == scoring.MAX_CLIPS + 1, F.col("s"))).over(w))
    r = r.withColumn("keep", (F.col("n") <= scoring.MAX_CLIPS) | (F.col("s") >= F.greatest(F.lit(80.0), F.col("at") - 1)))
    r = r.withColumn("any", F.max("keep").over(w))
    return r.filter(F.col("keep") | ~F.col("any")).select("video_id", "seq")


@query
def topk_by_score(spark, sf_dir):
    """TOP02, TOP03."""
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "start", "seq")
    return candidates(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("video_id", "seq", "rank")


@query
def merge_windows(spark, sf_dir):
    """FLD02."""
    return folds.fold(candidates(spark, sf_dir), lambda rows: folds.merge_windows(rows, 7200.0, 14400.0, 28800.0), "video_id long, start double, end double")


@query
def remove_overlaps(spark, sf_dir):
    """FLD10."""
    return folds.fold(candidates(spark, sf_dir), folds.remove_overlaps, "video_id long, seq long")


@query
def change_points(spark, sf_dir):
    """FLD13; a video lasts as long as its last point."""
    c = candidates(spark, sf_dir)
    first = c.groupBy("video_id").agg(F.min("start").alias("zero"))
    c = c.join(first, "video_id").select("video_id", F.round((F.col("start") - F.col("zero")) / 3600.0, 3).alias("time"), (F.col("seq") % 100 / 100.0).alias("diff"))
    return folds.fold(c, lambda rows: folds.change_points(rows, max(r["time"] for r in rows), apart=6.0), "video_id long, time double")


@query
def chunk_pack(spark, sf_dir):
    """FLD15."""
    return folds.fold(_segments(spark, sf_dir), lambda rows: folds.chunk_pack(rows, 1200, 3), "video_id long, seq long, chunk long")


@query
def greedy_clips(spark, sf_dir):
    """FLD07 over candidates with PRJ01 scores: the flagship."""
    c = candidates(spark, sf_dir).withColumn("score", scoring.score_coerce(F.col("score").cast("string")))
    return folds.fold(c, folds.greedy_select, "video_id long, seq long, start double, end double, score double")


@query
def asr_dedupe(spark, sf_dir):
    """FLD01, PRJ11; unit-tested, since SQL has no sequence ratio."""
    return folds.fold(_segments(spark, sf_dir), folds.asr_dedupe, "video_id long, seq long, start double, end double")


@query
def split_text(spark, sf_dir):
    """FLD14; tested on given cases, and by its parts' joint text and times."""
    return folds.fold(_segments(spark, sf_dir), lambda rows: [p for r in rows for p in folds.split_text(r, 42)], "video_id long, seq long, start double, end double, text string")


@query
def pad_edge(spark, sf_dir):
    """FLD08; unit-tested."""
    def step(rows):
        return folds.pad_edges(rows, [x for r in rows for x in (r["start"], r["end"])], 90.0)

    return folds.fold(_segments(spark, sf_dir), step, "video_id long, seq long, start double, end double")


@query
def split_long(spark, sf_dir):
    """FLD09, JN13; unit-tested."""
    def step(rows):
        ends, whole = [r["end"] for r in rows], {"start": min(r["start"] for r in rows), "end": max(r["end"] for r in rows)}
        return [{"video_id": rows[0]["video_id"], "start": a, "end": b} for a, b in folds.split_long(whole, ends, 60.0, 180.0, 120.0)]

    return folds.fold(_segments(spark, sf_dir), step, "video_id long, start double, end double")


@query
def normalize_topics(spark, sf_dir):
    """FLD06, PRJ47, PRJ48, FLT02; tested on given cases."""
    return folds.fold(topics(spark, sf_dir), lambda rows: topic_ops.normalize(rows, 1e9, 45.0), topic_ops.SCHEMA).drop("key_sentences")


@query
def find_peaks(spark, sf_dir):
    """FLD12, TOP01; unit-tested."""
    c = candidates(spark, sf_dir).select("video_id", F.col("start").alias("time"), F.col("score").alias("value"))
    return folds.fold(c, lambda rows: folds.find_peaks(rows, 1.0, 86400.0, 5), "video_id long, time double, value double")


@query
def video_span(spark, sf_dir):
    """AGG05, AGG06."""
    return asr_segments(spark, sf_dir).groupBy("video_id").agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("total"), F.count("*").alias("segments"))


@query
def fmt_mmss(spark, sf_dir):
    """PRJ04."""
    return candidates(spark, sf_dir).select("seq", text.fmt_mmss(F.col("score") * 60.0).alias("stamp"))


@query
def transcript_lines(spark, sf_dir):
    """PRJ51."""
    return _segments(spark, sf_dir).select("video_id", "seq", text.transcript_line(F.col("start"), F.col("end"), F.col("text")).alias("line"))


@query
def sentence_breaks(spark, sf_dir):
    """PRJ52: a line for each sentence."""
    return _segments(spark, sf_dir).select("video_id", "seq", F.regexp_replace("text", "([.?!]) ", "$1\n").alias("lines"))


@query
def join_cleanup(spark, sf_dir):
    """PRJ50: words and marks joined by spaces, then without space before marks."""
    spaced = F.regexp_replace("text", "([,.!?])", " $1")
    return _segments(spark, sf_dir).select("video_id", "seq", text.join_cleanup(spaced).alias("text"))


@query
def english_sample(spark, sf_dir):
    """AGG15: of the first five rows, those that aren't blank must be English: all if fewer than four, else four. Without any, false."""
    w = Window.partitionBy("video_id").orderBy("seq")
    t = F.expr("CASE WHEN video_id % 10 = 3 OR seq = 1 THEN ' ' ELSE text END")
    first = _segments(spark, sf_dir).withColumn("text", t).withColumn("n", F.row_number().over(w)).filter("n <= 5")
    full = text.stripped(F.col("text")) != ""
    votes = first.groupBy("video_id").agg(F.count_if(full).alias("n"), F.count_if(full & text.looks_english(F.col("text"))).alias("en"))
    return votes.select("video_id", ((F.col("n") > 0) & (F.col("en") >= F.least("n", F.lit(4)))).alias("english"))