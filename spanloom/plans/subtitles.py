"""Queries about subtitles: their texts, languages, tracks and decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanloom import hooks
from spanloom.functions import scoring, strings, text
from spanloom.functions.strings import lifted
from spanloom.operators import detect, folds, scenes
from spanloom.plans.registry import query
from spanloom.sinks import documents as sinks
from spanloom.sources import documents as sources
from spanloom.sources import srt
from spanloom.sources.relations import asr_segments, frames, table

_ASR = """asr AS (SELECT conv_id AS video_id, turn AS seq, (s - length(text)) / 10e0 AS start, s / 10e0 AS "end", text, role
  FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS s FROM conversations))"""
_CJK = r"[\x{4e00}-\x{9fff}]"
_HELD = 1 << 20  # bytes of a conversation whose n-grams are counted in one row


def _segments(spark, sf_dir):
    return asr_segments(spark, sf_dir).drop("role")


@query(
    sql=f"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN repeat('中', CAST(length(text) % 50 AS INT)) WHEN 1 THEN '12 ?!' ELSE '' END || CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS t FROM conversations),
      n AS (SELECT conv_id, turn, len(regexp_extract_all(t, '{_CJK}')) AS zh, len(regexp_extract_all(t, '[A-Za-z]')) AS en FROM t)
      SELECT conv_id, turn, CASE WHEN zh + en = 0 THEN 'uncertain' WHEN zh >= en THEN 'zh' ELSE 'en' END AS lang FROM n"""
)
def dominant_language(spark, sf_dir):
    """PRJ13."""
    t = F.expr("concat(CASE turn % 3 WHEN 0 THEN repeat('中', CAST(length(text) % 50 AS INT)) WHEN 1 THEN '12 ?!' ELSE '' END, CASE WHEN turn % 3 = 1 THEN '' ELSE text END)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.dominant_language(t).alias("lang"))


@query(
    sql="""WITH f AS (SELECT event_id, (event_id % 97) / 100e0 AS l, least(1e0, (event_id % 97) / 100e0 + (event_id % 31) / 60e0) AS r FROM events)
      SELECT event_id, r - l > 0.25e0 OR (l >= 0.15e0 AND 1 - r >= 0.15e0) AS subtitle FROM f"""
)
def subtitle_geometry(spark, sf_dir):
    """PRJ29."""
    left = F.expr("event_id % 97 / 100.0D")
    right = F.least(F.lit(1.0), left + F.expr("event_id % 31 / 60.0D"))
    return table(spark, sf_dir, "events").select("event_id", ((right - left > 0.25) | ((left >= 0.15) & (1 - right >= 0.15))).alias("subtitle"))


@query(
    sql="""WITH e AS (SELECT event_id, event_id % 10 AS score, event_id % 6 AS frames, (event_id % 11) / 10e0 AS change, event_id % 3 AS penalty, event_id % 2 = 0 AS fallback FROM events),
      s AS (SELECT *, CASE WHEN fallback THEN 0.68e0 ELSE 0.82e0 END + CASE WHEN score >= 8 THEN 0.08e0 WHEN score >= 7 THEN 0.04e0 ELSE 0e0 END + CASE WHEN frames >= 4 THEN 0.03e0 ELSE 0e0 END
        + CASE WHEN change >= 0.6e0 THEN 0.02e0 ELSE 0e0 END - CASE WHEN penalty > 0 THEN 0.08e0 ELSE 0e0 END AS c FROM e)
      SELECT event_id, round(greatest(0e0, least(CASE WHEN fallback THEN 0.79e0 ELSE 0.95e0 END, c)), 6) AS confidence FROM s"""
)
def en_confidence(spark, sf_dir):
    """PRJ27."""
    e = lambda x: F.expr(x)
    c = scoring.en_confidence(e("event_id % 10"), e("event_id % 6"), e("event_id % 11 / 10.0D"), e("event_id % 3"), e("event_id % 2 = 0"))
    return table(spark, sf_dir, "events").select("event_id", F.round(c, 6).alias("confidence"))


@query(
    sql="""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'auto' WHEN 'click' THEN 'en' WHEN 'error' THEN 'zh' WHEN 'signup' THEN 'none' ELSE 'auto' END AS requested,
        CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'bilingual' WHEN 3 THEN 'none' ELSE 'uncertain' END AS detected, (event_id % 100) / 100e0 AS confidence, (event_id % 50) / 100e0 + 0.4e0 AS boundary FROM events),
      d AS (SELECT *, requested = 'auto' AND detected = 'en' AND confidence < 0.85e0 AS doubted FROM e),
      s AS (SELECT *, CASE WHEN doubted THEN 'none' WHEN requested = 'auto' THEN detected ELSE requested END AS status FROM d),
      k AS (SELECT *, CASE WHEN status = 'none' THEN 'none' WHEN status IN ('en', 'bilingual') THEN 'replace' ELSE 'skip' END AS kind FROM s)
      SELECT event_id, requested AS requested_subtitle_status, status AS effective_subtitle_status, CASE WHEN requested = 'auto' THEN status END AS detected_status, CASE WHEN requested = 'auto' THEN confidence END AS confidence,
        CASE WHEN requested = 'auto' AND NOT doubted THEN detected WHEN requested IN ('en', 'zh') THEN requested END AS ocr_lang, CASE WHEN requested = 'auto' AND NOT doubted THEN boundary END AS detected_boundary,
        CASE kind WHEN 'none' THEN 'dual_bottom_ffmpeg_or_moviepy' WHEN 'skip' THEN 'skip_burn_keep_existing_' || status || '_hard_subtitles' ELSE 'mask_existing_hard_subtitles_and_burn_dual' END AS chosen_burn_mode,
        false AS used_zh_aligned, CASE WHEN kind = 'replace' THEN 'shared_dual_timeline' END AS subtitle_alignment_source, CASE WHEN kind = 'skip' THEN 'copy' ELSE 'ffmpeg' END AS burn_renderer,
        CASE kind WHEN 'none' THEN 'burn_dual_subtitles' WHEN 'skip' THEN 'keep_existing_' || status || '_hard_subtitles_without_burn' ELSE 'mask_existing_hard_subtitles_and_burn_dual_subtitles' END AS auto_final_action,
        CASE WHEN kind = 'replace' THEN coalesce(CASE WHEN requested = 'auto' AND NOT doubted THEN boundary END, 0.803e0) END AS hard_subtitle_mask, 'en=replace,zh=skip,bilingual=replace' AS subtitle_burn_policy,
        'EN=replace / ZH=skip / BILINGUAL=replace' AS subtitle_burn_policy_summary FROM k"""
)
def burn_decision(spark, sf_dir):
    """PRJ30, PRJ31."""
    requested = F.expr("CASE event_type WHEN 'view' THEN 'auto' WHEN 'click' THEN 'en' WHEN 'error' THEN 'zh' WHEN 'signup' THEN 'none' ELSE 'auto' END")
    detected = F.expr("CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'bilingual' WHEN 3 THEN 'none' ELSE 'uncertain' END")
    d = scoring.burn_decision(requested, detected, F.expr("event_id % 100 / 100.0D"), detected, F.expr("event_id % 50 / 100.0D + 0.4D"))
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.*")


@query(
    sql="""WITH t AS (SELECT user_id AS video_id, CASE event_type WHEN 'view' THEN 'zh' WHEN 'click' THEN 'en' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'zh' END WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'en' END END AS l
        FROM events WHERE event_id % 10 = user_id % 10)
      SELECT video_id, CASE WHEN coalesce(bool_or(l = 'zh'), false) AND coalesce(bool_or(l = 'en'), false) THEN 'bilingual' WHEN coalesce(bool_or(l = 'zh'), false) THEN 'zh' WHEN coalesce(bool_or(l = 'en'), false) THEN 'en' END AS soft FROM t GROUP BY 1"""
)
def soft_status(spark, sf_dir):
    """SRC07, PRJ53: subtitle tracks in probes' JSON, and the status that they give a video."""
    lang = F.expr("CASE event_type WHEN 'view' THEN 'CHI' WHEN 'click' THEN 'eng' WHEN 'error' THEN 'und' ELSE 'jpn' END")
    title = F.expr("CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Chinese (simplified)' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'English' ELSE 'x' END")
    track = F.concat(F.lit('{"index":2,"codec_type":"subtitle","tags":{"language":"'), lang, F.lit('","title":"'), title, F.lit('"}}'))
    probe = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","tags":{"language":"chi"}},{"index":1,"codec_type":"audio"},'), track, F.lit("]}"))
    probes = table(spark, sf_dir, "events").filter("event_id % 10 = user_id % 10").select(F.col("user_id").alias("video_id"), probe.alias("probe"))
    return detect.soft_status(sources.subtitle_tracks(probes, "probe"))


@query(
    sql="""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'bilingual' END AS soft, CASE event_id % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'none' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'zh' END AS ocr,
        (event_id % 90) / 100e0 AS c, CASE event_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' END AS spoken FROM events)
      SELECT event_id, CASE WHEN soft IS NOT NULL THEN soft WHEN coalesce(ocr, 'none') NOT IN ('none', 'uncertain') THEN ocr WHEN spoken = 'zh' THEN 'zh' ELSE 'none' END AS status,
        CASE WHEN soft IS NOT NULL THEN 1e0 WHEN coalesce(ocr, 'none') NOT IN ('none', 'uncertain') THEN c WHEN spoken IN ('zh', 'en') THEN 0.8e0 ELSE 0e0 END AS confidence FROM e"""
)
def subtitle_status(spark, sf_dir):
    """AGG19's top level, MDL12: soft tracks, then the picture, then what is spoken."""
    soft, ocr = F.expr("CASE event_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'bilingual' END"), F.expr("CASE event_id % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'none' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'zh' END")
    s = detect.first_status(soft, ocr, F.expr("event_id % 90 / 100.0D"), F.expr("CASE event_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' END"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


@query
def ocr_status(spark, sf_dir):
    """AGG09, AGG14, AGG17, AGG19, FLT06, FLT07, FLT11, PRJ28: the language of the text in a video's frames; tested on given cases."""
    kind = "video_id long, status string, lang string, boundary double, confidence double"

    def step(rows):
        return [{"video_id": rows[0]["video_id"], **detect.ocr_status(rows, 60.0, 5)}]

    return folds.fold(frames(spark, sf_dir), step, kind)


@query(
    sql="""WITH d AS (SELECT doc_id, (n_chars % 700) / 4e0 AS d, doc_id % 9 AS n FROM documents),
      u AS (SELECT doc_id, round_even(d * (i + 1) / (n + 1), 2) AS t FROM d, range(0, 9) r(i) WHERE d > 0 AND i < n AND (d < 20 OR n > 5)),
      e AS (SELECT doc_id, d, n, t FROM (SELECT doc_id, d, n, unnest(list_concat(list_transform(range(1, n // 2 + 1), lambda x: 5e0 * x), list_transform(range(1, n // 2 + 1), lambda x: d - 5e0 * x),
        CASE WHEN n % 2 = 1 THEN [d / 2] ELSE [] END)) AS t FROM d WHERE d >= 20 AND n BETWEEN 1 AND 5) WHERE t >= 0.1e0 AND t <= d - 0.1e0)
      SELECT doc_id, count(DISTINCT t) AS samples, round(min(t), 2) AS first_t, round(max(t), 2) AS last_t FROM (SELECT doc_id, t FROM u UNION ALL SELECT doc_id, t FROM e) GROUP BY 1"""
)
def sample_timestamps(spark, sf_dir):
    """ISL07."""
    at = F.pandas_udf(_stamps, "array<double>")
    d = table(spark, sf_dir, "documents").select("doc_id", at(F.expr("n_chars % 700 / 4.0D"), F.expr("CAST(doc_id % 9 AS INT)")).alias("t")).filter("size(t) > 0")
    return d.select("doc_id", F.size(F.array_distinct("t")).cast("long").alias("samples"), F.round(F.array_min("t"), 2).alias("first_t"), F.round(F.array_max("t"), 2).alias("last_t"))


def _stamps(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([scenes.sample_timestamps(float(a), int(b)) for a, b in zip(d, n, strict=True)], dtype=object)


@query(
    sql=f"""WITH {_ASR}, m AS (SELECT *, CAST(floor(start * 1000) AS BIGINT) AS a, CAST(floor("end" * 1000) AS BIGINT) AS b FROM asr)
      SELECT video_id, seq, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000 // 10) || ',' || printf('%d:%02d:%02d.%02d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000 // 10)
        || ',Default,,0,0,0,,{{\\an2\\pos(960,900)}}' || replace(text, chr(10), '\\N') AS event FROM m"""
)
def ass_events(spark, sf_dir):
    """SNK06."""
    return sinks.ass_events(_segments(spark, sf_dir), (960, 900))


@query(
    sql=f"""WITH {_ASR}, s AS (SELECT video_id, start, "end", text, row_number() OVER (PARTITION BY video_id ORDER BY start, seq) - 1 AS seq FROM asr)
      SELECT video_id, CAST(seq AS INT) AS seq, floor(start * 1000) / 1000e0 AS start, floor("end" * 1000) / 1000e0 AS "end", md5(replace(text, chr(10), ' ')) AS text_md5 FROM s"""
)
def srt_scan(spark, sf_dir):
    """SRC05a, PRJ06: what the writer writes reads back."""
    return srt.scan_srt(_srt_files(spark, sf_dir)).select("video_id", "seq", "start", "end", F.md5("text").alias("text_md5"))


@query(
    sql=f"""WITH {_ASR}, s AS (SELECT video_id, start, "end", text, row_number() OVER (PARTITION BY video_id ORDER BY start, seq) - 1 AS seq FROM asr)
      SELECT video_id, CAST(seq AS INT) AS seq, floor(start * 1000) / 1000e0 AS start, floor("end" * 1000) / 1000e0 AS "end" FROM s WHERE seq % 3 <> 2"""
)
def srt_scan_regex(spark, sf_dir):
    """SRC05b: comma or point before the milliseconds; blocks with bad times go."""
    return srt.scan_srt(_odd_files(spark, sf_dir), style="regex").select("video_id", "seq", "start", "end")


@query(
    sql=f"""WITH {_ASR}, s AS (SELECT video_id, start, "end", text, row_number() OVER (PARTITION BY video_id ORDER BY start, seq) - 1 AS seq FROM asr)
      SELECT video_id, CAST(seq AS INT) AS seq, floor(start * 1000) / 1000e0 AS start, floor("end" * 1000) / 1000e0 AS "end" FROM s WHERE seq % 3 = 0"""
)
def srt_scan_strict(spark, sf_dir):
    """SRC05c: a comma alone."""
    return srt.scan_srt(_odd_files(spark, sf_dir), style="strict").select("video_id", "seq", "start", "end")


def _srt_files(spark, sf_dir):
    return sinks.srt_documents(srt.srt_blocks(_segments(spark, sf_dir))).withColumnRenamed("document", "value")


def _odd_files(spark, sf_dir):
    """Every second of three blocks has points before its milliseconds, every third no times."""
    n = F.regexp_extract("block", "^(\\d+)", 1).cast("int") % 3
    odd = F.when(n == 2, F.regexp_replace("block", "(\\d\\d:\\d\\d:\\d\\d),(\\d\\d\\d)", "$1.$2")).when(n == 0, F.regexp_replace("block", "\\d\\d:\\d\\d:\\d\\d,", "soon,")).otherwise(F.col("block"))
    return sinks.srt_documents(srt.srt_blocks(_segments(spark, sf_dir)).withColumn("block", odd)).withColumnRenamed("document", "value")


def _upper(texts: list[str], to: str) -> list[str]:
    """A stand-in for a translator."""
    return [t.upper() if to == "en" else f"译{len(t)}，" * (1 + len(t) // 12) for t in texts]


@query
def translate_tracks(spark, sf_dir):
    """FLD20, FLD15, AGG15, AGG18, MDL09, PRJ20, HLP13: the four tracks of each video, with a stand-in translator; tested on given cases."""
    s = _segments(spark, sf_dir)
    return folds.fold(s, lambda rows: hooks.subtitle_tracks(rows, {"en": 65, "zh": 45}, _upper), "video_id long, lang string, idx int, start double, end double, text string")


@query(
    sql="""WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS ts, list(length(trim(text)) ORDER BY turn) AS ls FROM conversations GROUP BY 1),
      a AS (SELECT conv_id, len(ls) AS n, list_avg(ls) AS mean, list_max(ls) AS most, list_sum(ls) AS total FROM t)
      SELECT conv_id, CASE WHEN most >= 180 OR mean >= 70 THEN 640 WHEN most >= 120 OR mean >= 45 THEN 800 ELSE 800 END AS budget, CASE WHEN most >= 180 OR mean >= 70 THEN 10 WHEN most >= 120 OR mean >= 45 THEN 11 ELSE 14 END AS items,
        CAST(greatest(1024, least(floor((floor(n * greatest(CAST(total AS DOUBLE) / n * 2.5e0, 30e0)) + 300) * 1.2e0), 4096)) AS BIGINT) AS tokens FROM a"""
)
def chunk_limits(spark, sf_dir):
    """AGG18, PRJ43: what a request for a conversation's translation may hold."""

    def step(rows):
        ns = [len(r["text"].strip()) for r in rows]
        budget, items = hooks.chunk_limits(ns, "zh")
        return [{"conv_id": rows[0]["conv_id"], "budget": budget, "items": items, "tokens": hooks.token_budget(ns)}]

    return folds.fold(table(spark, sf_dir, "conversations").select("conv_id", "text"), step, "conv_id long, budget long, items long, tokens long", ("conv_id",))


@query(sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, md5('}{' || event_type) AS tail FROM events")
def json_object(spark, sf_dir):
    """PRJ18: the first object of an answer, by its braces; those in strings don't count."""
    inner = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "t": "}{'), F.col("event_type"), F.lit('"}'))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x\n```json\n"), inner, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So: "), inner, F.lit(" and {more}"))).otherwise(inner)
    found = table(spark, sf_dir, "events").select("event_id", lifted(strings.json_object, "string")(raw).alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.md5(F.get_json_object("j", "$.t")).alias("tail"))


@query(sql="SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 0 ELSE 2 END AS n, CASE turn % 4 WHEN 3 THEN '' ELSE trim(role) || '|b' END AS items FROM conversations")
def json_array(spark, sf_dir):
    """PRJ19: an array, fenced, as an object's translations, or nothing."""
    inner = F.concat(F.lit('[" '), F.col("role"), F.lit('", "b"]'))
    raw = F.when(F.col("turn") % 4 == 0, inner).when(F.col("turn") % 4 == 1, F.concat(F.lit("```\n"), inner, F.lit("\n```"))).when(F.col("turn") % 4 == 2, F.concat(F.lit('{"translations": '), inner, F.lit("}"))).otherwise("[1, 2]")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", lifted(strings.json_array, "array<string>")(raw).alias("a"))
    return found.select("conv_id", "turn", F.size("a").alias("n"), F.array_join("a", "|").alias("items"))


@query(sql="SELECT conv_id, CASE WHEN count(*) % 2 = 0 THEN string_agg(role, '|' ORDER BY turn) ELSE string_agg('o', '|') END AS lines FROM conversations GROUP BY 1")
def numbered_lines(spark, sf_dir):
    """PRJ49: numbered answers; where there are too many lines, the originals."""

    def step(rows):
        rows = sorted(rows, key=lambda r: r["turn"])
        answer = "\n".join(f"{i + 1}. {r['role']}" for i, r in enumerate(rows)) + ("\nextra" if len(rows) % 2 else "")
        return [{"conv_id": rows[0]["conv_id"], "lines": "|".join(strings.numbered_lines(answer, ["o"] * len(rows)))}]

    return folds.fold(table(spark, sf_dir, "conversations"), step, "conv_id long, lines string", ("conv_id",))


@query(
    sql="""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM conversations),
      g AS (SELECT conv_id, turn, array_to_string(w[i + 1 : i + 3], ' ') AS gram FROM w, LATERAL unnest(range(0, greatest(0, len(w) - 2))) AS r(i))
      SELECT conv_id, count(*) AS grams, count(DISTINCT gram) AS kinds FROM g GROUP BY 1"""
)
def ngram_repetition(spark, sf_dir):
    """AGG03, PRJ45's n-grams: how many there are in a conversation, and of how many kinds.

    A conversation's texts travel once and are counted in one row; n-grams travel alone in those that are too long for that."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "text")
    long = F.broadcast(t.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("n")).filter(F.col("n") > _HELD).select(F.col("conv_id").alias("long")))
    own = F.col("conv_id").eqNullSafe(F.col("long"))
    held = t.join(long, own, "left_anti").groupBy("conv_id").agg(F.collect_list("text").alias("texts"))
    # the list of all is a lambda's parameter, so it is made once for all that is counted in it
    full = F.filter(F.array(F.flatten(F.transform("texts", lambda x: text.ngrams(x, 3)))), lambda g: F.size(g) > 0)
    counts = F.transform(full, lambda g: F.struct(F.size(g).cast("long").alias("grams"), F.size(F.array_distinct(g)).cast("long").alias("kinds")))
    dealt = t.join(long, own, "left_semi").select("conv_id", F.explode(text.ngrams(F.col("text"), 3)).alias("gram"))
    return held.select("conv_id", F.inline(counts)).unionByName(dealt.groupBy("conv_id").agg(F.count("*").alias("grams"), F.countDistinct("gram").alias("kinds")))


@query(
    sql="""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'One of them. ' || text || ' Two. One of them.' ELSE text END AS t FROM conversations),
      s AS (SELECT conv_id, turn, regexp_replace(unnest(regexp_extract_all(trim(t), '[^.!?]*[.!?]|[^.!?]+$')), '^\\s+|\\s+$', '', 'g') AS s, unnest(range(0, len(regexp_extract_all(trim(t), '[^.!?]*[.!?]|[^.!?]+$')))) AS i FROM t),
      f AS (SELECT conv_id, turn, s, min(i) AS i FROM s WHERE s <> '' GROUP BY ALL)
      SELECT conv_id, turn, string_agg(s, ' ' ORDER BY i) AS text FROM f GROUP BY 1, 2"""
)
def sentence_dedupe(spark, sf_dir):
    """PRJ46."""
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("One of them. "), "text", F.lit(" Two. One of them."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.dedupe_sentences(t).alias("text"))


@query
def repetition_zones(spark, sf_dir):
    """ISL01, PRJ11, PRJ45, PRJ46: runs of repeated segments as one; tested on given cases."""
    t = F.expr("CASE WHEN seq % 4 = 2 THEN repeat('going round in a circle again. ', 3) WHEN seq % 4 = 3 THEN repeat('going round in a circle again. ', 3) ELSE text END")
    return folds.fold(_segments(spark, sf_dir).withColumn("text", t), folds.repetition_zones, "video_id long, seq long, start double, end double, text string")
