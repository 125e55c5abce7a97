"""Queries about media: files, caches, features, scenes, clips, topics' paths and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import scoring, text
from spanloom.operators import folds, islands, scenes
from spanloom.operators import topics as topic_ops
from spanloom.plans.registry import query
from spanloom.session import new_path
from spanloom.sinks import documents as sinks
from spanloom.sources import documents as sources
from spanloom.sources.relations import asr_segments, candidates, points, table, topics
from spanloom.streaming import folds as stream_folds

_CAND = """cand AS (SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value * 60e0 AS "end", value AS score, event_type AS topic FROM events)"""
_ASR = """asr AS (SELECT conv_id AS video_id, turn AS seq, (s - length(text)) / 10e0 AS start, s / 10e0 AS "end", text, role
  FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS s FROM conversations))"""
BOUNDS = topic_ops.Bounds(60.0, 180.0, 6, "opinion")


@query(
    sql="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bestvideo+bestaudio/best' WHEN 1 THEN 'bestvideo[height<=' || (event_id % 1081) || ']+bestaudio/best[height<=' || (event_id % 1081) || ']' WHEN 2 THEN 'worst' ELSE '137+140' END AS format FROM events"""
)
def download_format(spark, sf_dir):
    """SRC01's format."""
    q = F.expr("CASE event_id % 4 WHEN 0 THEN 'best' WHEN 1 THEN concat(event_id % 1081, 'p') WHEN 2 THEN 'worst' ELSE '137+140' END")
    return table(spark, sf_dir, "events").select("event_id", sources.download_format(q).alias("format"))


_FILES = """files AS (SELECT page_id % 20 AS video_id, '/m/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.part' ELSE '.mp4' END AS path, page_id % 17 AS mtime FROM pages),
  reported AS (SELECT page_id % 20 AS video_id, page_id AS rank, '/m/' || page_id || CASE WHEN page_id % 5 = 0 THEN '.mp4' ELSE '.mkv' END AS path FROM pages WHERE page_id % 20 < 14)"""


@query(
    sql=f"""WITH {_FILES}, f AS (SELECT r.video_id, arg_min(r.path, rank) AS first FROM reported r JOIN files USING (video_id, path) GROUP BY 1),
      n AS (SELECT video_id, arg_max(path, {{'m': mtime, 'p': path}}) AS newest FROM files WHERE NOT ends_with(path, '.part') GROUP BY 1),
      i AS (SELECT video_id FROM files UNION SELECT video_id FROM reported)
      SELECT i.video_id, coalesce(first, newest) AS path FROM i LEFT JOIN f USING (video_id) LEFT JOIN n USING (video_id)"""
)
def resolved_file(spark, sf_dir):
    """SRC02, SRC03."""
    p = table(spark, sf_dir, "pages")
    files = p.select(F.expr("page_id % 20").alias("video_id"), F.expr("concat('/m/', page_id, CASE WHEN page_id % 3 = 0 THEN '.part' ELSE '.mp4' END)").alias("path"), F.expr("page_id % 17").alias("mtime"))
    reported = p.filter("page_id % 20 < 14").select(F.expr("page_id % 20").alias("video_id"), F.col("page_id").alias("rank"), F.expr("concat('/m/', page_id, CASE WHEN page_id % 5 = 0 THEN '.mp4' ELSE '.mkv' END)").alias("path"))
    return sources.resolved(reported, files)


@query(
    sql="""WITH v AS (SELECT page_id AS video_id, CASE WHEN page_id % 4 = 0 THEN '/s/' || page_id || '.srt' END AS explicit, '/v/' || page_id AS stem FROM pages),
      f AS (SELECT CASE page_id % 3 WHEN 0 THEN '/s/' || page_id || '.srt' WHEN 1 THEN '/v/' || page_id || '_zh.srt' ELSE '/v/' || page_id || '.zh.srt' END AS path FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT '/v/' || page_id || '.zh.srt' FROM pages WHERE page_id % 2 = 0)
      SELECT video_id, CASE WHEN explicit IS NOT NULL THEN (SELECT min(path) FROM f WHERE path = explicit)
        ELSE coalesce((SELECT min(path) FROM f WHERE path = stem || '_zh.srt'), (SELECT min(path) FROM f WHERE path = stem || '.zh.srt')) END AS subtitle FROM v"""
)
def subtitle_discovery(spark, sf_dir):
    """SRC15, JN09."""
    p = table(spark, sf_dir, "pages")
    videos = p.select(F.col("page_id").alias("video_id"), F.expr("CASE WHEN page_id % 4 = 0 THEN concat('/s/', page_id, '.srt') END").alias("explicit"), F.expr("concat('/v/', page_id)").alias("stem"))
    path = F.expr("CASE page_id % 3 WHEN 0 THEN concat('/s/', page_id, '.srt') WHEN 1 THEN concat('/v/', page_id, '_zh.srt') ELSE concat('/v/', page_id, '.zh.srt') END")
    files = p.filter("page_id % 7 <> 0").select(path.alias("path")).unionByName(p.filter("page_id % 2 = 0").select(F.expr("concat('/v/', page_id, '.zh.srt')").alias("path")))
    return sources.discovered(videos, files, "zh")


@query(
    sql="""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value / 8 END * 60e0, 3600e0) AS guess, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, 0e0) AS zero,
      CASE WHEN event_id % 3 = 0 THEN value END AS known, event_id % 1080 > event_id % 720 AS vertical FROM events"""
)
def media_duration(spark, sf_dir):
    """SRC08, SRC09."""
    probed, size = F.expr("CASE WHEN event_id % 3 = 0 THEN value END"), F.expr("CASE WHEN event_id % 2 = 0 THEN value / 8 END")
    d = [sources.duration(probed, size, how).alias(name) for how, name in (("guess", "guess"), ("zero", "zero"), ("null", "known"))]
    return table(spark, sf_dir, "events").select("event_id", *d, F.expr("event_id % 1080 > event_id % 720").alias("vertical"))


@query(sql="SELECT event_id, i AS seq, event_id + i AS start, 't' || i AS topic FROM events, LATERAL unnest(range(0, event_id % 3)) r(i) WHERE event_id % 5 <> 0")
def json_scan(spark, sf_dir):
    """SRC04, FLT03: rows of JSON documents; what is no object or doesn't parse has none."""
    row = lambda i: F.concat(F.lit('{"start": '), (F.col("event_id") + i).cast("string"), F.lit(f', "topic": "t{i}"}}'))
    rows = F.array_join(F.slice(F.array(row(0), row(1)), 1, F.expr("CAST(event_id % 3 AS INT)")), ", ")
    doc = F.when(F.col("event_id") % 5 == 0, F.lit('{"topics": [')).otherwise(F.concat(F.lit('{"topics": ['), rows, F.lit("]}")))
    return sources.json_rows(table(spark, sf_dir, "events").select("event_id", doc.alias("d")), "d", "struct<start:bigint,topic:string>", "topics")


@query(sql="SELECT doc_id, concat_ws('_', CASE WHEN doc_id % 2 = 0 THEN 'mlx' END, substring(md5(text), 1, 16), 'base', lang, printf('chunk%03d', doc_id % 1200)) AS key FROM documents WHERE octet_length(encode(text)) <= 1048576")
def cache_key(spark, sf_dir):
    """SRC11; the first MiB tells a medium, and no document is longer."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", sources.cache_key(F.col("text").cast("binary"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'mlx' ELSE '' END"), F.lit("base"), F.col("lang"), F.expr("doc_id % 1200")).alias("key"))


@query(
    sql="""WITH c AS (SELECT conv_id AS video_id, turn AS clip, conv_id % 4 AS k, turn % 3 AS n FROM conversations)
      SELECT video_id, clip, k < 3 AND n > 0 AS hit, k < 3 AND n = 0 AS stale, CASE WHEN k < 3 AND n > 0 THEN n ELSE 9 END AS segments FROM c"""
)
def cache_resume(spark, sf_dir):
    """SRC10, SNK09, JN14, SET01: cached chunks, and the others computed anew."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("clip"))
    cache = chunks.filter("video_id % 4 < 3").withColumn("segments", F.array_repeat(F.lit("s"), F.expr("CAST(clip % 3 AS INT)")))
    found = sources.cached(chunks, cache)
    every = sources.resumed(chunks, cache, lambda misses: misses.withColumn("segments", F.array_repeat(F.lit("new"), 9)))
    return found.drop("segments").join(every.select("video_id", "clip", F.size("segments").alias("segments")), ["video_id", "clip"])


@query(
    sql="""WITH s AS (SELECT conv_id AS video_id, turn // 3 AS clip, turn AS seq, turn % 3 * 10e0 AS s, turn % 3 * 10e0 + CASE WHEN conv_id % 5 = 0 THEN 400e0 ELSE 8e0 END AS e, turn // 3 * 300e0 AS b FROM conversations),
      w AS (SELECT *, b > 0 AND max(e) OVER c <= 301 AND min(s) OVER c >= -1 AS rel FROM s WINDOW c AS (PARTITION BY video_id, clip))
      SELECT video_id, seq, CASE WHEN rel THEN round(s + b, 3) ELSE s END AS start, CASE WHEN rel THEN round(e + b, 3) ELSE e END AS "end", CASE WHEN rel THEN round(s + 0.25e0 + b, 3) ELSE s + 0.25e0 END AS word_start FROM w"""
)
def rebase_chunks(spark, sf_dir):
    """PRJ10, MDL02, MDL03: a chunk's times, and its words', counted from the start of the video."""
    s = F.expr("turn % 3 * 10.0D")
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.expr("turn div 3").alias("clip"), F.col("turn").alias("seq"), s.alias("start"), (s + F.expr("CASE WHEN conv_id % 5 = 0 THEN 400.0D ELSE 8.0D END")).alias("end"),
        F.array(F.struct(F.lit("w").alias("word"), (s + 0.25).alias("start"), (s + 0.5).alias("end"))).alias("words"), F.expr("turn div 3 * 300.0D").alias("chunk_start"), F.lit(300.0).alias("chunk_duration"),
    )
    return sources.rebased(c).select("video_id", "seq", "start", "end", F.col("words")[0]["start"].alias("word_start"))


@query
def transcribed(spark, sf_dir):
    """MDL01 to MDL03's rows: rebased chunks, without repeats, and (the first engine) without repetition; its parts are tested."""
    s = asr_segments(spark, sf_dir).drop("role").withColumn("clip", F.lit(0)).withColumn("chunk_start", F.lit(0.0)).withColumn("chunk_duration", F.lit(300.0))
    kind = "video_id long, seq long, start double, end double, text string"
    return folds.fold(sources.rebased(s), lambda rows: folds.repetition_zones(folds.asr_dedupe(rows)), kind)


@query(
    sql=f"""WITH {_CAND}, z AS (SELECT seq, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8) AS a, (seq % 50 - avg(seq % 50) OVER w) / (stddev_pop(seq % 50) OVER w + 1e-8) AS b,
        (seq % 7 - avg(seq % 7) OVER w) / (stddev_pop(seq % 7) OVER w + 1e-8) AS c FROM cand WINDOW w AS (PARTITION BY video_id))
      SELECT seq, round(0.5e0 * a + 0.3e0 * b + 0.2e0 * c, 6) AS loudness FROM z"""
)
def audio_score(spark, sf_dir):
    """AGG04, MDL04: how a moment stands out by three features."""
    c = candidates(spark, sf_dir).select("video_id", "seq", F.col("score").alias("rms"), F.expr("CAST(seq % 50 AS DOUBLE)").alias("centroid"), F.expr("CAST(seq % 7 AS DOUBLE)").alias("zcr"))
    return islands.weighted_zscores(c, {"rms": 0.5, "centroid": 0.3, "zcr": 0.2}, "loudness").select("seq", F.round("loudness", 6).alias("loudness"))


@query(sql=f"""WITH {_CAND} SELECT video_id, start AS time FROM cand WHERE topic = 'error' UNION SELECT DISTINCT video_id, 0e0 FROM cand WHERE topic = 'error'""")
def scene_list(spark, sf_dir):
    """MDL05, SET03: a video's scene changes, of which the first is its start."""
    p = points(spark, sf_dir, "error").select("video_id", "time")
    return p.unionByName(p.select("video_id", F.lit(0.0).alias("time"))).distinct()


@query(
    sql="""WITH b AS (SELECT event_id, (event_id % 100) / 100e0 AS c, event_type AS text, (event_id % 13) / 100e0 AS density FROM events)
      SELECT event_id, text, density >= 0.05e0 AS dense FROM b WHERE c >= 0.5e0"""
)
def ocr_boxes(spark, sf_dir):
    """FLT10, MDL06, MDL14."""
    b = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"), F.expr("event_id % 100 / 100.0D").alias("confidence"), F.expr("event_id % 13 / 100.0D").alias("density"))
    return b.filter("confidence >= 0.5D").select("event_id", "text", (F.col("density") >= 0.05).alias("dense"))


@query(sql="SELECT page_id AS video_id, i / 2e0 AS t FROM pages, LATERAL unnest(range(0, page_id % 13 * 2 + 1)) r(i)")
def frame_times(spark, sf_dir):
    """SRC12: where frames are taken, at two a second."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.expr("CAST(page_id % 13 * 2 AS INT)"))).alias("i")).select("video_id", (F.col("i") / 2.0).alias("t"))


@query(sql="SELECT page_id AS video_id, CASE WHEN page_id % 2 = 0 THEN 'a' WHEN page_id % 3 = 0 THEN 'b' WHEN page_id % 5 = 0 THEN 'c' END AS output FROM pages")
def first_output(spark, sf_dir):
    """MDL15: the first of three outputs that is there."""
    there = lambda n, v: F.when(F.col("page_id") % n == 0, v)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("video_id"), F.coalesce(there(2, "a"), there(3, "b"), there(5, "c")).alias("output"))


@query(
    sql=r"""WITH n AS (SELECT page_id, '  My - ' || replace(replace(url, '/', ' '), ':', '') || '  (v1)' AS name FROM pages),
      w AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '\s+', ' ', 'g'), '[^\w\s-]', '', 'g') AS w, regexp_extract(name, '\.[^.]*$') AS ext FROM n),
      j AS (SELECT page_id, ext, regexp_replace(regexp_replace(regexp_replace(w, '[- ]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS j FROM w)
      SELECT page_id, regexp_replace(left(j, 80), '_+$', '') || ext AS name FROM j"""
)
def sanitize_filename(spark, sf_dir):
    """PRJ37."""
    name = F.concat(F.lit("  My - "), F.translate(F.col("url"), "/:", " "), F.lit("  (v1)"))
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(name).alias("name"))


@query(
    sql=r"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  A title - of some length ' || page_id WHEN 2 THEN '!!!' ELSE 'Short_one' END AS t, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-ab/c d' || page_id || '.' ELSE 'id' || page_id END AS v,
        CASE WHEN page_id % 2 = 0 THEN '/x/y.webm' ELSE '/x/y' END AS p FROM pages),
      h AS (SELECT *, coalesce(nullif(trim(left(trim(coalesce(t, 'video')), 15)), ''), 'video') AS h FROM n),
      s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '[^\w\s-]', '', 'g'), '[- ]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM h)
      SELECT page_id, coalesce(nullif(s, ''), 'video') || '_' || coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif(v, ''), 'video'), '[^\w.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'video')
        || CASE WHEN page_id % 2 = 0 THEN '.webm' ELSE '.mp4' END AS name, CASE WHEN page_id % 2 = 0 THEN 'y_video_summary.md' ELSE 'a_b_c_video_summary.md' END AS summary FROM s"""
)
def stable_filename(spark, sf_dir):
    """PRJ38, PRJ39."""
    title = F.expr("CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('  A title - of some length ', page_id) WHEN 2 THEN '!!!' ELSE 'Short_one' END")
    video = F.expr("CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('-ab/c d', page_id, '.') ELSE concat('id', page_id) END")
    name = text.stable_filename(title, video, F.expr("CASE WHEN page_id % 2 = 0 THEN '/x/y.webm' ELSE '/x/y' END"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), text.summary_filename(F.expr("CASE WHEN page_id % 2 = 0 THEN '/x/y.webm' ELSE '/x/_a b/.. b c_.mp4' END")).alias("summary")).withColumn(
        "summary", F.when(F.col("page_id") % 2 == 0, F.col("summary")).otherwise(text.summary_filename(F.lit("/x/_a b!c_.mp4")))
    )


@query(
    sql=r"""SELECT event_id, replace(replace(replace(replace('a\' || event_type || ''':50%', '\', '\\'), '''', '''\'''''), ':', '\:'), '%', '%%') AS drawn, 'C\:/' || event_type AS path,
      CASE event_id % 5 WHEN 0 THEN 255 WHEN 1 THEN 17 WHEN 2 THEN 18 WHEN 3 THEN 171 ELSE 0 END AS r, CASE event_id % 5 WHEN 0 THEN 255 WHEN 1 THEN 34 WHEN 2 THEN 52 WHEN 3 THEN 205 ELSE 0 END AS g,
      CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 51 WHEN 2 THEN 86 WHEN 3 THEN 239 ELSE 0 END AS b, CASE event_id % 5 WHEN 0 THEN 230 WHEN 1 THEN 255 WHEN 2 THEN 200 WHEN 3 THEN 255 ELSE 255 END AS a FROM events"""
)
def escapes_and_colors(spark, sf_dir):
    """PRJ35, PRJ36."""
    drawn = F.concat(F.lit("a\\"), "event_type", F.lit("':50%"))
    path = F.replace(F.replace(F.concat(F.lit("C:\\"), "event_type"), F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))
    color = scoring.color(F.expr("CASE event_id % 5 WHEN 0 THEN ' Yellow@0.9' WHEN 1 THEN '#123' WHEN 2 THEN '#123456@200' WHEN 3 THEN '0xABCDEF@x' ELSE 'nonsense' END"))
    return table(spark, sf_dir, "events").select("event_id", text.escape_drawtext(drawn).alias("drawn"), path.alias("path"), color.alias("c")).select("event_id", "drawn", "path", "c.*")


@query(sql="SELECT event_id, CAST(greatest(1, round_even(greatest(value, 1e0) / 120e0, 0)) AS INT) AS expected, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'prompt' END AS prompt FROM events")
def expected_segments(spark, sf_dir):
    """PRJ42, PRJ44."""
    prompt = F.expr("CASE WHEN event_id % 2 = 0 AND CASE event_type WHEN 'view' THEN 'zh-CN' ELSE 'en' END LIKE 'zh%' THEN nullif(trim(' prompt '), '') END")
    return table(spark, sf_dir, "events").select("event_id", scoring.segments_expected(F.col("value"), 60.0, 180.0).alias("expected"), prompt.alias("prompt"))


@query(
    sql=f"""WITH {_CAND}, c AS (SELECT seq, score, CAST(seq % 240 AS DOUBLE) AS d, seq % 100 / 1e0 AS s, topic || ' is good' AS summary, CASE WHEN seq % 2 = 0 THEN 'why' ELSE ' ' END AS reason FROM cand)
      SELECT seq, CASE WHEN d <= 0 THEN 0e0 ELSE CAST(round(CAST(CAST(greatest(0e0, least(100e0, least(score, 100e0) * 0.55e0 + (1 - least(1e0, abs(d - 120) / 120e0)) * 20e0 + least(1e0, s / d) * 15e0 + (3e0 + 0.7e0 * 3) + CASE WHEN seq % 2 = 0 THEN 2.5e0 ELSE 0e0 END)) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) END AS rank_score FROM c"""
)
def candidate_score(spark, sf_dir):
    """PRJ26."""
    c = candidates(spark, sf_dir)
    got = topic_ops.candidate_score(F.least("score", F.lit(100.0)), F.expr("CAST(seq % 240 AS DOUBLE)"), F.expr("seq % 100 / 1.0D"), F.concat("topic", F.lit(" is good")), F.expr("CASE WHEN seq % 2 = 0 THEN 'why' ELSE ' ' END"), 120.0)
    return c.select("seq", got.alias("rank_score"))


@query(
    sql="""WITH f AS (SELECT event_id, unnest(['年轻人 ' || event_type, '学生党', 'plain']) AS label, event_id % 3 = 0 AS has FROM events)
      SELECT event_id, label FROM f WHERE label = 'plain' OR (has AND label LIKE '年轻人%')"""
)
def audience_labels(spark, sf_dir):
    """FLT09, JN12: a label with a general term stays only where the transcript has the term."""
    terms = F.array(*[F.lit(t) for t in ("年轻人", "年轻创业者", "普通人", "上班族", "宝妈", "学生党")])
    e = table(spark, sf_dir, "events").withColumn("transcript", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("给年轻人 "), "props")).otherwise(F.col("props")))
    e = e.select("event_id", F.lower("transcript").alias("t"), F.explode(F.array(F.concat(F.lit("年轻人 "), "event_type"), F.lit("学生党"), F.lit("plain"))).alias("label"))
    named = F.filter(terms, lambda x: F.col("label").contains(x))
    return e.filter((F.size(named) == 0) | F.exists(named, lambda x: F.col("t").contains(x))).select("event_id", "label")


@query(sql=f"""WITH {_CAND} SELECT seq, start, "end" FROM cand WHERE "end" > start AND "end" - start BETWEEN 60 AND 270""")
def valid_segments(spark, sf_dir):
    """FLT02, FLT12, FLT13."""
    d = F.col("end") - F.col("start")
    return candidates(spark, sf_dir).filter((d > 0) & d.between(60.0, 180.0 * 1.5)).select("seq", "start", "end")


@query(
    sql="""WITH f AS (SELECT '/in/' || page_id AS src, CASE WHEN page_id % 4 = 0 THEN '/in/' || page_id ELSE '/out/' || page_id END AS dst, page_id FROM pages),
      p AS (SELECT CASE WHEN page_id % 7 = 0 THEN NULL ELSE src END AS src, dst FROM f), e AS (SELECT '/out/' || (page_id * 2) AS dst FROM pages UNION SELECT '/in/' || page_id FROM pages)
      SELECT src, dst, CASE WHEN src IS NULL THEN 'skip' WHEN src = dst THEN 'keep' ELSE 'copy' END AS action FROM p
      UNION ALL SELECT NULL, dst, 'delete' FROM e WHERE dst NOT IN (SELECT dst FROM p) AND dst NOT IN (SELECT src FROM p WHERE src IS NOT NULL)"""
)
def copy_plan(spark, sf_dir):
    """SNK14, SET04, FLT14: what to copy, and what is stale at the target; no source is deleted."""
    p = table(spark, sf_dir, "pages")
    src = F.concat(F.lit("/in/"), F.col("page_id").cast("string"))
    files = p.select(F.when(F.col("page_id") % 7 != 0, src).alias("src"), F.when(F.col("page_id") % 4 == 0, src).otherwise(F.concat(F.lit("/out/"), F.col("page_id").cast("string"))).alias("dst"))
    have = p.select(F.concat(F.lit("/out/"), (F.col("page_id") * 2).cast("string")).alias("dst")).unionByName(p.select(src.alias("dst")))
    return sinks.copy_plan(files, have)


@query(sql="SELECT user_id AS video_id, count(*) AS processed, count(*) FILTER (WHERE event_id % 3 = 0) AS successful, count(*) FILTER (WHERE event_id % 3 <> 0) AS failed FROM events GROUP BY 1")
def batch_counts(spark, sf_dir):
    """SNK15, AGG06."""
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.expr("CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("ok"))
    return sinks.batch_counts(r)


@query(sql="SELECT event_id, user_id AS video_id, 'ffmpeg -y -i /v/' || user_id || '.mp4 -ss ' || printf('%.3f', (event_id % 500) / 8e0) || ' -t ' || printf('%.3f', value) || ' /c/' || event_id || '.mp4' AS command FROM events")
def cut_commands(spark, sf_dir):
    """SNK10's plan; a hook runs the commands."""
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("video_id"), F.concat(F.lit("/v/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("path"), F.concat(F.lit("/c/"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("out"), F.expr("event_id % 500 / 8.0D").alias("start"), F.col("value").alias("duration"))
    return sinks.cut_commands(c).select(F.regexp_extract("out", "(\\d+)", 1).cast("long").alias("event_id"), "video_id", F.array_join("command", " ").alias("command"))


@query(
    sql=f"""WITH {_ASR}, g AS (SELECT video_id, count(*) AS segments, string_agg('{{"seq":' || seq || ',"role":"' || role || '"}}', ',' ORDER BY seq) AS rows FROM asr GROUP BY 1)
      SELECT video_id, '{{"segments":' || segments || ',"asr_result":[' || rows || ']}}' AS document FROM g"""
)
def analysis_json(spark, sf_dir):
    """SNK01 to SNK04: a JSON document for each video."""
    rows = asr_segments(spark, sf_dir).select("video_id", F.col("seq").cast("long").alias("seq"), "role")
    return sinks.json_documents(rows, ["video_id"], "asr_result", "seq", segments=F.count("*"))


@query(
    sql=f"""WITH {_ASR}, c AS (SELECT video_id, seq AS clip, start, "end", "end" - start AS d FROM asr),
      s AS (SELECT video_id, clip, '### Clip ' || clip || chr(10) || chr(10) || '- **文件**: `c' || clip || '.mp4`' || chr(10) || '- **时间范围**: ' || printf('%.2f', start) || 's - ' || printf('%.2f', "end") || 's' || chr(10) || '- **时长**: ' || printf('%.2f', d) || 's'
        || chr(10) || '- **评分**: ' || printf('%.2f', clip * 10e0) || CASE WHEN clip % 2 = 0 THEN chr(10) || '- **字幕文件**:' || chr(10) || '  - 中文: `a.srt`' || chr(10) || '  - fr: `b.srt`' ELSE '' END
        || CASE WHEN clip % 3 = 0 THEN chr(10) || '- **最终策略**: EN=replace' || chr(10) || '- **最终动作**: `burn`' ELSE '' END || chr(10) AS section, CASE WHEN clip % 2 = 0 THEN 2 ELSE 0 END AS tracks FROM c)
      SELECT video_id, '# 短视频智能剪辑与翻译 - 项目摘要报告' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 剪辑片段' || chr(10) || chr(10) || '**总计**: ' || count(*) || ' 个片段' || chr(10) || chr(10) || string_agg(section, chr(10) ORDER BY clip)
        || chr(10) || '## 统计信息' || chr(10) || chr(10) || '- **剪辑片段总数**: ' || count(*) || chr(10) || '- **字幕文件总数**: ' || CAST(sum(tracks) AS BIGINT) || chr(10) || '- **处理耗时**: 12.50 秒' || chr(10) AS document FROM s GROUP BY 1"""
)
def run_report(spark, sf_dir):
    """SNK07."""
    track = lambda lang, path: F.struct(F.lit(lang).alias("lang"), F.lit(path).alias("path"))
    third = lambda v: F.when(F.col("seq") % 3 == 0, v)
    clips = asr_segments(spark, sf_dir).select(
        "video_id", F.col("seq").alias("clip"), F.concat(F.lit("/out/c"), F.col("seq").cast("string"), F.lit(".mp4")).alias("path"), "start", "end", (F.col("end") - F.col("start")).alias("duration"), (F.col("seq") * 10.0).alias("score"),
        F.when(F.col("seq") % 2 == 0, F.array(track("zh", "/s/a.srt"), track("fr", "/s/b.srt"))).otherwise(F.array().cast("array<struct<lang:string,path:string>>")).alias("subtitles"),
        third("EN=replace").alias("policy"), third("burn").alias("action"), F.lit(None).cast("string").alias("renderer"),
    )
    return sinks.run_reports(clips, 12.5)


@query
def video_summary(spark, sf_dir):
    """SNK08, MDL08's document, TOP04; tested on a given case."""
    t = topics(spark, sf_dir).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "topic", "summary"))), lambda x: F.struct(x["topic"].alias("topic"), x["summary"].alias("summary"))).alias("topics"), F.array_sort(F.collect_set("reason")).alias("core_points"))
    none = F.array().cast("array<string>")
    rows = t.select("video_id", "topics", "core_points", F.lit("").alias("title"), F.lit("One.").alias("one_sentence_summary"), *[none.alias(c) for c in ("evidence_points", "insights", "actionable_takeaways", "caveats", "best_for")], F.array(F.lit("a"), F.lit("b")).alias("keywords"), F.lit("").alias("x_post_copy_zh"), F.lit("post").alias("x_post_copy_en"))
    return sinks.video_summaries(rows)


@query(sql=f"""WITH {_CAND}, t AS (SELECT video_id, seq, topic, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM cand) SELECT video_id, string_agg(topic, ',' ORDER BY seq) AS head FROM t WHERE n <= 8 GROUP BY 1""")
def list_heads(spark, sf_dir):
    """TOP04: the first eight of a list."""
    w = Window.partitionBy("video_id").orderBy("seq")
    first = candidates(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 8")
    return first.groupBy("video_id").agg(sinks.ordered(F.col("topic"), "seq", glue=",").alias("head"))


def _with_asr(step):
    """Topics are their own speech, so that edges to snap to are there."""
    return lambda rows: step(rows, [{"start": r["start"], "end": r["end"]} for r in rows])


@query
def merge_overlapping(spark, sf_dir):
    """FLD03, AGG02; tested on given cases."""
    return folds.fold(topics(spark, sf_dir), topic_ops.merge_overlapping, topic_ops.SCHEMA).drop("key_sentences")


@query
def merge_short(spark, sf_dir):
    """FLD04; tested on given cases."""
    return folds.fold(topics(spark, sf_dir), lambda rows: topic_ops.merge_short(rows, BOUNDS), topic_ops.SCHEMA).drop("key_sentences")


@query
def merge_adjacent(spark, sf_dir):
    """FLD05, FLD19, FLT05; tested on given cases."""
    b = topic_ops.Bounds(60.0, 180.0, 6, "topic")
    return folds.fold(topics(spark, sf_dir), lambda rows: topic_ops.strategy_filter(rows, b), topic_ops.SCHEMA).drop("key_sentences")


@query
def topic_candidates(spark, sf_dir):
    """FLD17, FLD09, JN13, JN06: the summaries of some topics replace their texts; tested on given cases."""

    def step(rows, asr):
        summaries = [{"topic": r["topic"], "summary": r["reason"], "reason": "", "score": r["score"] / 2} for r in rows if r["seq"] % 3 == 0]
        return topic_ops.candidates(rows, summaries, asr, topic_ops.Bounds(15.0, 60.0))

    return folds.fold(topics(spark, sf_dir), _with_asr(step), topic_ops.SCHEMA + ", fit double").drop("key_sentences")


@query
def topic_durations(spark, sf_dir):
    """FLD18, FLD08; tested on given cases."""
    return folds.fold(topics(spark, sf_dir), _with_asr(lambda rows, asr: topic_ops.fit_durations(rows, asr, BOUNDS)), topic_ops.SCHEMA).drop("key_sentences")


@query
def topic_clips(spark, sf_dir):
    """The branch of clips from topics: FLD17, FLD18, FLD07; tested on given cases."""
    return folds.fold(topics(spark, sf_dir), _with_asr(lambda rows, asr: topic_ops.choose(rows, [], asr, BOUNDS)), topic_ops.SCHEMA + ", fit double").drop("key_sentences")


def _scene_rows(spark, sf_dir):
    c = candidates(spark, sf_dir).filter("topic IN ('error', 'purchase')")
    return c.select("video_id", "seq", (F.col("start") / 600.0 % 4320.0).alias("time"), "score", "topic")


@query
def scene_segments(spark, sf_dir):
    """FLD11, FLT12, TOP08; tested on given cases."""

    def step(rows):
        times = sorted({round(r["time"], 3) for r in rows if r["topic"] == "error"})
        return [r | {"video_id": rows[0]["video_id"]} for r in scenes.scene_segments(times, 60.0, 180.0, 6)]

    return folds.fold(_scene_rows(spark, sf_dir), step, "video_id long, start double, end double, score double")


@query
def key_segments(spark, sf_dir):
    """FLD16, JN04, FLD10, TOP02; tested on given cases."""

    def step(rows):
        rows = sorted(rows, key=lambda r: (r["time"], r["seq"]))
        found = scenes.key_segments([r for r in rows if r["topic"] == "purchase"], sorted({r["time"] for r in rows if r["topic"] == "error"}), 60.0, 180.0, 6)
        return [r | {"video_id": rows[0]["video_id"]} for r in found]

    return folds.fold(_scene_rows(spark, sf_dir), step, "video_id long, start double, end double, score double")


@query
def visual_sync(spark, sf_dir):
    """FLD21, HLP03, MDL13, JN03: a video's words between changes of the picture; some videos have a soft track; tested on given cases."""

    def step(rows):
        rows = sorted(rows, key=lambda r: r["seq"])
        soft = rows if rows[0]["video_id"] % 5 == 0 else []
        diffs = [{"video_id": 0, "time": r["start"] + 0.5, "diff": r["seq"] % 4 / 10.0} for r in rows]
        return [r | {"video_id": rows[0]["video_id"]} for r in scenes.visual_sync(soft, diffs, rows, rows[-1]["end"])]

    return folds.fold(asr_segments(spark, sf_dir).drop("role"), step, "video_id long, start double, end double, text string")


@query
def layouts(spark, sf_dir):
    """PRJ32, PRJ33, PRJ34, PRJ21: where lines and masks lie in pictures of several sizes; tested on given cases."""

    def step(rows):
        out = []
        for r in rows:
            vertical = r["page_id"] % 2 == 0
            width, height = (1080, 1920) if vertical else (1280 + r["page_id"] % 5 * 160, 720 + r["page_id"] % 5 * 90)
            sizes = scenes.layout(height, vertical, (None, "en", "zh")[r["page_id"] % 3], 0.8, (40, 40, 40) if vertical else (56, 56, 15))
            box = scenes.mask(width, height, vertical, 0.803, 28 if vertical else 18, sizes, [r["page_id"] * 7 % 900], [r["page_id"] * 3 % 200])
            out.append({"page_id": r["page_id"], **sizes, **box, **scenes.anchors(box, height, sizes)})
        return out

    names = "en_fontsize zh_fontsize margin_v_zh margin_v_en inter_gap x y w h radius_px feather_px padding_px center_x en_bottom zh_bottom inner_pad_y".split()
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id % 16").alias("part"))
    return folds.fold(p, step, "page_id long, " + ", ".join(f"{n} long" for n in names), ("part",))


@query(
    sql=f"""WITH RECURSIVE {_ASR}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end") AS rn FROM asr),
      f AS (SELECT video_id, rn, start AS s, "end" AS e, 1 AS g FROM o WHERE rn = 1 UNION ALL
        SELECT o.video_id, o.rn, CASE WHEN m THEN f.s ELSE o.start END, o."end", CASE WHEN m THEN g ELSE g + 1 END
        FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT o.start - f.e <= 2.5e0 AND f.e - f.s < 60 AND o."end" - f.s <= 120 AS m))
      SELECT video_id, min(s) AS start, arg_max(e, rn) AS "end" FROM f GROUP BY video_id, g"""
)
def streamed_windows(spark, sf_dir):
    """The survey's streaming extension of FLD02: transcripts land as files and pass through a stateful stream."""
    land, out = new_path(spark, "stream-land"), new_path(spark, "stream-windows")
    # one file each for odd and even parts of a transcript would be out of order: all of a video's rows are in one file, and a last row moves the watermark on
    rows = asr_segments(spark, sf_dir).select("video_id", "start", "end", F.timestamp_seconds(F.lit(1000)).alias("at"))
    rows.write.parquet(f"{land}/1")
    spark.createDataFrame([(-1, 0.0, 0.0, 1_000_000)], "video_id long, start double, end double, s long").select("video_id", "start", "end", F.timestamp_seconds("s").alias("at")).write.parquet(f"{land}/2")
    source = spark.readStream.schema(rows.schema).parquet(f"{land}/*")
    stream_folds.drained(lambda s: stream_folds.merge_windows(s, 2.5, 60.0, 120.0), source, out, new_path(spark, "stream-state"))
    return spark.read.schema(stream_folds.KIND).parquet(out).filter("video_id >= 0")
