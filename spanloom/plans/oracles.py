"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from spanloom.plans import media, subtitles  # noqa: F401  (they register theirs)
from spanloom.plans.registry import SQL

_ASR = """asr AS (SELECT conv_id AS video_id, turn AS seq, (s - length(text)) / 10.0::DOUBLE AS start, s / 10.0::DOUBLE AS "end", text, role
  FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS s FROM conversations))"""
_CLIPS = """clips AS (SELECT video_id, k AS clip, CAST(k * 50 AS DOUBLE) AS clip_start, least(k * 50 + 60.0::DOUBLE, total) AS clip_end FROM
  (SELECT video_id, total, unnest(range(0, 1 + greatest(0, CAST(ceil((total - 60) / 50) AS BIGINT)))) AS k
   FROM (SELECT video_id, max("end") AS total FROM asr GROUP BY 1) WHERE total > 0))"""
_SUBSET = """subset AS (SELECT a.video_id, clip, seq, greatest(0.0::DOUBLE, start - clip_start) AS start,
  least(clip_end - clip_start, "end" - clip_start) AS "end", text FROM asr a JOIN clips c ON a.video_id = c.video_id AND start <= clip_end AND "end" >= clip_start)"""
_SPEECH = """speech AS (SELECT video_id, clip, sum("end" - start) AS speech FROM subset GROUP BY 1, 2)"""
_CAND = """cand AS (SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS start,
  epoch_us(ts) / 1e6::DOUBLE + value * 60.0::DOUBLE AS "end", value AS score, event_type AS topic FROM events)"""
_TOPIC = """topic AS (SELECT user_id AS video_id, event_id AS seq, n * 40e0 + event_id % 7 * 5e0 AS start, n * 40e0 + event_id % 7 * 5e0 + (20e0 + event_id % 60) AS "end",
  't' || (n // 3) || ' ' || event_type || ' a' || (event_id % 5) AS topic, event_type || ' point ' || (event_id % 4) || '. Then ' || (event_id % 3) || '.' AS summary,
  CAST(event_id % 101 AS DOUBLE) AS score, 'because ' || event_type || '.' AS reason,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'for it' ELSE 'strongly against ' || event_type END AS stance, ['k' || (event_id % 3), 'm' || (event_id % 2)] AS key_sentences,
  CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 11 AS DOUBLE) END AS conclusion_clarity, CAST(event_id % 7 AS DOUBLE) AS self_contained,
  CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 8 AS DOUBLE) END AS info_density, CAST(event_id % 9 AS DOUBLE) AS viral_fit,
  CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 100 AS DOUBLE) END AS publishability
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"""


def _coerce(x: str) -> str:
    """A score on any of three scales to 0-100."""
    return f"CASE WHEN {x} IS NULL THEN 70e0 WHEN isnan({x}) OR {x} <= 0 THEN 0e0 WHEN {x} <= 1 THEN {x} * 100 WHEN {x} <= 10 THEN {x} * 10 ELSE least({x}, 100e0) END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct({a} || {b})) AS DOUBLE) END"


def _tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'))"


_CLUSTER = f"""tok AS (SELECT *, {_tokens('topic')} AS tt, {_tokens('summary')} AS st FROM topic),
  lagged AS (SELECT *, lag("start") OVER w AS b0, lag("end") OVER w AS b1, lag(tt) OVER w AS bt, lag(st) OVER w AS bs FROM tok WINDOW w AS (PARTITION BY video_id ORDER BY start, "end", score DESC, seq)),
  near AS (SELECT *, greatest({_jaccard('bt', 'tt')}, {_jaccard('bs', 'st')}) AS alike, least(b1, "end") - greatest(b0, start) AS shared, start - b1 AS gap FROM lagged),
  clus AS (SELECT * EXCLUDE (tt, st, bt, bs), CAST(sum(CASE WHEN b0 IS NOT NULL AND ((shared > 0 AND (alike >= 0.2e0 OR shared >= 0.5e0 * least(b1 - b0, "end" - start)))
    OR (gap BETWEEN 0 AND 18 AND alike >= 0.65e0)) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start, "end", score DESC, seq) AS BIGINT) AS cluster FROM near)"""


ORACLES = SQL | {
    "chunk_windows": f"WITH {_ASR}, {_CLIPS} SELECT * FROM clips",
    "asr_subset": f"WITH {_ASR}, {_CLIPS}, {_SUBSET} SELECT * FROM subset",
    "window_transcript": f"""WITH {_ASR}, {_CLIPS} SELECT a.video_id, clip, string_agg(text, chr(10) ORDER BY seq) AS transcript
      FROM asr a JOIN clips c ON a.video_id = c.video_id AND start < clip_end AND "end" > clip_start GROUP BY 1, 2""",
    "word_alignment": f"""WITH {_ASR}, {_CLIPS}, w AS (SELECT video_id, seq, start, "end", string_split(text, ' ') AS ws, unnest(range(0, len(string_split(text, ' ')))) AS pos FROM asr),
      m AS (SELECT video_id, seq, pos, ws[pos + 1] AS word, start + ("end" - start) * (pos + 0.5::DOUBLE) / len(ws) AS mid FROM w)
      SELECT m.video_id, clip, count(*) AS words, regexp_replace(string_agg(word, ' ' ORDER BY mid, seq, pos), '\\s+([,.!?])', '\\1', 'g') AS text
      FROM m JOIN clips c ON m.video_id = c.video_id AND mid >= clip_start AND mid < clip_end GROUP BY 1, 2""",
    "nearest_scene": f"""WITH {_CAND}, s AS (SELECT video_id, start AS scene FROM cand WHERE topic = 'error'), c AS (SELECT video_id, seq, start AS time FROM cand WHERE topic = 'purchase')
      SELECT c.video_id, seq, coalesce(min({{'d': abs(scene - (time - 43200)), 's': scene}}) FILTER (WHERE scene < time).s, greatest(0.0::DOUBLE, time - 43200)) AS start,
        coalesce(min({{'d': abs(scene - (time + 43200)), 's': scene}}) FILTER (WHERE scene > time).s, time + 43200) AS "end"
      FROM c LEFT JOIN s ON c.video_id = s.video_id GROUP BY c.video_id, seq, time""",
    "topic_summary_lookup": f"""WITH {_CAND}, l AS (SELECT trim(topic) AS topic, arg_max(CASE WHEN seq % 7 = 0 THEN '' ELSE topic || '-' || (seq % 10) END, seq) AS summary FROM cand GROUP BY 1)
      SELECT video_id, seq, coalesce(nullif(summary, ''), c.topic) AS summary FROM cand c LEFT JOIN l ON c.topic = l.topic""",
    "first_match_join": f"WITH {_CAND} SELECT video_id, seq, min(seq) OVER (PARTITION BY video_id, topic) AS first_seq FROM cand",
    "positional_full_join": f"""WITH {_ASR}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, role ORDER BY start, seq) AS place FROM asr)
      SELECT video_id, place, least(a.start, b.start) AS start, greatest(a."end", b."end") AS "end", a.text AS a_text, b.text AS b_text
      FROM (SELECT * FROM n WHERE role = 'user') a FULL JOIN (SELECT * FROM n WHERE role = 'assistant') b USING (video_id, place)""",
    "cache_anti_join": f"WITH {_ASR}, {_CLIPS} SELECT video_id, clip FROM clips WHERE (video_id + clip) % 3 <> 0",
    "score_coerce": f"""WITH r AS (SELECT event_id AS seq, try_cast(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN CAST(event_id % 13 AS VARCHAR)
      WHEN 3 THEN CAST((event_id % 100) / 100.0::DOUBLE AS VARCHAR) ELSE CAST(event_id % 150 AS VARCHAR) END AS DOUBLE) AS x FROM events) SELECT seq, round(CAST({_coerce('x')} AS DOUBLE), 6) AS score FROM r""",
    "speech_coverage": f"""WITH {_ASR}, {_CLIPS}, {_SUBSET}, {_SPEECH} SELECT c.video_id, c.clip, round(least(1.0::DOUBLE, coalesce(speech, 0) / (clip_end - clip_start)), 4) AS coverage
      FROM clips c LEFT JOIN speech s ON c.video_id = s.video_id AND c.clip = s.clip""",
    "clip_fit": f"""WITH {_ASR}, {_CLIPS}, {_SUBSET}, {_SPEECH}, d AS (SELECT c.video_id, c.clip, clip_end - clip_start AS d, coalesce(speech, 0.0::DOUBLE) AS s FROM clips c LEFT JOIN speech p ON c.video_id = p.video_id AND c.clip = p.clip)
      SELECT video_id, clip, round(round(least(100, greatest(0, 60 * (1 - least(1.0::DOUBLE, abs(d - 45) / 45.0::DOUBLE)) + 40 * CASE WHEN d > 0 THEN least(1.0::DOUBLE, s / d) ELSE 0 END)), 2), 1) AS fit FROM d""",
    "text_norm": r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS norm_md5 FROM documents",
    "token_jaccard": f"""WITH {_ASR}, t AS (SELECT video_id, seq, {_tokens('text')} AS b, lag({_tokens('text')}) OVER (PARTITION BY video_id ORDER BY seq) AS a FROM asr)
      SELECT video_id, seq, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE) END, 6) AS jaccard FROM t WHERE a IS NOT NULL""",
    "token_union": f"WITH {_ASR}, t AS (SELECT video_id, unnest({_tokens('text')}) AS tok FROM asr) SELECT video_id, count(DISTINCT tok) AS tokens, min(tok) AS lo, max(tok) AS hi FROM t GROUP BY 1",
    "language_status": r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('中', CAST(floor(length(text) * (doc_id % 40) / 40e0) AS INT)) ELSE '' END AS t FROM documents),
      n AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS zh, len(regexp_extract_all(t, '[A-Za-z]')) AS en FROM t)
      SELECT doc_id, CASE WHEN trim(t) = '' THEN 'en' WHEN zh + en = 0 THEN 'uncertain' WHEN zh / (zh + en)::DOUBLE >= 0.6 THEN 'zh' WHEN zh / (zh + en)::DOUBLE >= 0.11 THEN 'bilingual' ELSE 'en' END AS status FROM n""",
    "meta_output": r"""WITH t AS (SELECT conv_id, regexp_matches(CASE turn % 6 WHEN 0 THEN 'Translator NOTE ' WHEN 1 THEN '此处应为空行' WHEN 2 THEN '原文第12行 ' WHEN 3 THEN 'Note: ' ELSE '' END || text,
      '(?i)此处应为空行|原文第\d+行|占位|空行|do not translate|leave this line blank|placeholder|translator note|note:') AS m FROM conversations)
      SELECT conv_id, count(*) FILTER (WHERE m) AS meta, coalesce(bool_or(m), false) AS any_meta FROM t GROUP BY 1""",
    "lang_drift": r"""WITH t AS (SELECT conv_id, CASE WHEN turn % 4 = 1 THEN '  ' WHEN conv_id % 9 = turn THEN text || '中' ELSE text END AS t FROM conversations),
      f AS (SELECT conv_id, regexp_matches(t, '[\x{4e00}-\x{9fff}]') AS cjk, len(regexp_extract_all(t, '[A-Za-z]')) >= 4 AND NOT regexp_matches(trim(t), '^[A-Z]{1,8}$') AS latin, trim(t) <> '' AS f FROM t)
      SELECT conv_id, coalesce(count(*) FILTER (WHERE f AND latin AND NOT cjk) / CAST(nullif(count(*) FILTER (WHERE f), 0) AS DOUBLE) > 0.15e0, false) AS drift_zh,
        coalesce(count(*) FILTER (WHERE f AND cjk) / CAST(nullif(count(*) FILTER (WHERE f), 0) AS DOUBLE) > 0.15e0, false) AS drift_en FROM f GROUP BY 1""",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "transcript_prefix": f"""WITH {_ASR}, u AS (SELECT video_id, CAST(sum(length(text) + 1) OVER w AS BIGINT) AS used, row_number() OVER w AS n FROM asr WINDOW w AS (PARTITION BY video_id ORDER BY seq))
      SELECT video_id, count(*) AS lines, max(used) AS chars FROM u WHERE used <= 1500 OR n = 1 GROUP BY 1""",
    "change_windows": f"""WITH {_CAND}, p AS (SELECT video_id, start, lead(start) OVER (PARTITION BY video_id ORDER BY start) AS "end" FROM cand WHERE topic = 'error')
      SELECT * FROM p WHERE "end" - start >= 0.4::DOUBLE""",
    "srt_lines": f"""WITH {_ASR}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, seq) AS n, CAST(floor(start * 1000) AS BIGINT) AS a, CAST(floor("end" * 1000) AS BIGINT) AS b FROM asr)
      SELECT video_id, seq, n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> '
        || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS block FROM m""",
    "chunk_clusters": f"WITH {_TOPIC}, {_CLUSTER} SELECT video_id, seq, cluster FROM clus",
    "cluster_collapse": f"""WITH {_TOPIC}, {_CLUSTER},
      o AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY start, "end", score DESC, seq) AS rn,
        row_number() OVER (PARTITION BY video_id, cluster ORDER BY score DESC, "end" - start DESC, start, "end", seq) AS best FROM clus),
      frag AS (SELECT video_id, cluster, f, min(rn * 100 + i) AS place FROM (SELECT video_id, cluster, rn, unnest([split_part(summary, '. ', 1) || '.', split_part(summary, '. ', 2)]) AS f, unnest([1, 2]) AS i FROM o) GROUP BY ALL),
      sums AS (SELECT video_id, cluster, string_agg(f, ' ' ORDER BY place) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY place) AS k FROM frag) WHERE k <= 3 GROUP BY 1, 2),
      why AS (SELECT video_id, cluster, string_agg(reason, ' ' ORDER BY place) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY place) AS k
        FROM (SELECT video_id, cluster, reason, min(rn) AS place FROM o GROUP BY ALL)) WHERE k <= 3 GROUP BY 1, 2),
      keys AS (SELECT video_id, cluster, string_agg(s, '|' ORDER BY place) AS key_sentences, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY place) AS k
        FROM (SELECT video_id, cluster, s, min(CASE WHEN best = 1 THEN 0 ELSE rn END * 100 + i) AS place FROM (SELECT video_id, cluster, rn, best, unnest(key_sentences) AS s, unnest([1, 2]) AS i FROM o) GROUP BY ALL)) WHERE k <= 3 GROUP BY 1, 2),
      g AS (SELECT video_id, cluster, min(start) AS start, max("end") AS "end", arg_min(topic, best) AS topic, max(score) AS top, count(*) AS members, arg_max(stance, {{'l': length(stance), 'b': best = 1, 'r': -rn}}) AS stance,
        max(conclusion_clarity) AS conclusion_clarity, max(self_contained) AS self_contained, max(info_density) AS info_density, max(viral_fit) AS viral_fit, max(publishability) AS publishability FROM o GROUP BY 1, 2),
      n AS (SELECT g.*, summary, reason, key_sentences, keys.n AS ks, list_avg(list_filter([conclusion_clarity, self_contained, info_density, viral_fit], lambda x: x IS NOT NULL)) * 10 AS mean4
        FROM g JOIN sums USING (video_id, cluster) JOIN why USING (video_id, cluster) JOIN keys USING (video_id, cluster))
      SELECT video_id, cluster, start, "end", topic, summary, reason, stance, key_sentences, conclusion_clarity, self_contained, info_density, viral_fit, publishability,
        round(least(100e0, greatest(top, publishability, mean4, CASE WHEN stance <> '' THEN least(100e0, 50e0 + 4 * len(string_split(stance, ' '))) END, least(100e0, 55e0 + 8 * ks)) + least(8e0, (members - 1) * 2e0)), 2) AS score FROM n""",
    "zscore": f"WITH {_CAND} SELECT seq, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8), 4) AS z FROM cand WINDOW w AS (PARTITION BY video_id)",
    "nearest_rank_pct": f"WITH {_CAND}, l AS (SELECT video_id, list(score ORDER BY score) AS s FROM cand GROUP BY 1) SELECT video_id, s[CAST(round_even((len(s) - 1) * 0.8::DOUBLE, 0) AS BIGINT) + 1] AS p80 FROM l",
    "failure_reason": f"""WITH {_CAND} SELECT video_id, CASE WHEN count(DISTINCT topic) = 1 THEN min(topic) WHEN bool_or(topic = 'signup') THEN 'llm_empty_segments' ELSE 'all_topic_windows_failed' END AS reason FROM cand GROUP BY 1""",
    "frame_vote": """WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS zh, count(*) FILTER (WHERE role = 'assistant') AS en FROM conversations GROUP BY 1)
      SELECT conv_id, CASE WHEN zh + en = 0 THEN 'uncertain' WHEN zh >= en THEN 'zh' ELSE 'en' END AS lang FROM c""",
    "stream_score": r"""WITH f AS (SELECT conv_id AS video_id, CASE role WHEN 'user' THEN '0.80-0.95' WHEN 'assistant' THEN '0.10-0.30' ELSE '0.55-0.75' END AS region, turn AS frame,
        trim(CASE WHEN turn % 5 = 4 THEN ' ' WHEN conv_id % 7 = 3 THEN 'Button panel ' || text ELSE text END) AS t FROM conversations),
      h AS (SELECT *, list_filter(regexp_extract_all(lower(t), '[a-z][a-z0-9_-]{2,}'), lambda x: list_contains(string_split(
        'gallery toolbar sidebar button buttons screen browser console terminal command install installer download upload output settings editor panel preview widget parklistscreen enableedgetoedge edgegallery', ' '), x)) AS hits,
        CAST(t <> lag(t) OVER (PARTITION BY video_id, region ORDER BY frame) AS INT) AS ch FROM f WHERE t <> ''),
      a AS (SELECT video_id, region, count(*) AS frames, coalesce(avg(ch), 0) AS change, avg(length(t)) AS chars, avg(CAST(len(regexp_split_to_array(t, '\s+')) >= 3 AS INT)) AS wordy, sum(len(hits)) AS hits,
        len(list_distinct(flatten(list(hits)))) AS kinds FROM h GROUP BY 1, 2)
      SELECT video_id, region, frames, kinds >= 3 OR hits >= 4 AS heavy, CAST(greatest(0, (CASE WHEN change >= 0.4 THEN 3 ELSE 0 END) + (CASE WHEN chars >= 15 THEN 2 ELSE 0 END)
        + (CASE WHEN CAST(split_part(region, '-', 1) AS DOUBLE) >= 0.5 THEN 2 ELSE 0 END) + (CASE WHEN wordy >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN frames >= 3 THEN 1 ELSE 0 END) - least(6, 2 * hits)) AS BIGINT) AS score FROM a""",
    "strategy_filter": f"""WITH {_CAND}, c AS (SELECT *, {_coerce('score')} AS s FROM cand),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, start, seq) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM c),
      k AS (SELECT *, max(s) FILTER (WHERE rn = 7) OVER (PARTITION BY video_id) AS nth FROM r),
      f AS (SELECT *, n <= 6 OR s >= greatest(80, nth - 1) AS keep FROM k), g AS (SELECT *, bool_or(keep) OVER (PARTITION BY video_id) AS has FROM f)
      SELECT video_id, seq FROM g WHERE keep OR NOT has""",
    "topk_by_score": f"""WITH {_CAND}, r AS (SELECT video_id, seq, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start, seq) AS INT) AS rank FROM cand) SELECT * FROM r WHERE rank <= 5""",
    "merge_windows": f"""WITH RECURSIVE {_CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end") AS rn FROM cand),
      f AS (SELECT video_id, rn, start AS s, "end" AS e, 1 AS g FROM o WHERE rn = 1 UNION ALL
        SELECT o.video_id, o.rn, CASE WHEN m THEN f.s ELSE o.start END, o."end", CASE WHEN m THEN g ELSE g + 1 END
        FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT o.start - f.e <= 7200 AND f.e - f.s < 14400 AND o."end" - f.s <= 28800 AS m))
      SELECT video_id, min(s) AS start, arg_max(e, rn) AS "end" FROM f GROUP BY video_id, g""",
    "remove_overlaps": f"""WITH RECURSIVE {_CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, seq) AS rn FROM cand),
      f AS (SELECT video_id, rn, seq, "end" AS e, score AS sc, 1 AS g FROM o WHERE rn = 1 UNION ALL
        SELECT o.video_id, o.rn, CASE WHEN ov AND NOT o.score > sc THEN f.seq ELSE o.seq END, CASE WHEN ov AND NOT o.score > sc THEN f.e ELSE o."end" END,
          CASE WHEN ov AND NOT o.score > sc THEN sc ELSE o.score END, CASE WHEN ov THEN g ELSE g + 1 END
        FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT o.start < f.e AS ov))
      SELECT video_id, arg_max(seq, rn) AS seq FROM f GROUP BY video_id, g""",
    "change_points": f"""WITH RECURSIVE {_CAND}, z AS (SELECT video_id, round((start - min(start) OVER (PARTITION BY video_id)) / 3600e0, 3) AS time, seq FROM cand),
      o AS (SELECT video_id, time, row_number() OVER (PARTITION BY video_id ORDER BY time) AS rn FROM z WHERE seq % 100 / 100.0::DOUBLE > 0.015::DOUBLE AND seq % 100 / 100.0::DOUBLE < 0.7::DOUBLE),
      f AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS rn, 0e0 AS t, true AS hit FROM z UNION ALL
        SELECT o.video_id, o.rn, CASE WHEN o.time - f.t >= 6 THEN o.time ELSE f.t END, o.time - f.t >= 6 FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1)
      SELECT DISTINCT video_id, t AS time FROM (SELECT video_id, t FROM f WHERE hit UNION ALL SELECT video_id, max(time) FROM z GROUP BY 1)""",
    "chunk_pack": f"""WITH RECURSIVE {_ASR}, o AS (SELECT video_id, seq, length(text) AS n, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM asr),
      f AS (SELECT video_id, rn, seq, n AS chars, 1 AS items, CAST(0 AS BIGINT) AS chunk FROM o WHERE rn = 1 UNION ALL
        SELECT o.video_id, o.rn, o.seq, CASE WHEN b THEN o.n ELSE chars + o.n END, CASE WHEN b THEN 1 ELSE items + 1 END, CASE WHEN b THEN chunk + 1 ELSE chunk END
        FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1, LATERAL (SELECT chars + o.n > 1200 OR items >= 3 AS b))
      SELECT video_id, seq, chunk FROM f""",
    "greedy_clips": f"""WITH RECURSIVE {_CAND}, c AS (SELECT video_id, seq, start, "end", CAST({_coerce('score')} AS DOUBLE) AS score FROM cand),
      o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start, seq) AS rn FROM c),
      f AS (SELECT video_id, rn, true AS hit, [{{'s': start, 'e': "end"}}] AS chosen FROM o WHERE rn = 1 UNION ALL
        SELECT o.video_id, o.rn, ok, CASE WHEN ok THEN list_append(chosen, {{'s': o.start, 'e': o."end"}}) ELSE chosen END
        FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1,
        LATERAL (SELECT len(chosen) < 6 AND len(list_filter(chosen, lambda x: o.start < x.e AND o."end" > x.s)) = 0 AS ok))
      SELECT o.video_id, o.seq, o.start, o."end", o.score FROM f JOIN o USING (video_id, rn) WHERE hit""",
    "video_span": f'WITH {_ASR} SELECT video_id, coalesce(max("end"), 0) AS total, count(*) AS segments FROM asr GROUP BY 1',
    "fmt_mmss": f"""WITH {_CAND}, m AS (SELECT seq, CAST(round_even(score * 60.0::DOUBLE, 0) AS BIGINT) AS s FROM cand)
      SELECT seq, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp FROM m""",
    "transcript_lines": f"""WITH {_ASR} SELECT video_id, seq, printf('[%.1fs - %.1fs] %s', start, "end", text) AS line FROM asr""",
    "sentence_breaks": f"""WITH {_ASR} SELECT video_id, seq, replace(replace(replace(text, '. ', '.' || chr(10)), '? ', '?' || chr(10)), '! ', '!' || chr(10)) AS lines FROM asr""",
    "join_cleanup": f"""WITH {_ASR} SELECT video_id, seq, regexp_replace(regexp_replace(text, '([,.!?])', ' \\1', 'g'), '\\s+([,.!?])', '\\1', 'g') AS text FROM asr""",
    "english_sample": f"""WITH {_ASR}, n AS (SELECT video_id, CASE WHEN video_id % 10 = 3 OR seq = 1 THEN ' ' ELSE text END AS text, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM asr),
      v AS (SELECT video_id, trim(text) <> '' AS f, NOT regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') AND len(regexp_extract_all(text, '[A-Za-z]')) >= 4 AND NOT regexp_matches(trim(text), '^[A-Z]{{1,8}}$') AS en
        FROM n WHERE n <= 5)
      SELECT video_id, count(*) FILTER (WHERE f) > 0 AND count(*) FILTER (WHERE f AND en) >= least(count(*) FILTER (WHERE f), 4) AS english FROM v GROUP BY 1""",
}
