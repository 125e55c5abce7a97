"""Whether a video has subtitles, and in what language: from soft tracks, from text read in sampled frames, or from what is spoken.

Frames are rows of video_id, region ("0.80-0.95": from where to where of the height), frame, text and top (where the text begins). Scores of regions are one aggregation; the
decision over a video's few regions is a step of a fold.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.functions.strings import lifted, seq_ratio
from spanloom.operators.folds import Row

# Scores that a region needs, and what a detection is trusted by default.
EN_SCORE, HEAVY, SURE = 6, 3, 0.95
_WORDS = frozenset(text.UI_WORDS)


def status_of(t: str) -> str:
    """en, zh, bilingual or uncertain, by the share of CJK among CJK and Latin characters; an empty text is en."""
    zh, en = len(re.findall("[一-鿿]", t)), len(re.findall("[A-Za-z]", t))
    if not t.strip():
        return "en"
    if not zh + en:
        return "uncertain"
    share = zh / (zh + en)
    return "zh" if share >= text.ZH_SHARE else "bilingual" if share >= text.BILINGUAL_SHARE else "en"


def dominant(t: str) -> str:
    zh, en = len(re.findall("[一-鿿]", t)), len(re.findall("[A-Za-z]", t))
    return "uncertain" if not zh + en else "zh" if zh >= en else "en"


def _full(texts: list[str]) -> list[str]:
    return [t.strip() for t in texts if t and t.strip()]


def change_ratio(texts: list[str], least: float = 0.85) -> float:
    """Share of neighbouring texts that differ."""
    pairs = list(zip(texts, texts[1:], strict=False))
    return sum(seq_ratio(a, b) < least for a, b in pairs) / len(pairs) if pairs else 0.0


def fixed_mark(texts: list[str], least: float = 0.9) -> bool:
    """Whether a region's texts stay the same, as a logo does."""
    full = _full(texts)
    return len(full) >= 3 and sum(seq_ratio(a, b) for a, b in zip(full, full[1:], strict=False)) / (len(full) - 1) >= least


def frame_vote(texts: list[str]) -> str:
    """The language of most frames; zh on a tie."""
    found = [status_of(t) for t in _full(texts)]
    zh, en = sum(s in ("zh", "bilingual") for s in found), found.count("en")
    return "uncertain" if not zh + en else "zh" if zh >= en else "en"


def top_of(region: str) -> float | None:
    try:
        return float(region.split("-")[0])
    except ValueError:
        return None


def sure_bilingual(texts: list[str], region: str) -> bool:
    """A low region whose texts change and are mostly in both languages."""
    full, top = _full(texts), top_of(region)
    if len(full) < 3 or top is None or top < 0.5:
        return False
    return sum(status_of(t) == "bilingual" for t in full) >= max(2, len(full) // 2) and change_ratio(full) >= 0.4


def en_confidence(score: int, frames: int, change: float, penalty: int, fallback: bool) -> float:
    sure = (0.68 if fallback else 0.82) + (0.08 if score >= 8 else 0.04 if score >= 7 else 0.0)
    sure += 0.03 * (frames >= 4) + 0.02 * (change >= 0.6) - 0.08 * (penalty > 0)
    return max(0.0, min(0.79 if fallback else SURE, sure))


def stream_score(texts: list[str], region: str) -> Row:
    """How much a region looks like subtitles, up to 9, with what it was judged by."""
    full, top = _full(texts), top_of(region)
    n = len(full)
    change = change_ratio(full)
    chars, wordy = (sum(map(len, full)) / n, sum(len(t.split()) >= 3 for t in full) / n) if n else (0.0, 0.0)
    hits = [w for t in full for w in re.findall("[a-z][a-z0-9_-]{2,}", t.lower()) if w in _WORDS]
    penalty = min(6, 2 * len(hits))
    signal = change >= 0.4 or chars >= 15 or wordy >= 0.5
    points = 3 * (change >= 0.4) + 2 * (chars >= 15) + 2 * (top is not None and top >= 0.5) + (wordy >= 0.5) + (n >= 3)
    heavy = len(set(hits)) >= HEAVY or len(hits) >= 4
    return {"score": max(0, points - penalty), "signal": signal, "change": change, "frames": n, "penalty": penalty, "heavy": heavy}


def ocr_status(frames: list[Row], duration: float, samples: int) -> Row:
    """status, lang, boundary and confidence of the text in a video's sampled frames."""
    nothing = {"status": "none", "lang": None, "boundary": None, "confidence": 0.0}
    if duration <= 0:
        return nothing | {"status": "uncertain"}
    samples = max(samples, 3)
    regions: dict[str, list[Row]] = {}
    for r in sorted(frames, key=lambda r: (r["region"], r["frame"])):
        regions.setdefault(r["region"], []).append(r)
    texts = {k: [r["text"] or "" for r in v] for k, v in regions.items()}
    low = [k for k in regions if (top_of(k) or 0.0) >= 0.5]
    sure, kept = [], []
    for region, held in texts.items():
        full = _full(held)
        if len(full) < max(2, math.ceil(samples * 0.4)) or duration >= 30.0 and fixed_mark(held):
            continue
        if status_of(" ".join(full)) == "en":
            s = stream_score(held, region)
            if s["score"] < EN_SCORE or s["heavy"]:
                continue
            sure.append(en_confidence(s["score"], s["frames"], s["change"], s["penalty"], False))
        kept.append(region)
    fallback = not kept
    if fallback:
        kept = [k for k in low if not (duration >= 30.0 and fixed_mark(texts[k]))]
    full = [t for k in kept for t in texts[k] if t.strip()]
    if not full:
        return nothing
    whole = " ".join(full)
    status, confidence = status_of(whole), 0.85 if fallback else SURE
    if status == "en" and fallback:
        scores = {k: stream_score(texts[k], k) for k in kept}
        good = [s for s in scores.values() if s["score"] >= EN_SCORE and s["signal"] and s["frames"] >= 3 and s["change"] >= 0.5 and not s["heavy"]]
        if not good:
            return nothing
        confidence = en_confidence(good[0]["score"], good[0]["frames"], good[0]["change"], good[0]["penalty"], True)
    elif status == "en":
        confidence = sum(sure) / len(sure) if sure else 0.82
    elif status == "bilingual" and not any(sure_bilingual(texts[k], k) for k in kept):
        below = full if fallback else [t for k in kept if k in low for t in texts[k]]
        status = frame_vote(below)
        if status == "uncertain":
            status = dominant(" ".join(below) or whole)
    if status == "uncertain":
        return nothing if fallback else nothing | {"status": status}
    tops = [r["top"] for k in (low if fallback else kept) if k in low for r in regions[k] if r["top"] is not None and (r["text"] or "").strip()]
    return {"status": status, "lang": status, "boundary": min(tops, default=None), "confidence": confidence}


def soft_language(language: Column, title: Column) -> Column:
    """zh or en of a subtitle track, by its tags; null if neither."""
    lang, name = F.lower(F.coalesce(language, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    zh = (lang == "chi") | name.contains("chinese") | lang.contains("zh")
    return F.when(zh, "zh").when((lang == "eng") | name.contains("english") | lang.contains("en"), "en")


def soft_status(tracks: DataFrame) -> DataFrame:
    """video_id and the status that its soft tracks (video_id, language, title) give it, null if they give none."""
    own = tracks.select("video_id", soft_language(F.col("language"), F.col("title")).alias("l")).groupBy("video_id")
    has = own.agg(F.coalesce(F.bool_or(F.col("l") == "zh"), F.lit(False)).alias("zh"), F.coalesce(F.bool_or(F.col("l") == "en"), F.lit(False)).alias("en"))
    return has.select("video_id", F.when(F.col("zh") & F.col("en"), "bilingual").when(F.col("zh"), "zh").when(F.col("en"), "en").alias("soft"))


def first_status(soft: Column, ocr: Column, ocr_confidence: Column, spoken: Column) -> Column:
    """status and confidence: soft tracks first, then text in the picture, then what is spoken (which tells of no English subtitles)."""
    pair = lambda s, c: F.struct(s.alias("status"), c.alias("confidence"))
    one = F.lit
    return (
        F.when(soft.isNotNull(), pair(soft, one(1.0))).when(~F.coalesce(ocr, one("none")).isin("none", "uncertain"), pair(ocr, ocr_confidence))
        .when(spoken == "zh", pair(one("zh"), one(0.8))).when(spoken == "en", pair(one("none"), one(0.8))).otherwise(pair(one("none"), one(0.0)))
    )


def stream_scores(frames: DataFrame) -> DataFrame:
    """stream_score() of each region of each video, and whether it lasts and is no fixed mark, in one aggregation over neighbouring frames."""
    full = text.stripped(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("video_id", "region").orderBy("frame")
    t = frames.withColumn("t", full).filter("t <> ''").withColumn("ratio", lifted(seq_ratio, "double")(F.lag("t").over(w), F.col("t")))
    t = t.withColumn("ratio", F.when(F.row_number().over(w) > 1, F.col("ratio"))).withColumn("hits", text.ui_hits(F.col("t")))
    a = t.groupBy("video_id", "region").agg(
        F.coalesce(F.avg((F.col("ratio") < 0.85).cast("int")), F.lit(0.0)).alias("change"), F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("like"),
        F.avg(F.length("t")).alias("chars"), F.avg((F.size(F.split("t", "\\s+")) >= 3).cast("int")).alias("wordy"), F.count("*").alias("frames"),
        F.sum(F.size("hits")).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("kinds"),
    )
    pts = lambda cond, p: F.when(cond, p).otherwise(0)
    top = F.split("region", "-")[0].try_cast("double")
    points = pts(F.col("change") >= 0.4, 3) + pts(F.col("chars") >= 15, 2) + pts(top >= 0.5, 2) + pts(F.col("wordy") >= 0.5, 1) + pts(F.col("frames") >= 3, 1)
    return a.select(
        "video_id", "region", F.greatest(F.lit(0), points - F.least(F.lit(6), 2 * F.col("hits"))).cast("long").alias("score"), "change", "frames",
        ((F.col("kinds") >= HEAVY) | (F.col("hits") >= 4)).alias("heavy"), ((F.col("frames") >= 3) & (F.col("like") >= 0.9)).alias("fixed"),
    )
