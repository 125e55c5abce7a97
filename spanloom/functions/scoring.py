"""Scores and decisions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DURATION, MAX_DURATION, MAX_CLIPS = 60.0, 180.0, 6
# Confidence below which English subtitles are not trusted.
TRUSTED = 0.85


def score_coerce(raw: Column) -> Column:
    """A score on any of the scales 0-1, 0-10, 0-100 to 0-100; 70 if it isn't a number, 0 if NaN."""
    x = raw.try_cast("double")
    return F.when(x.isNull(), 70.0).when(F.isnan(x) | (x <= 0), 0.0).when(x <= 1, x * 100).when(x <= 10, x * 10).otherwise(F.least(x, F.lit(100.0)))


def target_duration(least: float = MIN_DURATION, most: float = MAX_DURATION) -> float:
    return max(least, min(most, (least + most) / 2))


def clip_fit(duration: Column, speech: Column, target: float | None = None) -> Column:
    """60 for the length, 40 for the share of speech."""
    t = target_duration() if target is None else target
    near = 1 - F.least(F.lit(1.0), F.abs(duration - t) / max(t, 1.0))
    talk = F.when(duration > 0, F.least(F.lit(1.0), speech / duration)).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(60 * near + 40 * talk, 2)))


# What is done about each status by default, and the names of the decisions.
MODES = {"en": "replace", "zh": "skip", "bilingual": "replace"}
DUAL, MASK_DUAL = "burn_dual_subtitles", "mask_existing_hard_subtitles_and_burn_dual_subtitles"


def burn_mode(status: Column, modes: dict[str, str] = MODES) -> Column:
    """replace or skip, as configured for the status; any other is skipped."""
    of = F.create_map(*[F.lit(v) for kv in modes.items() for v in kv])
    return F.coalesce(F.element_at(of, F.lower(F.trim(status))), F.lit("skip"))


def burn_decision(requested: Column, detected: Column, confidence: Column, lang: Column, boundary: Column, modes: dict[str, str] = MODES, trusted: float = TRUSTED, fallback: float = 0.803) -> Column:
    """What to do about subtitles in the picture, as one struct. English that was detected with too little confidence counts as none."""
    auto = requested == "auto"
    doubted = auto & (detected == "en") & (confidence < trusted)
    status = F.when(doubted, "none").when(auto, detected).otherwise(requested)
    spoken = F.when(auto & ~doubted, lang).when(requested.isin("en", "zh"), requested)
    top = F.when(auto & ~doubted, boundary)
    mode = burn_mode(status, modes)
    kind = F.when(status == "none", "none").when(mode == "skip", "skip").when((mode == "replace") & status.isin("en", "zh", "bilingual"), "replace").otherwise("other")
    by = lambda none, skip, replace, other: F.when(kind == "none", none).when(kind == "skip", skip).when(kind == "replace", replace).otherwise(other)
    null = F.lit(None).cast("string")
    policy = F.lit(f"EN={modes['en']} / ZH={modes['zh']} / BILINGUAL={modes['bilingual']}")
    cells = {
        "requested_subtitle_status": requested, "effective_subtitle_status": status, "detected_status": F.when(auto, status), "confidence": F.when(auto, confidence), "ocr_lang": spoken,
        "detected_boundary": top,
        "chosen_burn_mode": by(
            F.lit("dual_bottom_ffmpeg_or_moviepy"), F.concat(F.lit("skip_burn_keep_existing_"), status, F.lit("_hard_subtitles")),
            F.lit("mask_existing_hard_subtitles_and_burn_dual"), F.lit("dual_bottom_unknown_status_fallback"),
        ),
        "used_zh_aligned": F.lit(False), "subtitle_alignment_source": by(null, null, F.lit("shared_dual_timeline"), null), "burn_renderer": by(F.lit("ffmpeg"), F.lit("copy"), F.lit("ffmpeg"), F.lit("ffmpeg")),
        "auto_final_action": by(F.lit(DUAL), F.concat(F.lit("keep_existing_"), status, F.lit("_hard_subtitles_without_burn")), F.lit(MASK_DUAL), F.lit(DUAL)),
        "hard_subtitle_mask": F.when(kind == "replace", F.coalesce(top, F.lit(fallback))), "subtitle_burn_policy": F.lit(",".join(f"{k}={v}" for k, v in modes.items())),
        "subtitle_burn_policy_summary": policy,
    }
    return F.struct(*[c.alias(k) for k, c in cells.items()])


def en_confidence(score: Column, frames: Column, change: Column, penalty: Column, fallback: Column) -> Column:
    """Confidence of an English stream from its score and what it was judged by."""
    sure = F.when(fallback, 0.68).otherwise(0.82) + F.when(score >= 8, 0.08).when(score >= 7, 0.04).otherwise(0.0) + F.when(frames >= 4, 0.03).otherwise(0.0)
    sure = sure + F.when(change >= 0.6, 0.02).otherwise(0.0) - F.when(penalty > 0, 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.when(fallback, 0.79).otherwise(0.95), sure))


def color(value: Column) -> Column:
    """Red, green, blue and alpha (0 to 255) of a colour: a name, #rgb, #rrggbb or 0xrrggbb, each with @alpha; black if it is anything else."""
    parts = F.split(F.trim(F.lower(F.coalesce(value, F.lit("")))), "@", 2)
    base, given = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    names = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "00ff00", "blue": "0000ff", "yellow": "ffff00"}
    named = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), base)
    short = F.regexp_replace(F.regexp_extract(base, "^#([0-9a-f]{3})$", 1), "(.)", "$1$1")
    code = F.coalesce(named, F.nullif(short, F.lit("")), F.nullif(F.regexp_extract(base, "^(?:#|0x)([0-9a-f]{6})$", 1), F.lit("")), F.lit("000000"))
    channel = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("int")
    alpha = F.when(given.isNull(), 255.0).when(given <= 1, F.bround(given * 255)).otherwise(F.bround(given))
    return F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"), F.greatest(F.lit(0), F.least(F.lit(255), alpha.cast("int"))).alias("a"))


def segments_expected(span: Column, least: float, most: float) -> Column:
    """How many topics a window of some seconds may have."""
    return F.greatest(F.lit(1), F.bround(F.greatest(span, F.lit(1.0)) / max((least + most) / 2, 60.0)).cast("int"))
