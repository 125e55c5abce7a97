"""Clips from scene changes and climaxes, and subtitles timed by what is seen. Steps of folds, as in topics."""

from __future__ import annotations

import math

from spanloom.operators.folds import Row, change_points, merge_windows, remove_overlaps


def scene_segments(scenes: list[float], least: float, most: float, clips: int) -> list[Row]:
    """From scene to scene, each clip ending at the change nearest to the target length; clips of a length out of bounds are passed over."""
    target, out, i = (least + most) / 2, [], 0
    while i < len(scenes) - 1 and len(out) < clips:
        start = scenes[i]
        later = [s for s in scenes[i + 1 :] if s > start]
        end = min(later, key=lambda s: abs(s - start - target)) if later else start + target
        i = scenes.index(end) if later else len(scenes)
        if least <= end - start <= 1.5 * most:
            out.append({"start": start, "end": end, "score": 1.0})
    return out


def key_segments(climaxes: list[Row], scenes: list[float], least: float, most: float, clips: int) -> list[Row]:
    """Clips about the climaxes, from scene change to scene change, without overlaps; from the scenes alone if there is no climax."""
    if not climaxes:
        return scene_segments(scenes, least, most, clips)
    half, out = (least + most) / 4, []
    for i, c in enumerate(climaxes):
        a, e = c["time"] - half, c["time"] + half
        before, after = [s for s in scenes if s < c["time"]], [s for s in scenes if s > c["time"]]
        start = min(before, key=lambda s: abs(s - a)) if before else max(0.0, a)
        end = min(after, key=lambda s: abs(s - e)) if after else e
        end += max(0.0, least - (end - start)) - max(0.0, end - start - most)
        out.append({"start": max(0.0, start), "end": end, "score": c["score"], "seq": i})
    best = sorted(remove_overlaps(out), key=lambda r: -r["score"])[:clips]
    return sorted(best, key=lambda r: r["start"])


def sample_timestamps(duration: float, samples: int) -> list[float]:
    """Where to look for subtitles: evenly, or every five seconds from both ends and in the middle if a long video has few samples."""
    if duration <= 0 or samples <= 0:
        return []
    if duration < 20 or samples > 5:
        return [round(duration * (i + 1) / (samples + 1), 2) for i in range(samples)]
    ends = [5.0 * (i + 1) for i in range(samples // 2)]
    every = {*ends, *(duration - t for t in ends), *([duration / 2] if samples % 2 else [])}
    return sorted(t for t in every if 0.1 <= t <= duration - 0.1)


def words_of(asr: list[Row]) -> list[Row]:
    """A transcript's words with their times; a segment without words is one."""
    out = []
    for s in asr:
        words = [w for w in s.get("words") or [] if (w["word"] or "").strip()]
        out += [w | {"word": w["word"].strip()} for w in words] if s.get("words") else [{"word": s["text"].strip(), "start": s["start"], "end": s["end"]}]
    return sorted(out, key=lambda w: w["start"])


def align_words(words: list[Row], windows: list[Row]) -> list[Row]:
    """The words whose middle lies in a window, as its text; windows without words go."""
    import re

    out = []
    for w in windows:
        inside = [x["word"] for x in words if w["start"] <= (x["start"] + x["end"]) / 2 < w["end"]]
        if inside:
            out.append(w | {"text": re.sub(r"\s+([,.!?])", r"\1", " ".join(inside)).strip()})
    return out


def visual_sync(soft: list[Row], diffs: list[Row], asr: list[Row], duration: float | None) -> list[Row]:
    """Subtitles as a soft track has them, or the transcript's words dealt to the windows between changes of the picture."""
    plain = lambda rows: [{k: r[k] for k in ("start", "end", "text")} for r in rows]
    if soft or not asr:
        return plain(soft)
    if duration is None:
        return plain(asr)
    times = [r["time"] for r in change_points(diffs, duration)]
    if len(times) < 2:
        return plain(asr)
    windows = [{"video_id": 0, "start": a, "end": b} for a, b in zip(times, times[1:], strict=False) if b - a >= 0.4]
    return plain(align_words(words_of(asr), merge_windows(windows)))


def geometry(left: float, right: float, margin: float = 0.15) -> bool:
    """Whether a box of text is wide or central enough for a subtitle."""
    return right - left > 0.25 or left >= margin and 1.0 - right >= margin


def layout(height: int, vertical: bool, hard: str | None = None, boundary: float = 0.80, sizes: tuple[int, int, int] = (0, 0, 0)) -> dict[str, int]:
    """Sizes and margins of both subtitle lines in pixels, from the sizes (English, Chinese, margin) at the base height."""
    scale = height / (1920 if vertical else 1080)
    en, zh = (max(1, round(s * scale)) for s in sizes[:2])
    if hard in ("en", "zh"):
        gap = max(3, round(zh * 0.08))
        low = int((1.0 - boundary) * height) + max(10, round(zh * 0.30)) + gap
        return {"en_fontsize": en, "zh_fontsize": zh, "margin_v_zh": low, "margin_v_en": low, "inter_gap": gap}
    gap, low = max(4, round(8 * scale)), max(1, round(sizes[2] * scale))
    return {"en_fontsize": en, "zh_fontsize": zh, "margin_v_zh": low, "margin_v_en": low + zh + gap, "inter_gap": gap}


def percentile(values: list[float], share: float, other: float) -> float:
    """The value at the nearest rank, half to even."""
    return sorted(values)[min(len(values) - 1, max(0, round((len(values) - 1) * share)))] if values else other


def mask(width: int, height: int, vertical: bool, boundary: float, padding: int, sizes: dict[str, int], widths: list[int], heights: list[int]) -> dict[str, int]:
    """The box that hides a subtitle in the picture, from the sizes of the blocks that will cover it."""
    pad = max(8, round(padding * (height / (1920 if vertical else 1080))))
    side, above = max(16, round(width * (0.04 if vertical else 0.03))), max(10, round(height * (0.014 if vertical else 0.012)))
    wide = percentile([w for w in widths if w > 0], 0.68, int(width * 0.46)) + 2 * side
    w = min(int(width * (0.86 if vertical else 0.78)), max(int(width * (0.40 if vertical else 0.30)), wide))
    high = percentile([h for h in heights if h > 0], 0.68, round(sizes["en_fontsize"] * 1.35 + sizes["zh_fontsize"] * 1.35 + sizes["inter_gap"]))
    high = (high if high > 0 else round(height * 0.14)) + 2 * above
    h = min(round(height * (0.16 if vertical else 0.14)), max(round(height * (0.08 if vertical else 0.07)), high))
    radius = max(14, round(max(1, min(w, h)) * (0.42 if vertical else 0.38)))
    y = min(max(0, math.floor(boundary * height) - pad), height - h - max(4, round(height * 0.006)))
    return {"x": max(0, (width - w) // 2), "y": y, "w": w, "h": h, "radius_px": radius, "feather_px": max(2, round(radius * 0.18)), "padding_px": pad}


def anchors(box: dict[str, int], height: int, sizes: dict[str, int]) -> dict[str, int]:
    """Where both lines stand within a mask: English above Chinese."""
    inner = max(8, round(min(box["h"] * 0.12, height * 0.012)))
    low = box["y"] + box["h"] - inner
    high = max(low - sizes["zh_fontsize"] - sizes["inter_gap"], box["y"] + inner + sizes["en_fontsize"])
    return {"center_x": box["x"] + box["w"] // 2, "en_bottom": high, "zh_bottom": low, "inner_pad_y": inner}
