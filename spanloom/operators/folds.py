"""Ordered folds: decisions from what was already put out.

A fold runs once for each video, over its rows in order. Steps are plain functions of lists of dicts; fold() hands each
video's rows to one through Arrow. The shuffle by video is the only one, so chained folds share it.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions.strings import dedupe_sentences, repeats_itself
from spanloom.functions.strings import split_text as split_text_parts

Row = dict


def fold(rows: DataFrame, step: Callable[[list[Row]], list[Row]], schema: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Apply step to the rows of each key; it sorts for itself and returns rows of schema."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(step(t.to_pylist()), schema=arrow)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def merge_windows(rows: list[Row], gap: float = 2.5, short: float = 2.5, most: float = 6.0) -> list[Row]:
    """Extend a window while it is short, the next is near and both together aren't too long."""
    out: list[Row] = []
    for r in sorted(rows, key=lambda r: (r["start"], r["end"])):
        last = out[-1] if out else None
        if last and r["start"] - last["end"] <= gap and last["end"] - last["start"] < short and r["end"] - last["start"] <= most:
            last["end"] = r["end"]
        else:
            out.append({"video_id": r["video_id"], "start": r["start"], "end": r["end"]})
    return out


def remove_overlaps(rows: list[Row]) -> list[Row]:
    """Of overlapping neighbours the one with the strictly higher score stays, else the first."""
    out: list[Row] = []
    for r in sorted(rows, key=lambda r: (r["start"], r["seq"])):
        if out and r["start"] < out[-1]["end"]:
            if r["score"] > out[-1]["score"]:
                out[-1] = r
        else:
            out.append(r)
    return out


def greedy_select(rows: list[Row], most: int = 6) -> list[Row]:
    """Best first, if it overlaps nothing chosen before, up to most; in order of start."""
    chosen: list[Row] = []
    for r in sorted(rows, key=lambda r: (-r["score"], -r.get("fit", 0.0), r["start"], r["seq"])):
        if len(chosen) == most:
            break
        if all(r["end"] <= c["start"] or r["start"] >= c["end"] for c in chosen):
            chosen.append(r)
    return sorted(chosen, key=lambda r: (r["start"], r["seq"]))


def change_points(rows: list[Row], duration: float, least: float = 0.015, most: float = 0.7, apart: float = 0.4) -> list[Row]:
    """The start, times whose difference is in bounds and that are apart from the last accepted, and the duration; each once, in order."""
    times = [0.0]
    for r in sorted(rows, key=lambda r: r["time"]):
        if least < r["diff"] < most and r["time"] - times[-1] >= apart:
            times.append(round(r["time"], 3))
    return [{"video_id": rows[0]["video_id"] if rows else 0, "time": t} for t in sorted({*times, round(duration, 3)})]


def chunk_pack(rows: list[Row], budget: int, cap: int) -> list[Row]:
    """Number chunks of consecutive texts; a chunk ends when the next would exceed the budget of characters or the cap of items."""
    out, chunk, chars, items = [], 0, 0, 0
    for r in sorted(rows, key=lambda r: r["seq"]):
        n = len(r["text"] or "")
        if items and (chars + n > budget or items >= cap):
            chunk, chars, items = chunk + 1, 0, 0
        chars, items = chars + n, items + 1
        out.append({"video_id": r["video_id"], "seq": r["seq"], "chunk": chunk})
    return out


def asr_dedupe(rows: list[Row]) -> list[Row]:
    """Drop repeated segments; of two the longer stays if it is clearly longer."""
    import re

    def norm(t: str) -> str:
        return re.sub(r"[\W_]+", "", (t or "").lower())

    out: list[Row] = []
    for r in sorted((r for r in rows if (r["text"] or "").strip()), key=lambda r: (r["start"], r["end"])):
        if out:
            last = out[-1]
            near = min(last["end"], r["end"]) - max(last["start"], r["start"]) > 0
            gap, a, b = r["start"] - last["end"], norm(last["text"]), norm(r["text"])
            longer = (r["end"] - r["start"]) - (last["end"] - last["start"])
            if a and a == b and (near or gap <= 1.0):
                if longer > 0.15:
                    out[-1] = r
                continue
            if near and gap <= 1.0 and 2 * min(len(a), len(b)) >= 0.97 * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= 0.97:
                if longer > 0.25:
                    out[-1] = r
                continue
        out.append(r)
    return out


def repetition_zones(rows: list[Row], alike: float = 0.85) -> list[Row]:
    """Runs of segments that repeat themselves, or the one before, as one: the first's, without its repeated sentences, to the end of the last. Blank segments go."""
    out, run, before = [], [], ""

    def close() -> None:
        if len(run) > 1:
            out.append(run[0] | {"end": run[-1]["end"], "text": dedupe_sentences(run[0]["text"])})
        else:
            out.extend(run)
        run.clear()

    for r in sorted(rows, key=lambda r: (r["start"], r["end"])):
        text = (r["text"] or "").strip()
        if not text:
            continue
        if repeats_itself(text) or before and SequenceMatcher(None, before.lower(), text.lower()).ratio() >= alike:
            run.append(r)
        else:
            close()
            out.append(r)
        before = text
    close()
    return out


def split_long(row: Row, ends: list[float], least: float, most: float, target: float) -> list[tuple[float, float]]:
    """Cut a segment that is too long, at the boundaries nearest to the target where there are any."""
    start, end = row["start"], row["end"]
    inner = sorted({e for e in ends if start < e < end})
    if end - start <= most:
        return [(start, end)]
    out, at = [], start
    while end - at > most:
        lo, hi = at + least, min(at + most, end - least)
        if hi < lo:
            hi = min(at + most, end)
        ideal = min(at + target, hi)
        near = [e for e in inner if lo <= e <= hi]
        cut = min(near, key=lambda e: abs(e - ideal)) if near else ideal
        if cut <= at:
            break
        out.append((at, cut))
        at = cut
    return [*out, (at, end)]


def _snap(edge: float, lo: float, hi: float, target: float, bounds: list[float], right: bool) -> float:
    near = [b for b in bounds if lo <= b <= hi and (b >= edge if right else b <= edge)]
    return min(near, key=lambda b: abs(b - target)) if near else min(max(target, lo), hi)


def pad_edges(rows: list[Row], bounds: list[float], least: float) -> list[Row]:
    """Extend short segments to the right, then to the left, at boundaries; the last may pass the end."""
    out, bounds = [dict(r) for r in sorted(rows, key=lambda r: r["start"])], sorted(set(bounds))
    for i, r in enumerate(out):
        if r["end"] - r["start"] >= least:
            continue
        last = i == len(out) - 1
        before = out[i - 1]["end"] if i else 0.0
        after = out[i + 1]["start"] if not last else out[-1]["end"]
        need = least - (r["end"] - r["start"])
        if (room := min(need, after - r["end"])) > 0:
            r["end"] = _snap(r["end"], r["end"], after, r["end"] + room, bounds, True)
            need = least - (r["end"] - r["start"])
        if need > 0 and (room := min(need, r["start"] - before)) > 0:
            r["start"] = _snap(r["start"], before, r["start"], r["start"] - room, bounds, False)
            need = least - (r["end"] - r["start"])
        if need > 0 and last:
            r["end"] = _snap(r["end"], r["end"], r["end"] + need, r["end"] + need, bounds, True)
    return out


def find_peaks(rows: list[Row], height: float, apart: float, most: int) -> list[Row]:
    """Local maxima (the middle of a plateau), thinned so that the higher wins within a distance, the best of them in order of time."""
    rows = sorted(rows, key=lambda r: r["time"])
    peaks, i = [], 1
    while i < len(rows) - 1:
        if rows[i]["value"] > rows[i - 1]["value"]:
            j = i
            while j + 1 < len(rows) and rows[j + 1]["value"] == rows[i]["value"]:
                j += 1
            if j + 1 < len(rows) and rows[j + 1]["value"] < rows[i]["value"] and rows[i]["value"] >= height:
                peaks.append(rows[(i + j) // 2])
            i = j + 1
        else:
            i += 1
    kept: list[Row] = []
    for p in sorted(peaks, key=lambda p: (-p["value"], -p["time"])):
        if all(abs(p["time"] - k["time"]) >= apart for k in kept):
            kept.append(p)
    return sorted(sorted(kept, key=lambda p: (-p["value"], p["time"]))[:most], key=lambda p: p["time"])


def split_text(row: Row, most: int, lang: str = "en") -> list[Row]:
    """Cut a subtitle into parts of at most so many characters, with times in proportion to their lengths, 0.05 s at least; the last ends where the subtitle does."""
    start, end = row["start"], row["end"]
    text = (row["text"] or "").strip()
    if end <= start:
        return [row | {"end": round(start + 0.05, 3)}]
    parts = split_text_parts(text, most, lang) if len(text) > most else []
    if not parts:
        return [row]
    total = sum(map(len, parts))
    spans = [max(0.05, (end - start) * len(p) / total) for p in parts]
    shrink = min(1.0, (end - start) / sum(spans))
    out, at = [], start
    for i, (part, span) in enumerate(zip(parts, spans, strict=True)):
        stop = end if i == len(parts) - 1 else at + span * shrink
        stop = stop if stop > at else at + 0.05
        out.append(row | {"text": part, "start": round(at, 3), "end": round(stop, 3)})
        at = stop
    return out
