"""Settings with their checks, and the arguments of a run."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, fields

STRATEGIES, STATUSES = ("opinion", "topic", "hybrid"), ("auto", "none", "en", "zh", "bilingual")


@dataclass(frozen=True)
class Config:
    """The defaults."""

    min_duration: float = 60.0
    max_duration: float = 180.0
    max_clips: int = 6
    clip_strategy: str = "opinion"
    chunk_seconds: float = 300.0
    chunk_overlap: float = 5.0
    topic_least: float = 20.0
    topic_chunk_seconds: float = 1500.0
    topic_chunk_overlap: float = 180.0
    climaxes: int = 5
    max_en_chars: tuple[int, int] = (35, 65)  # vertical, horizontal
    max_zh_chars: tuple[int, int] = (25, 45)
    en_confidence: float = 0.85
    ocr_samples: int = 11
    boundary: float = 0.803
    burn_en: str = "replace"
    burn_zh: str = "skip"
    burn_bilingual: str = "replace"
    mask_color: str = "black@0.9"
    llm_api_key: str = ""
    openai_api_key: str = ""

    def __post_init__(self) -> None:
        wrong = [
            (self.min_duration <= 0 or self.max_duration < self.min_duration, "durations"), (self.max_clips < 1, "max_clips"), (self.clip_strategy not in STRATEGIES, "clip_strategy"),
            (not 0 <= self.chunk_overlap < self.chunk_seconds, "chunk_overlap"), (not 0 <= self.topic_chunk_overlap < self.topic_chunk_seconds, "topic_chunk_overlap"),
            (not 0 <= self.en_confidence <= 1 or not 0 < self.boundary < 1, "subtitle thresholds"), (min(*self.max_en_chars, *self.max_zh_chars) < 1, "character limits"),
        ]
        if bad := [name for is_bad, name in wrong if is_bad]:
            raise ValueError(f"out of range: {', '.join(bad)}")

    def public(self) -> dict:
        """All settings, keys of services masked."""
        return {k: "***" if k.endswith("api_key") and v else v for k, v in asdict(self).items()}

    def burn_modes(self) -> dict[str, str]:
        return {"en": self.burn_en, "zh": self.burn_zh, "bilingual": self.burn_bilingual}


def from_settings(found: dict[str, str]) -> Config:
    """Settings by their names in capitals; pairs as two numbers with a comma."""
    given = {}
    for f in fields(Config):
        raw = found.get(f.name.upper())
        if raw is not None:
            kind = type(f.default)
            given[f.name] = tuple(int(x) for x in raw.split(",")) if kind is tuple else kind(raw)
    return Config(**given)


def final_bounds(least: float | None, most: float | None, base: Config) -> tuple[float, float]:
    """Durations as asked for, else as configured; the greatest is no less than the least."""
    low = least if least and least > 0 else base.min_duration
    return low, max(low, most if most and most > 0 else base.max_duration)


def clips_wanted(value, other: int = 4) -> int:
    """A number of clips, at least one; other where it is none."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return other


def analysis_plan(strategy: str | None) -> tuple[bool, bool, bool]:
    """Whether to analyse sound, scenes and topics; everything for an unknown strategy."""
    return (False, False, True) if (strategy or "opinion").lower() in ("opinion", "topic") else (True, True, True)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="spanloom", description="Clips and subtitles of timed segments")
    p.add_argument("--tables", required=True, help="folder of the input tables")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--query", action="append", default=[], help="a registered query to run; all of them if none is named")
    p.add_argument("--strategy", choices=STRATEGIES, default="opinion")
    p.add_argument("--min-duration", type=float)
    p.add_argument("--max-duration", type=float)
    p.add_argument("--max-clips", type=int, default=6)
    p.add_argument("--subtitle-status", choices=STATUSES, default="auto")
    return p.parse_args(given)
