"""Models behind the engine, as hooks: what a user plugs in for speech, pictures and language, and how rows pass through it."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions import strings, text
from spanloom.functions.strings import json_array

Translate = Callable[[list[str], str], list[str]]
_META, _CJK = re.compile(text.META), re.compile("[一-鿿]")


class ModelHooks(Protocol):
    """Everything that the engine asks of models. A hook runs on executors, so it must be picklable."""

    def transcribe(self, audio: bytes) -> list[dict]: ...  # segments with start, end, text and words
    def audio_features(self, audio: bytes) -> list[dict]: ...  # rms, centroid and zcr of each frame
    def scenes(self, video: bytes) -> list[float]: ...  # times of changes
    def read_text(self, image: bytes) -> list[dict]: ...  # boxes with text and confidence
    def spoken_language(self, audio: bytes) -> str | None: ...
    def difference(self, image: bytes, other: bytes) -> float: ...  # mean absolute difference of the subtitle region, 0 to 1
    def density(self, image: bytes) -> float: ...  # share of bright pixels in a region
    def complete(self, prompt: str) -> str: ...  # a language model's answer
    def translate(self, texts: list[str], to: str) -> list[str]: ...


class Retry(Exception):
    """An answer that is worth another attempt: too many requests, a server's error, an answer that doesn't parse."""


def attempts(ask: Callable[[], object], most: int = 4, wait: float = 1.5, sleep: Callable[[float], None] = time.sleep):
    """The answer of the first attempt that doesn't ask for another; waits double. Other errors end it at once."""
    for n in range(most):
        try:
            return ask()
        except Retry:
            if n == most - 1:
                raise
            sleep(wait * 2**n)


def first_engine(*engines: Callable[[bytes], list[dict]]) -> Callable[[bytes], list[dict]]:
    """The segments of the first engine that works."""

    def run(audio: bytes) -> list[dict]:
        for n, engine in enumerate(engines):
            try:
                return engine(audio)
            except Exception:
                if n == len(engines) - 1:
                    raise
        return []

    return run


def looks_english(t: str) -> bool:
    """Four Latin letters or more, no CJK, and no acronym of one word."""
    t = t.strip()
    return bool(t) and not _CJK.search(t) and len(re.findall("[A-Za-z]", t)) >= 4 and not re.fullmatch("[A-Z]{1,8}", t)


def drifts(texts: list[str], to: str) -> bool:
    """Whether over 15 % of the texts that aren't blank are in the wrong language."""
    full = [t.strip() for t in texts if (t or "").strip()]
    wrong = {"en": lambda t: bool(_CJK.search(t)), "zh": looks_english}.get(to)
    return bool(full and wrong) and sum(map(wrong, full)) / len(full) > text.DRIFT_SHARE


def talks(texts: list[str]) -> bool:
    """Whether a text is a translator's remark."""
    return any(_META.search(t.strip()) for t in texts if (t or "").strip())


def gated(ask: Callable[[list[str], str, int], str], texts: list[str], to: str) -> list[str] | None:
    """A model's translation if it has a line for each text, in the right language and without remarks; it is asked twice, the second time strictly."""
    for n in range(2):
        try:
            got = json_array(ask(texts, to, n))
        except Retry:
            continue
        except Exception:
            return None
        if len(got) == len(texts) and not drifts(got, to) and not talks(got):
            return got
    return None


def degrading(request: Callable[[list[str], str], list[str] | None], fallback: Translate) -> Translate:
    """A translation that halves what fails, down to single lines, which the fallback translates."""

    def run(texts: list[str], to: str) -> list[str]:
        got = request(texts, to)
        if got is not None:
            return got
        if len(texts) <= 1:
            return fallback(texts, to)
        half = max(1, len(texts) // 2)
        return run(texts[:half], to) + run(texts[half:], to)

    return run


def backend(name: str, llm_key: str | None, openai_key: str | None) -> str:
    """The translation backend: as named, or by the keys at hand."""
    if name != "auto":
        return name
    return "siliconflow" if llm_key else "openai" if openai_key else "googletrans"


def chunk_limits(lengths: list[int], to: str) -> tuple[int, int]:
    """Characters and items that a request may hold: fewer where texts are long."""
    budget, items = (1100, 24) if to == "en" else (800, 14)
    mean, most = sum(lengths) / max(1, len(lengths)), max(lengths, default=0)
    if most >= 180 or mean >= 70:
        return max(600, int(budget * 0.8)), max(8, int(items * 0.75))
    if most >= 120 or mean >= 45:
        return max(800, int(budget * 0.9)), max(10, int(items * 0.85))
    return budget, items


def token_budget(lengths: list[int]) -> int:
    """Tokens that a request's answer may take."""
    n = len(lengths)
    return max(1024, min(int((int(n * max(sum(lengths) / max(n, 1) * 2.5, 30)) + 300) * 1.2), 4096))


def translate_all(texts: list[str], to: str, translate: Translate) -> list[str]:
    """Texts in requests of bounded size; already English ones stay."""
    sample = [t for t in texts[:5] if (t or "").strip()]
    if to == "en" and sample and sum(map(looks_english, sample)) >= min(4, len(sample)):
        return list(texts)
    lengths = [len((t or "").strip()) for t in texts]
    budget, cap = chunk_limits(lengths, to)
    out, held, used = [], [], 0
    for t, n in zip(texts, lengths, strict=True):
        if held and (used + n > budget or len(held) >= cap):
            out += translate(held, to)
            held, used = [], 0
        held.append(t)
        used += n
    return out + (translate(held, to) if held else [])


def subtitle_tracks(rows: list[dict], most: dict[str, int], translate: Translate) -> list[dict]:
    """A clip's tracks: the original split, English split, Chinese of the split English, once wrapped at its times and once split further."""
    from spanloom.operators.folds import split_text

    rows = sorted(rows, key=lambda r: r["start"])
    to = lambda held, lang: [r | {"text": t} for r, t in zip(held, translate_all([r["text"] for r in held], lang, translate), strict=True)]
    cut = lambda held, lang: [p for r in held for p in split_text(r, most[lang], lang)]
    english = cut(to(rows, "en"), "en")
    chinese = to(english, "zh")
    aligned = [r | {"text": strings.wrap_cjk(r["text"], most["zh"])} for r in chinese]
    tracks = {"original": cut(rows, "en"), "en": english, "zh_aligned": aligned, "zh": cut(chinese, "zh")}
    return [{**{k: r[k] for k in ("video_id", "start", "end", "text")}, "lang": lang, "idx": i} for lang, held in tracks.items() for i, r in enumerate(held)]


def mapped(rows: DataFrame, hook: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows through a hook, a batch at a time. To bound how many calls run at once, repartition the rows before."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_pylist(hook(batch.to_pylist()), schema=kinds).to_batches()

    return rows.mapInArrow(run, schema)
