"""Text expressions. They are Columns, so Spark compiles them into the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and thresholds of the text rules.
CJK = "[\\x{4e00}-\\x{9fff}]"
LATIN = "[A-Za-z]"
TOKEN = "[a-z0-9]+|[\\x{4e00}-\\x{9fff}]"
ZH_SHARE, BILINGUAL_SHARE, DRIFT_SHARE = 0.6, 0.11, 0.15
META = "(?i)此处应为空行|原文第\\d+行|占位|空行|do not translate|leave this line blank|placeholder|translator note|note:"
UI_WORDS = (
    "gallery toolbar sidebar button buttons screen browser console terminal command install installer download upload output settings editor panel preview "
    "widget parklistscreen enableedgetoedge edgegallery"
).split()


def norm_text(text: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def tokens(text: Column) -> Column:
    """The set of words of ASCII letters and digits, and of single CJK characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def language_status(text: Column) -> Column:
    """en, zh, bilingual or uncertain, by the share of CJK among CJK and Latin characters; an empty text is en."""
    zh, en = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(LATIN))
    share = zh / F.nullif(zh + en, F.lit(0))
    return (
        F.when(F.coalesce(stripped(text), F.lit("")) == "", "en").when(zh + en == 0, "uncertain")
        .when(share >= ZH_SHARE, "zh").when(share >= BILINGUAL_SHARE, "bilingual").otherwise("en")
    )


def looks_english(text: Column) -> Column:
    """Four Latin letters or more, no CJK, and no acronym of one word."""
    return ~text.rlike(CJK) & (F.regexp_count(text, F.lit(LATIN)) >= 4) & ~stripped(text).rlike("^[A-Z]{1,8}$")


def meta_output(text: Column) -> Column:
    """Whether a model talks about its answer instead of giving it."""
    return text.rlike(META)


def dominant_language(text: Column) -> Column:
    """zh where there are as many CJK characters as Latin letters, else en; uncertain without either."""
    zh, en = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(LATIN))
    return F.when(zh + en == 0, "uncertain").when(zh >= en, "zh").otherwise("en")


def drift(wrong: Column, text: Column) -> Column:
    """Aggregate: whether more than a share of the texts that aren't blank are in the wrong language."""
    full = stripped(F.coalesce(text, F.lit(""))) != ""
    return F.coalesce(F.count_if(full & wrong) / F.nullif(F.count_if(full), F.lit(0)) > DRIFT_SHARE, F.lit(False))


def ui_hits(text: Column) -> Column:
    """The words of a text that belong to user interfaces, each as often as it comes."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: w.isin(*UI_WORDS))


def sentences(text: Column) -> Column:
    """Parts that end with each single mark . ! or ?, and the rest; stripped, none empty."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), stripped), lambda s: s != "")


def dedupe_sentences(text: Column) -> Column:
    """Each sentence once, in the order of first appearance."""
    return F.array_join(F.array_distinct(sentences(stripped(text))), " ")


def merge_fragments(texts: Column, most: int = 3) -> Column:
    """The first distinct sentences of several texts, without the marks around them that join."""
    parts = F.flatten(F.transform(texts, lambda t: F.split(stripped(F.coalesce(t, F.lit(""))), "(?<=[。！？.!?])\\s+")))
    marks = "[ \\t\\r\\n。；;，,]+"
    clean = F.filter(F.transform(parts, lambda f: F.regexp_replace(f, f"^{marks}|{marks}$", "")), lambda f: f != "")
    return F.array_join(F.slice(F.array_distinct(clean), 1, most), " ")


def merge_unique(lists: Column, most: int = 3) -> Column:
    """The first distinct members of several lists that aren't blank."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.flatten(lists), stripped), lambda s: s != "")), 1, most)


def fmt_srt(seconds: Column) -> Column:
    """HH:MM:SS,mmm, cut off."""
    ms = F.floor(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_srt(stamp: Column) -> Column:
    """Seconds of HH:MM:SS,mmm; 0 if it is anything else."""
    part = lambda i: F.regexp_extract(stamp, "^\\s*(\\d+):(\\d+):(\\d+)[,.](\\d+)\\s*$", i).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000, F.lit(0.0))


def fmt_mmss(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on, of half-even rounded seconds."""
    s = F.bround(seconds).cast("long")
    long_form = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s >= 3600, long_form).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def transcript_line(start: Column, end: Column, text: Column) -> Column:
    return F.format_string("[%.1fs - %.1fs] %s", start, end, text)


def join_cleanup(text: Column) -> Column:
    """No space before punctuation."""
    return F.regexp_replace(text, "\\s+([,.!?])", "$1")


EXTENSION = "(?<=[^./])(\\.[^./]*)$"


def sanitize_name(name: Column, most: int = 80) -> Column:
    """A file's name without extension: words of letters and digits joined by single underscores, cut to most characters."""
    words = F.regexp_replace(F.regexp_replace(name, "(?U)\\s+", " "), "(?U)[^\\w\\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(words, "[- ]", "_"), "_+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, most), "_+$", "")


def sanitize_filename(name: Column, most: int = 80) -> Column:
    """sanitize_name() of a name, with its extension as it is."""
    return F.concat(sanitize_name(F.regexp_replace(name, EXTENSION, ""), most), F.regexp_extract(name, EXTENSION, 1))


def stable_filename(title: Column, video: Column, path: Column) -> Column:
    """The title's first 15 characters, the id, and the path's extension (.mp4 if it has none)."""
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    head = filled(stripped(F.substring(stripped(F.coalesce(title, F.lit("video"))), 1, 15)), "video")
    safe = F.regexp_replace(F.regexp_replace(stripped(filled(video, "video")), "(?U)[^\\w.-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.concat(filled(sanitize_name(head, 15), "video"), F.lit("_"), filled(safe, "video"), filled(F.regexp_extract(path, EXTENSION, 1), ".mp4"))


def summary_filename(path: Column) -> Column:
    """A path's stem of plain characters, and a suffix."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), EXTENSION, "")
    clean = F.regexp_replace(F.regexp_replace(stripped(stem), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("video")), F.lit("_video_summary.md"))


def escape_drawtext(text: Column) -> Column:
    """Marks that a drawn text's filter takes for its own."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("'\\''"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("\\:")), F.lit("%"), F.lit("%%"))


def fmt_ass(seconds: Column) -> Column:
    """H:MM:SS.cc, cut off from milliseconds."""
    ms = F.floor(seconds * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.floor(ms % 1000 / 10))


def ngrams(text: Column, size: int) -> Column:
    """Runs of so many words in lower case, each as often as it comes. White space is that of \\s in SQL, which has no vertical tab."""
    words = F.array_remove(F.split(F.lower(text), "[ \\t\\n\\f\\r]+"), "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    # a lambda evaluates what it captures for each element: its parameter is the list of words, so the text is split once
    return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, runs(w)).otherwise(F.array().cast("array<string>"))))


def fenced_json(text: Column) -> Column:
    """The inside of the first fenced block, or else from the first brace to the last."""
    fence = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    return F.when(fence != "", fence).otherwise(F.regexp_extract(text, "(?s)\\{.*\\}", 0))
