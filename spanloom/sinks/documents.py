"""Documents written for each video: JSON, SubRip, ASS and Markdown. A document is a string column of one row for each video; write() stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import fmt_ass

# What the reports call things.
LANGUAGES = {"original": "原始", "zh": "中文", "en": "英文"}
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: {x}
PlayResY: {y}
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,{style}

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""  # fmt: skip


def ordered(value: Column, *order: str, glue: str = "\n") -> Column:
    """Aggregate: strings joined in the order of other columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), glue)


def write(documents: DataFrame, path: str, column: str) -> None:
    """One text file for each partition of documents."""
    documents.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def json_documents(rows: DataFrame, keys: list[str], name: str, order: str, **more: Column) -> DataFrame:
    """One JSON object for each key: more's aggregates, and the rows as an array under name."""
    inner = F.struct(*[c for c in rows.columns if c not in keys])
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), inner.alias("_r"))))
    found = rows.groupBy(*keys).agg(F.transform(held, lambda x: x["_r"]).alias(name), *[c.alias(k) for k, c in more.items()])
    return found.select(*keys, F.to_json(F.struct(*more, name)).alias("document"))


def srt_documents(blocks: DataFrame) -> DataFrame:
    """The blocks of a video (see sources.srt) as one document."""
    return blocks.groupBy("video_id").agg(ordered(F.col("block"), "seq").alias("document"))


def ass_events(segments: DataFrame, place: tuple[int, int] | None = None) -> DataFrame:
    """video_id, seq and the event line of each segment; a place puts its lower middle there."""
    at = F.lit(f"{{\\an2\\pos({place[0]},{place[1]})}}" if place else "")
    line = F.concat(F.lit("Dialogue: 0,"), fmt_ass(F.col("start")), F.lit(","), fmt_ass(F.col("end")), F.lit(",Default,,0,0,0,,"), at, F.replace("text", F.lit("\n"), F.lit("\\N")))
    return segments.select("video_id", "seq", line.alias("event"))


def ass_documents(segments: DataFrame, style: str, x: int, y: int, place: tuple[int, int] | None = None) -> DataFrame:
    return ass_events(segments, place).groupBy("video_id").agg(F.concat(F.lit(ASS_HEAD.format(style=style, x=x, y=y)), ordered(F.col("event"), "seq")).alias("document"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"- **{name}**: "), value))


def clip_sections(clips: DataFrame) -> DataFrame:
    """The report's section of each clip (video_id, clip, path, start, end, duration, score, subtitles as lang and path, policy, action, renderer)."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    names = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    tracks = F.transform("subtitles", lambda s: F.concat(F.lit("  - "), F.coalesce(F.element_at(names, s["lang"]), s["lang"]), F.lit(": `"), base(s["path"]), F.lit("`")))
    parts = [
        F.concat(F.lit("### Clip "), F.col("clip").cast("string"), F.lit("\n")), _line("文件", F.concat(F.lit("`"), base(F.col("path")), F.lit("`"))),
        _line("时间范围", F.concat(two("start"), F.lit("s - "), two("end"), F.lit("s"))), _line("时长", F.concat(two("duration"), F.lit("s"))), _line("评分", two("score")),
        F.when(F.size("subtitles") > 0, F.concat(F.lit("- **字幕文件**:\n"), F.array_join(tracks, "\n"))), _line("最终策略", F.col("policy")),
        _line("最终动作", F.concat(F.lit("`"), F.col("action"), F.lit("`"))), _line("渲染器", F.concat(F.lit("`"), F.col("renderer"), F.lit("`"))),
    ]
    return clips.select("video_id", "clip", F.size("subtitles").alias("tracks"), F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("section"))


def run_reports(clips: DataFrame, seconds: float) -> DataFrame:
    """One Markdown report of a run for each video: its clips in order, and how many clips and subtitle files there are."""
    a = clip_sections(clips).groupBy("video_id").agg(ordered(F.col("section"), "clip").alias("sections"), F.count("*").alias("clips"), F.sum("tracks").alias("tracks"))
    text = F.concat(
        F.lit("# 短视频智能剪辑与翻译 - 项目摘要报告\n\n---\n\n## 剪辑片段\n\n**总计**: "), F.col("clips").cast("string"), F.lit(" 个片段\n\n"), F.col("sections"),
        F.lit("\n## 统计信息\n\n- **剪辑片段总数**: "), F.col("clips").cast("string"), F.lit("\n- **字幕文件总数**: "), F.col("tracks").cast("string"),
        F.lit(f"\n- **处理耗时**: {seconds:.2f} 秒\n"),
    )
    return a.select("video_id", text.alias("document"))


def _bullets(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise("- 无")


def video_summaries(rows: DataFrame) -> DataFrame:
    """One Markdown summary for each video, of title, one_sentence_summary, lists of points, and topics (structs of topic and summary), of which eight are shown."""
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    shown = F.filter(F.slice("topics", 1, 8), lambda t: F.concat(t["topic"], t["summary"]) != "")
    lines = F.transform(shown, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), filled(t["topic"], "主题"), F.lit(" - "), filled(t["summary"], "无")))
    sections = [("核心内容", "core_points"), ("关键依据", "evidence_points"), ("对用户的启示与价值", "insights"), ("可执行建议", "actionable_takeaways"), ("适用边界", "caveats"), ("适合谁看", "best_for")]
    parts = [F.concat(F.lit("# "), filled("title", "视频总结")), F.lit("## 一句话概括"), filled("one_sentence_summary", "暂无")]
    for name, column in sections:
        parts += [F.lit(f"## {name}"), _bullets(F.col(column))]
    parts += [F.lit("## 关键词"), F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("无")]
    parts += [F.when(F.size("topics") > 0, F.concat(F.lit("## 结构线索\n\n"), F.array_join(lines, "\n")))]
    parts += [F.lit("## X Post 文案"), F.lit("### 中文"), filled("x_post_copy_zh", "暂无"), F.lit("### English"), filled("x_post_copy_en", "暂无")]
    return rows.select("video_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("document"))


def copy_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """src, dst and action of a layout (src, dst): copy, keep where both are one, or skip a null source; and what is stale at the target (dst) is deleted, but no source is."""
    plan = files.select("src", "dst", F.when(F.col("src").isNull(), "skip").when(F.col("src") == F.col("dst"), "keep").otherwise("copy").alias("action"))
    wanted = files.select("dst").unionByName(files.filter("src IS NOT NULL").select(F.col("src").alias("dst")))
    stale = existing.join(wanted, "dst", "left_anti").distinct()
    return plan.unionByName(stale.select(F.lit(None).cast("string").alias("src"), "dst", F.lit("delete").alias("action")))


def cut_commands(clips: DataFrame) -> DataFrame:
    """The command that cuts each clip (video_id, path, out, start, duration) afresh, with an exact seek; run_hook() runs them."""
    args = F.array(*[F.lit(a) for a in ("ffmpeg", "-y", "-i")], F.col("path"), F.lit("-ss"), F.format_string("%.3f", "start"), F.lit("-t"), F.format_string("%.3f", "duration"), F.col("out"))
    return clips.select("video_id", "out", args.alias("command"))


def run_hook(commands: DataFrame, hook) -> DataFrame:
    """video_id, out and ok: whether hook(command), called where the row lies, said so."""
    from spanloom.hooks import mapped

    def run(rows: list[dict]) -> list[dict]:
        return [{"video_id": r["video_id"], "out": r["out"], "ok": bool(hook(r["command"]))} for r in rows]

    return mapped(commands, run, "video_id long, out string, ok boolean")


def batch_counts(results: DataFrame) -> DataFrame:
    """How many clips were processed, went well and failed; a missing file counts as failed."""
    return results.groupBy("video_id").agg(
        F.count("*").alias("processed"), F.count_if(F.coalesce("ok", F.lit(False))).alias("successful"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed")
    )


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)))
