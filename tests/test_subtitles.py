"""Subtitle rules, model hooks, scenes and layout on given cases."""

import pytest

from spanloom import hooks
from spanloom.config import Config, analysis_plan, clips_wanted, final_bounds, from_settings
from spanloom.functions import strings
from spanloom.operators import detect, folds, scenes
from spanloom.sources.documents import settings

EN = ["This is the first subtitle line", "Another line is spoken here", "They go on talking about it", "And now the end has come", "Thank you all for watching"]


def frames(texts, region="0.80-0.95", top=0.82):
    return [{"video_id": 1, "region": region, "frame": i, "text": t, "top": top} for i, t in enumerate(texts)]


def test_meta_output_and_drift():
    assert hooks.talks(["此处应为空行"]) and hooks.talks(["NOTE: keep"]) and hooks.talks(["原文第3行"]) and not hooks.talks(["A plain line", "", None])
    assert hooks.drifts(["This is English text", "这是中文"], "zh") and not hooks.drifts(["这是中文", "API"], "zh")
    assert hooks.drifts(["这是中文", "fine"], "en") and not hooks.drifts([], "en") and not hooks.drifts(["", "x"], "fr")


def test_answers_of_models():
    assert strings.json_array('```json\n["a ", "b"]\n```') == ["a", "b"] and strings.json_array('{"translations": ["x"]}') == ["x"]
    assert strings.json_array('Here: ["a"] done') == ["a"] and strings.json_array('["a", 1]') == [] and strings.json_array("") == []
    assert strings.json_object("not json at all") == "{}" and strings.json_object('so {"a": "}", "b": {"c": 1}} and {x}') == '{"a": "}", "b": {"c": 1}}'
    assert strings.json_object('```\n{"k": 1}\n```') == '{"k": 1}' and strings.json_object("{broken") == "{}" and strings.json_object(None) == "{}"
    assert strings.numbered_lines("1. one\n\n2. two", ["a", "b"]) == ["one", "two"] and strings.numbered_lines("1. one", ["a", "b"]) == ["a", "b"]
    assert strings.numbered_lines("v1. one", ["a"]) == ["v1. one"]


def test_halving_ends_at_single_lines():
    asked = []

    def request(texts, to):
        asked.append(len(texts))
        return None if len(texts) > 1 or texts[0] == "bad" else [texts[0].upper()]

    assert hooks.degrading(request, lambda ts, to: [f"g:{t}" for t in ts])(["a", "bad", "c"], "en") == ["A", "g:bad", "C"] and asked == [3, 1, 2, 1, 1]


def test_gate_asks_twice():
    answers = iter(['["only one"]', '["第一", "第二"]'])
    assert hooks.gated(lambda ts, to, n: next(answers), ["a", "b"], "zh") == ["第一", "第二"]
    assert hooks.gated(lambda ts, to, n: '["placeholder", "x"]', ["a", "b"], "en") is None
    assert hooks.gated(lambda ts, to, n: 1 / 0, ["a"], "en") is None


def test_retries_wait_double_and_other_errors_end():
    waits, left = [], [hooks.Retry(), hooks.Retry()]

    def ask():
        if left:
            raise left.pop()
        return "ok"

    assert hooks.attempts(ask, sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(ValueError):
        hooks.attempts(lambda: int("x"), sleep=waits.append)
    with pytest.raises(hooks.Retry):
        hooks.attempts(lambda: (_ for _ in ()).throw(hooks.Retry()), 2, sleep=waits.append)


def test_first_engine_that_works():
    assert hooks.first_engine(lambda a: 1 / 0, lambda a: [{"text": "x"}])(b"") == [{"text": "x"}]
    with pytest.raises(ZeroDivisionError):
        hooks.first_engine(lambda a: 1 / 0)(b"")


def test_backend_by_keys():
    assert [hooks.backend("auto", a, b) for a, b in (("k", "k"), ("", "k"), ("", ""))] == ["siliconflow", "openai", "googletrans"] and hooks.backend("openai", "k", "") == "openai"


def test_chunks_and_english_that_stays():
    seen = []
    up = lambda ts, to: seen.append(len(ts)) or [t.upper() for t in ts]
    assert hooks.translate_all(["这是一句话"] * 30, "en", up) == ["这是一句话"] * 30 and seen == [24, 6]
    seen.clear()
    assert hooks.translate_all(EN, "en", up) == EN and not seen
    hooks.translate_all(["x" * 100] * 10, "zh", up)
    assert max(seen) * 100 <= 800 and hooks.token_budget([10] * 3) == 1024 and hooks.token_budget([400] * 20) == 4096


def test_tracks_have_english_times():
    rows = [{"video_id": 1, "start": 0.0, "end": 8.0, "text": "One line that is rather long, so it has to be cut somewhere near the middle of it"}, {"video_id": 1, "start": 8.0, "end": 9.0, "text": "short words here"}]
    out = hooks.subtitle_tracks(rows, {"en": 42, "zh": 10}, lambda ts, to: list(ts) if to == "en" else ["很长的一句中文字幕，需要再分开来放" for _ in ts])
    by = lambda lang: [(r["start"], r["end"]) for r in out if r["lang"] == lang]
    assert by("zh_aligned") == by("en") and len(by("zh")) > len(by("en")) and all("\n" in r["text"] for r in out if r["lang"] == "zh_aligned")
    assert by("zh")[-1][1] == 9.0


def test_wrapping():
    assert strings.wrap_cjk("今天天气很好，我们去公园散步吧", 12) == "今天天气很好，我们去公园\n散步吧"
    assert strings.wrap_cjk("一二三四五六七，八九十一二三四", 12) == "一二三四五六七，\n八九十一二三四" and strings.wrap_cjk(" ab ", 5) == "ab"
    assert strings.wrap_pixel("one two three", 8, len) == "one two\nthree" and strings.wrap_pixel("一二三四五", 2, len) == "一二\n三四\n五" and strings.wrap_pixel("", 5, len) == ""


def test_repetition():
    assert strings.repeats_itself("This sentence comes again. " * 3) and not strings.repeats_itself("Short. Short. Short.")
    assert strings.repeats_itself("we go on and on we go on and on we go on and on then") and not strings.repeats_itself("each word here is said but once in all of this long line")
    rows = [{"start": float(i), "end": i + 1.0, "text": t, "seq": i} for i, t in enumerate(["hello to all of you", "Again it is said. " * 3, "Again it is said. " * 3, "", "something else now"])]
    out = folds.repetition_zones(rows)
    assert [(r["start"], r["end"], r["text"]) for r in out] == [(0.0, 1.0, "hello to all of you"), (1.0, 3.0, "Again it is said."), (4.0, 5.0, "something else now")]


def test_asr_dedupe_rules():
    rows = [{"start": 295.0, "end": 296.935, "text": "If it were."}, {"start": 295.639, "end": 297.132, "text": "if it WERE"}, {"start": 299.0, "end": 300.0, "text": "If it were."}]
    assert [(r["start"], r["end"]) for r in folds.asr_dedupe(rows)] == [(295.0, 296.935), (299.0, 300.0)]
    long = [{"start": 0.0, "end": 1.0, "text": "same words"}, {"start": 1.5, "end": 2.8, "text": "same words"}]
    assert [(r["start"], r["end"]) for r in folds.asr_dedupe(long)] == [(1.5, 2.8)]


def test_languages():
    assert [detect.status_of(t) for t in ("中文字幕ab", "中ab cd efg", "plain english", "", "123")] == ["zh", "bilingual", "en", "en", "uncertain"]
    assert [detect.dominant(t) for t in ("中a", "中ab", "1")] == ["zh", "en", "uncertain"] and detect.frame_vote(["中文", "english words"]) == "zh" and detect.frame_vote([" "]) == "uncertain"


def test_ocr_status_of_changing_english():
    got = detect.ocr_status(frames(EN), 60.0, 5)
    assert got["status"] == "en" and got["confidence"] >= 0.85 and got["boundary"] == 0.82


def test_ocr_status_of_a_logo_and_of_user_interface():
    assert detect.ocr_status(frames(["MY CHANNEL LOGO"] * 5), 60.0, 5)["status"] == "none"
    busy = ["open the settings panel", "click the button in the toolbar", "install from the terminal", "the sidebar shows a preview", "download from the gallery"]
    assert detect.ocr_status(frames(busy), 60.0, 5)["status"] == "none" and detect.ocr_status([], 60.0, 5)["status"] == "none" and detect.ocr_status(frames(EN), 0, 5)["status"] == "uncertain"


def test_ocr_status_of_chinese_and_bilingual():
    zh = ["今天我们来看看", "这个问题很重要", "大家都知道的", "接下来是重点", "谢谢大家观看"]
    assert detect.ocr_status(frames(zh), 60.0, 5) == {"status": "zh", "lang": "zh", "boundary": 0.82, "confidence": 0.95}
    both = [f"{a}\n{b[:12]}" for a, b in zip(zh, EN, strict=True)]
    assert detect.ocr_status(frames(both), 60.0, 5)["status"] == "bilingual" and detect.ocr_status(frames(both, "0.10-0.30"), 60.0, 5)["status"] in ("uncertain", "zh", "en")
    mixed = [*zh[:4], "Gallery Toolbar Words Everywhere In This Frame"]
    assert detect.ocr_status(frames(mixed), 60.0, 5)["status"] == "zh"


def test_scene_walk_and_key_segments():
    assert [(r["start"], r["end"]) for r in scenes.scene_segments([0.0, 15.0, 35.0, 55.0, 70.0], 15, 30, 6)] == [(0.0, 15.0), (15.0, 35.0), (35.0, 55.0), (55.0, 70.0)]
    climaxes = [{"time": t, "score": s} for t, s in ((10.0, 2.5), (30.0, 2.3), (50.0, 2.1))]
    out = scenes.key_segments(climaxes, [0.0, 15.0, 35.0, 55.0, 70.0], 15, 30, 2)
    assert [(r["start"], r["end"]) for r in out] == [(0.0, 15.0), (15.0, 35.0)] and all(a["end"] <= b["start"] for a, b in zip(out, out[1:], strict=False))
    assert scenes.key_segments([{"time": 100.0, "score": 1.0}], [], 60, 180, 3) == [{"start": 40.0, "end": 160.0, "score": 1.0, "seq": 0}]
    assert scenes.key_segments([], [], 60, 180, 3) == []


def test_sample_timestamps():
    assert scenes.sample_timestamps(100.0, 5) == [5.0, 10.0, 50.0, 90.0, 95.0] and scenes.sample_timestamps(10.0, 4) == [2.0, 4.0, 6.0, 8.0] and len(scenes.sample_timestamps(100.0, 11)) == 11
    assert scenes.sample_timestamps(0, 5) == scenes.sample_timestamps(50, 0) == []


def test_visual_sync():
    asr = [{"start": 0.0, "end": 4.0, "text": "Hello world , again", "words": [{"word": w, "start": float(i), "end": i + 0.5} for i, w in enumerate(["Hello", "world", ",", "again"])]}]
    diffs = [{"video_id": 1, "time": 1.9, "diff": 0.1}]
    assert scenes.visual_sync([], diffs, asr, 4.0) == [{"start": 0.0, "end": 4.0, "text": "Hello world, again"}]
    diffs.append({"video_id": 1, "time": 2.9, "diff": 0.1})
    assert scenes.visual_sync([], diffs, asr, 9.0) == [{"start": 0.0, "end": 2.9, "text": "Hello world,"}, {"start": 2.9, "end": 9.0, "text": "again"}]
    assert scenes.visual_sync([{"start": 0, "end": 1, "text": "soft", "x": 1}], diffs, asr, 4.0) == [{"start": 0, "end": 1, "text": "soft"}]
    assert scenes.visual_sync([], [], asr, None)[0]["text"] == "Hello world , again" and scenes.visual_sync([], diffs, [], 4.0) == []


def test_layout_and_mask():
    sizes = scenes.layout(1080, False, None, 0.8, (56, 56, 15))
    assert sizes == {"en_fontsize": 56, "zh_fontsize": 56, "margin_v_zh": 15, "margin_v_en": 79, "inter_gap": 8}
    assert scenes.layout(1080, False, "en", 0.8, (56, 56, 15))["margin_v_zh"] == 215 + 17 + 4
    box = scenes.mask(1920, 1080, False, 0.803, 18, sizes, [], [])
    assert box["w"] == int(1920 * 0.46) + 2 * 58 and box["x"] == (1920 - box["w"]) // 2 and box["y"] + box["h"] <= 1080 and box["padding_px"] == 18
    at = scenes.anchors(box, 1080, sizes)
    assert at["en_bottom"] < at["zh_bottom"] <= box["y"] + box["h"] and scenes.geometry(0.4, 0.6) and not scenes.geometry(0.02, 0.1) and scenes.geometry(0.0, 0.3)


def test_settings():
    lines = ["# no", "export A='x # y' # z", 'B="q\\"r"', "C = plain # note", "D", "=5", "E=a#b"]
    assert settings(lines, {}) == {"A": "x # y", "B": 'q"r', "C": "plain", "E": "a#b"}
    assert settings(["A=1"], {"A": "2"}) == {"A": "2"} and settings(["A=1"], {"A": "2"}, True) == {"A": "1"}
    c = from_settings({"MAX_CLIPS": "3", "MAX_EN_CHARS": "30,60", "LLM_API_KEY": "secret"})
    assert c.max_clips == 3 and c.max_en_chars == (30, 60) and c.public()["llm_api_key"] == "***" and final_bounds(None, 50, c) == (60.0, 60.0)
    with pytest.raises(ValueError, match="durations"):
        Config(min_duration=100, max_duration=50)
    assert analysis_plan("topic") == (False, False, True) and analysis_plan("?") == (True, True, True) and clips_wanted("x") == 4 and clips_wanted(-3) == 1


def test_hook_runs_where_rows_lie(spark):
    from spanloom.session import ship
    from spanloom.sinks.documents import run_hook

    ship(spark)
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "video_id long, out string, command array<string>")
    assert {r["out"]: r["ok"] for r in run_hook(rows, lambda c: c == ["x"]).collect()} == {"a": True, "b": False}


def test_written_documents_read_back(spark, tmp_path):
    from spanloom.sinks import documents
    from spanloom.sources import srt

    s = spark.createDataFrame([(1, 0, 0.0, 1.5, "one"), (1, 1, 2.0, 3.25, "two\nlines")], "video_id long, seq long, start double, end double, text string")
    documents.write(documents.srt_documents(srt.srt_blocks(s)), str(tmp_path / "srt"), "document")
    back = srt.scan_srt(spark.read.text(str(tmp_path / "srt"), wholetext=True).filter("length(value) > 0")).collect()
    assert [(r["start"], r["end"], r["text"]) for r in sorted(back)] == [(0.0, 1.5, "one"), (2.0, 3.25, "two lines")]
    ass = documents.ass_documents(s, "Arial", 1920, 1080).first()["document"]
    assert "PlayResX: 1920" in ass and ass.endswith("Dialogue: 0,0:00:02.00,0:00:03.25,Default,,0,0,0,,two\\Nlines")


def test_sessions_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanloom.streaming import folds as stream

    rows = spark.createDataFrame([(1, 0.0, 1.0, 0), (1, 1.0, 2.0, 60), (1, 9.0, 9.5, 4000), (2, 0.0, 1.0, 100_000)], "video_id long, start double, end double, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    stream.drained(stream.sessions, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0.0, 2.0, 2), (1, 9.0, 9.5, 1)]


def test_windows_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanloom.streaming import folds as stream

    rows = [(1, 0.0, 1.0, 10), (1, 1.0, 2.0, 60), (1, 9.0, 9.5, 70), (2, 0.0, 1.0, 100_000)]
    df = spark.createDataFrame(rows, "video_id long, start double, end double, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream.drained(stream.merge_windows, source(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(1, 0.0, 2.0), (1, 9.0, 9.5)]
    stream.drained(stream.merge_windows, source(), str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new: nothing twice
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got
