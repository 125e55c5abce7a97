import random

from spanloom.operators import folds


def seg(start, end, text="", seq=0, **more):
    return {"video_id": 1, "seq": seq, "start": start, "end": end, "text": text, **more}


def test_split_long_at_boundaries():
    assert folds.split_long(seg(0, 130), [42.0, 88.0, 130.0], 15, 60, 37.5) == [(0, 42.0), (42.0, 88.0), (88.0, 130)]


def test_split_long_without_boundaries_stays_in_bounds():
    out = folds.split_long(seg(0, 95), [], 30, 60, 45)
    assert out[0][0] == 0 and out[-1][1] == 95 and all(30 <= b - a <= 60 for a, b in out)


def test_pad_edges_snaps_right_then_left():
    out = folds.pad_edges([seg(0.0, 88.8), seg(182.7, 378.0)], [88.8, 121.4, 140.0], 120.0)
    assert out[0]["end"] == 121.4
    out = folds.pad_edges([seg(363.1, 480.3), seg(548.3, 607.5)], [480.3, 488.7, 507.0], 120.0)
    assert (out[1]["start"], round(out[1]["end"], 1)) == (488.7, 608.7)


def test_asr_dedupe_keeps_longer():
    rows = [seg(295.0, 296.935, "You can go."), seg(295.639, 297.132, "You can go."), seg(298.0, 299.0, "If it were.")]
    assert [r["text"] for r in folds.asr_dedupe(rows)] == ["You can go.", "If it were."]


def test_chunk_pack_counts():
    sizes = lambda texts, budget, cap: [
        sum(r["chunk"] == c for r in folds.chunk_pack([seg(0, 1, t, i) for i, t in enumerate(texts)], budget, cap)) for c in range(5)
    ]
    assert sizes(["abcd"] * 5, 10, 99)[:3] == [2, 2, 1]
    assert sizes(["abcd"] * 5, 99, 2)[:3] == [2, 2, 1]
    assert sizes(["x" * 100] * 10, 850, 99)[:2] == [8, 2]


def test_split_text_keeps_words_and_span():
    row = seg(1.0, 9.0, "this is a long line, that has to be cut into several parts of some length")
    out = folds.split_text(row, 42)
    assert " ".join(p["text"] for p in out) == row["text"] and out[-1]["end"] == 9.0 and all(len(p["text"]) <= 42 for p in out)


def test_change_points_start_and_end_with_the_video():
    rows = [{"video_id": 1, "time": t, "diff": d} for t, d in ((0.2, 0.5), (0.3, 0.5), (0.5, 0.5), (0.8, 0.9), (1.0, 0.0151), (1.2, 0.3), (1.5, 0.3))]
    assert [r["time"] for r in folds.change_points(rows, 2.0)] == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert [r["time"] for r in folds.change_points([], 2.0)] == [0.0, 2.0]


def test_split_text_on_given_cases():
    long = "This is a fairly long subtitle line, which goes on and on without any end in sight"
    out = folds.split_text(seg(0.0, 6.0, long), 42)
    assert [p["text"] for p in out] == ["This is a fairly long subtitle line,", "which goes on and on without any end in", "sight"]
    assert out[0]["start"] == 0.0 and out[-1]["end"] == 6.0 and all(p["end"] > p["start"] for p in out)
    assert folds.split_text(seg(3.0, 3.0, long), 42)[0]["end"] == 3.05
    zh = "今天我们来看一看这个问题，它其实没有那么简单，需要慢慢说"
    out = folds.split_text(seg(0.0, 4.0, zh), 22, "zh")
    assert "".join(p["text"] for p in out) == zh and all(len(p["text"]) <= 22 for p in out) and out[0]["text"].endswith("，")
    assert folds.split_text(seg(0.0, 1.0, "short", n=7), 42) == [seg(0.0, 1.0, "short", n=7)]


def test_greedy_never_overlaps():
    rng = random.Random(3)
    rows = [seg(a := rng.randint(0, 90), a + rng.randint(1, 20), seq=i, score=float(rng.randint(0, 9))) for i in range(60)]
    out = folds.greedy_select(rows, 6)
    assert all(x["end"] <= y["start"] for x, y in zip(out, out[1:], strict=False))


def test_peaks_take_plateau_middle_and_distance():
    rows = [{"video_id": 1, "time": float(i), "value": v} for i, v in enumerate([0, 2, 2, 2, 0, 3, 0, 0])]
    assert [p["time"] for p in folds.find_peaks(rows, 1.0, 2.0, 5)] == [2.0, 5.0]
    assert [p["time"] for p in folds.find_peaks(rows, 1.0, 4.0, 5)] == [5.0]
