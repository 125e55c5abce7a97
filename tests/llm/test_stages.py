"""Every pipeline stage, and the operators behind, on odd rows: nulls, empties, repeats, ties, equal ids, an empty table and columns with clashing names."""

import corpus_pipeline
import pytest
from conftest import SF

NAMES = ["_key", "_file", "_pos", "_gone", "_n", "_copies", "_bad", "row", "file", "pos", "p", "n_tokens", "copy", "score", "digest", "_metadata"]
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (5, "one  two"), (5, "a text of its own under an id that others have"),
    (None, "one two three four five six"), (6, "ONE two three four five six"), (7, LONG), (8, LONG + " end"), (9, "é" * 60), (9, "é" * 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", 1, *NAMES) for i, t in TEXTS], kind)


def kept(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else 99, (r["text"] or "")[:30], len(r["text"] or "")) for r in df.collect())


def brief(rows):
    return sorted((i if i is not None else 99, (t or "")[:30], len(t or "")) for i, t in rows)


WANT = {
    "toxicity": brief(TEXTS),
    # 2 equals 1; 3 has white space, which is not empty; 5 equals 4; one of the 9s
    "exact_dedup": brief([TEXTS[i] for i in (0, 2, 3, 6, 7, 8, 9, 10, 11)]),
    # no words: 1, 2, 3 stay; 4 and both short 5s; None and 6 are alike and 6 has an id; 7 and 8; one of the 9s
    "near_dedup": brief([TEXTS[i] for i in (0, 1, 2, 3, 6, 8, 9, 11)]),
}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, docs, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    out = stage(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    if name == "packing":
        rows = out.collect()
        assert sorted({r["doc_id"] if r["doc_id"] is not None else 99 for r in rows}) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 99]
        assert sum(r["start"] == 0 for r in rows) == len(TEXTS)
        return
    assert out.columns == docs.columns
    assert {tuple(r[n] for n in NAMES) for r in out.collect()} == {tuple(NAMES)}
    if name in WANT:
        assert kept(out) == WANT[name]
    else:
        assert {r["doc_id"] for r in out.collect()} <= {i for i, _ in TEXTS} and out.count() <= 2 * len(TEXTS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_no_rows(spark, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF).count() == 0
