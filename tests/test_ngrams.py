"""ngram_repetition: odd texts against its SQL, and a text that is split once."""

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.plans import subtitles
from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import queries

TEXTS = ["", " ", "a b", " a  b\tc ", "A b C a B c", "a\x0bb c d", "a b c d e", "\r\na\fb\n\nc\nd\r", None, "one", "x x x x x", "\x0ba b", "中 文 字 中 文 字"]


@pytest.mark.parametrize("held", [1 << 20, 20, -1])
def test_odd_texts_against_sql(agree, tmp_path, monkeypatch, held):
    monkeypatch.setattr(subtitles, "_HELD", held, raising=False)
    rows = [(f"c{k % 5}" if k % 7 else None, k, "user", t) for k, t in enumerate([*TEXTS, *TEXTS[::-1]])]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet", index=False)
    agree(queries()["ngram_repetition"], ORACLES["ngram_repetition"], str(tmp_path))


def test_runs_of_words(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.ngrams(F.col("t"), 3).alias("g")).collect()
    for t, g in got:
        words = [w for w in (t or "").lower().translate(dict.fromkeys(map(ord, "\t\n\f\r"), " ")).split(" ") if w]
        assert g == [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]


def test_no_lambda_splits_the_text_again(spark):
    """Each run would cost a split of its whole text, and a turn the square of its words."""
    plan = _plan(spark.createDataFrame([("a b c d",)], "t string").select(F.explode(text.ngrams(F.col("t"), 3))))
    assert plan.count("split(") == plan.count("lower(") == 1


def test_texts_travel_instead_of_ngrams(spark):
    """Each conversation's list is made once; only the branch of long conversations deals n-grams out, and it splits once too."""
    plan = _plan(queries()["ngram_repetition"](spark, SF))
    assert plan.count("split(") == plan.count("lower(") == 2 and plan.count("collect_list(") == 1 and plan.count("explode(") == 1


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()
