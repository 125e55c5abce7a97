"""Every sampled example is found by all of its terms, not by those that tell the labels apart alone."""

import pytest
from spanloom.llm import toxicity
from spanloom.llm.common import prepare


@pytest.fixture(scope="module")
def index(spark):
    prepare(spark)
    rows = [(i, f"plain words of row{chr(97 + i)} and others{chr(97 + i)}") for i in range(20)]
    rows += [(100, "zyqqo wrumpf gnarlik"), (101, "same eight words begin each of these rows quux"), (102, "same eight words begin each of these rows blorp")]
    labels = [(i, 0) for i in range(20)] + [(100, 1), (101, 1), (102, 1)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_an_example_of_rare_terms_is_the_evidence_for_its_copy(index):
    near = index.score("zyqqo wrumpf gnarlik")[1]
    assert near[0][:2] == (100, 1) and near[0][2] == pytest.approx(1)


def test_rows_that_begin_alike_are_all_examples(index):
    assert {101, 102} <= set(index.ids) and len(index.ids) == 23
    assert index.score("blorp")[1][0][0] == 102
