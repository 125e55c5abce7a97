"""What a stage leaves on disk while the next ones run: no tables that its result doesn't read, and no shuffle files."""

import os
import time

import corpus_pipeline
from conftest import SF
from spanloom.llm import near_dedup
from spanloom.session import shared_dir

WORDS = [f"word{i}" for i in range(400)]
#: Rows 0 to 39 are near copies of each other, 40 to 59 equal copies, the others alone.
TEXTS = [" ".join(WORDS[:200] + [f"end{i}"]) for i in range(40)] + [" ".join(WORDS[200:300])] * 20 + [" ".join(f"{w}x{i}" for w in WORDS[:50]) for i in range(20)]


def labels(spark, before):
    return sorted(name.rpartition("-")[0] for name in set(os.listdir(shared_dir(spark))) - before)


def test_near_dedup_leaves_what_its_result_reads(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    before = set(os.listdir(shared_dir(spark)))
    out = near_dedup.first_of_groups(docs)
    assert labels(spark, before) == ["near-members", "near-rows"]
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 40, *range(60, 80)]
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 40, *range(60, 80)]
    before = set(os.listdir(shared_dir(spark)))
    rows = near_dedup.group_rows(docs)
    assert labels(spark, before) == ["near-edges", "near-sketches"]
    want = {i: 0 if i < 40 else 40 if i < 60 else i for i in range(80)}
    assert {r["doc_id"]: r["component_id"] for r in rows.collect()} == want


def test_a_stage_begins_without_the_shuffle_files_of_the_one_before(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = manager.getAllFiles()
        found = (files.apply(i).getPath() for i in range(files.size()))
        return {f for f in found if f.endswith(".data") and os.path.exists(f)}

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, following in (("exact_dedup", "near_dedup"), ("near_dedup", "mixing"), ("exact_dedup", "packing"), ("packing", "exact_dedup")):
        before, path = held(), str(tmp_path / f"{name}-{following}")
        out = stages[name](spark, docs, SF)
        out.write.parquet(path)
        del out
        made = held() - before
        assert made, name
        stages[following](spark, spark.read.parquet(path) if name != "packing" else docs, SF)
        for _ in range(20):
            if not made & held():
                break
            time.sleep(0.25)
        assert not made & held(), (name, following)
