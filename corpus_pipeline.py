"""The corpus pipeline: stages of training-data operators over documents, each reading the rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from spanloom.llm.common import new_path, prepare, release, table

#: Language-model operators (classifiers, sketches, token packing) that SQL can't express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; the others stay as they are.

    Null and empty texts, and texts without a known term, get the sample's share of toxic rows, and stay where that is under a half. Repeated rows and equal ids are scored each by
    its own text. An empty table stays empty. Other columns are carried, whatever their names."""
    prepare(spark)
    return toxicity.reject(docs, toxicity.learnt(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest id stays: a null id comes last, and the row written first wins a tie.

    A null text counts as empty, and empty texts equal each other. Equal ids with different texts both stay. An empty table stays empty. Other columns are carried, whatever their names."""
    prepare(spark)
    release(spark)  # what the stage before shuffled is written by now
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays: a null id comes last, and the row written first wins a tie.

    Texts that are null or have no words are in no group and stay. Equal ids with texts that aren't near both stay. An empty table stays empty. Other columns are carried, whatever their names."""
    prepare(spark)
    release(spark)  # what the stage before shuffled is written by now
    return near_dedup.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate towards the target weights says, rounded by a hash of its id and text.

    Null and empty texts have no tokens and the domains' shares as their posterior. Repeated rows have equal copies. Without labels each row stays once. An empty table stays empty. Other
    columns are carried, whatever their names."""
    prepare(spark)
    release(spark)  # what the stage before shuffled is written by now
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences; repeated rows and equal ids are documents of their own, and null texts have the closing id alone. Of an empty table there are none."""
    prepare(spark)
    release(spark)  # what the stage before shuffled is written by now
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir.rstrip("/")).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
