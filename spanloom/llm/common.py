"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import new_path, ship

#: Bytes of text that one unit of parallel work should hold.
UNIT_BYTES = 8 << 20
#: Bytes of rows that pass to a Python worker at once.
BATCH_BYTES = "4m"


_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """What a worker process keeps between tasks: the store of the operator that it ran last, and no other, since an executor's workers share its memory."""
    if name not in _KEPT:
        for had in _KEPT.values():
            if isinstance(had, dict):
                had.clear()
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers; and bound what passes to them at once, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it again: this cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files that no table needs any more: it learns that from the driver's garbage collection alone, which may be far off. What Python still held goes a moment after Python lets go."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def units_of(df: DataFrame, text: str = "text", unit_bytes: int = UNIT_BYTES) -> int:
    """How many units of work the texts of a table make, from a count over all rows."""
    total = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.lit(0)).alias("b")).first()["b"]
    return max(1, -(-total // unit_bytes))
