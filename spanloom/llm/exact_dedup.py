"""Exact deduplication by a keyed stream.

The documents pass once through Structured Streaming. Its keyed state, held on disk by RocksDB without
expiry, retains for each digest the row that stays (stable identifier), where that row lies (content
locator: file and row number) and how many rows had the digest. A digest that was hit more than once is
then checked on the full bytes: the least and the greatest text under a digest must be the same. Both are
combined on the map side, so a group of any size moves one text per task. If texts differ under one digest,
their rows are grouped by the texts themselves.

Only DataFrame operations run here.

Defined cases: a null text counts as empty; empty texts equal each other; of rows with equal text and equal
doc_id, the first by file and row number stays; a null doc_id comes after all others; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import new_path, stored
from spanloom.session import unused

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each of many small stores sets megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: The byte check reads texts whose digest begins as a hit's does; beginnings of so many bits are broadcast, hence 2^20 rows at most.
BEGIN_BITS = 20
#: A group is hot above this share of all rows; hence at most 1 / share groups are hot, which bounds their broadcast.
HOT_SHARE = 1e-4


def normalised(text: Column) -> Column:
    """One space for each run of ASCII white space. Runs that already are one space need no match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(df: DataFrame, digest) -> DataFrame:
    """doc_id, norm, digest and where each row lies; df must read files."""
    meta = F.col("_metadata")
    return df.select(
        "doc_id", normalised(F.col("text")).alias("norm"), meta["file_path"].alias("file"), meta["row_index"].alias("pos")
    ).withColumn("digest", digest(F.col("norm")))


def _first(group: str = "") -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "pos")).alias("first")


def _pattern(path: str) -> str:
    """A pattern that matches a path alone: its own pattern marks are escaped, and its last plain character stands in brackets."""
    marks = "\\*?[]{},"
    at = max(i for i, c in enumerate(path) if c not in marks + "/^-")
    return "".join(f"[{c}]" if i == at else f"\\{c}" if c in marks else c for i, c in enumerate(path))


def stream_state(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """digest, first, n: the final state after every file under path has passed through the stream."""
    held = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # as a pattern, since a stream takes a folder or a pattern, but no single file
        state = _rows(reader.parquet(_pattern(path)), digest).groupBy("digest").agg(_first(), F.count("*").alias("n"))
        out, seen = new_path(spark, "dedup-state"), []

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
            seen.append(f"{out}/batch-{number}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", new_path(spark, "dedup-stream"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not seen:
        return spark.createDataFrame([], state.schema)
    last = spark.read.schema(state.schema).parquet(*dict.fromkeys(seen))
    # a later batch holds an earlier first row, if any, and a larger count
    return last if len(set(seen)) == 1 else last.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def _skew_join(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Join rows to their group's row; groups above the hot share are broadcast, so none floods a task."""
    least = max(1000, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) > least)
    keys = F.broadcast(hot.select(on))
    warm = rows.join(F.broadcast(hot), on)
    return warm.unionByName(rows.join(keys, on, "left_anti").join(groups.filter(F.col(size) <= least), on))


def dedup_files(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """For each row under path: doc_id, file, pos, keep_id, group_size, kept and the digest of its normalised text."""
    state = stream_state(spark, path, digest, files_per_batch)
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = _rows(spark.read.schema(spark.read.parquet(path).select("doc_id", "text").schema).parquet(path), digest)
    groups = state.select("digest", "first", F.col("n").alias("group_size"))
    begin = F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - BEGIN_BITS).alias("begin")
    begins = groups.filter("group_size > 1").select(begin).distinct()
    checked = rows.select("digest", "norm", begin).join(F.broadcast(begins), "begin", "left_semi")
    clash = stored(
        checked.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest"),
        "dedup-clash",
    )
    slim = rows.select("digest", "doc_id", "file", "pos", sha256(F.col("norm")).alias("text_sha256"))
    if clash.isEmpty():
        joined = _skew_join(slim, groups, "digest", "group_size", total)
    else:
        full = rows.withColumn("text_sha256", sha256(F.col("norm"))).join(clash, "digest", "left_semi")
        own = full.groupBy("digest", "norm").agg(_first(), F.count("*").alias("group_size"))
        joined = _skew_join(slim.join(clash, "digest", "left_anti"), groups, "digest", "group_size", total).unionByName(
            full.join(own, ["digest", "norm"]).drop("norm")
        )
    return joined.select(
        "doc_id", "file", "pos", F.col("first.doc_id").alias("keep_id"), "group_size",
        ((F.col("first.file") == F.col("file")) & (F.col("first.pos") == F.col("pos"))).alias("kept"), "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. The rows land in the shared folder first, which gives each a locator."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "dedup-land")
    docs.write.parquet(path)
    file, pos = unused(docs.columns, "file", "pos")
    stay = dedup_files(spark, path).filter("kept").select(F.col("file").alias(file), F.col("pos").alias(pos))
    landed = spark.read.schema(docs.schema).parquet(path)
    at = landed.metadataColumn("_metadata")
    landed = landed.select("*", at["file_path"].alias(file), at["row_index"].alias(pos))
    return landed.join(stay, [file, pos], "left_semi").drop(file, pos)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_files(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256"
    )


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
