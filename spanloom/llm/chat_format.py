"""Chat formatting with every participant's perspective, in DataFrame operations only.

For each speaker of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; the masks are the character ranges [start, end) of what the assistant says, with its closing mark, to be trained on. System
turns are context: they are rendered as such and take no perspective.

A conversation is cut into chunks of CHUNK turns. Ranks come from a range partitioning of the turns: a turn's rank is its place within its
partition and conversation plus the number of the conversation's turns in earlier partitions. So a conversation of any length is neither
sorted nor gathered in one task; only a chunk is. The partitioned turns are written once, and all that follows reads them: computed twice, their bounds could differ.

Defined cases: turns with equal numbers are ordered by role and text; repeated rows are all rendered; a null role is
the speaker "unknown"; a null text is empty; null conversation ids form one conversation, null turns come first; the marks' opening "<|" is broken up
where a text holds it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table

CHUNK = 64
SYSTEM = "system"


def _ranked(turns: DataFrame) -> DataFrame:
    key = ["conv_id", "turn", "role", "text"]
    dealt = stored(turns.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "chat-turns")
    local = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    sizes = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(F.col("part").alias("p2"), F.col("conv_id").alias("c2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = dealt.withColumn("place", F.row_number().over(local))
    return placed.join(earlier, (F.col("part") == F.col("p2")) & F.col("conv_id").eqNullSafe(F.col("c2"))).withColumn(
        "rank", F.col("place") + F.col("before") - 1
    )


def perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, text, mask_starts and mask_ends."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    chunks = (
        _ranked(clean).withColumn("chunk", F.floor(F.col("rank") / chunk))
        .groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    )
    people = clean.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c3"), F.col("role").alias("perspective")).distinct()
    both = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("c3")))

    def part(t):
        head = (
            F.when(t["role"] == F.col("perspective"), F.lit("<|im_start|>assistant\n"))
            .when(t["role"] == SYSTEM, F.lit("<|im_start|>system\n"))
            .otherwise(F.concat(F.lit("<|im_start|>user name="), t["role"], F.lit("\n")))
        )
        body = F.concat(t["text"], F.lit("<|im_end|>"))
        return F.struct(head.alias("head"), body.alias("body"), (t["role"] == F.col("perspective")).alias("own"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.when(p["own"], F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(acc["none"])
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"), acc["none"].alias("none"))

    none = F.array().cast("array<struct<s:int,e:int>>")
    parts = both.withColumn("parts", F.transform("turns", part))
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"), none.alias("none"))
    spans = parts.withColumn("spans", F.aggregate("parts", zero, step, lambda a: a["spans"]))
    return spans.select(
        "conv_id", "perspective", F.col("chunk").cast("long").alias("chunk"), F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.col("spans.s").cast("array<bigint>").alias("mask_starts"), F.col("spans.e").cast("array<bigint>").alias("mask_ends"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("conv_id", "perspective", "chunk", "n_turns", "text", joined("mask_starts"), joined("mask_ends"))


OP2_SQL = rf"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank FROM clean),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM clean WHERE role <> '{SYSTEM}'),
parts AS (
  SELECT r.conv_id, p.perspective, r.rank // {CHUNK} AS chunk, r.rank, r.role = p.perspective AS own,
         CASE WHEN r.role = p.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN r.role = '{SYSTEM}' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || r.role || chr(10) END AS head,
         r.text || '<|im_end|>' AS body
  FROM ranked r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY rank)
            - length(body) - 1 AS s FROM parts)
SELECT conv_id, perspective, chunk, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE own), '') AS mask_starts,
       coalesce(string_agg(CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE own), '') AS mask_ends
FROM placed GROUP BY conv_id, perspective, chunk
"""
