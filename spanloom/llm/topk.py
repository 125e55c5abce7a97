"""Exact top-k inner products by pivot-table elimination.

Inner products become distances: a candidate x gets one more component sqrt(R^2 - |x|^2), R being the greatest
norm, and a query gets 0 there, so that d^2 = |q|^2 + R^2 - 2 q.x. Distances of every candidate to PIVOTS candidates are computed once.
For a query, the greatest |d(q, pivot) - d(x, pivot)| is a lower bound of d(q, x), hence an upper bound of the score. Candidates
are scored exactly in the order of their bounds, in slices, until the k-th best score is above every bound that is left. As the pivots are candidates themselves, every block
starts from the k-th best score among them, however its own candidates turn out.

Candidates and queries are dealt to blocks of bounded size, and each block of queries meets each block of candidates in a task of its own;
the blocks' best k are merged by rank. Both numbers of blocks grow with the table.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor do those with a null id or
another length than most vectors' (the smaller one on a tie); of rows with equal id and vector, each is a candidate, except to queries with
that id; of several vectors of one query id the least asks, once; a query with fewer candidates than k returns all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table

PIVOTS, SLICE = 32, 2048
#: Rows of a block of queries and of candidates, at most about.
QUERY_BLOCK, ROW_BLOCK = 512, 8192


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the floor of 64 times each component."""
    x = F.col("embedding").cast("array<double>")
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 64.0)).alias("v"))


def _matrix(batch: pa.Table | pa.RecordBatch) -> np.ndarray:
    col = batch.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, radius: float, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query within one block."""
    out, n = [], len(ids)
    lifted = np.c_[q, np.zeros(len(q))]
    dq = np.sqrt(np.maximum(0, ((lifted[:, None] - pivots[None]) ** 2).sum(-1))).astype(np.float32)
    reach = (q * q).sum(1) + radius**2
    slack = 1e-3 * np.maximum(1.0, np.sqrt(reach))  # of distances in single precision
    known = q @ pivots[:, :-1].T  # scores of candidates that some block holds
    for i, query in enumerate(query_ids):
        low = np.zeros(n, np.float32)
        for p in range(len(pivots)):
            np.maximum(low, np.abs(dx[p] - dq[i, p]), out=low)
        bound = np.floor((reach[i] - np.maximum(0, low.astype(np.float64) - slack[i]) ** 2) / 2 + 1e-6)
        other = np.sort(known[i][pivot_ids != query])
        sure = other[-k] if len(other) >= k else -np.inf
        order = np.argsort(-bound)
        order = order[: np.searchsorted(-bound[order], -sure, side="right")]
        got_ids, got = np.empty(0, np.int64), np.empty(0, np.float64)
        for s in range(0, len(order), SLICE):
            part = order[s : s + SLICE]
            if len(got) >= k and bound[part[0]] < got[k - 1]:
                break
            part = part[ids[part] != query]
            got, got_ids = np.r_[got, x[part] @ q[i]], np.r_[got_ids, ids[part]]
            if len(got) > k:
                kth = np.partition(got, len(got) - k)[len(got) - k]
                near = np.flatnonzero(got >= kth)
                got, got_ids = got[near], got_ids[near]
            best = np.lexsort((got_ids, -got))[:k]
            got, got_ids = got[best], got_ids[best]
        out += [(int(query), int(c), int(s)) for c, s in zip(got_ids, got, strict=True)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; both tables have vec_id and v."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score long"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, total = sizes[0]["d"], sizes[0]["n"]
    vectors, queries = vectors.filter(F.size("v") == dim), queries.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    radius = float(vectors.agg(F.max(norm)).first()[0]) ** 0.5
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()  # PIVOTS rows
    p, pivot_ids = np.array([r["v"] for r in chosen], dtype=np.float64).reshape(len(chosen), dim), np.array([r["vec_id"] for r in chosen])
    p = np.c_[p, np.sqrt(np.maximum(0, radius**2 - (p * p).sum(1)))]
    nx = max(1, -(-total // row_block))
    nq = max(1, -(-queries.count() // query_block))
    # each candidate's distances to the pivots, computed once, before queries come in
    tabled = vectors.mapInArrow(_table(p, radius), "vec_id long, v array<long>, d array<float>")
    tabled = tabled.withColumn("xb", F.pmod(F.xxhash64("vec_id"), F.lit(nx)))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(nq)))
    left = asked.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("xb", F.col("xb").cast("long"))
    right = tabled.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("qb", F.col("qb").cast("long"))
    both = left.select("qb", "xb", "vec_id", "v", F.lit(None).cast("array<float>").alias("d"), F.lit(True).alias("asks")).unionByName(
        right.select("qb", "xb", "vec_id", "v", "d", F.lit(False).alias("asks"))
    )

    def run(t: pa.Table) -> pa.Table:
        rows = []
        asks = t["asks"].to_numpy()
        q, x = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        if len(q) and len(x):
            d = x["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            rows = _best(q["vec_id"].to_numpy(), _matrix(q), x["vec_id"].to_numpy(), _matrix(x), np.ascontiguousarray(d.T), p, pivot_ids, radius, k)
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = both.groupBy("qb", "xb").applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _table(pivots: np.ndarray, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            lifted = np.c_[x, np.sqrt(np.maximum(0, radius**2 - (x * x).sum(1)))]
            square = (lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * lifted @ pivots.T
            d = np.sqrt(np.maximum(0, square)).astype(np.float32)
            d = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], d], names=["vec_id", "v", "d"])

    return run


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantised(table(spark, sf_dir, "embeddings")), "topk-vectors")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
