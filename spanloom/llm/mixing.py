"""Mixing to target weights by soft membership.

A classifier learnt from the labelled table gives every document a posterior p over domains. Each document then gets a rate r >= 0, the number of copies
it is to have on average, so that the domains' expected token totals match the targets. With T the tokens of all documents, n a document's tokens and G the goals, the rates minimise

    1/2 sum over domains ((sum of n r p) / T - G / T)^2  +  PULL/2 (sum of n (r - 1)^2) / T,     0 <= r <= MOST.

The least squares alone would feed a domain that the documents hardly have from the few that look like it, at any rate; the pull of each rate to 1, weighted by tokens, leaves
such a domain unmet instead, and MOST bounds a single document's copies.
The fit is a projected gradient that projects lazily: with y the summed gradients (one number for each domain), a rate is 1 + p . y, cut to its bounds. A step takes sums over all
documents: the domains' totals and the Gram matrix of the documents whose rate isn't at a bound, in whose metric the step is taken, halved while the objective's dual doesn't fall. The
driver sees these K and K x K numbers only, and nothing is kept for each document between steps. A domain that ends within NEAR of its goal is in reach: its goal is then moved by what
the pull made it miss, and the fit goes on, at most MOVES times, as such a goal may be out of reach by a little; what domains miss in the end is reported.

Before the fit, a goal above MOST times the tokens that a domain has at all is cut to that, its weight going to the other domains.

Domains come from the labels: "toxic", "low" (quality 0) and "high". Posteriors are naive Bayes over hashed word and shape features (a shape is cut after 12 letters), tempered by length.

Defined cases: a null text counts as empty and has the domains' shares as its posterior and no tokens; null labels are ignored, of several labels of one row
the worst counts; without labels every document belongs to "high"; repeated rows are documents of their own, and rows with equal ids and texts have equal copies; rows with equal ids and other texts have their
own; an empty table gives an empty result; other columns are carried by mix(), whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import kept, stored, table
from spanloom.session import unused

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.96, "low": 0.03, "toxic": 0.01}
#: Bounds of what the classifier is learnt from, and of its size.
EXAMPLES, FEATURES = 8192, 1 << 15
#: Weight of the pull to one copy, the greatest rate, and how far from its goal (as a share of it) a domain in reach may end before its goal is moved.
PULL, MOST, NEAR = 1e-3, 16.0, 0.25
#: Passes over all documents at most; the gradient at which a fit has converged, and the share of all tokens within which a domain is met.
STEPS, CLOSE, MET, MOVES = 60, 1e-9, 1e-6, 6
#: Distinct words whose features a worker process keeps.
STORE = 300_000
SHAPES = str.maketrans({**dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("0123456789", "0")})
RUNS = re.compile(r"(.)\1+")
_FEATURES: dict[bytes, int] = {}


def features_of(word: str) -> tuple[int, int]:
    """The hashed features of a word: itself in lower case, and its shape."""
    shape = RUNS.sub(r"\1", word.translate(SHAPES))[:12]
    return zlib.crc32(word.lower().encode()) % FEATURES, zlib.crc32(b"\0" + shape.encode()) % FEATURES


def _code(word: bytes) -> int:
    """Both features of a word in one number. A worker process keeps those of the words it met."""
    own, shape = features_of(word.decode())
    if len(word) <= 256:
        if len(_FEATURES) >= STORE:
            _FEATURES.clear()
        _FEATURES[word] = own * FEATURES + shape
    return own * FEATURES + shape


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of words, as numbers of words and of shapes."""
    found = list(map(_FEATURES.get, words))
    if None in found:
        found = [_code(w) if c is None else c for w, c in zip(words, found, strict=True)]
    return np.divmod(np.array(found, np.int64), FEATURES)


def _keep() -> None:
    kept("mixing", lambda: _FEATURES)


def _words(text: str | None) -> tuple[list[bytes], int]:
    """The distinct words of a text in UTF-8, which bytes split at just the six ASCII spaces, and the number of all words."""
    words = (text or "").encode().split()
    return list(dict.fromkeys(words)), len(words)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the domains and log rates of the features in each, from a bounded sample of labelled rows."""
    worst = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), worst.alias("d")).filter("doc_id IS NOT NULL AND d IS NOT NULL")
    sample = stored(rows.groupBy("doc_id").agg(F.max("d").alias("d")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "mix-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep()
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for d, text in zip(batch["d"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sums[d, -1] += 1
                for f in np.concatenate(_features(_words(text)[0])).tolist():
                    sums[d, f] += 1
        ds, fs = zip(*sums, strict=True) if sums else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int32()), pa.array(fs, pa.int32()), pa.array(sums.values(), pa.int64())], names=["d", "f", "n"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("d", "text")
    sums = got.mapInArrow(count, "d int, f int, n long").groupBy("d", "f").agg(F.sum("n").alias("n")).toArrow()  # at most K x FEATURES rows
    d, f, n = (sums[c].to_numpy() for c in ("d", "f", "n"))
    share, rate = np.zeros(len(DOMAINS)), np.full((FEATURES, len(DOMAINS)), 0.5)
    share[d[f < 0]] = n[f < 0]
    rate[f[f >= 0], d[f >= 0]] += n[f >= 0]
    if not share.any():
        share[0] = 1
    with np.errstate(divide="ignore"):
        return np.log(share / share.sum()), np.log(rate / rate.sum(0))


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], names: tuple[str, str] = ("n_tokens", "p"), keep_text: bool = False) -> DataFrame:
    """The rows of docs with two more columns: the number of words, and the posterior over DOMAINS. The text itself goes unless keep_text."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep()
        share, rate = held.value
        for batch in batches:
            n, p = [], []
            for text in batch.column(at).to_pylist():
                words, total = _words(text)
                x = share.copy()
                if words:  # tempered: words of one text aren't independent
                    own, shape = _features(words)
                    x = x + (rate[own].sum(0) + rate[shape].sum(0)) * (min(1.0, 8.0 / (2 * len(words)) ** 0.5))
                e = np.exp(x - x.max())
                n.append(total)
                p.append((e / e.sum()).tolist())
            cols = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*(batch.schema.names[i] for i in kept), *names])

    schema = T.StructType([docs.schema.fields[i] for i in kept]).add(names[0], "long").add(names[1], T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema)


def _dot(p: Column, y: np.ndarray) -> Column:
    return sum((p[k] * float(y[k]) for k in range(len(DOMAINS))), F.lit(0.0))


def rate_of(p: Column, y: np.ndarray) -> Column:
    """1 + p . y, cut to 0 and MOST."""
    return F.greatest(F.lit(0.0), F.least(F.lit(MOST), 1.0 + _dot(p, y)))


@dataclass
class Fit:
    """The steps' sum, the domains' goals and totals as shares of all tokens, whether the fit converged, and its passes over all documents."""

    y: np.ndarray
    goal: np.ndarray
    have: np.ndarray
    converged: bool
    passes: int

    def missing(self) -> dict[str, float]:
        """What each domain lacks (or, if negative, has too much) of its goal, as a share of all tokens; a goal is the target given, if there is no supply too."""
        return dict(zip(DOMAINS, (self.goal - self.have).tolist(), strict=True))


def goals(mass: np.ndarray, targets: dict[str, float], budget: float) -> tuple[np.ndarray, np.ndarray]:
    """The wanted shares, and those cut to MOST times what a domain has, the rest going to the others by weight."""
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    if not weight.sum() > 0:
        return mass, mass
    wanted, most = budget * weight / weight.sum(), MOST * mass
    goal, free = wanted.copy(), np.ones(len(DOMAINS), bool)
    for _ in DOMAINS:
        free &= goal < most
        left = budget - most[~free].sum()
        goal = np.where(free, 0.0, most)
        if free.any() and weight[free].sum() > 0:
            goal[free] = left * weight[free] / weight[free].sum()
    return wanted, np.minimum(goal, most)


def solve(members: DataFrame, targets: dict[str, float], budget: float = 1.0, names: tuple[str, str] = ("n_tokens", "p")) -> Fit:
    """Fit rates whose expected totals are the targets' shares of budget times all tokens."""
    k, n, p = len(DOMAINS), F.col(names[0]).cast("double"), F.col(names[1])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    passes = 0

    def at(y: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, Gram matrix of the rates within their bounds, and the sum of the rates' integral."""
        nonlocal passes
        passes += 1
        x, r = 1.0 + _dot(p, y), rate_of(p, y)
        inner = F.when((x > 0) & (x < MOST), n).otherwise(0.0)
        whole = n * F.when(x <= 0, 0.0).when(x >= MOST, MOST * x - MOST * MOST / 2).otherwise(x * x / 2)
        sums = members.agg(
            *[F.coalesce(F.sum(n * r * p[i]), F.lit(0.0)) for i in range(k)],
            *[F.coalesce(F.sum(inner * p[i] * p[j]), F.lit(0.0)) for i, j in pairs],
            F.coalesce(F.sum(whole), F.lit(0.0)),
        ).first()
        gram = np.zeros((k, k))
        for v, (i, j) in enumerate(pairs):
            gram[i, j] = gram[j, i] = sums[k + v]
        return np.array(sums[:k]) / total, gram / total, sums[-1] / total

    y = np.zeros(k)
    have, gram, whole = at(y, 1.0)
    total = have.sum()  # every rate is 1
    if not total > 0:
        return Fit(y, np.zeros(k), np.zeros(k), True, passes)
    have, gram, whole = have / total, gram / total, whole / total
    wanted, goal = goals(have, targets, budget)
    aim, converged, moves = goal.copy(), False, 0
    while passes < STEPS:
        slope = have - aim + PULL * y
        if np.abs(slope).max() <= CLOSE:
            miss = goal - have
            move = np.where((np.abs(miss) <= NEAR * goal) & (np.abs(miss) > MET), miss, 0.0)
            if not move.any() or moves == MOVES:
                converged = True
                break
            aim, moves = aim + move, moves + 1
            continue
        step = -np.linalg.solve(gram + PULL * np.eye(k), slope)
        dual, size = whole - aim @ y + PULL / 2 * (y @ y), 1.0
        while passes < STEPS:
            new = y + size * step
            have2, gram2, whole2 = at(new, total)
            if whole2 - aim @ new + PULL / 2 * (new @ new) <= dual + 1e-4 * size * (slope @ step) + 1e-13 or size < 1e-6:
                break
            size /= 2
        y, have, gram, whole = new, have2, gram2, whole2
    return Fit(y, wanted, have, converged, passes)


def copies_of(rate: Column, *row: Column) -> Column:
    """The rate rounded up or down, by a hash of the row, to keep its mean."""
    draw = F.pmod(F.xxhash64(*row, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """doc_id, h (hash of the text), n_tokens, p, rate and copies; and, equal in all rows, missed (the domains' goals that aren't met, as shares of all tokens) and converged."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    members = stored(posteriors(slim, fit(docs, labels)), "mix-members")
    found = solve(members, targets, budget)
    rated = members.withColumn("rate", rate_of(F.col("p"), found.y))
    missed = F.array(*[F.lit(float(v)) for v in found.missing().values()])
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), F.col("h"))).withColumn("missed", missed).withColumn("converged", F.lit(found.converged))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its copies say, with all columns of docs. Rows stay where they are: nothing is shuffled."""
    n, p, copy = unused(docs.columns, "n_tokens", "p", "copy")
    members = stored(posteriors(docs, fit(docs, labels), (n, p), keep_text=True), "mix-members")
    rate = rate_of(F.col(p), solve(members, targets, budget, (n, p)).y)
    copies = copies_of(rate, F.col("doc_id").cast("long"), F.xxhash64("text"))
    out = members.withColumn(p, copies).filter(F.col(p) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(p))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    missed = [F.col("missed")[i].alias(f"missed_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "n_tokens", *shares, "rate", "copies", *missed, "converged")
