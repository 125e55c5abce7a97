"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows (EXAMPLES, the first by a hash of the id). Terms are words and the first letters of longer
words. The vectors range over all terms of the sample. Terms that tell the labels apart in the sample (a likelihood ratio that no term would be likely to
reach by chance, given how many were tried), at most TERMS, weigh TELLING times as much.

The vectors stand in an inverted index cut into blocks of BLOCK examples, with the greatest weight of each term in each block. The terms with the longest
postings, as many as DENSE cells hold, stand in full instead, so that a batch of texts meets them in one matrix product. For a text, a block's bound is the greatest
of its examples' sums over these terms, plus the sum of the block's greatest weights of the others. As weights are positive, the k-th greatest of the examples' sums is a similarity that
k examples reach: blocks whose bounds are under it are ruled out, and the others scored exactly. Bounds are summed some terms at a time, no further than until a
quarter of the blocks stays in any case, as all are scored then. The neighbours vote with their similarity; PRIOR votes of the sample's share
of toxic rows keep the score calibrated where few or no neighbours are near. The neighbours are the evidence. Similarities are rounded to nine places, so that equal examples tie.

Defined cases: a null text counts as empty; a text without known terms gets the sample's share; of several labels of one row the greatest counts; null
labels are ignored; without any labelled row every score is 0; ties in similarity go to the smaller id; repeated rows and equal ids are scored each by its own text;
an empty table gives an empty result; other columns are ignored by score() and carried by reject(), whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold_of, kept, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is learnt: examples, whose terms are all broadcast, and terms that weigh more.
EXAMPLES, TERMS = 8192, 20_000
NEIGHBOURS, BLOCK = 15, 64
#: Cells (terms x examples) of the terms that stand in full, texts that meet them at once, and words whose terms a worker keeps.
DENSE, BATCH, STORE = 1 << 22, 256, 150_000
#: Terms whose postings are made into weights at once, and terms of a text that bounds begin with.
PART, PROBE = 1 << 15, 64
#: A term that tells labels apart has LEAST rows and SHARE of the rarer label's rows at least, and a likelihood ratio of 2 ln(terms tried) at least.
LEAST, SHARE, TELLING = 3, 0.02, 8.0
PREFIX = 5
PRIOR = 0.5


def terms_of(text: str | None) -> Counter:
    """Words and, as "letters*", the starts of longer words, each with its number of times; a start met twice or more is a term of its own too, as "letters*2"."""
    counts = Counter(WORD.findall((text or "").lower()))
    starts: Counter = Counter()
    for word, n in counts.items():
        if len(word) > PREFIX:
            starts[f"{word[:PREFIX]}*"] += n
    for start, n in starts.items():
        counts[start] = n
        if n > 1:
            counts[f"{start}2"] = n
    return counts


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from starts to stops, one after the other, and the ranges' lengths."""
    lengths = stops - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths), lengths


class Runs:
    """Numbers of which many short runs are read together: they are held as bytes, whose parts are joined faster than those of arrays."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.kind, self.data = numbers.dtype, numbers.tobytes()
        self.numbers = np.frombuffer(self.data, self.kind)

    def between(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The runs from starts to stops, one after the other."""
        data, size = self.data, self.kind.itemsize
        return np.frombuffer(b"".join([data[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist(), strict=True)]), self.kind)


class Index:
    """Examples as TF-IDF vectors of unit length, in blocks."""

    def __init__(
        self, examples: list[tuple[int, int, dict[str, int]]], idf: dict[str, float], share: float, k: int = NEIGHBOURS, block: int = BLOCK, dense: int = DENSE
    ) -> None:
        names = sorted(idf)
        number = {t: j for j, t in enumerate(names)}
        held = [(i, y, {t: n for t, n in c.items() if t in number}) for i, y, c in examples]
        row = np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for _, _, c in held])
        term = np.array([number[t] for _, _, c in held for t in c], np.int32)
        times = np.array([n for _, _, c in held for n in c.values()], np.int32)
        ids, labels = np.array([i for i, _, _ in held], np.int64), np.array([y for _, y, _ in held], np.int64)
        self._learn(pa.array(names, pa.string()), np.array([idf[t] for t in names], float), ids, labels, row, term, times, share, (k, block, dense))

    @classmethod
    def of(cls, names: pa.Array, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, share: float) -> Index:
        """From sorted names of terms with their idf, and one entry of row, term and times for each term of an example."""
        new = cls.__new__(cls)
        new._learn(names, idf, ids, labels, row, term, times, share, (NEIGHBOURS, BLOCK, DENSE))
        return new

    def _learn(self, names, idf, ids, labels, row, term, times, share, sizes) -> None:
        weight = (1 + np.log(np.maximum(times, 1))) * idf[term] if len(term) else np.empty(0)
        norms = np.sqrt(np.bincount(row, weight * weight, len(ids)))
        # alike examples side by side make tight bounds: by their heaviest term
        heavy = np.full(len(ids), len(names))
        starts, most_of = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)]), np.zeros(len(ids))
        if len(row):
            most_of[row[starts]] = np.maximum.reduceat(weight, starts)
            heavy[row[starts]] = np.minimum.reduceat(np.where(weight == most_of[row], term, np.int32(len(names))), starts)
        del weight
        order = np.lexsort((ids, heavy))
        order = order[norms[order] > 0]
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        del most_of, starts
        by = np.argsort(term.astype(np.int64) * len(ids) + place[row], kind="stable")
        self.held = (names, idf, share, sizes, ids[order], labels[order], norms[order], np.bincount(term, minlength=len(names)).astype(np.uint32),
                     place[row[by]].astype(np.uint32), times[by].astype(np.uint32))

    def __getattr__(self, name: str):
        """What is made of the postings is made where it is first asked for: the driver only sends them."""
        if name.startswith("__") or self.__dict__.get("held") is None:
            raise AttributeError(name)
        self._enter(self.held)
        return self.__dict__[name]

    def __getstate__(self) -> bytes:
        """What is broadcast: the postings alone, as each executor writes it to disk."""
        return zlib.compress(pickle.dumps(self.held), 1)

    def __setstate__(self, state: bytes) -> None:
        self._enter(pickle.loads(zlib.decompress(state)))  # noqa: S301
        self.held = None  # a worker sends it no further

    def _enter(self, held: tuple) -> None:
        self.held = held
        self.names, self.idf, self.share, (self.k, self.block, dense), ids, labels, norms, counts, at, times = held
        self.ids, self.labels, n = ids.tolist(), labels.tolist(), len(ids)
        self.id_of, self.blocks, self.words, self.known = ids, -(-n // self.block), {}, np.empty((0, 3), np.int64)
        # names are found by this process's hashes of them; those that share a hash are kept apart
        hashes = np.empty(len(self.names), np.int64)
        for a in range(0, len(self.names), PART):
            hashes[a : a + PART] = list(map(hash, self.names.slice(a, PART).to_pylist()))
        self.by_hash = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.by_hash]
        alike = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        alike = self.by_hash[np.union1d(alike, alike + 1)]
        self.alike = dict(zip(self.names.take(pa.array(alike)).to_pylist(), alike.tolist(), strict=True))
        # the terms with the longest postings, by number on a tie
        full = np.argsort(-counts.astype(np.int64), kind="stable")[: dense // max(1, n)]
        self.full_of = np.full(len(self.names), -1, np.int32)
        self.full_of[full] = np.arange(len(full))
        self.full = np.zeros((len(full), n))
        left = int(counts[self.full_of < 0].sum())
        term, posts, weights = np.empty(left, np.int32), np.empty(left, np.min_scalar_type(n)), np.empty(left)
        ends, used = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), 0
        for a in range(0, len(self.names), PART):  # a part at a time, as an executor's memory is shared
            some = slice(ends[a], ends[min(a + PART, len(self.names))])
            own = np.repeat(np.arange(a, min(a + PART, len(self.names)), dtype=np.int32), counts[a : a + PART])
            weight, where = (1 + np.log(np.maximum(times[some], 1))) * self.idf[own] / norms[at[some]], at[some]
            mine = self.full_of[own] >= 0
            self.full[self.full_of[own[mine]], where[mine]] = weight[mine]
            to = slice(used, used + int((~mine).sum()))
            term[to], posts[to], weights[to] = own[~mine], where[~mine], weight[~mine]
            used = to.stop
        # an entry is another term in a block: its block, its greatest weight, and its postings; terms have entries from first[term] on
        own = (posts // self.block).astype(np.min_scalar_type(self.blocks))
        start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])][: len(term)])
        self.most = Runs(np.maximum.reduceat(weights, start) if len(start) else np.empty(0))
        self.block_of, self.start = Runs(own[start]), np.r_[start, len(term)]
        self.first = np.searchsorted(term[start], np.arange(len(self.names) + 1, dtype=np.int32))
        del term, own, start
        self.at = Runs(posts)
        del posts
        self.weight = Runs(weights)

    def _numbers(self, terms: list[str | None]) -> np.ndarray:
        """The numbers of terms; -1 where unknown."""
        numbers = np.full(len(terms), -1, np.int64)
        if not len(self.names):
            return numbers
        own = np.fromiter(map(hash, terms), np.int64, len(terms))
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[at] == own)
        found = self.by_hash[at[maybe]]
        same = pa.compute.equal(self.names.take(pa.array(found)), pa.array([terms[i] for i in maybe.tolist()], pa.string()))
        same = same.fill_null(False).to_numpy(zero_copy_only=False)
        numbers[maybe[same]] = found[same]
        if self.alike:
            for i in maybe.tolist():
                numbers[i] = self.alike.get(terms[i], numbers[i])
        return numbers

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, of their starts and of their starts met again; -1 where unknown."""
        found = np.full((len(words), 3), -1, np.int64)
        found[:, 0] = self._numbers(words)
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > PREFIX:
                at.setdefault(w[:PREFIX], []).append(i)
        own, starts = np.fromiter(chain.from_iterable(at.values()), np.int64), list(at)
        for column, end in ((1, "*"), (2, "*2")):
            found[own, column] = np.repeat(self._numbers([s + end for s in starts]), list(map(len, at.values())))
        return found

    def units(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The numbers of each text's known terms, those that terms_of() finds, and their weights in a vector of unit length."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        every = list(chain.from_iterable(words))
        new = list(set(every).difference(self.words))
        if new:
            if len(self.words) + len(new) > STORE:
                self.words, new = {}, list(set(every))
            used = len(self.words)
            if used + len(new) > len(self.known):
                self.known = np.concatenate([self.known[:used], np.empty((max(len(new), used + 1024), 3), np.int64)])
            self.known[used : used + len(new)] = self._word_numbers(new)
            self.words.update(zip(new, range(used, used + len(new)), strict=True))
        found = list(map(self.words.__getitem__, every))
        size, text = len(self.names) + 1, np.repeat(np.arange(len(texts)), list(map(len, words)))
        known = self.known[np.array(found, np.intp)]
        word, start = known[:, 0] >= 0, known[:, 1] >= 0
        keys, times = np.unique(text[word] * size + known[word, 0], return_counts=True)
        starts, first, often = np.unique(text[start] * size + known[start, 1], return_index=True, return_counts=True)
        again = known[start, 2][first]
        more = (often > 1) & (again >= 0)
        keys, times = np.concatenate([keys, starts, text[start][first][more] * size + again[more]]), np.concatenate([times, often, often[more]])
        order = np.argsort(keys)
        text, term = np.divmod(keys[order], size)
        w = (1 + np.log(times[order])) * self.idf[term]
        norms = np.sqrt(np.bincount(text, w * w, len(texts)))
        w, cuts = w / norms[text], np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(term[a:b], w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _unit(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        number, times = self._numbers(list(counts)), np.array(list(counts.values()), float)
        order = np.argsort(number)[(number < 0).sum() :]
        w = (1 + np.log(times[order])) * self.idf[number[order]]
        return number[order], w / (np.sqrt(w @ w) or 1.0)

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        term, w = self._unit(counts)
        return dict(zip(self.names.take(pa.array(term)).to_pylist(), w.tolist(), strict=True))

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For unit vectors as terms and weights, the places and similarities of the k most similar examples with positive similarity."""
        none = np.empty(0, np.int64), np.empty(0)
        if not self.blocks:
            yield from (none for _ in queries)
            return
        q = np.zeros((len(queries), len(self.full)))
        for row, (term, w) in zip(q, queries, strict=True):
            own = self.full_of[term]
            row[own[own >= 0]] = w[own >= 0]
        sums = q @ self.full
        tops = np.maximum.reduceat(sums, np.arange(0, len(self.ids), self.block), axis=1)
        for (term, w), own, top in zip(queries, sums, tops, strict=True):
            rest = self.full_of[term] < 0
            term, w = term[rest], w[rest]
            first, last = self.first[term], self.first[term + 1]
            reached = np.partition(own, -self.k)[-self.k] if len(own) >= self.k else 0.0
            bound, a, z = top.copy(), 0, PROBE
            while 4 * (now := (bound > 0) & (bound + 1e-9 >= reached)).sum() < self.blocks and a < len(term):  # bounds only grow
                some = self.block_of.between(first[a:z], last[a:z])
                bound += np.bincount(some, np.repeat(w[a:z], last[a:z] - first[a:z]) * self.most.between(first[a:z], last[a:z]), self.blocks)
                a, z = z, 2 * z
            if 4 * now.sum() < self.blocks:
                entries, lengths = _spans(first, last)
                here = now[self.block_of.numbers[entries]]
                weights, entries = np.repeat(w, lengths)[here], entries[here]
                posts, lengths = _spans(self.start[entries], self.start[entries + 1])
                own += np.bincount(self.at.numbers[posts], np.repeat(weights, lengths) * self.weight.numbers[posts], len(own))
            else:  # whole postings are read faster than many of their parts
                first, last = self.start[first], self.start[last]
                own += np.bincount(self.at.between(first, last), np.repeat(w, last - first) * self.weight.between(first, last), len(own))
            # sums only grow, and those of the blocks that are ruled out stay under what was reached
            reached = np.partition(own, -self.k)[-self.k] if len(own) >= self.k else 0.0
            hits = np.flatnonzero((own >= reached - 1e-9) & (own > 0))
            near = np.round(own[hits], 9)
            keep = np.lexsort((hits, self.id_of[hits], -near))[: self.k]
            keep = keep[near[keep] > 0]
            yield hits[keep], near[keep]

    def nearest(self, counts: dict[str, int]) -> list[tuple[float, int]]:
        """The k most similar examples with positive similarity, as (similarity, place)."""
        places, best = next(iter(self.nearest_many([self._unit(counts)])))
        return list(zip(best.tolist(), places.tolist(), strict=True))

    def score_many(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The score of each text, and its neighbours' places and similarities."""
        for a in range(0, len(texts), BATCH):
            for places, best in self.nearest_many(self.units(texts[a : a + BATCH])):
                votes = sum(s * self.labels[at] for s, at in zip(best.tolist(), places.tolist(), strict=True))
                yield (self.share * PRIOR + votes) / (PRIOR + sum(best.tolist())), places, best

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        score, places, best = next(self.score_many([text]))
        return score, [(self.ids[at], self.labels[at], s) for at, s in zip(places.tolist(), best.tolist(), strict=True)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [terms_of(t) for t in batch["text"].to_pylist()]
        terms, ns = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
        cols = [batch[c] for c in ("doc_id", "label", "hash", "head", "tail")]
        yield pa.RecordBatch.from_arrays([*cols, terms, ns], names=["doc_id", "label", "hash", "head", "tail", "terms", "n"])


def _telling(term: np.ndarray, row: np.ndarray, size: int, labels: np.ndarray, alone: np.ndarray, most: int) -> np.ndarray:
    """The terms that tell the labels apart among the rows that are marked as alone."""
    pos, neg = int(labels[alone].sum()), int((1 - labels[alone]).sum())
    own = alone[row]
    df, a = np.bincount(term[own], minlength=size).astype(float), np.bincount(term[own], labels[row[own]], size)
    tried = np.flatnonzero(df >= max(LEAST, SHARE * min(pos, neg)))
    if not len(tried):
        return tried
    a, df, n = a[tried], df[tried], pos + neg
    share = pos / n

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / due), 0.0)

    ratio = 2 * (part(a, df * share) + part(df - a, df * (1 - share)) + part(pos - a, (n - df) * share) + part(neg - df + a, (n - df) * (1 - share)))
    good = np.flatnonzero(ratio >= 2 * math.log(max(1, len(tried))))
    return tried[good[np.argsort(-ratio[good], kind="stable")][:most]]


def _firsts(group: np.ndarray, labels: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows, of those in order, that are the first of their group and label."""
    _, first = np.unique(np.stack([group[order], labels[order]], 1), axis=0, return_index=True)
    return order[np.sort(first)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """Learn from the first rows of labels, by a hash of the id, whose texts are in docs. The sample's terms come to the driver, which makes the index."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    sample = stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "toxic-sample")
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "\\s+")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select(
        "doc_id", "label", "text", F.xxhash64("text").alias("hash"), F.xxhash64(F.slice(words, 1, 8)).alias("head"), F.xxhash64(F.slice(F.reverse(words), 1, 8)).alias("tail"),
    )
    # at most EXAMPLES rows, and those with their ids
    found = every.mapInArrow(_examples, "doc_id long, label int, hash long, head long, tail long, terms array<string>, n array<int>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("hash", "ascending")]).combine_chunks()
    ids, y, head, tail = (found[c].to_numpy().astype(np.int64) for c in ("doc_id", "label", "head", "tail"))
    if not len(ids):
        return Index([], {}, 0.0)
    lists = [found[c].combine_chunks() for c in ("terms", "n")]
    del found
    row = np.repeat(np.arange(len(ids), dtype=np.int32), lists[0].value_lengths().to_numpy())
    coded, times = lists[0].flatten().dictionary_encode(), lists[1].flatten().to_numpy()
    del lists
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    del coded
    # copies of one text are no independent evidence of which terms tell: rows that begin or end with the same words count once there
    alone = np.zeros(len(ids), bool)
    alone[_firsts(tail, y, np.sort(_firsts(head, y, np.arange(len(ids)))))] = True
    idf = np.log((1 + len(ids)) / (1 + np.bincount(term, minlength=len(names)))) + 1
    idf[_telling(term, row, len(names), y, alone, terms)] *= TELLING
    return Index.of(names, idf, ids, y, row, term, times, float(y.mean()))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (neighbours with label and similarity) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity", dict)
        ids, labels = np.array(held.value.ids, np.int64), np.array(held.value.labels, np.int32)
        for batch in batches:
            found = list(held.value.score_many(batch["text"].to_pylist()))
            places, near = (np.concatenate([x[j] for x in found]) if found else np.empty(0, int) for j in (1, 2))
            ends = pa.array(np.cumsum([0, *(len(x[1]) for x in found)]), pa.int32())
            near = pa.StructArray.from_arrays([pa.array(ids[places]), pa.array(labels[places]), pa.array(near, pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in found], pa.float64()), pa.ListArray.from_arrays(ends, near)], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, evidence array<struct<doc_id:long,label:int,similarity:double>>"
    )


def reject(docs: DataFrame, index: Index, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under least, with all columns. Rows stay where they are: nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity", dict)
        for batch in batches:
            yield batch.filter(pa.array([x[0] < least for x in held.value.score_many(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnt(spark: SparkSession, sf_dir: str) -> Index:
    """The index from the training fold of the documents' labels."""
    train = lambda name: table(spark, sf_dir, name).filter(fold_of(F.col("doc_id"), 5) != 0)
    return fit(train("documents"), train("labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), learnt(spark, sf_dir))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
