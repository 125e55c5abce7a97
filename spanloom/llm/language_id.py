"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its
longest character n-grams that the model knows: all its 5-grams first, then 4-grams, down to single letters.
A text's score per language is the mean over its words; the prediction is the best, and its score the
posterior of a softmax over that mean times the number of words, at most CERTAIN.

Words of any length are counted over all training texts, each task combining its own counts first. The model is what is
broadcast, and its size is bounded: WORDS words and GRAMS n-grams, each language having an equal quota, so that a small language's don't give way to a large one's. Those of a language stay whose count
reaches the least threshold that keeps no more than its quota; rarer words are scored by n-grams. Thresholds come from histograms of the counts, so nothing is sorted. At most LANGUAGES languages are learnt, those with the most words.

Defined cases: a text that is null or has no letter is "und" with score 0, and so is every text where no
language can be learnt; rows with a null language or null text teach nothing; ties go to the language that comes first by name; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fold_of, kept, remove, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the model.
WORDS, GRAMS, LANGUAGES, LONGEST = 100_000, 100_000, 256, 5
#: Distinct words that a task counts before it passes them on.
FLUSH = 300_000
#: Counts up to this one have bins of their own in the histograms; above, bins keep as many leading bits.
BINS = 1 << 10
#: Unseen words whose rows a task keeps before it starts anew.
STORE = 100_000
CERTAIN = 40.0
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """A word's n-grams; n-grams of two or more letters see its edges."""
    if size == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
        langs, words, ns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["lang", "item", "n"]
        )

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > FLUSH:
            yield out()
            counts = {}
    yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        langs, grams = zip(*counts, strict=True) if counts else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "item", "n"]
        )

    for batch in batches:
        for lang, word, n in zip(batch["lang"].to_pylist(), batch["item"].to_pylist(), batch["n"].to_pylist(), strict=True):
            for size in range(1, LONGEST + 1):
                for gram in grams_of(word, size):
                    counts[lang, gram] += n
        if len(counts) > FLUSH:
            yield out()
            counts = Counter()
    yield out()


class Model:
    """Languages, and a row of log frequencies for each known word and n-gram."""

    def __init__(self, langs: list[str], words: pa.Table, grams: pa.Table) -> None:
        """From tables of lang, item and n; all of an item's languages are there."""
        self.langs = langs
        items, counts = self._counts(words)
        self.words, self.rows, self.grams = {item: i for i, item in enumerate(items)}, self._logs(counts), {}
        items, counts = self._counts(grams)
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        for size in range(1, LONGEST + 1):
            own = np.flatnonzero(sizes == size)
            self.grams |= zip((items[i] for i in own), self._logs(counts[own]), strict=True)

    def _counts(self, found: pa.Table) -> tuple[list[str], np.ndarray]:
        coded = found["item"].combine_chunks().dictionary_encode()
        items = coded.dictionary.to_pylist()
        counts = np.zeros((len(items), len(self.langs)))
        lang = pa.compute.index_in(found["lang"], pa.array(self.langs, pa.string())).to_numpy()
        np.add.at(counts, (coded.indices.to_numpy(), lang), found["n"].to_numpy())
        order = sorted(range(len(items)), key=items.__getitem__)
        return [items[i] for i in order], counts[order]

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts.sum(0) + 1))

    def word(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return self.rows[found]
        for size in range(LONGEST, 0, -1):
            known = [g for g in map(self.grams.get, grams_of(word, size)) if g is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, store: Store) -> tuple[str, float]:
        words = Counter(words_of(text or ""))
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        times = np.fromiter(words.values(), float, len(words))
        total = (store.of(list(words)) * times[:, None]).sum(axis=0)  # each language's sum in the same order
        number = words.total()
        x = total / number * min(number, CERTAIN)
        p = np.exp(x - x.max())
        return self.langs[int(p.argmax())], float(p.max() / p.sum())


class Store:
    """The rows of the known words, and behind them those of the unseen words that a task met, STORE at most between two texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at, self.rows = dict(self.model.words), self.model.rows

    def of(self, words: list[str]) -> np.ndarray:
        found = list(map(self.at.get, words))
        if None in found:
            new = [w for w, i in zip(words, found, strict=True) if i is None]
            if len(self.at) - len(self.model.words) + len(new) > STORE:
                self.clear()
                new = [w for w in words if w not in self.at]
            used = len(self.at)
            if used + len(new) > len(self.rows):
                grown = np.empty((max(used + len(new), used + STORE // 8), len(self.model.langs)))
                grown[:used] = self.rows[:used]
                self.rows = grown
            for i, word in enumerate(new, used):
                self.rows[i], self.at[word] = self.model.word(word), i
            found = list(map(self.at.get, words))
        return self.rows[found]


def fit(train: DataFrame) -> Model:
    """Learn from lang and text of all rows of train."""
    known = train.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    words = known.mapInArrow(_count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = stored(words, "langid-words")
    langs = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = sorted(r["lang"] for r in langs)
    kept = words.filter(F.col("lang").isin(names)) if names else words
    grams = stored(kept.mapInArrow(_count_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "langid-grams")
    model = Model(names, most_frequent(kept, names, WORDS), most_frequent(grams, names, GRAMS))
    remove(words)
    remove(grams)
    return model


def most_frequent(counts: DataFrame, langs: list[str], most: int) -> pa.Table:
    """lang, item and n of the items that reach the threshold of any language; with each, all of its languages. At most `most` items, and their languages."""
    n = F.col("n")
    low = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(n)) - BINS.bit_length())).cast("long")
    bins = counts.groupBy("lang", (n - n % low).alias("low")).agg(F.count("*").alias("items")).toArrow().to_pylist()
    least = {}
    for lang in langs:
        held = 0
        for r in sorted((r for r in bins if r["lang"] == lang), key=lambda r: -r["low"]):
            held += r["items"]
            if held > most // len(langs):
                break
            least[lang] = r["low"]
    if not least:
        return counts.limit(0).toArrow()
    need = F.element_at(F.create_map(*[F.lit(v) for kv in least.items() for v in kv]), F.col("lang"))
    items = counts.filter(n >= need).select("item").distinct()
    return counts.join(F.broadcast(items), "item", "left_semi").select("lang", "item", "n").toArrow()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = kept(name, lambda: Store(held.value))
        for batch in batches:
            found = [held.value.predict(t, store) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 3)
    found = predict(docs, fit(docs.filter(fold != 1)))
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
