"""Token counts of a unigram vocabulary, without the tokens.

For each word an Aho-Corasick automaton enumerates the vocabulary's matches, and dynamic programming over
their ends carries the best score and the number of pieces on the best path. The rules are those of unigram
tokenizers: at an end a later start wins only with a strictly better score; a character that no piece of its
own covers costs the least score less 10 and becomes its UTF-8 bytes (byte fallback), or else one unknown piece
for each run of such characters.

A text is cut at ASCII white space, and every word gets the mark U+2581 in front. A worker process keeps one automaton for a vocabulary, and the counts of the words it met.

Defined cases: null and empty texts have no words, no tokens and score 0; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import kept, table

MARK = "▁"
PENALTY = 10.0
#: Entries that a worker's store of counted words may hold before it starts anew; longer words aren't kept.
STORE, KEPT = 300_000, 64
#: ASCII white space; str.split() would cut at more.
SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, n_words long, n_tokens long, score double"


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The plain pieces of a sentencepiece file with their scores; control, unknown and byte pieces never match text."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in plain]


def counter(pieces: list[tuple[str, float]], byte_fallback: bool = True) -> Callable[[str], tuple[int, float]]:
    """A function from a string to the number of pieces on its best path and that path's score."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for piece, score in pieces:
        found.add_word(piece, (len(piece), score))
    found.make_automaton()
    unknown = min((s for _, s in pieces), default=0.0) - PENALTY

    def count(text: str) -> tuple[int, float]:
        n = len(text)
        best, pieces_at, open_at = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = [()] * n
        for end, match in found.iter(text):
            ends[end] = (*ends[end], match)
        for end in range(1, n + 1):
            top, single, matches = None, False, ends[end - 1]
            if len(matches) > 1:
                matches = sorted(matches, reverse=True)  # the earliest start first: it keeps the place on a tie
            for size, score in matches:
                at = best[end - size] + score
                single = single or size == 1
                if top is None or at > top:
                    top, number, is_open = at, pieces_at[end - size] + 1, False
            if not single:
                at = best[end - 1] + unknown
                if top is None or at > top:
                    top, is_open = at, True
                    if byte_fallback:
                        number = pieces_at[end - 1] + len(text[end - 1].encode())
                    else:
                        number = pieces_at[end - 1] + (not open_at[end - 1])
            best[end], pieces_at[end], open_at[end] = top, number, is_open
        return pieces_at[n], best[n]

    return count


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens and score of each row. The vocabulary is broadcast; its size doesn't depend on the documents."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hashlib.sha256(repr((pieces, byte_fallback)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, store = kept(name, lambda: (counter(held.value, byte_fallback), {}))
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                words = Counter(SPACE.split(text or ""))
                words.pop("", None)
                tokens, score = 0, 0.0
                for word, times in words.items():
                    got = store.get(word)
                    if got is None:
                        got = count(MARK + word)
                        if len(word) <= KEPT:
                            if len(store) >= STORE:
                                store.clear()
                            store[word] = got
                    tokens += times * got[0]
                    score += times * got[1]
                rows.append((words.total(), tokens, score))
            n_words, n_tokens, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
