"""Packing of documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

A hash of where a row lies (its file and row number) deals the documents to groups of about 4 MB of text, so that every group
is packed alone, in one task and bounded memory, however many rows are copies of one, and the number of groups grows with the input. A document's
tokens fill whole sequences first. The remainders, longest first, go each to the first bin with room, which
a tournament tree of bin capacities finds in logarithmic time. What room is left is then filled by cutting the
pieces of the emptiest bins, and the last bin is cut into sequences of a power of two, which need no padding.

Tokens come from the tokenizer file itself. Its pre-tokenizer drops white space and its normaliser maps single
characters, so text between white space encodes on its own; each worker keeps the ids of what it met.

Defined cases: a null text counts as empty and has the closing id alone; repeated rows and equal ids are packed
as documents of their own; an empty table gives an empty result; other columns are ignored, whatever their names; rows that don't come from files are written first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanloom.llm.common import UNIT_BYTES, kept, stored, table, units_of

END_ID = 2
SEQUENCE = 4096
#: Entries that a worker's store of encoded words, as written and as encoded, may hold before it starts anew. Executors have several workers, and each has a store.
STORE = 800_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the tokenizer takes for white space, and the characters that only str.split() takes for it.
SPACE, APART = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "\x1c\x1d\x1e\x1f"


def word_encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit numbers. A worker process keeps the encoder of a path."""
    return kept(f"packing {path}", lambda: _encoder(path))


def _encoder(path: str) -> Callable[[str], bytes]:
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok, store = Tokenizer.from_file(path), {}
    specials = tuple(t.content for t in tok.get_added_tokens_decoder().values())

    def ids(words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    marks = dict(zip(".,", ids([".", ","]), strict=True))

    def core(word: str) -> tuple[str, bytes]:
        """A word without its last mark, which is a token of its own after a letter; ASCII in lower case, as the normaliser has it. It is its own core, so one store holds both."""
        end = b""
        if len(word) > 1 and word[-1] in marks and word[-2].isalpha():
            word, end = word[:-1], marks[word[-1]]
        return (word.lower() if word.isascii() else word), end

    letters = np.zeros(tok.get_vocab_size(), bool)  # ids that end a word
    for piece, i in tok.get_vocab().items():
        letters[i] = piece.endswith("</w>")

    def several(words: list[str]) -> list[bytes]:
        """Words of letters alone in one go; each ends with the first id that ends a word."""
        got = np.asarray(tok.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(letters[got]) + 1
        if len(ends) != len(words):  # a letter that the normaliser takes apart
            return ids(words)
        data, at = got.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(new: list[str]) -> None:
        made = {w: core(w) for w in new}
        missing = {c for c, _ in made.values() if c not in store}
        for kind, how in ((True, several), (False, ids)):
            part = [c for c in missing if c.isalpha() is kind]
            for s in range(0, len(part), 4096):
                store.update(zip(part[s : s + 4096], how(part[s : s + 4096]), strict=True))
        store.update({w: store[c] + end if end else store[c] for w, (c, end) in made.items() if w != c})

    def encode(text: str) -> bytes:
        if any(s in text for s in specials):  # they may stand inside or across words
            return ids([text])[0]
        words = SPACE.split(text) if any(c in text for c in APART) else text.split()
        new = [w for w in set(words) if w not in store]
        if new:
            if len(store) + 2 * len(new) > STORE:  # words, and cores that no text has
                store.clear()
                new = list(set(words))
            learn(new)
        return b"".join(map(store.__getitem__, words))

    return encode


class FirstFit:
    """Bins with a tournament tree over their free room; a match is won by the greater room."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.bins, self.leaves = size, [], 1
        while self.leaves < most:
            self.leaves *= 2
        self.room = [size] * (2 * self.leaves)

    def add(self, need: int) -> int:
        """Put need into the first bin with room for it and return the bin's number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        room[at] -= need
        found = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def plan(lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document's position, start, length); each token is in one piece."""
    full, rest = [], []
    for i, n in enumerate(lengths):
        whole = n // size
        full += [[(i, k * size, size)] for k in range(whole)]
        if n % size:
            rest.append((n % size, i, whole * size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = FirstFit(size, len(rest)), []
    for n, i, start in rest:
        b = tree.add(n)
        if b == len(bins):
            bins.append([])
        bins[b].append((i, start, n))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if fill[b] < size), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:  # the fullest bins are topped up from the emptiest
        to, of = order[lo], order[hi]
        room, (i, start, n) = size - fill[to], bins[of].pop()
        take = min(room, n)
        bins[to].append((i, start, take))
        fill[to] += take
        fill[of] -= take
        if take < n:
            bins[of].append((i, start + take, n - take))
        lo += fill[to] == size
        hi -= fill[of] == 0
    done = full + [b for b in bins if b and sum(p[2] for p in b) == size]
    for left in (b for b in bins if b and sum(p[2] for p in b) < size):  # one at most
        total = sum(p[2] for p in left)
        left = left[::-1]
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                part, need = [], 1 << bit
                while need:
                    i, start, n = left.pop()
                    take = min(need, n)
                    part.append((i, start, take))
                    need -= take
                    if take < n:
                        left.append((i, start + take, n - take))
                done.append(part)
    return done


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the file and row number that tell a row from its copies."""

    def read(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at["file_path"].alias("file"), at["row_index"].alias("pos"))

    try:
        return read(docs)
    except AnalysisException:  # not the rows of files
        return read(stored(docs.select("doc_id", "text"), "packing-rows"))


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, unit_bytes: int = UNIT_BYTES // 2, seed: int = 7) -> DataFrame:
    """doc_id and text to one row per piece; see SCHEMA."""
    path, groups = path or tokenizer_path(), units_of(docs, unit_bytes=unit_bytes)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(path), END_ID.to_bytes(4, "little")
        rows = []
        for batch in batches:
            rows += [
                (i, encode(t or "") + end) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
            ]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), zlib.crc32(r[1])))  # the same on every attempt
        out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        first = key[0].as_py() << 32
        for number, parts in enumerate(plan([len(b) // 4 for _, b in rows], size)):
            offset = 0
            for i, start, n in parts:
                doc, ids = rows[i]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                for c, v in zip(out, (doc, start, n, crc, len(ids) // 4, first + number, offset), strict=True):
                    out[c].append(v)
                offset += n
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    dealt = _located(docs).select(F.pmod(F.xxhash64("file", "pos", F.lit(seed)), F.lit(groups)).alias("grp"), "doc_id", "text")
    return dealt.groupBy("grp").applyInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
