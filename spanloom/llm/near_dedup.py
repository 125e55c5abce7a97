"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: in each round every shingle is thrown by a fresh hash into one of SIZE bins, where it leaves the round and its hash; a bin
keeps the least. The first SIZE rounds place shingles at random, round SIZE + j puts all into bin j, so after 2 SIZE rounds at the latest every
coordinate is filled; rounds end once all are. Each coordinate agrees between two sets with their similarity as its probability, and concentrates.

Texts with equal words form a class, which one row stands for. Classes whose sketches agree in one of BANDS bands of ROWS coordinates meet in a bucket.
A bucket's pairs are never all made: each member is first held against the bucket's smallest id, by its full shingle set.
Verified links give components. What is left are buckets with several components. There, members of different components whose sizes and sketches allow the threshold are
held against each other on their full sets, block by block, in the first band that they share. So links within a component are never searched for, pairs are never
rows, and all others that a band brings together are verified. A pair at similarity 0.75 shares no band with a probability of 5e-6.
Sets are held as 64-bit hashes of their shingles; a pair that they call similar is confirmed on the words themselves before it becomes a link.

Defined cases: a text that is null or has no words has no shingles and no links; a null id too takes no part in links and is its own component (null); rows with equal ids
are one document, linked with each other, to group_rows, but documents of their own to first_of_groups; an empty table gives an empty result; a text of any length is hashed in
parts of CHUNK bytes; other columns are ignored (group_rows) or carried, whatever their names (first_of_groups).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import UNIT_BYTES, kept, remove, stored, table
from spanloom.session import unused

WORDS, SIZE, BANDS, ROWS = 5, 512, 32, 4
NUMERATOR, DENOMINATOR = 75, 100
#: Bits of a coordinate that hold its round: 2 SIZE rounds and, above them all, an empty bin.
ROUND_BITS = (2 * SIZE).bit_length()
#: Least number of coordinates (of SIZE) whose last four bits agree, to verify a pair of different components. At a similarity of 0.75
#: and with chance agreements 392 are expected; this is 5 standard deviations below.
LEAST_EQUAL = 344
#: Members of a bucket that one task compares at once.
BLOCK = 2048
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 19
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def normal(text: str | None) -> bytes:
    """The words of a text, in lower case (A-Z), with one space between."""
    return b" ".join((text or "").encode().lower().split())


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a buffer where spaces and newlines (after each text) end words, and where words end."""
    n = len(buf)
    up = np.cumprod(np.full(n, _M1), dtype=np.uint64)
    down = np.cumprod(np.full(n, _U(pow(int(_M1), -1, 1 << 64))), dtype=np.uint64)
    sums = np.r_[_U(0), np.cumsum((buf.astype(np.uint64) + _U(1)) * up, dtype=np.uint64)]
    ends = np.flatnonzero((buf == 32) | (buf == 10))
    starts = np.r_[0, ends[:-1] + 1]
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M3), ends


def _parts(text: bytes) -> Iterator[np.ndarray]:
    """A normal text in buffers of about CHUNK bytes, cut between words."""
    at = 0
    while at < len(text):
        cut = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
        cut = len(text) if cut < 0 else cut
        yield np.frombuffer(text[at:cut] + b"\n", np.uint8)
        at = cut + 1


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each normal text's shingles; none for an empty text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) < CHUNK):
            held += len(texts[b]) + 1
            b += 1
        some = [i for i in range(a, b) if texts[i]]
        a = b
        if not some:
            continue
        if len(some) == 1:
            w = np.concatenate([_word_hashes(part)[0] for part in _parts(texts[some[0]])])
            last = np.array([len(w)])
        else:
            buf = np.frombuffer(b"\n".join(texts[i] for i in some) + b"\n", np.uint8)
            w, ends = _word_hashes(buf)
            last = np.flatnonzero(buf[ends] == 10) + 1
        n = len(w) - words + 1
        s = np.zeros(max(n, 0), np.uint64)
        for j in range(words):
            if n > 0:
                s = s * _M1 + w[j : j + n]
        s, at = _mix(s), 0
        for i, to in zip(some, last.tolist(), strict=True):
            if to - at >= words:
                out[i] = np.unique(s[at : to - words + 1])
            else:
                whole = to - at
                for x in w[at:to].tolist():
                    whole = (whole * int(_M1) + x) & ((1 << 64) - 1)
                out[i] = _mix(np.array([whole], np.uint64))
            at = to
    return out


def sketch(items: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketch of a set of hashes that isn't empty; size is a power of two."""
    empty = _U((1 << 64) - 1)
    out = np.full(size, empty)
    low, first = _U(size - 1), 0
    while first < 2 * size:
        rounds = np.arange(first, min(2 * size, first + max(1, 4096 // len(items))), dtype=np.uint64)
        x = _mix(items[None, :] ^ _mix(rounds * _M1 + _U(1))[:, None])
        bins = np.where((rounds < size)[:, None], x & low, (rounds - np.minimum(rounds, _U(size)))[:, None])
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << _U(64 - ROUND_BITS))[:, None] | (x >> _U(ROUND_BITS))).ravel())
        first += len(rounds)
        if out.max() != empty:  # later rounds are greater and change nothing
            break
    return out


def band_keys(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * _M2
    for col in s[: bands * ROWS].reshape(bands, ROWS).T:
        key = _mix(key * _M1 + col)
    return key.view(np.int64)


def last_bits(s: np.ndarray) -> bytes:
    """The last four bits of each coordinate, two in a byte."""
    x = (s & _U(15)).astype(np.uint8)
    return (x[::2] | x[1::2] << 4).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many coordinates of each row of a agree with b in their last bits."""
    x = a ^ b
    return ((x & 15) == 0).sum(1) + (x < 16).sum(1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both) and both > 0


def _ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, equal for equal pairs alone."""
    return np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]


def confirmed(a: bytes, b: bytes) -> bool:
    """Whether two normal texts' shingle sets, as words and not as hashes, are similar."""
    ids: dict[bytes, int] = {}
    first, second = a.split(b" "), b.split(b" ")
    if min(len(first), len(second)) < WORDS:
        return first == second
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in [*first, *second]), np.int64, len(first) + len(second))
    shingle = word
    for j in range(1, WORDS):
        shingle = _ranks(shingle[:-1], word[j:])
    x, y = np.unique(shingle[: len(first) - WORDS + 1]), np.unique(shingle[len(first) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


_SKETCHED = "doc_id long, n long, digest binary, keys array<long>, bands binary, sig binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("near_dedup", dict)
    for batch in batches:
        for part in (batch.slice(s, 512) for s in range(0, batch.num_rows, 512)):
            texts = [normal(t) for t in part["text"].to_pylist()]
            n, digest, keys, bands, sigs = [], [], [], [], []
            for text, items in zip(texts, shingles(texts), strict=True):
                n.append(len(items))
                if len(items):
                    s = sketch(items)
                    digest.append(hashlib.blake2b(text, digest_size=16).digest())
                    keys.append(band_keys(s))
                    bands.append(keys[-1].tobytes())
                    sigs.append(last_bits(s))
                else:
                    digest.append(None)
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bands, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "digest", "keys", "bands", "sig"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts to the pairs that are similar."""
    held: dict[int, tuple[bytes, np.ndarray]] = {}

    def of(i: int, text: bytes) -> np.ndarray:
        had = held.get(i)
        if had is None or had[0] != text:
            if len(held) > 256:
                held.clear()
            had = held[i] = (text, shingles([text])[0])
        return had[1]

    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
        good = [(a, b) for a, b, ta, tb in rows if similar(of(a, ta), of(b, tb)) and confirmed(ta, tb)]
        cols = list(zip(*good, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full shingle sets are similar. Hot ids are split by Spark's skew join."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("norm").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("norm").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it can be reached from: stars are drawn to their smallest nodes until nothing changes."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        new = stored(new, "near-edges")
        same = new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty()
        remove(now)
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _close(t: pa.Table) -> pa.Table:
    """Members of a bucket's two blocks to the links between different components, each verified on the full shingle sets.

    A pair is looked at in the first band that it shares, and not at all once links found here connect it."""
    t = t.sort_by([("doc_id", "ascending")])
    key, ids, comp, n, side = (t[c].to_numpy() for c in ("key", "doc_id", "comp", "n", "side"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), -1)
    bands = np.frombuffer(b"".join(t["bands"].to_pylist()), np.int64).reshape(len(t), -1)
    here = int(np.flatnonzero(bands[0] == key[0])[0])
    norms, sets = t["norm"], {}
    root = {int(c): int(c) for c in np.unique(comp)}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles([norms[i].as_py()])[0]
        return sets[i]

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: of both
    links = []
    for i in left:
        js = right[(comp[right] != comp[i]) & (ids[right] != ids[i])]
        if side[i] == 2:
            js = js[(side[js] != 2) | (js > i)]
        small, large = np.minimum(n[js], n[i]), np.maximum(n[js], n[i])
        js = js[DENOMINATOR * small >= NUMERATOR * large]
        same = agreeing(sig[js], sig[i])
        good = (same >= LEAST_EQUAL) & ~(bands[js, :here] == bands[i, :here]).any(1)
        for j in js[good][np.argsort(-same[good], kind="stable")].tolist():
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and similar(of(int(i)), of(j)) and confirmed(norms[int(i)].as_py(), norms[j].as_py()):
                root[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    cols = list(zip(*links, strict=True)) or [(), ()]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _late_links(members: DataFrame, sigs: DataFrame, texts: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between components that share a bucket. A large bucket is cut into blocks, and two blocks meet in a task."""
    now = members.join(comps.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    held = now.join(mixed, "key", "left_semi").join(sigs, "doc_id")
    sizes = held.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / UNIT_BYTES)).cast("int").alias("blocks"))
    held = held.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = held.withColumn("other", meets).join(texts, "doc_id").select(
        "key", "doc_id", "comp", "n", "sig", "bands", "norm", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return pairs.groupBy("key", "i", "j").applyInArrow(_close, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's id, n and sketch, and the ids in company (node) with their components (comp). Both are stored; the tables between go once nothing reads them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(rows.mapInArrow(_sketches, _SKETCHED), "near-sketches")
    usable = found.filter("doc_id IS NOT NULL AND n > 0")
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    # only ids meet in buckets; sketches are joined to the few that have company
    own = usable.select("doc_id", "digest", "keys").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    keyed = own.select("doc_id", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("hi")).filter("leader <> hi").select("key", "leader")
    members = stored(keyed.join(several, "key").distinct(), "near-members")
    active = members.select("doc_id").distinct()
    texts = rows.join(active, "doc_id", "left_semi").select("doc_id", "text")
    texts = stored(texts.mapInArrow(_normal_rows, "doc_id long, norm binary"), "near-texts")
    stars = members.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    # a class's rows, and rows with equal ids, are linked as they are
    alike = usable.select("digest", "doc_id").join(classes, "digest").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = stored(verified(stars, texts), "near-links")
    comps = components(links)
    sigs = usable.select("doc_id", "n", "sig", "bands").join(active, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sigs = stored(sigs.join(texts.groupBy("doc_id").agg(F.max(F.octet_length("norm")).alias("size")), "doc_id"), "near-sigs")
    late = stored(_late_links(members, sigs, texts, comps), "near-links")
    for done in (members, texts, links, sigs):
        remove(done)
    whole = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(late).unionByName(alike))
    for done in (classes, comps, late):
        remove(done)
    return found, whole


def _components_of(found: DataFrame, whole: DataFrame) -> DataFrame:
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(whole, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def group_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    return _components_of(*_grouped(docs))


def _normal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([normal(t) for t in batch["text"].to_pylist()], pa.binary())], names=["doc_id", "norm"])


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their group by doc_id (a null comes last, and the row written first on a tie), with all columns.

    Rows are numbered once, in files of their own, and grouped by their numbers, so equal ids of different texts don't meet."""
    (row,) = unused(docs.columns, "row")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found, whole = _grouped(held.select(F.col(row).alias("doc_id"), "text"))
    groups = _components_of(found, whole).select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
    several = groups.filter("row <> comp").select("comp").distinct()
    members = groups.join(several, "comp", "left_semi").join(held.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id")), "row")
    members = stored(members.select("comp", "row", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("place")), "near-members")
    remove(found)
    remove(whole)
    firsts = members.groupBy("comp").agg(F.min("place").alias("place"))
    gone = members.select("row").join(firsts.select(F.col("place.row").alias("row")), "row", "left_anti").withColumnRenamed("row", "gone")
    stay = held.join(gone, held[row] == gone["gone"], "left_anti")
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_rows(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
