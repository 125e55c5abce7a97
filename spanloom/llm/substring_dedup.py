"""Removal of repeated substrings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Every window of LENGTH bytes has an anchor, the K-byte string in it with the least hash, so equal windows have equal anchors. The windows of one
   anchor make a segment. Anchors are dealt by their hash. Of segments with equal 64-bit hashes under one anchor, the one in the
   smallest document stays, first within a task, then within a bucket; the others' windows are settled. Most of the corpus ends here.
2. What stays under an anchor with several different segments is looked up in the texts and dealt again, now as bytes. Windows whose hash no other document has are left out.
3. The rest of a bucket makes texts T of bounded size, unless one anchor has more. The suffixes of T are sorted, and breadth-first backward
   extension over the transform derives the common prefixes by increasing value: the intervals of all strings of one more byte follow from those of
   one byte less, and the expansion stops at LENGTH or when no interval splits. The intervals of that depth are the equal windows; all but
   those of the smallest document in an interval are removed.
4. Windows meet their texts again by shard, a hash of the row. Texts are shuffled once; Spark reuses that exchange.

Different segments are compared by their bytes. Equal ones are told by 64-bit hashes under one anchor, whose 48-bit hash is independent.

Defined cases: a null text counts as empty; a null id comes after all others; rows with equal ids don't remove from each
other; texts shorter than LENGTH stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import release, stored, table, units_of

LENGTH, K = 50, 16
#: Bytes hashed at once, of text between a task's flushes, of T sorted at once (an anchor's segments stay together), and of text in a bucket or shard.
CHUNK, FLUSH, SORTED, UNIT = 1 << 17, 6 << 20, 1 << 17, 4 << 20
#: Partitions that buckets are dealt to at most; a partition's buckets are sorted, and read one at a time.
PARTS = 1 << 14
_LAST = (1 << 63) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For texts that lie in buf up to their ends: anchors' positions, 48-bit hashes, and first and last window starts."""
    n, w = len(buf), length - k + 1
    if n < length:
        return (np.empty(0, np.int64),) * 4
    v = buf.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    h = v[: n - k + 1] * _M1
    h ^= h >> np.uint64(29)
    h += v[k - 8 :][: n - k + 1] * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 21) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    at = (m & low).astype(np.int64)  # the anchor of the window that starts here
    inside = np.ones(len(at) + 1, bool)
    for e in ends:
        inside[max(0, e - length + 1) : e] = False
    inside[-1] = False
    starts = np.flatnonzero(inside[:-1] & np.r_[True, ~inside[:-2] | (at[1:] != at[:-1])])
    lasts = np.flatnonzero(inside[:-1] & np.r_[~inside[1:-1] | (at[1:] != at[:-1]), True])
    where = at[starts]
    return where, h[where] >> np.uint64(16), starts, lasts


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts, or parts of long ones, in buffers of about CHUNK bytes: texts' numbers, offsets within them, buffer parts."""
    who, base, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[s : s + CHUNK + length - 1]
            if held and held + len(part) > CHUNK:
                yield who, base, parts
                who, base, parts, held = [], [], [], 0
            who.append(i)
            base.append(s)
            parts.append(part)
            held += len(part)
    if parts:
        yield who, base, parts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    up = np.cumprod(np.full(n + 1, _M1), dtype=np.uint64)
    down = np.cumprod(np.full(n + 1, np.uint64(pow(int(_M1), -1, 1 << 64))), dtype=np.uint64)
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings buf[start:end], from one pass over buf."""
    up, down = _powers(len(buf))
    sums = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)]
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def _records(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """All segments of the texts: text number, anchor's hash, segment's hash, first window's start and number of windows."""
    out = []
    for who, base, parts in _pieces(texts, length):
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(parts), np.uint8)
        at, h, lo, hi = anchors(buf, ends, length, k)
        if len(at):
            own = np.searchsorted(ends, lo, side="right")
            shift = np.array(base)[own] - (ends - sizes)[own]
            out.append((np.array(who)[own], h, range_hashes(buf, lo, hi + length), lo + shift, hi - lo + 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5


def _planes(x: np.ndarray, size: int) -> bytes:
    """Numbers of some bytes as all their first bytes, then all their second ones, and so on: the high ones, mostly zero or alike, vanish when Spark compresses what it shuffles or writes."""
    return x.view(np.uint8).reshape(-1, size).T.tobytes()


def _whole(blob: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    """n numbers from their planes, which begin at a place in blob."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)


def _packed(cols: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    return b"".join(_planes(np.ascontiguousarray(cols[c].astype(t)), np.dtype(t).itemsize) for c, t in kinds.items())


def _unpacked(blobs: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    size, out = sum(np.dtype(t).itemsize for t in kinds.values()), {c: [] for c in kinds}
    for blob in blobs:
        n, at = len(blob) // size, 0
        for c, t in kinds.items():
            out[c].append(_whole(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(v) if v else np.empty(0, kinds[c]) for c, v in out.items()}


def _dealt(where: np.ndarray) -> list[np.ndarray]:
    """Places of rows by the bucket or shard that they go to."""
    if not len(where):
        return []
    order = np.argsort(where, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(where[order])) + 1)


def _classes(h: np.ndarray, seg: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor and segment; then, in that order, whether the row's document is the least of its segment, and bounds of segments and anchors."""
    order = np.argsort((h.astype(np.uint64) << np.uint64(32)) | (seg >> np.uint64(32)), kind="stable")
    h, seg, ids = h[order], seg[order], ids[order]
    anchor = np.r_[True, h[1:] != h[:-1]]
    own = anchor | np.r_[True, seg[1:] != seg[:-1]]
    first = np.flatnonzero(own)
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(h)]))
    return order, ids == least, own, anchor


#: Records of a bucket: anchor (its low 32 bits), segment, place of the document in the list beside them, first window, number of windows.
_SEEN = {"h": "<u4", "seg": "<u8", "doc": "<u4", "lo": "<u8", "n": "u1"}
#: Documents of a bucket's records.
_DOCS = {"id": "<i8", "row": "<i8"}
#: Windows that go, and segments whose bytes are wanted, by row.
_GONE = {"row": "<i8", "lo": "<u8", "n": "u1"}
_OPEN = {"row": "<i8", "lo": "<u8", "n": "u1", "anchor": "<u8"}
_BYTES = {"id": "<i8", "row": "<i8", "lo": "<u8", "n": "u1", "anchor": "<u8"}
_OUT = "shard long, gone binary, open binary"


def _blobs(names: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


def _scan(buckets: int, shards: int, length: int, k: int):
    """Rows of id, row and text to one row for each bucket and flush, with the records as bytes."""
    names = {"bucket": "long", "docs": "binary", "seen": "binary", "gone": "binary"}

    def flush(ids: list[tuple[int, int]], texts: list[bytes]) -> pa.RecordBatch:
        who, h, seg, lo, n = _records(texts, length, k)
        out = []
        if len(who):
            doc = np.array(ids, np.int64)
            h = h.astype(np.uint64)
            # an anchor's hash is the least of many, so small ones are common: mixed again, buckets are even
            bucket = (((_mixed(h * _M1) >> np.uint64(28)) * np.uint64(buckets)) >> np.uint64(36)).astype(np.int64)
            for part in _dealt(bucket):
                order, least, _, _ = _classes(h[part] & np.uint64(0xFFFFFFFF), seg[part], doc[who[part], 0])
                part, kept = part[order], least
                mine, gone = part[kept], part[~kept]
                docs, local = np.unique(who[mine], return_inverse=True)
                cols = {"h": h[mine] & np.uint64(0xFFFFFFFF), "seg": seg[mine], "doc": local, "lo": lo[mine], "n": n[mine]}
                out.append((int(bucket[part[0]]), _packed({"id": doc[docs, 0], "row": doc[docs, 1]}, _DOCS), _packed(cols, _SEEN), _packed({"row": doc[who[gone], 1], "lo": lo[gone], "n": n[gone]}, _GONE)))
        return _blobs(names, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # which returns what is freed
        ids, texts, held = [], [], 0
        for batch in (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256)):
            for i, row, t in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if len(t) < length:
                    continue
                ids.append((i, row))
                texts.append(t)
                held += len(t)
                if held >= FLUSH:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        yield flush(ids, texts)

    return run


def _by_bucket(run):
    """Apply run to the rows of each bucket of a task, whose rows are sorted by bucket: one bucket is held at a time."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["bucket"][0].as_py() != bucket[a]:
                    done, held = held, []
                    yield from run(done).to_batches()
                held.append(batch.slice(a, b - a))
        if held:
            done, held = held, []
            yield from run(done).to_batches()

    return over


def _dealt_by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """All rows of a bucket in one partition, one bucket after the other; the sort spills where a partition holds many."""
    parts = min(PARTS, buckets)
    return rows.withColumn("part", F.floor(F.col("bucket") * parts / buckets).cast("int")).repartitionById(parts, "part").drop("part").sortWithinPartitions("bucket")


def _column(held: list[pa.RecordBatch], name: str) -> list[bytes]:
    return [x for batch in held for x in batch[name].to_pylist()]


def _settle(shards: int):
    """A bucket's records to settled windows, and to segments that are wanted as bytes, by shard."""

    def run(held: list[pa.RecordBatch]) -> pa.Table:
        bucket, seen = held[0]["bucket"][0].as_py(), _column(held, "seen")
        names = [np.stack(list(_unpacked([d], _DOCS).values()), 1) for d in _column(held, "docs")]
        gone = _unpacked(_column(held, "gone"), _GONE)
        held.clear()
        c, sizes = _unpacked(seen, _SEEN), [len(x) // sum(np.dtype(k).itemsize for k in _SEEN.values()) for x in seen]
        del seen
        step = np.repeat(np.cumsum([0, *map(len, names)][:-1]), sizes)
        doc = np.concatenate(names)[c["doc"].astype(np.int64) + step] if len(c["h"]) else np.empty((0, 2), np.int64)
        wanted = np.empty(0, np.int64)
        if len(doc):
            order, least, own, anchor = _classes(c["h"], c["seg"], doc[:, 0])
            first = np.flatnonzero(anchor)
            several = np.repeat(np.add.reduceat(own, first) > 1, np.diff(np.r_[first, len(own)]))
            late, wanted = order[~least], order[least & several]
            gone = {"row": np.r_[gone["row"], doc[late, 1]], "lo": np.r_[gone["lo"], c["lo"][late]], "n": np.r_[gone["n"], c["n"][late]]}
        high = np.uint64(bucket << 32)
        asked = {"row": doc[wanted, 1], "lo": c["lo"][wanted], "n": c["n"][wanted], "anchor": c["h"][wanted].astype(np.uint64) | high}
        out = [(int(gone["row"][p[0]] % shards), _packed({k: v[p] for k, v in gone.items()}, _GONE), b"") for p in _dealt(gone["row"] % shards)]
        out += [(int(asked["row"][p[0]] % shards), b"", _packed({k: v[p] for k, v in asked.items()}, _OPEN)) for p in _dealt(asked["row"] % shards)]
        return pa.Table.from_batches([_blobs({"shard": "long", "gone": "binary", "open": "binary"}, out)])

    return run


def _fetch(length: int):
    """A shard's texts and wanted segments to the segments' bytes, by bucket."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        c, out = _unpacked(wanted["open"].to_pylist(), _OPEN), []
        if len(c["row"]) and len(texts):
            rows = {r: (i, t) for r, i, t in zip(texts["row"].to_pylist(), texts["id"].to_pylist(), texts["text"].to_pylist(), strict=True)}
            for p in _dealt((c["anchor"] >> np.uint64(32)).astype(np.int64)):
                row, lo, n = c["row"][p], c["lo"][p], c["n"][p]
                own = [rows[r] for r in row.tolist()]
                data = b"".join(t[s : s + w + length - 1] for (_, t), s, w in zip(own, lo.tolist(), n.tolist(), strict=True))
                cols = {"id": np.array([i for i, _ in own], np.int64), "row": row, "lo": lo, "n": n, "anchor": c["anchor"][p]}
                out.append((int(c["anchor"][p[0]] >> np.uint64(32)), _packed(cols, _BYTES), data))
        return pa.Table.from_batches([_blobs({"bucket": "long", "held": "binary", "data": "binary"}, out)])

    return run


def _expand(shards: int, length: int):
    """A bucket's segments as bytes to the windows that go, by shard."""

    def run(held: list[pa.RecordBatch]) -> pa.Table:
        c = _unpacked(_column(held, "held"), _BYTES)
        data = np.frombuffer(b"".join(_column(held, "data")), np.uint8)
        held.clear()
        sizes = c["n"].astype(np.int64) + length - 1
        base = np.cumsum(np.r_[0, sizes[:-1]])
        order = np.argsort(c["anchor"], kind="stable")
        anchor = c["anchor"][order]
        whole = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(order)]
        reach = np.r_[0, np.cumsum(sizes[order])][whole]
        out, a = [], 0
        while a < len(whole) - 1:
            b = max(a + 1, int(np.searchsorted(reach, reach[a] + SORTED, side="right")) - 1)
            out += _removed(c, data, base, order[whole[a] : whole[b]], length)
            a = b
        gone = {k: np.concatenate([o[k] for o in out]) if out else np.empty(0, _GONE[k]) for k in _GONE}
        rows = [(int(gone["row"][p[0]] % shards), _packed({k: v[p] for k, v in gone.items()}, _GONE), b"") for p in _dealt(gone["row"] % shards)]
        return pa.Table.from_batches([_blobs({"shard": "long", "gone": "binary", "open": "binary"}, rows)])

    return run


def _removed(c: dict[str, np.ndarray], data: np.ndarray, base: np.ndarray, segs: np.ndarray, length: int) -> list[dict]:
    n = c["n"][segs].astype(np.int64)
    owner = np.repeat(np.arange(len(segs)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(np.r_[0, n[:-1]]), n)
    # windows that two documents may share, by hash; a segment is kept from its first to its last
    sizes = n + length - 1
    at = np.cumsum(np.r_[0, sizes[:-1]])
    buf = data[np.repeat(base[segs] - at, sizes) + np.arange(int(sizes.sum()))]
    start = at[owner] + inner
    hashes, ids = range_hashes(buf, start, start + length), c["id"][segs]
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    by = ids[owner[order]]
    live = np.zeros(len(owner), bool)
    live[order] = np.repeat(np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first), np.diff(np.r_[first, len(by)]))
    shared = np.flatnonzero(live)
    if not len(shared):
        return []
    mine, where = np.unique(owner[shared], return_index=True)
    lo = inner[shared[where]]
    hi = inner[shared[np.r_[where[1:], len(shared)] - 1]]
    # the text T, and its windows
    width = hi - lo + length
    begin = np.cumsum(np.r_[0, width[:-1] + 1])
    text = np.zeros(int(width.sum()) + len(mine), np.int16)
    spot = np.arange(int(width.sum())) - np.repeat(np.cumsum(np.r_[0, width[:-1]]), width)
    text[np.repeat(begin, width) + spot] = buf[np.repeat(at[mine] + lo, width) + spot].astype(np.int16) + 1
    kind, _ = equal_windows(text, length)
    count = hi - lo + 1
    seg = np.repeat(np.arange(len(mine)), count)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(np.r_[0, count[:-1]]), count)
    cls, doc = kind[begin[seg] + step], ids[mine][seg]
    least = np.full(int(kind.max()) + 1, _LAST, np.int64)
    np.minimum.at(least, cls, doc)
    gone = np.flatnonzero(doc > least[cls])
    if not len(gone):
        return []
    new = np.r_[True, (np.diff(gone) != 1) | (np.diff(seg[gone]) != 0)]
    a = gone[new]
    z = gone[np.r_[np.flatnonzero(new)[1:], len(gone)] - 1]
    own = segs[mine[seg[a]]]
    return [{"row": c["row"][own], "lo": c["lo"][own].astype(np.int64) + lo[seg[a]] + step[a], "n": step[z] - step[a] + 1}]


def equal_windows(t: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For a text of symbols (0 separates), the class of each position by its first bytes, and the common prefixes in suffix order, up to length."""
    n = len(t)
    packed = t.astype(np.int64)
    wide = np.r_[packed, np.zeros(7, np.int64)]
    rank = np.zeros(n, np.int64)
    for i in range(7):
        rank = rank * 257 + wide[i : i + n]
    depth = 7
    while True:  # suffix order by prefix doubling, as deep as the threshold
        order = np.argsort(rank)  # equal ones in any order
        dense = np.cumsum(np.r_[False, rank[order][1:] != rank[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if depth >= length or dense[-1] == n - 1:
            break
        nxt = np.zeros(n, np.int64)
        nxt[: n - depth] = rank[depth:] + 1
        rank, depth = rank * (n + 1) + nxt, 2 * depth
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # the place from which backward extension by its first symbol leads to a place
    source = place[np.minimum(order + 1, n - 1)].astype(np.int32)
    first = t[order]
    cut = np.r_[True, first[1:] != first[:-1]]
    lcp = np.where(cut, 0, -1)
    for value in range(1, length):
        group = np.cumsum(cut, dtype=np.int32)[source]
        new = cut | np.r_[True, group[1:] != group[:-1]]
        fresh = new & ~cut
        if not fresh.any():
            break
        lcp[fresh] = value
        cut = new
    return np.cumsum(cut)[place], lcp


def spans_of(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Ranges of window starts to the maximal runs of bytes [start, end) that they cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, the text as bytes and spans, the runs [start, end) of its bytes that go."""
    shards = buckets = units_of(docs, unit_bytes=UNIT)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    ).withColumn("shard", F.pmod("row", F.lit(shards)))
    texts = rows.groupBy("shard")
    scanned = rows.select("id", "row", "text").mapInArrow(_scan(buckets, shards, length, k), "bucket long, docs binary, seen binary, gone binary")
    settled = stored(_dealt_by_bucket(scanned, buckets).mapInArrow(_by_bucket(_settle(shards)), _OUT), "substring-settled")
    release(docs.sparkSession)  # the records were shuffled for this table alone
    wanted = settled.filter(F.length("open") > 0).groupBy("shard")
    fetched = texts.cogroup(wanted).applyInArrow(_fetch(length), "bucket long, held binary, data binary")
    found = _dealt_by_bucket(fetched, buckets).mapInArrow(_by_bucket(_expand(shards, length)), _OUT)
    gone = settled.filter(F.length("gone") > 0).unionByName(found).groupBy("shard")

    def cover(texts: pa.Table, gone: pa.Table) -> pa.Table:
        c = _unpacked(gone["gone"].to_pylist(), _GONE)
        by: dict[int, list] = {}
        for row, lo, n in zip(c["row"].tolist(), c["lo"].tolist(), c["n"].tolist(), strict=True):
            by.setdefault(row, []).append((lo, lo + n - 1))
        spans = [[{"start": s, "end": e} for s, e in spans_of(by.get(r, []), length)] for r in texts["row"].to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays([texts["doc_id"], texts["text"], pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    return texts.cogroup(gone).applyInArrow(cover, "doc_id long, text binary, spans array<struct<start:long,end:long>>")


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                left, at = hashlib.sha256(), 0
                for s in gone:
                    left.update(text[at : s["start"]])
                    at = s["end"]
                left.update(text[at:])
                rows.append((len(text), sum(s["end"] - s["start"] for s in gone), len(gone), left.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.mapInArrow(run, f"doc_id {spans.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_spans(table(spark, sf_dir, "documents")))
