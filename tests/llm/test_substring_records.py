"""Records of repeated substrings are small once they are compressed, as they are when shuffled, and come back whole."""

import numpy as np
import pyarrow as pa
from spanloom.llm import substring_dedup as sd


def test_records_come_back_from_several_blobs():
    rng = np.random.default_rng(1)
    parts = [{c: rng.integers(0, np.iinfo(t).max, n, dtype=t) for c, t in sd._SEEN.items()} for n in (0, 1, 700)]
    got = sd._unpacked([sd._packed(p, sd._SEEN) for p in parts], sd._SEEN)
    for c, t in sd._SEEN.items():
        assert got[c].dtype == np.dtype(t) and got[c].tolist() == np.concatenate([p[c] for p in parts]).tolist()
    assert sd._unpacked([], sd._GONE)["row"].tolist() == []
    gone = {"row": np.array([-1, -(1 << 63), 5]), "lo": np.array([0, 1 << 40, 3]), "n": np.array([1, 35, 255])}
    assert {c: v.tolist() for c, v in sd._unpacked([sd._packed(gone, sd._GONE)], sd._GONE).items()} == {c: v.tolist() for c, v in gone.items()}


def test_scanned_records_are_small():
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 250)).encode() for _ in range(1000)]
    ids = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(rng.integers(-(1 << 63), (1 << 63) - 1, 1000)), pa.array(texts, pa.binary())], names=["id", "row", "text"])
    out = pa.Table.from_batches(list(sd._scan(16, 16, sd.LENGTH, sd.K)(iter([batch]))))
    size = sum(len(pa.compress(x, codec="lz4_raw", asbytes=True)) for c in ("docs", "seen", "gone") for x in out[c].to_pylist() if x)
    assert size < 1.1 * sum(map(len, texts))


def test_the_scan_leaves_no_shuffle_files(spark):
    import os
    import time

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))) for i in range(200)], "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = manager.getAllFiles()
        found = (files.apply(i).getPath() for i in range(files.size()))
        return {f: os.path.getsize(f) for f in found if f.endswith(".data") and os.path.exists(f)}

    before = held()
    sd.repeated_spans(docs)
    for _ in range(40):
        left = sum(n for f, n in held().items() if f not in before)
        if left < 100_000:
            break
        time.sleep(0.25)
    assert left < 100_000
