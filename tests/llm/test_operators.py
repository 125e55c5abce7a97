"""Each operator against a brute-force version, SQL or an exact round trip, and on nulls, empties, ties and repeated rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from spanloom.llm import chat_format, exact_dedup, language_id, mixing, near_dedup, packing, substring_dedup, token_counts, topk, toxicity
from spanloom.llm.common import prepare
from spanloom.llm.queries import oracle_sql, queries

ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, h string, row string, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, ties, and columns with clashing names."""
    prepare(spark)
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (5, "one  two"), (None, "one two three four five six"), (6, "ONE two three four five six"), (7, long), (8, long + " end"), (9, "é" * 60), (10, "é" * 60 + "x")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "l", 0.5, "h", "r", 2) for i, t in texts], ODD)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(agree, name):
    agree(queries()[name], oracle_sql()[name])


def brute_removed(rows, length=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op10_substring_dedup"](spark, SF).collect())) == brute_removed(docs)


def test_substrings_odd(spark, odd, empty):
    texts = [r["text"] for r in odd.collect()]
    rows = [(i if i is not None else 1 << 62, (t or "")[:3000].encode()) for i, t in zip([r["doc_id"] for r in odd.collect()], texts, strict=True)]
    short = spark.createDataFrame([(None if i == 1 << 62 else i, t.decode()) for i, t in rows], "doc_id long, text string")
    got = sorted((r[0] if r[0] is not None else 1 << 62, *r[1:]) for r in substring_dedup.digests(substring_dedup.repeated_spans(short)).collect())
    assert got == brute_removed(rows) and sum(r[2] for r in got) > 2000
    assert substring_dedup.digests(substring_dedup.repeated_spans(empty)).count() == 0


def test_substrings_under_one_frequent_line(spark):
    """A line that many documents have, with other words about it in each: all under one anchor."""
    line = "this line of words is in every document of the table, and it is longer than fifty bytes by far"
    rows = [(i, f"{hashlib.md5(bytes([i])).hexdigest()} {line} {hashlib.sha1(bytes([i])).hexdigest()}".encode()) for i in range(60)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.digests(substring_dedup.repeated_spans(df)).collect())
    assert got == brute_removed(rows) and all(r[2] >= len(line) for r in got[1:])


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_groups(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op7_near_dedup"](spark, SF).collect())) == brute_groups(docs)


def test_near_groups_odd(odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.group_rows(odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[4] == (1, 4) and got[5] == (1, 4) and got[8][1] == 7 and got[None][1] is None
    assert near_dedup.group_rows(empty).count() == 0


def test_sketch_agrees_as_similarity():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    x, y = near_dedup.sketch(np.r_[common, a]), near_dedup.sketch(np.r_[common, b])
    assert abs((x == y).mean() - 0.75) < 0.1 and (near_dedup.sketch(common[:1]) < (1 << 64) - 1).all()


def test_exact_dedup_odd(odd, empty):
    got = {(r["doc_id"], r["text"]) for r in exact_dedup.dedup(odd).select("doc_id", "text").collect()}
    assert {i for i, _ in got} == {1, 3, 4, None, 6, 7, 8, 9, 10}
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.dedup(odd).columns == odd.columns


def test_exact_dedup_checks_bytes_and_batches(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    odd.select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "d"))
    plain = lambda df: sorted(map(repr, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    want = plain(exact_dedup.dedup_files(spark, str(tmp_path / "d")))
    assert plain(exact_dedup.dedup_files(spark, str(tmp_path / "d"), digest=lambda n: F.concat(F.lit("00000000"), F.lpad(F.length(n).cast("string"), 8, "0")))) == want
    assert plain(exact_dedup.dedup_files(spark, str(tmp_path / "d"), files_per_batch=1)) == want


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.word_encoder(packing.tokenizer_path())
    for t in ["", "Hello, World. it's o'clock 12 a.b", "İstanbul ΣΑΣ ﬁ éx ǆ", "x<|endoftext|>y", "tab\tnew\nline nbsp"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    rows = packing.pack(odd).collect()
    lengths = {}
    for r in rows:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    one = [r for r in rows if r["doc_id"] == 1]
    assert len(one) == 1 and one[0]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
    assert packing.pack(empty).count() == 0


def test_plan_places_every_token_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9000, 300).tolist()
    seen = [np.zeros(n, int) for n in lengths]
    for seq in packing.plan(lengths):
        n = sum(p[2] for p in seq)
        assert n == 4096 or n & (n - 1) == 0
        for i, s, k in seq:
            seen[i][s : s + k] += 1
    assert all((x == 1).all() for x in seen)


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_match_a_unigram_tokenizer(fallback):
    from tokenizers import Tokenizer, models

    pieces = token_counts.vocabulary()
    extra = [(f"<0x{i:02X}>", -1e6) for i in range(256)] if fallback else []
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *extra], 0, fallback))
    # the added pieces must not lower the least score
    least = min(s for _, s in pieces)
    assert not extra or least <= -1e6
    count = token_counts.counter(pieces, fallback)
    for word in ["▁hello", "▁thohawhre", "▁größe", "▁漢字かな", "▁á̂z", "▁🙂🙂x", "▁the,", "▁aaaaaaa", "▁"]:
        assert count(word)[0] == len(tok.encode(word).ids), word


def test_token_counts_odd(odd, empty):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(odd, token_counts.vocabulary()).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_words"] == 0 and got[7]["n_words"] == 40_000
    assert token_counts.count_tokens(empty, token_counts.vocabulary()).count() == 0


def test_topk_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(90)] + [(100, None), (101, [float("nan")] * 8), (102, [None] + [1.0] * 7), (103, [1.0, 2.0]), (None, [0.0] * 8)]
    rows += [(200, rows[3][1]), (201, rows[3][1])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, row_block=16, query_block=2).collect())
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ x), i) for i, x in good if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(30)]
    examples = [(i, i % 2, {w: int(rng.integers(1, 4)) for w in rng.choice(words, 4, replace=False)}) for i in range(300)]
    index = toxicity.Index(examples, {w: 1.0 + k / 30 for k, w in enumerate(words)}, 0.5, k=5, block=16)
    for _ in range(20):
        query = {w: 1 for w in rng.choice(words, 3, replace=False)}
        v = index.vector(query)
        every = sorted((-round(sum(v.get(t, 0) * x for t, x in index.vector(c).items()), 9), i) for i, _, c in examples)
        assert [(-round(s, 9), index.ids[at]) for s, at in index.nearest(query)] == [e for e in every if e[0] < 0][:5]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op5_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.97 and got.score.between(0, 1).all()


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    index = toxicity.fit(odd, labels)
    assert toxicity.score(odd, index).count() == odd.count() and toxicity.score(empty, index).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.0}


def test_language_held_out(spark):
    got = queries()["op6_language_id"](spark, "/root/testdata/sf0.01").filter("held_out")
    got = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_language_odd(odd, empty):
    model = language_id.fit(odd)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "en"
    assert language_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rates = mixing.rates(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    p, total = np.stack(rates.p), rates.n_tokens.sum()
    have = (rates.rate * rates.n_tokens).values @ p / total
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(have - want / want.sum()).max() < 1e-4 and (rates.rate >= 0).all()


def test_mixing_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0, 1), (6, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, labels).columns == odd.columns
    assert mixing.mix(empty, labels).count() == 0 and mixing.rates(odd, labels.limit(0)).count() == odd.count()


def test_chat_odd(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 1, None, "<|x"), (1, 1, None, "<|x"), (None, 0, "a", "alone"), (2, 0, "system", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.perspectives(turns, chunk=2).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "a"), (1, "b"), (1, "unknown"), (None, "a")}
    for r in got:
        for s, e in zip(r["mask_starts"], r["mask_ends"], strict=True):
            assert r["text"][:s].endswith("<|im_start|>assistant\n") and r["text"][s:e].endswith("<|im_end|>")
    assert chat_format.perspectives(turns.limit(0)).count() == 0
