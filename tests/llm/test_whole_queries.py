"""Whole queries against brute force over every row and text of a small table."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from spanloom.llm import chat_format, language_id, packing, token_counts, toxicity
from spanloom.llm.common import prepare
from spanloom.llm.queries import queries


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op3_is_the_tokenizers_ids_without_padding(spark, docs):
    from tokenizers import Tokenizer

    tok, size = Tokenizer.from_file(packing.tokenizer_path()), packing.SEQUENCE
    got = queries()["op3_packing"](spark, SF).toPandas()
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in docs.items()}
    assert set(got.doc_id) == set(ids)
    for i, own in got.groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for start, n, crc, total in zip(own.start, own.length, own.ids_crc32, own.doc_tokens, strict=True):
            assert (start, total) == (at, len(ids[i])) and crc == zlib.crc32(ids[i][start : start + n].tobytes())
            at += n
        assert at == len(ids[i])
    lengths = []
    for _, own in got.groupby("sequence_id"):
        own, at = own.sort_values("offset"), 0
        for offset, n in zip(own.offset, own.length, strict=True):
            assert offset == at
            at += n
        lengths.append(at)
    assert all(n == size or n & (n - 1) == 0 and n < size for n in lengths)


def test_op3_deals_copies_to_all_groups(spark, tmp_path):
    """A third of all rows are one row."""
    rows = [(1, "copy of one row " * 40)] * 400 + [(i, f"row {i} " * 80) for i in range(2, 802)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "d")), unit_bytes=40_000).filter("doc_id = 1").toPandas()
    groups = (got.sequence_id // (1 << 32)).value_counts()
    assert len(groups) > 5 and groups.max() < 2.5 * groups.mean() and (got.start == 0).sum() == 400


def brute_unigram(word, pieces, least):
    """Best score and number of pieces by plain dynamic programming over all substrings."""
    best, count = [0.0] + [None] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(end):  # an earlier start keeps the place on a tie
            s = pieces.get(word[start:end])
            if s is not None and (best[end] is None or best[start] + s > best[end]):
                best[end], count[end] = best[start] + s, count[start] + 1
        if word[end - 1] not in pieces and (best[end] is None or best[end - 1] + least > best[end]):
            best[end], count[end] = best[end - 1] + least, count[end - 1] + len(word[end - 1].encode())
    return count[-1], best[-1]


def test_op4_counts_and_scores(spark, docs):
    pieces = dict(token_counts.vocabulary())
    least, known = min(pieces.values()) - token_counts.PENALTY, {}
    got = {r["doc_id"]: r for r in queries()["op4_token_counts"](spark, SF).collect()}
    assert set(got) == set(docs)
    some = sorted(docs, key=lambda i: zlib.crc32(str(i).encode()))[:60]  # brute force is slow; each text is whole
    for i in some:
        words = Counter(w for w in token_counts.SPACE.split(docs[i]) if w)
        for w in words:
            if w not in known:
                known[w] = brute_unigram(token_counts.MARK + w, pieces, least)
        assert got[i]["n_words"] == words.total() and got[i]["n_tokens"] == sum(n * known[w][0] for w, n in words.items())
        assert math.isclose(got[i]["score"], sum(n * known[w][1] for w, n in words.items()), rel_tol=1e-9, abs_tol=1e-6)


def test_op5_votes_of_the_nearest_of_all_examples(spark, docs):
    index = toxicity.learnt(spark, SF)
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(index.ids) <= {i for i in labels if zlib.crc32(str(i).encode()) % 5} and len(index.ids) > 40
    vectors = [index.vector(toxicity.terms_of(docs[i])) for i in index.ids]
    got = {r["doc_id"]: r for r in queries()["op5_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        v = index.vector(toxicity.terms_of(text))
        near = sorted((-round(sum(w * x.get(t, 0.0) for t, w in v.items()), 9), j, y) for j, y, x in zip(index.ids, index.labels, vectors, strict=True))[: toxicity.NEIGHBOURS]
        near = [n for n in near if n[0] < 0]
        votes = index.share * toxicity.PRIOR + sum(-s * y for s, _, y in near)
        assert got[i]["score"] == pytest.approx(votes / (toxicity.PRIOR - sum(s for s, _, _ in near)), abs=1e-6), i
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_op6_scores_words_first(spark, docs):
    train = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL").toPandas()
    train = train[[zlib.crc32(str(i).encode()) % 3 != 1 for i in train.doc_id]]
    langs = sorted(set(train.lang))
    words = {w: np.zeros(len(langs)) for t in train.text for w in language_id.words_of(t)}
    for lang, t in zip(train.lang, train.text, strict=True):
        for w in language_id.words_of(t):
            words[w][langs.index(lang)] += 1
    grams: dict = {}
    for w, n in words.items():
        for size in range(1, language_id.LONGEST + 1):
            for g in language_id.grams_of(w, size):
                grams.setdefault(size, {}).setdefault(g, np.zeros(len(langs)))[:] += n
    logs = lambda d: dict(zip(d, np.log((np.array(list(d.values())) + 0.5) / (sum(d.values()) + 1)), strict=True))
    words, grams = logs(words), {size: logs(d) for size, d in grams.items()}

    def word(w):
        if w in words:
            return words[w]
        for size in range(language_id.LONGEST, 0, -1):
            known = [grams[size][g] for g in language_id.grams_of(w, size) if g in grams[size]]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    got = {r["doc_id"]: r for r in queries()["op6_language_id"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        own = [w for w in language_id.words_of(text) if any(c.isalpha() for c in w)]
        if not own:
            assert got[i]["lang_pred"] == "und"
            continue
        x = np.sum([word(w) for w in own], axis=0) / len(own) * min(len(own), language_id.CERTAIN)
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert got[i]["lang_pred"] == langs[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-6)


def test_op6_keeps_a_small_languages_words(spark, monkeypatch):
    prepare(spark)
    rows = [(i, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{c}" for c in "abcdefgh"), "en") for i in range(400)] + [(1000 + i, "zu mala neno refu", "zz") for i in range(4)]
    monkeypatch.setattr(language_id, "WORDS", 200)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "zz"] and {"mala", "neno", "refu"} <= set(model.words) and len(model.words) <= 200


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_op2_ranks_are_gapless_however_it_is_planned(spark, reuse, adaptive):
    prepare(spark)
    turns = spark.createDataFrame([(c, t, "ab"[t % 2], f"t{t}") for c in range(3) for t in range(500 if c else 3000)], "conv_id long, turn long, role string, text string").repartition(7)
    held = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        ranks = chat_format._ranked(turns).select("conv_id", "turn", "rank").collect()
        assert len(ranks) == 4000 and all(r["rank"] == r["turn"] for r in ranks)
        assert chat_format.perspectives(turns).agg({"n_turns": "sum"}).first()[0] == 8000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_confirmed_on_words():
    from spanloom.llm.near_dedup import confirmed

    a = " ".join(f"w{i}" for i in range(100)).encode()
    assert confirmed(a, a) and confirmed(a, a + b" x y") and not confirmed(a, b" ".join(reversed(a.split()))) and confirmed(b"one two", b"one two") and not confirmed(b"one two", a)


def test_long_text_in_parts_has_the_same_shingles(monkeypatch):
    from spanloom.llm import near_dedup

    text = b" ".join(f"w{i % 701}x{i % 13}".encode() for i in range(5000))
    whole = near_dedup.shingles([text])[0]
    monkeypatch.setattr(near_dedup, "CHUNK", 1000)
    assert (near_dedup.shingles([text])[0] == whole).all() and len(near_dedup.shingles([text, b"a b c d e f"])[1]) == 2
