"""The mixing fit against brute force, and on domains that the documents can't supply."""

import numpy as np
import pytest
from conftest import SF

from spanloom.llm import mixing
from spanloom.llm.common import prepare

KIND = "doc_id long, n_tokens long, p array<double>"


def members(spark, n, p):
    return spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], KIND)


def brute(n, p, goal):
    """Plain projected gradient on the rates themselves, with the pull."""
    total, r = n.sum(), np.ones(len(n))
    z, t = r.copy(), 1.0
    for _ in range(60_000):
        slope = p @ ((n * z) @ p / total - goal) + mixing.PULL * (z - 1)
        new = np.clip(z - slope / (1 + mixing.PULL), 0, mixing.MOST)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, r = new + (before - 1) / t * (new - r), new
    return r


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rates_are_those_of_a_plain_fit(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 400, 60).astype(float)
    p = rng.dirichlet([2.0, 0.3, 0.3], 60)
    monkeypatch.setattr(mixing, "NEAR", 0.0)  # goals aren't moved: the pulled objective itself
    fit = mixing.solve(members(spark, n, p), mixing.TARGETS)
    have = n @ p / n.sum()
    got = np.clip(1 + p @ fit.y, 0, mixing.MOST)
    assert fit.converged and np.abs(got - brute(n, p, mixing.goals(have, mixing.TARGETS, 1.0)[1])).max() < 1e-4


def test_targets_in_reach_are_met(spark):
    rng = np.random.default_rng(5)
    p = np.eye(3)[rng.integers(0, 3, 90)] * 0.99 + 0.01 / 3
    fit = mixing.solve(members(spark, rng.integers(1, 400, 90), p), mixing.TARGETS)
    assert fit.converged and max(map(abs, fit.missing().values())) < 1e-5


def test_targets_just_out_of_reach_end(spark):
    """Each row has more of a domain than its target: the fit ends, and says what is missed."""
    p = np.eye(3)[np.arange(90) % 3] * 0.9 + 0.1 / 3
    fit = mixing.solve(members(spark, np.full(90, 100), p), mixing.TARGETS)
    assert fit.converged and fit.missing()["toxic"] < -0.02


def test_a_domain_without_supply_is_left_unmet(spark):
    """One short row of a domain must not be copied at will, nor push the others out."""
    n = np.array([400.0] * 800 + [1.0])
    p = np.array([[1 - 2e-6, 1e-6, 1e-6]] * 800 + [[0.2, 0.7, 0.1]])
    fit = mixing.solve(members(spark, n, p), mixing.TARGETS)
    rate = np.clip(1 + p @ fit.y, 0, mixing.MOST)
    assert np.abs(rate[:800] - 1).max() < 0.05 and rate[800] <= mixing.MOST
    assert fit.missing()["low"] == pytest.approx(0.03, abs=1e-3) and fit.missing()["toxic"] == pytest.approx(0.01, abs=1e-3)


def test_short_odd_row_beside_good_documents(spark):
    prepare(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.filter("toxic = 0 AND quality = 1"), "doc_id").select("doc_id", "text")
    odd = good.unionByName(spark.createDataFrame([(10**9, "zq")], "doc_id long, text string"))
    rates = mixing.rates(odd, labels).toPandas()
    assert rates.rate.between(0.5, 2.0).all() and rates.copies.sum() <= 1.2 * len(rates)


def test_mix_repeats_rows_and_keeps_columns(spark):
    prepare(spark)
    rows = [(i, "alpha beta gamma delta", i, 1, 2, 3, 4) for i in range(40)] + [(40, None, 0, 1, 2, 3, 4), (None, "", 0, 1, 2, 3, 4), (3, "other text", 0, 1, 2, 3, 4), (3, "other text", 0, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, p int, copy int, _key int, _copies int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, {"high": 1.0}, budget=2.0)
    assert out.columns == docs.columns
    assert out.filter("doc_id < 40 AND doc_id <> 3").count() == 78  # each twice
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_whole_query_agrees_with_its_rates(spark):
    from spanloom.llm.queries import queries

    got = queries()["op8_mixing"](spark, SF).toPandas()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and np.allclose(p.sum(1), 1)
    have = (got.rate * got.n_tokens).to_numpy() @ p / got.n_tokens.sum()
    missed = got[[f"missed_{d}" for d in mixing.DOMAINS]].to_numpy()[0]
    assert got.converged.all() and np.allclose(have + missed, [0.96, 0.03, 0.01], atol=1e-9) and (np.abs(got.copies - got.rate) < 1).all()
