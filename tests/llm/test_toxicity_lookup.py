"""Terms are found without a pass over all names, also where hashes clash, and bounds that are cut short lose no neighbour."""

import time

import numpy as np
from spanloom.llm import toxicity


def test_a_lookup_does_not_read_all_names():
    terms = {f"name{i}": 1 for i in range(200_000)}
    index = toxicity.Index([(1, 1, terms)], dict.fromkeys(terms, 1.0), 0.5, dense=1)
    index._numbers(["name5"])
    took = []
    for _ in range(9):
        began = time.perf_counter()
        found = index._numbers(["name77", None, "absent", "name199999"]).tolist()
        took.append(time.perf_counter() - began)
    assert [None if i < 0 else index.names[i].as_py() for i in found] == ["name77", None, None, "name199999"]
    assert min(took) < 0.004


def test_names_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(toxicity, "hash", lambda s: len(s) if s else 0, raising=False)
    names = ["aa", "bb", "ccc", "dddd", "eeee", "ffffff"]
    index = toxicity.Index([(1, 1, dict.fromkeys(names, 1))], dict.fromkeys(names, 1.0), 0.5)
    asked = ["bb", "aa", "zz", None, "ccc", "xxx", "eeee", "dddd", "ffffff", "ggggg"]
    assert [None if i < 0 else index.names[i].as_py() for i in index._numbers(asked)] == ["bb", "aa", None, None, "ccc", None, "eeee", "dddd", "ffffff", None]


def test_neighbours_are_exact_whether_bounds_rule_out_blocks_or_not():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(600)]
    tight = [(i, i % 2, {words[(i // 20 * 7 + j) % 600]: 1 + int(rng.integers(3)) for j in range(90)}) for i in range(400)]
    loose = [(i, i % 2, {words[j]: 1 for j in rng.integers(0, 600, 150)}) for i in range(400)]
    for examples in (tight, loose):
        index = toxicity.Index(examples, {w: 1.0 + k / 300 for k, w in enumerate(words)}, 0.5, k=5, block=8, dense=400 * 20)
        vectors = {i: index.vector(c) for i, _, c in examples}
        for i, _, counts in examples[::40]:
            mine = index.vector(counts)
            want = sorted((-round(sum(v * vectors[j].get(t, 0.0) for t, v in mine.items()), 9), j) for j in vectors)[:5]
            assert [(j, -s) for s, j in want] == [(index.ids[at], s) for s, at in index.nearest(counts)]
