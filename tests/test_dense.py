"""Dense vectors from the lake's co-occurrences, against numpy on small lakes."""

import math
import random
import re

import numpy as np
import pytest

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.operators import dense as dn
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake

WORDS = "red green blue apple pear plum river lake sea dog cat cow one two three".split()


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("dense"), random.Random(4)
    for t in range(4):
        near = WORDS[(t % 3) * 5:(t % 3) * 5 + 7]
        rows = [[" ".join(r.choices(near, k=r.randint(1, 6))), r.choice(WORDS), str(r.randint(0, 99))] for _ in range(60)]
        write_csv(folder / f"t{t}.csv", ["colour of fruit", f"animal {t % 2}", "n"], rows)
    return LakeState(Lake.from_folder(spark, str(folder), fmt="csv"), ScoreConfig())


def pairs_by_hand(samples, columns, window):
    n = {}
    name = {(r["table_idx"], r["col_idx"]): r["column_name"] for r in columns}
    split = lambda s: [t for t in re.split(r"[^a-z0-9]+", s.lower()) if t]
    for r in samples:
        toks = split(r["value"])
        met = [(x, y) for i, x in enumerate(toks) for y in toks[i + 1:i + 1 + window]]
        met += [(x, y) for x in toks for y in set(split(name[r["table_idx"], r["col_idx"]]))]
        for x, y in met:
            if x != y:
                n[min(x, y), max(x, y)] = n.get((min(x, y), max(x, y)), 0) + 1
    return n


def matrix_of(weights):
    tokens = sorted({r["a"] for r in weights})
    place = {t: i for i, t in enumerate(tokens)}
    w = np.zeros((len(tokens),) * 2)
    for r in weights:
        w[place[r["a"]], place[r["b"]]] = r["w"]
    return tokens, w


def test_weights_equal_their_definition(state):
    cfg = dn.DenseConfig(window=2, min_count=4)
    pairs = dn.token_pairs(state.samples, state.profiles.columns, cfg)
    want = pairs_by_hand(state.samples.collect(), state.profiles.columns.collect(), 2)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == want
    sums = {}
    for (a, b), n in want.items():
        sums[a], sums[b] = sums.get(a, 0) + n, sums.get(b, 0) + n
    kept = {p: n for p, n in want.items() if sums[p[0]] >= 4 and sums[p[1]] >= 4}
    own = {}
    for (a, b), n in kept.items():
        own[a], own[b] = own.get(a, 0) + n, own.get(b, 0) + n
    total = sum(own.values())
    ppmi = {p: math.log(n * total / (own[p[0]] * own[p[1]])) for p, n in kept.items()}
    got = {(r["a"], r["b"]): r["w"] for r in dn.ppmi(pairs, cfg).collect()}
    assert got.keys() == {x for (a, b), v in ppmi.items() if v > 0 for x in ((a, b), (b, a))}
    assert all(abs(v - ppmi[min(p), max(p)]) < 1e-12 for p, v in got.items())


@pytest.mark.parametrize("block", [4, 2048])
def test_vectors_equal_numpy_up_to_sign(state, monkeypatch, block):
    monkeypatch.setattr(dn, "BLOCK_TOKENS", block)
    cfg = dn.DenseConfig(min_count=2, dim=5, more=8, tolerance=1e-11, rounds=80)
    weights = dn.ppmi(dn.token_pairs(state.samples, state.profiles.columns, cfg), cfg)
    tokens, w = matrix_of(weights.collect())
    got = {r["token"]: r["vec"] for r in dn.token_vectors(weights, cfg).collect()}
    assert sorted(got) == tokens
    u, s, _ = np.linalg.svd(w)
    mine = np.array([got[t] for t in tokens])
    for d in range(5):
        gap = min(abs(s[d] - s[x]) for x in range(len(s)) if x != d)
        want = u[:, d] * math.sqrt(s[d])
        assert abs(np.linalg.norm(mine[:, d]) - math.sqrt(s[d])) < 1e-5
        if gap > 1e-2 * s[0]:
            assert min(np.abs(mine[:, d] - want).max(), np.abs(mine[:, d] + want).max()) < 1e-4


def test_text_vectors_are_weighted_sums(state):
    cfg = dn.DenseConfig(min_count=2, dim=4, more=4)
    weights = dn.ppmi(dn.token_pairs(state.samples, state.profiles.columns, cfg), cfg)
    vectors = dn.token_vectors(weights, cfg)
    known = {r["token"]: np.array(r["vec"]) for r in vectors.collect()}
    counts = dn.column_tokens(state.profiles, state.samples)
    rows = counts.collect()
    share, total = {}, sum(r["n"] for r in rows)
    for r in rows:
        share[r["token"]] = share.get(r["token"], 0) + r["n"]
    want = {}
    for r in rows:
        if r["token"] in known:
            key = r["table_idx"], r["col_idx"]
            weight = cfg.rare / (cfg.rare + share[r["token"]] / total)
            want[key] = want.get(key, 0) + r["n"] * weight * known[r["token"]]
    # vectors were made twice: compare lengths and products, which no sign changes
    got = {(r["table_idx"], r["col_idx"]): np.array(r["vec"]) for r in dn.text_vectors(
        counts, ["table_idx", "col_idx"], vectors, state.profiles.columns, cfg).collect()}
    assert got.keys() == {(r["table_idx"], r["col_idx"]) for r in state.profiles.columns.collect()}
    for a in want:
        for b in want:
            assert abs(got[a] @ got[b] - want[a] @ want[b]) < 1e-4 * max(1, abs(want[a] @ want[b]))


def test_labels_with_dense_vectors(state):
    labels = state.with_config(ScoreConfig(embedder=dn.DenseConfig(min_count=2, dim=6, more=4))).labels().collect()
    scores = {(r["query_table"], r["candidate_table"]): r["semantic_table"] for r in labels}
    assert len(labels) == 16 and all(abs(scores[t, t] - 1) < 1e-6 for t, _ in scores)
    assert all(scores[a, b] == scores[b, a] and 0 <= scores[a, b] <= 1 for a, b in scores)
    # t0 and t3 draw from the same words
    assert scores["t0.csv", "t3.csv"] > max(scores["t0.csv", "t1.csv"], scores["t0.csv", "t2.csv"])
