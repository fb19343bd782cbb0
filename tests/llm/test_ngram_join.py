"""N-gram Jaccard join against brute force."""

import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest

from lakesift.llm import ngram_join as J


def brute(rows, words, pct):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]) and sets[i]:
                head[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return sorted(repr((k, len(s), low.get(find(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def families(seed, n):
    """Bases with copies that differ in a few words, around the similarity asked for."""
    r = random.Random(seed)
    rows = []
    for b in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 5, 9, 30, 80, 200, 400]))]
        for _ in range(r.choice([1, 2, 6, 12])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = f"v{r.randrange(9000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("words,pct", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, edges, words, pct):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    more = [(1000 + i, t) for i, t in families(words, 40)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = J.ngram_jaccard(table, J.Join(words, pct)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows + more, words, pct)


def test_pairs_are_verified_in_passes_of_bounded_bytes(spark, monkeypatch):
    made, stage = [], J.staged
    monkeypatch.setattr(J, "PASS_BYTES", 5000)
    monkeypatch.setattr(J, "VERIFY_SHARE", 0)
    monkeypatch.setattr(J, "staged", lambda df, name: made.append(name) or stage(df, name))
    rows = families(11, 12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = [(x, y) for x in range(len(rows)) for y in range(x)]
    classes = spark.createDataFrame([(i, t) for i, t in rows], "c bigint, text string").selectExpr("c", "xxhash64(text) h")
    some = random.Random(2).sample(pairs, 200)
    got = J.verify(docs, spark.createDataFrame(some, "x bigint, y bigint"), classes, J.Join(3, 60), "text").collect()
    sets = J.sets_of([t.encode() for _, t in rows], 3)
    inter = {(x, y): len(np.intersect1d(sets[x], sets[y])) for x, y in some}
    assert sorted(map(tuple, got)) == sorted(p for p, n in inter.items() if 100 * n >= 60 * (len(sets[p[0]]) + len(sets[p[1]]) - n))
    shipped = sum(len(rows[y][1].encode()) for _, y in some)
    assert made.count("links") == -(-shipped // 5000) > 2


def test_bitmaps_bound_the_distance_of_long_sets():
    r = np.random.default_rng(3)
    for size in (0, 1, 700, 2040, 2050, 9000):
        base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for share in (0, 0.05, 0.2, 0.5):
            kept = base[r.random(len(base)) >= share]
            other = np.unique(np.concatenate([kept, r.integers(0, 2**63, int(share * size), dtype=np.uint64)]))
            a, b, far = J.bitmap(base), J.bitmap(other), len(np.setxor1d(base, other))
            assert J.least_distance(a, b) == J.least_distance(b, a) <= far
            if size > 500 and share == 0.5:  # 1024 bits prove at most 1024 differences, half of them as a rule
                assert 180 * J.least_distance(a, b) > 20 * (len(base) + len(other))


def test_far_pairs_of_long_texts_ship_no_texts(spark, monkeypatch):
    """Texts of a family that share half of their words meet in buckets, but none is
    linked: their sets of 4,000 grams are too long for the fixed parity bits."""
    asked, verify = [], J.verify
    monkeypatch.setattr(J, "verify", lambda docs, pairs, *more: asked.append(pairs.count()) or verify(docs, pairs, *more))
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    rows = []
    for i in range(12):
        copy, at = list(base), r.randrange(4000)
        for j in range(at, at + 1300):
            copy[j % 4000] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows.append((12, rows[3][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = J.ngram_jaccard(docs, J.Join(5, 80)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(x)) for x in got) == brute(rows, 5, 80)
    assert len(asked) > 1 and sum(asked[1:]) <= 10, asked


@pytest.mark.parametrize("pct", [80, 85, 95])
def test_linked_sets_share_a_signature(pct):
    r = np.random.default_rng(pct)
    for size in (1, 5, 7, 12, 40, 150, 600):
        base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(25):
            n = len(base)
            drop = r.integers(0, max(1, n * (100 - pct) // 100) + 1)
            other = np.unique(np.concatenate([base[r.permutation(n)[drop:]], r.integers(0, 2**63, int(r.integers(0, 3)), dtype=np.uint64)]))
            inter = len(np.intersect1d(base, other))
            if 100 * inter < pct * (len(base) + len(other) - inter) or np.array_equal(base, other):
                continue
            for n_sets in (10, 10**6):
                more = J.bands(pct, 2 * size + 5)
                plans = {j: J.plan_band(pct, lo, hi, n_sets) for j, (lo, hi) in enumerate(more) if J.distance(pct, hi)}
                a, b = (set(J.signatures([s], plans, pct)[0].tolist()) for s in (base, other))
                assert a & b, (size, drop, n_sets)


def test_plans_cover_the_distance():
    for low, high in J.bands(85, 3000):
        k = J.distance(85, high)
        for n_sets in (1, 10**4, 10**9):
            n1, n2, k2 = J.plan_band(85, low, high, n_sets)
            assert n1 * (k2 + 1) > k and n2 > k2


def test_a_band_larger_than_a_pass_comes_in_shares():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (120, 130, 140, 300, 310)]
    more = J.bands(80, 400)
    plans = {j: J.plan_band(80, lo, hi, 1000) for j, (lo, hi) in enumerate(more) if hi > 100}
    per_set = {j: n1 * comb(n2, k2) for j, (n1, n2, k2) in plans.items()}
    rows = {j: 1000 * n for j, n in per_set.items()}
    limit = 1000 * 20 * J.ROW_BYTES  # twenty signatures a set
    passes = J.pass_plans(plans, rows, limit)
    for plan in passes:  # shares differ a little in size
        assert max(Counter(J.signatures(sets, plan, 80)[1].tolist()).values(), default=0) <= 25
    whole = Counter(zip(*(x.tolist() for x in J.signatures(sets, plans, 80))))
    parts = [Counter(zip(*(x.tolist() for x in J.signatures(sets, plan, 80)))) for plan in passes]
    assert len(passes) > len(plans) and sum(parts, Counter()) == whole


@pytest.mark.parametrize("pct", [80, 85])
def test_signatures_hardly_lengthen_with_the_number_of_sets(pct):
    r = np.random.default_rng(5)
    for j, (low, high) in enumerate(J.bands(pct, 1500)):
        if low < 45:
            continue
        few, many = (J.plan_band(pct, low, high, n) for n in (10**4, 10**6))
        size = [n1 * comb(n2, k2) for n1, n2, k2 in (few, many)]
        assert size[1] <= 1.4 * size[0], (low, few, many)
        sets = [np.unique(r.integers(0, 2**64 - 1, low, dtype=np.uint64)) for _ in range(60)]
        got = J.signatures(sets, {j: few}, pct)[0]  # disjoint sets don't meet by their empty parts
        assert len(got) - len(set(got.tolist())) <= len(got) / 500


def test_a_family_whose_smallest_class_is_far_does_not_expand_into_pairs(spark, monkeypatch):
    """Copies with two changed words are linked with those that have one, not with each other."""
    near, stage = [], J.staged

    def staged(df, name):
        out = stage(df, name)
        near.extend([out.count()] if name == "near" else [])
        return out

    monkeypatch.setattr(J, "staged", staged)
    r = random.Random(6)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(155)], []
    for i in range(150):
        copy = list(base)
        for at in r.sample(range(5, 150), 1 if i % 3 == 0 else 2):
            copy[at] = f"v{i}x{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = J.ngram_jaccard(docs, J.Join(4, 85)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(x)) for x in got) == brute(rows, 4, 85)
    assert sum(near) < len(rows), near
