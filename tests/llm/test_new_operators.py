"""Transducers and the divergence audit, SetSketch near duplicates, multi-index
hard negatives: against DuckDB, brute force and their own bounds."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakesift.llm import divergence, multi_index, setsketch
from lakesift.llm.common import word_spans
from lakesift.llm.ngram_join import Join
from lakesift.llm.oracle import ORACLE_SQL
from lakesift.llm.queries import QUERIES
from lakesift.llm.transducer import Builder, Transducers, first_key

from .conftest import same
from .test_ngram_join import brute, families

# --- transducers ----------------------------------------------------------------


def built(words, cuts):
    parts, i = [], 0
    step = max(1, -(-len(words) // cuts))
    while i < len(words):
        j = min(len(words), i + step)
        while j < len(words) and first_key(words[j]) == first_key(words[j - 1]):
            j += 1
        b = Builder()
        for w in words[i:j]:
            b.add(w)
        parts.append(("x", first_key(words[i]), i, b.finish()))
        i = j
    return parts


@pytest.mark.parametrize("n,cuts", [(1, 1), (7, 1), (300, 1), (4000, 1), (4000, 4)])
def test_ordinals_are_places_in_byte_order(n, cuts):
    r = random.Random(n)
    words = sorted({"".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 12))).encode() for _ in range(n)})
    t = Transducers(built(words, cuts))
    tried = words + [w + b"a" for w in words] + [w[:-1] for w in words if len(w) > 1] + [b"z" * 500]
    buf, starts, ends, offsets = word_spans([b" ".join(tried), b"a b"])
    place = {w: i for i, w in enumerate(words)}
    tokens = bytes(buf).split()
    got = t.ordinals(buf, starts, ends, ["x", "no transducer"], offsets).tolist()
    assert got == [place.get(w, -1) for w in tokens[: offsets[1]]] + [-1, -1]
    assert [t.term("x", i) for i in range(len(words))] == words
    assert t.term("x", len(words)) is None and t.term("y", 0) is None


def test_transducer_is_minimal():
    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 6)).encode() for i in range(90)})
    b = Builder()
    for w in words:
        b.add(w)
    b.finish()
    rests = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(b.states) == len(rests)


# --- divergence audit ------------------------------------------------------------

def audit_by_hand(rows, min_docs, smooth, top):
    found, seen, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        found.update((lang, source, w) for w in words)
        seen.update((lang, w) for w in set(words))
    kept = {}
    for (lang, w), n in seen.items():
        if n >= min_docs:
            kept.setdefault(lang, set()).add(w)

    def shares(lang, count):
        terms = kept.get(lang, set())
        total = sum(count(w) for w in terms) + smooth * len(terms)
        return {w: 1 + 10**9 * (count(w) + smooth) // total for w in terms}

    p = {g: shares(g[0], lambda w, g=g: found[(*g, w)]) for g in groups}
    q = {lang: shares(lang, lambda w, lang=lang: sum(found[(a, s, w)] for a, s in groups if a == lang)) for lang, _ in groups}
    out = []
    for lang, source in groups:
        pairs = [(t, sum(abs(p[lang, source][w] - p[lang, t][w]) for w in kept.get(lang, ()))) for a, t in groups if a == lang and t != source]
        terms = [(w, x - q[lang][w]) for w, x in p[lang, source].items() if found[lang, source, w] and x > q[lang][w]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_the_definition(spark, edges, monkeypatch, small):
    if small:  # several transducers, passes and blocks of terms and sources
        for name, value in (("SHARD_TERMS", 20), ("PASS_BYTES", 20000), ("TERM_BLOCK", 16), ("SOURCE_BLOCK", 2), ("CHUNK_ROWS", 50)):
            monkeypatch.setattr(divergence, name, value)
    r = random.Random(4)
    pool = ["".join(r.choice("abcé字Z") for _ in range(r.randint(1, 10))) for _ in range(150)]
    rows = [(r.choice(["en", "fr", None]), r.choice(["a", "b", "é", "web", None]), " ".join(r.choices(pool, k=r.randint(0, 60)))) for _ in range(150)]
    rows += [("zz", "only", "one two"), ("yy", "a", None), ("yy", "b", "1 2 3"), ("en", "late", "")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, source string, text string, n int, ord int")
    got = divergence.divergence_audit(docs.repartition(5), divergence.Audit(min_docs=9, top=7))
    got = sorted(repr(tuple(x)) for x in got.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audit_by_hand(rows, 9, 5, 7)


def test_distances_of_blocks_add_up_in_any_order_of_rows(monkeypatch):
    monkeypatch.setattr(divergence, "TERM_BLOCK", 2)
    audit, total, v, n = divergence.Audit(), {"é": 30, "b": 31, "a": 32}, 4, {"é": [9, 0, 1, 0], "b": [1, 2, 3, 5], "a": [0, 7, 0, 5]}
    kernel, sums = divergence._distance_kernel(audit), Counter()
    for block, sources in enumerate((["é", "b", "a"], ["a", "é", "b"])):
        rows = [{"lang": "x", "a": 0, "b": 0, "block": block, "source": s, "side": 0, "total": total[s], "v": v, "ord": o, "n": c}
                for s in sources for o, c in [(0, 0), *((o, n[s][o]) for o in range(2 * block, 2 * block + 2))]]
        for r in kernel(pa.Table.from_pylist(rows)).to_pylist():
            sums[r["source"], r["item"]] += r["value"]
    p = {s: divergence.shares(np.array(n[s]), np.full(v, total[s]), audit) for s in n}
    assert sums == {(s, t): int(np.abs(p[s] - p[t]).sum()) for s, t in (("a", "b"), ("a", "é"), ("b", "é"))}


def test_audit_edges_equal_sql(spark, edges, duck):
    name = "op11_divergence_audit"
    same(QUERIES[name](spark, edges), *duck(edges, ORACLE_SQL[name]))


def test_shares_are_exact():
    audit = divergence.Audit()
    r = random.Random(2)
    counts = [r.randrange(10 ** r.randint(1, 15)) for _ in range(500)]
    totals = [c + 5 + r.randrange(10 ** r.randint(1, 15)) for c in counts]
    got = divergence.shares(np.array(counts), np.array(totals), audit)
    assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals)]


# --- SetSketch -------------------------------------------------------------------

def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    for n, miss in ((4, 1), (60, 10), (900, 300)):
        sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(60)]
        parts = [(s[: n - miss], s[miss:]) for s in sets]
        a, b = (setsketch.registers([p[i] for p in parts]) for i in (0, 1))
        assert (setsketch.registers(sets) == np.maximum(a, b)).all()
        size = np.full(60, float(n - miss))
        found, good = setsketch.likely((a > b).sum(axis=1), (a < b).sum(axis=1), size, size, 0.8)
        true = (n - 2 * miss) / n
        assert abs(found.mean() - true) < 0.02 and good.all() == (true >= 0.79)


def test_linked_sets_share_a_band_and_pass_the_bounds():
    r = np.random.default_rng(7)
    for n, miss in ((5, 1), (10, 2), (300, 60)):
        sets = [r.permutation(np.unique(r.integers(0, 2**63, n, dtype=np.uint64))) for _ in range(400)]
        a, b = setsketch.registers([np.sort(s) for s in sets]), setsketch.registers([np.sort(s[miss:]) for s in sets])
        bands = (a == b)[:, : setsketch.BANDS * setsketch.BAND].reshape(len(a), setsketch.BANDS, setsketch.BAND)
        assert bands.all(axis=2).any(axis=1).all()
        assert (((a ^ b) & 1).sum(axis=1) <= setsketch.MAX_BITS).all()
        u, v = np.full(len(a), float(n)), np.full(len(a), float(n - miss))
        assert setsketch.likely((a > b).sum(axis=1), (a < b).sum(axis=1), u, v, 0.8)[1].all()


@pytest.mark.parametrize("words,pct", [(2, 80), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, edges, words, pct):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    more = [(1000 + i, t) for i, t in families(words, 60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = setsketch.near_duplicates(table, Join(words, pct)).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute(rows + more, words, pct)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sets_that_are_linked_with_equal_ones_only():
    assert [setsketch.alone(Join(2, p)) for p in (50, 80, 85, 95)] == [1, 4, 6, 19]


# --- multi-index -----------------------------------------------------------------

def negatives_by_hand(rows, m):
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if key is not None and key % m.shift_every == 0:
            label = int(np.fmod(label + 1, m.labels))
        kept.append((key, [int(np.floor(np.float64(x) * m.scale)) for x in vector], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (key, v, label) in enumerate(kept):
        if key is None or key % m.every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), k, lab) for j, (k, w, lab) in enumerate(kept) if j != i]
        for s, k, _ in sorted((x for x in scores if x[2] == label), key=order)[: m.positives]:
            fit = [x for x in scores if x[2] != label and m.low_pct * s <= 100 * x[0] <= m.high_pct * s]
            for rank, (t, n, _) in enumerate(sorted(fit, key=order)[: m.negatives], 1):
                out.append((key, k, rank, n, s, t))
    return sorted(map(repr, out))


def vectors(seed, n, width, grid):
    """Clustered vectors on a coarse grid, so that scores tie."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, width)) * 0.4
    return [(i, [float(v) for v in np.round(x[i] * grid) / grid], int(r.integers(0, 4))) for i in range(n)]


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, v int, cell int, score int"


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many cells, shards, copies and rounds
        for name, value in (("CELL_ROWS", 6), ("SHARD_ROWS", 40), ("SHARD_ANCHORS", 5), ("FIRST_ROWS", 10), ("GROWTH", 3), ("BLOCK_SCORES", 64)):
            monkeypatch.setattr(multi_index, name, value)
    rows = vectors(3, 600, 7, 2)
    rows += [(900, rows[0][1], 1)] * 60 + [(None, rows[1][1], 2), (None, rows[2][1], 0)]
    rows += [(1000, None, 1), (1100, [1.0] * 7, None), (1200, [1.0, None] + [0.0] * 5, 1), (1300, [float("nan")] + [0.0] * 6, 1),
             (1400, [float("inf")] * 7, 2), (1500, [0.0] * 7, 3), (1600, [2.0, 1.0], 1), (1700, [], 0), (1800, [1.5] * 7, 77)]
    mining = multi_index.Mining(every=20)
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(4)
    got = multi_index.hard_negatives(table, mining).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == negatives_by_hand(rows, mining)


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [x * 2.0**22 for x in v], label) for i, v, label in vectors(5, 60, 4, 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = multi_index.hard_negatives(table, multi_index.Mining(every=10)).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == negatives_by_hand(rows, multi_index.Mining(every=10))
    with pytest.raises(OverflowError):
        multi_index.products(np.array([[2**40, 2**40]]), np.array([[2**40, 2**40]]))


def test_hard_negatives_equal_sql(spark, edges, duck):
    name = "op13_hard_negatives"
    same(QUERIES[name](spark, edges), *duck(edges, ORACLE_SQL[name]))


def test_cells_come_in_the_order_of_their_bounds():
    r = np.random.default_rng(2)
    a, b = r.normal(size=9), r.normal(size=5)
    found = list(multi_index.multi_sequence(a, b))
    assert len({(i, j) for _, i, j in found}) == 45
    assert [s for s, _, _ in found] == sorted((s for s, _, _ in found), reverse=True)
    assert all(s == a[i] + b[j] for s, i, j in found)


def test_bounds_hold_for_all_rows_of_a_cell():
    r = np.random.default_rng(4)
    x, q = r.integers(-300, 300, (800, 12)).astype(float), r.integers(-300, 300, 12).astype(float)
    codes = multi_index.fit_codebook(x[:200], 8)
    at, far = multi_index.nearest(x, codes)
    radius = np.array([far[at == c].max(initial=0) for c in range(len(codes))])
    low, high = multi_index.half_bounds(q, codes, radius)
    assert ((low[at] <= x @ q) & (x @ q <= high[at])).all()
