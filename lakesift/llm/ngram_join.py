"""N-gram Jaccard self-join with PartEnum signatures, and its link components.

A document's set holds the hashes of its distinct word n-grams (a text of
fewer words counts as one gram).  Sets of similar size fall into bands; for
each band the largest Hamming distance ``k`` of two linked sets is known.  The
gram domain is cut by hash into ``n1`` partitions, so that in one of them two
linked sets differ in at most ``k2`` grams, and each of these into ``n2``
parts; every subset of ``n2 - k2`` parts gives a signature.  Two linked sets
share at least one, so no link is lost.  With some partitions more than the distance
asks for, they share one that has grams (sets with too many empty parts excepted,
see :func:`signatures`), so sets that have only empty parts in common don't meet
and signatures hardly lengthen with the number of sets.  Candidates are first held against the
bound that parity bits give (two sets differ in as many grams at least as
their bits), those beyond each class's best meeting also against bitmaps that grow
with the sets, then checked on the full sets.

``n1``, ``n2`` and ``k2`` follow the counted sets of each band.  The result doesn't
depend on them.

Work within a bucket (one signature) stays linear: documents with equal sets
form one class; within a task, and then over all tasks, each class of a bucket
is compared with the bucket's smallest class only.  If such a comparison fails
and other links don't join the two, the bucket is open: its classes are then
compared with one drawn from the bucket, in rounds while these find links, and
at last all pairs of its classes that are still in different components.  So
components are exact and large groups of near copies don't expand into all pairs,
also if the smallest class is far from many of them.  (Groups whose members stay
just below the similarity are compared in pairs, by their parity bits within the
join; that is what an exact join has to rule out.)

Edge cases: null, blank and empty texts have an empty set and no links; equal
texts and repeated rows share a class; a null id counts for no component id
(a component of null ids only has a null one); very long texts are one row of
hashes of bounded chunks; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import WORDS_MAP, gram_hashes, input_bytes, mix, on_workers, runs, small_side, staged, word_hashes

#: Signature rows that a worker combines before it sends them.
CHUNK_ROWS = 1 << 19
#: Shuffled bytes of a signature row, and of a pass over the documents: a share
#: of the input, but this many at least.
ROW_BYTES = 16
PASS_SHARE = 0.6
PASS_BYTES = 64 << 20
#: Bytes that the pairs of a pass of :func:`verify` or :func:`bounded` ship: a share of the
#: input, but ``PASS_BYTES`` at least.
VERIFY_SHARE = 0.5
#: Cost of a chance meeting in a bucket, in signatures: of one that the parity bits
#: rule out within the join, and of one that goes on to the bitmaps.
CHECK_COST = 1
CHANCE_COST = 20
#: A round of pivots follows another that found as many links as this share of the classes in open buckets.
MANY_LINKS = 0.02
#: Bytes of text whose sets a worker holds at once.
SET_BYTES = 1 << 20
#: Columns of the parity bits.
BITS = tuple(f"p{i}" for i in range(16))
_DIGEST = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


@dataclass(frozen=True)
class Join:
    """What links two documents: ``pct`` per cent Jaccard of ``words``-grams."""

    words: int = 4
    pct: int = 85

    def linked(self, inter: int, union: int) -> bool:
        return inter > 0 and 100 * inter >= self.pct * union


@lru_cache(maxsize=64)
def bands(pct: int, largest: int) -> tuple[tuple[int, int], ...]:
    """Bands [low, high] of set sizes; a linked partner is in the same or a neighbouring band."""
    out, low = [], 1
    while low <= largest or not out:
        high = low * 100 // pct
        out.append((low, high))
        low = high + 1
    return tuple(out)


def distance(pct: int, high: int) -> int:
    """Largest Hamming distance of two linked sets of at most ``high`` grams."""
    return 2 * high * (100 - pct) // (100 + pct)


def slack(k: int, n1: int, k2: int) -> int:
    """Partitions, beyond one, in which two linked sets differ in at most ``k2`` grams."""
    return n1 - 1 - k // (k2 + 1)


def many(n: int, q: float, m: int) -> float:
    """Bound on the chance that more than ``m`` of ``n`` events of chance ``q`` occur (Chernoff)."""
    share = (m + 1) / n
    if share <= q or q <= 0:
        return float(q > 0)
    rest = (1 - share) * log((1 - share) / (1 - q)) if share < 1 else 0
    return exp(-n * (share * log(share / q) + rest))


@lru_cache(maxsize=4096)
def plan_band(pct: int, low: int, high: int, n_sets: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of the least cost: signatures, and unrelated sets met in
    their buckets.  Two disjoint sets share a signature only where the parts of
    both are empty and both are thin (see :func:`signatures`); each partition
    beyond those that the distance asks for makes fewer sets thin."""
    k, best = distance(pct, high), None
    cells = 64 * len(BITS)
    told = cells / 2 * (1 - exp(-4 * low / cells)) > 1.1 * k  # parity bits of disjoint sets
    chance = CHECK_COST if told else CHANCE_COST
    least = max(1, low * pct // 100)  # sets of the band before take part
    sizes = (least, (least + low) / 2, low, (low + high) / 2)
    for k2 in range(min(k, 6) + 1):
        bad = k // (k2 + 1)
        for n2 in range(k2 + 1, min(k2 + 8, 12) if k2 else 2):
            subsets, cost = comb(n2, k2), None
            for more in range(bad + 2):
                n1, before, met = bad + 1 + more, cost, 0.0
                for size in sizes:
                    full = 1 - exp(-size / n1 / n2)  # chance that a cell has a gram
                    few = sum(comb(n2, i) * full**i * (1 - full) ** (n2 - i) for i in range(k2 + 1))
                    empty = max(exp(-size / n1 * (n2 - k2) / n2), min(1.0, (more + 1) / n1) / subsets)
                    met += many(n1, few, more) * empty / len(sizes)
                cost = n1 * subsets * (1 + chance * n_sets * met**2)
                if best is None or cost < best[0]:
                    best = (cost, n1, n2, k2)
                if n1 * subsets >= best[0]:
                    break
    return best[1:]


def _set_of(words: np.ndarray, grams: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    if b - a >= n:
        return np.unique(grams[a: b - n + 1])
    if b == a:
        return grams[:0]
    h = np.array([b - a], np.uint64)
    for i in range(a, b):
        h = mix((h ^ words[i: i + 1]) * _DIGEST[0])
    return h


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    words, offsets = word_hashes([t.translate(WORDS_MAP) for t in texts])
    grams, _ = gram_hashes(words, offsets, n)
    return [_set_of(words, grams, offsets[i], offsets[i + 1], n) for i in range(len(texts))]


def digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 63-bit digests of a set; the first names its class."""
    out = []
    for salt in _DIGEST:
        d = mix(s ^ (salt + np.uint64(seed))).sum(dtype=np.uint64) + np.uint64(len(s))
        out.append(int(mix(np.atleast_1d(d))[0] >> np.uint64(1)))
    return tuple(out)


def signatures(sets: list[np.ndarray], plans: dict[int, tuple[int, int, int]], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of non-empty sets and, for each, the index of its set.  A set
    takes part in the instance of its own band and in that of the next.  A plan may
    end with (share, shares): only that share of the band's signatures.

    A partition is full for a set if more than ``k2`` of its parts have grams: each
    of its signatures there has some.  A set is thin if more partitions aren't full
    than those spared by the distance (:func:`slack`).  Two linked sets agree on a
    signature in one partition more than that, so one with grams if either isn't
    thin; only thin sets give signatures without grams, which all such sets share."""
    largest = max((len(s) for s in sets), default=1)
    highs = np.array([h for _, h in bands(pct, int(largest * 100 / pct) + 2)])
    at = np.searchsorted(highs, [len(s) for s in sets])
    by_shape: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
    for i, j in enumerate(at):
        for band in (int(j), int(j) + 1):
            if band in plans:
                n1, n2, k2, *share = plans[band]
                by_shape.setdefault((n2, k2, *(share or (0, 1))), []).append((i, band, n1))
    sigs, owners = [], []
    for (n2, k2, share, shares), items in by_shape.items():
        sizes = np.array([len(sets[i]) for i, _, _ in items])
        n1s = np.array([n1 for _, _, n1 in items])
        x = np.concatenate([sets[i] for i, _, _ in items])
        first = np.concatenate([[0], np.cumsum(n1s)[:-1]])
        part = ((x >> np.uint64(32)) * np.repeat(n1s, sizes).astype(np.uint64)) >> np.uint64(32)
        sub = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
        cell = (np.repeat(first, sizes) + part.astype(np.int64)) * n2 + sub.astype(np.int64)
        h, total = mix(x ^ _DIGEST[1]), int(n1s.sum())
        # exact 64-bit sums: two halves, each below 2**53
        low = np.bincount(cell, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), total * n2)
        high = np.bincount(cell, (h >> np.uint64(32)).astype(np.float64), total * n2)
        cells = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(total, n2)
        number = np.arange(total) - np.repeat(first, n1s)
        band = np.repeat(np.array([b for _, b, _ in items]), n1s)
        place = mix(number.astype(np.uint64) * _DIGEST[0] + band.astype(np.uint64))
        owner = np.repeat(np.array([i for i, _, _ in items]), n1s)
        has = np.bincount(cell, minlength=total * n2).reshape(total, n2) > 0
        spared = [slack(distance(pct, int(highs[b])), n1, k2) for _, b, n1 in items]
        thin = np.repeat(np.add.reduceat(has.sum(axis=1) <= k2, first) > spared, n1s)
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            own = ((number + c) % shares == share) & (thin | has[:, chosen].any(axis=1))
            sigs.append(mix(cells[own][:, chosen].sum(axis=1, dtype=np.uint64) * _DIGEST[1] + place[own] + np.uint64(c + 1)))
            owners.append(owner[own])
    if not sigs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(owners)


def pass_plans(plans: dict, rows: dict[int, int], limit: int) -> list[dict]:
    """The bands' plans in passes whose signature rows take about ``limit`` bytes
    of shuffle at most; a larger band comes in shares (one for each partition and
    subset of parts at most).  Bands and shares have no signatures in common, so
    passes can follow one another and free their shuffles."""
    out, size = [], limit
    for j in sorted(plans):
        cost = rows[j] * ROW_BYTES
        n1, n2, k2 = plans[j]
        shares = min(-(-cost // max(1, int(limit))), max(n1, comb(n2, k2)))
        if shares > 1:
            out += [{j: (n1, n2, k2, share, shares)} for share in range(shares)]
            size = limit
            continue
        if not out or size + cost > limit:
            out.append({})
            size = 0
        out[-1][j] = plans[j]
        size += cost
    return out


def _texts(batch, column: int) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column(column)]


# --- passes over the documents ------------------------------------------------

def parity(x: np.ndarray) -> np.ndarray:
    """Parity bits of a set: of the grams in each of 1024 cells."""
    cells = 64 * len(BITS)
    bits = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_table(docs: DataFrame, join: Join, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, hash of the text, size of the set, class ``c``, a
    second digest, the parity bits and the text."""
    kind, n = docs.schema[id_col].dataType.simpleString(), join.words

    def run(batches):
        for batch in batches:
            texts = _texts(batch, 2)
            sizes, first, second, bits = [], [], [], []
            for a, b in runs(texts, SET_BYTES):
                for s in sets_of(texts[a:b], n):
                    d = digest(s, seed)
                    sizes.append(len(s))
                    first.append(d[0])
                    second.append(d[1])
                    bits.append(parity(s))
            words = np.array(bits, np.int64).reshape(len(sizes), len(BITS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, first, second)),
                 *(pa.array(words[:, i].copy()) for i in range(len(BITS))), batch.column(2)],
                ["id", "h", "n", "c", "d", *BITS, "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h bigint, n bigint, c bigint, d bigint, " + ", ".join(f"{b} bigint" for b in BITS) + ", text string")


def signature_rows(sets: DataFrame, join: Join, plans: dict, seed: int) -> DataFrame:
    """(sig, c, low) of the sets that take part in the plans' bands (those of
    the band and of the one before; others' texts are not hashed): classes that share a signature within a worker's chunk
    come with the chunk's smallest class, which alone represents the chunk in
    the bucket (low null)."""
    n, pct = join.words, join.pct

    def run(batches):
        seen: set[int] = set()
        held, rows = [], 0

        def flush():
            sig, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, sig))
            sig, c = sig[order], c[order]
            head = np.concatenate([[True], sig[1:] != sig[:-1]])
            low = c[head][np.cumsum(head) - 1]
            keep = head | (c != low)
            sig, c, low, head = sig[keep], c[keep], low[keep], head[keep]
            for a in range(0, len(sig), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[part]), pa.array(c[part]), pa.array(low[part], mask=head[part])], ["sig", "c", "low"])

        for batch in batches:
            texts = _texts(batch, 0)
            for a, b in runs(texts, SET_BYTES):
                sets, names = [], []
                for s in sets_of(texts[a:b], n):
                    if len(s):
                        name = digest(s, seed)[0]
                        if name not in seen:
                            seen.add(name)
                            sets.append(s)
                            names.append(name)
                if not sets:
                    continue
                sig, owner = signatures(sets, plans, pct)
                if not len(sig):
                    continue
                held.append((sig, np.array(names, np.int64)[owner]))
                rows += len(sig)
                if rows >= CHUNK_ROWS:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    # bands[j] and bands[j - 1] take part in the instance of band j
    limits = bands(pct, 2)
    while len(limits) <= max(plans):
        limits = bands(pct, limits[-1][1] + 1)
    low = min(limits[max(0, j - 1)][0] for j in plans)
    high = max(limits[j][1] for j in plans)
    return sets.where(F.col("n").between(low, high)).select("text").mapInArrow(run, "sig bigint, c bigint, low bigint")


def bucket_edges(rows: DataFrame) -> DataFrame:
    """(sig, x, y), x < y: each class of a bucket with the smallest class of its
    chunk, and each chunk's with the bucket's.  Chunks were combined before
    the shuffle, so a bucket has a row for each chunk at most."""
    local = rows.where("low is not null").selectExpr("sig", "low x", "c y")
    lowest = rows.where("low is null").select("sig", "c").withColumn("x", F.min("c").over(Window.partitionBy("sig")))
    return local.unionByName(lowest.where("x < c").selectExpr("sig", "x", "c y"))


def close(join: Join, a: str, b: str) -> str:
    """SQL condition that two linked sets fulfil: on their sizes, and on the
    distance that their parity bits prove."""
    bits = " + ".join(f"bit_count({a}.{p} ^ {b}.{p})" for p in BITS)
    return (f"100 * least({a}.n, {b}.n) >= {join.pct} * greatest({a}.n, {b}.n)"
            f" and ({bits}) * {100 + join.pct} <= {100 - join.pct} * ({a}.n + {b}.n)")


def bitmap(x: np.ndarray) -> bytes:
    """Parity bits of a set in one to two cells a gram (a power of two of them)."""
    cells = max(128 * len(BITS), 1 << len(x).bit_length())
    bits = np.bincount((x & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """Distance that the bitmaps of two sets prove; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def bounded(docs: DataFrame, sets: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (x, y) that bitmaps as long as the sets leave: the parity bits of
    fixed length prove little of long sets, and a bitmap is a small part of the
    text that :func:`verify` ships.  Pairs go in passes by the bytes they ship."""
    n, pct = join.words, join.pct

    def of_texts(batches):
        seen = set()
        for batch in batches:
            rows = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if c not in seen:  # rows with equal sets
                    seen.add(c)
                    s = sets_of([text.as_py().encode()], n)[0]
                    rows.append((c, len(s), bitmap(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                ["c", "n", "bits"])

    def run(batches):
        for batch in batches:
            nx, bx, ny, by = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [(100 + pct) * least_distance(a, b) <= (100 - pct) * (m + k) for m, a, k, b in zip(nx, bx, ny, by)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    wanted = staged(pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct(), "bounded")
    rows = sets.where("n > 0").select("c", "text").join(small_side(wanted, wanted.count(), 16), "c")
    maps = rows.mapInArrow(of_texts, "c bigint, n bigint, bits binary").groupBy("c")
    maps = staged(maps.agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "bitmaps")
    x, y = (maps.select(F.col("c").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"b{e}")) for e in "xy")
    shipped = pairs.join(maps.select(F.col("c").alias("y"), F.octet_length("bits").alias("size")), "y")
    parts = in_passes(pairs, shipped.agg(F.sum("size")).first()[0] or 0, docs)
    return reduce(DataFrame.unionByName, [
        staged(part.join(y, "y").join(x, "x").select("x", "y", "nx", "bx", "ny", "by").mapInArrow(run, "x bigint, y bigint"), "bounded-pairs")
        for part in parts
    ])


def in_passes(pairs: DataFrame, shipped: int, docs: DataFrame) -> list[DataFrame]:
    """The pairs in parts that ship a bounded share of ``shipped`` bytes each."""
    passes = max(1, -(-shipped // int(max(PASS_BYTES, VERIFY_SHARE * input_bytes(docs)))))
    if passes == 1:
        return [pairs]
    return [pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(passes)) == number) for number in range(passes)]


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, join: Join, text_col: str) -> DataFrame:
    """The linked ones of pairs (x, y).  A class's text is that of the rows with
    its text hash; each pair ships the text of y, that of x meets it in the
    second join.  Pairs go in passes by the bytes they ship, each of which frees
    its shuffles."""
    n, pct = join.words, join.pct
    hashed = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def named(pairs: DataFrame, name: str) -> DataFrame:
        found = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct().join(classes.select("c", "h"), "c")
        found = staged(found, name)
        return hashed.join(small_side(found, found.count(), 24), "h")

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            keep = []
            for x, tx, ty in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if x != last:
                    last, last_set = x, sets_of([tx.as_py().encode()], n)[0]
                other = sets_of([ty.as_py().encode()], n)[0]
                inter = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * inter >= pct * (len(last_set) + len(other) - inter))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    sizes = named(pairs, "wanted").groupBy(F.col("c").alias("y")).agg(F.max(F.octet_length("text")).alias("size"))
    shipped = pairs.join(sizes, "y").agg(F.sum("size")).first()[0] or 0
    out = []
    for part in in_passes(pairs, shipped, docs):
        texts = named(part, "wanted-texts").groupBy("c").agg(F.first("text").alias("text"))
        with_y = part.join(texts.select(F.col("c").alias("y"), F.col("text").alias("ty")), "y")
        both = with_y.join(texts.select(F.col("c").alias("x"), F.col("text").alias("tx")), "x")
        out.append(staged(both.select("x", "y", "tx", "ty").mapInArrow(run, "x bigint, y bigint"), "links"))
    return reduce(DataFrame.unionByName, out)


# --- components -----------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(c, comp): the smallest class reachable, for every class with an edge.

    Alternating large and small stars: each round links every vertex to the
    smallest one near it; it ends when nothing changes.  Minima are partial
    aggregates, so a hub with many edges is no hot key in them."""
    edges = staged(edges.selectExpr("greatest(x, y) u", "least(x, y) v").where("u != v").distinct(), "star")
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").where("u != v")
        down = large.selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
        down = staged(down, "large")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v != m").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v"))
        edges = staged(small.where("u != v").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.selectExpr("u c", "v comp").unionByName(edges.selectExpr("v c", "v comp").distinct())


def still_open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, c, comp) of the buckets whose classes are in different components."""
    named = members.select("sig", "c").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    apart = named.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("sig")
    return staged(named.join(apart, "sig", "left_semi").select("sig", "c", "comp"), "members")


def pivot_pairs(members: DataFrame, number: int) -> DataFrame:
    """(x, y), x < y: in each bucket one class, drawn by hash anew in each round,
    with those of other components.  As many rows as members at most."""
    drawn = F.struct(F.xxhash64("sig", "c", F.lit(number)).alias("h"), "c", "comp")
    pivots = members.groupBy("sig").agg(F.min(drawn).alias("p")).select("sig", F.col("p.c").alias("pc"), F.col("p.comp").alias("other"))
    met = members.join(pivots, "sig").where("comp != other")
    return met.selectExpr("least(c, pc) x", "greatest(c, pc) y").distinct()


@dataclass
class Links:
    """``sets``: id, n, c of each document; ``links``: checked pairs (x, y) of
    classes; ``comps``: (c, comp) of classes with a link."""

    sets: DataFrame
    links: DataFrame
    comps: DataFrame


def similarity_links(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> Links:
    """Classes, links and components of a table of documents."""
    spark = docs.sparkSession
    on_workers(spark)
    seed = 0
    while True:
        sets = staged(set_table(docs, join, seed, id_col, text_col), "sets")
        clash = sets.groupBy("c").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a != b")
        if clash.isEmpty():
            break
        seed += 1  # two sets share a name: name all anew

    # sets of each size: as many rows as there are sizes of sets
    sizes = sets.where("n > 0").groupBy("n").agg(F.approx_count_distinct("c").alias("m")).collect()
    edges = bands(join.pct, max((r["n"] for r in sizes), default=1))
    plans, counts = {}, [0] * (len(edges) + 2)
    for r in sizes:
        j = next(i for i, (_, high) in enumerate(edges) if r["n"] <= high)
        counts[j] += r["m"]
    more = bands(join.pct, edges[-1][1] + 1)
    for j, (low, high) in enumerate(more):
        n_sets = counts[j] + (counts[j - 1] if j else 0)
        if counts[j] and distance(join.pct, high) > 0:
            plans[j] = plan_band(join.pct, low, high, n_sets)

    classes = staged(sets.where("n > 0").groupBy("c").agg(
        F.min("h").alias("h"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in BITS)), "classes")
    rows = {j: (counts[j] + (counts[j - 1] if j else 0)) * n1 * comb(n2, k2) for j, (n1, n2, k2) in plans.items()}
    passes = [
        staged(bucket_edges(signature_rows(sets, join, part, seed)), "bucket-edges")
        for part in pass_plans(plans, rows, max(PASS_BYTES, PASS_SHARE * input_bytes(docs)))
    ]
    edges = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], "sig bigint, x bigint, y bigint")
    # a bucket's classes against its smallest: bound first, then the full sets; of
    # each class first the meeting with the most buckets, then what stays apart
    pairs = edges.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))
    x, y = classes.alias("a"), classes.alias("b")
    pairs = pairs.join(x, F.col("x") == F.col("a.c")).join(y, F.col("y") == F.col("b.c"))
    pairs = staged(pairs.where(close(join, "a", "b")).select("x", "y", "m"), "pairs")
    best = Window.partitionBy("y").orderBy(F.desc("m"), F.asc("x"))
    first = staged(pairs.withColumn("place", F.row_number().over(best)).where("place = 1").select("x", "y"), "first-pairs")
    links = verify(docs, first, classes, join, text_col)
    comps = staged(components(links), "first-comps")
    pairs = pairs.select("x", "y")
    ends = [comps.select(F.col("c").alias(e), F.col("comp").alias(f"c{e}")) for e in "xy"]
    rest = pairs.join(first, ["x", "y"], "left_anti").join(ends[0], "x", "left").join(ends[1], "y", "left")
    rest = staged(rest.where("coalesce(cx, x) != coalesce(cy, y)").select("x", "y"), "rest")
    if not rest.isEmpty():
        links = staged(links.unionByName(verify(docs, bounded(docs, sets, rest, join), classes, join, text_col)), "links")
        comps = staged(components(links), "comps")

    # open buckets: their classes aren't all in one component
    side = comps.select(F.col("c").alias("y"), F.col("comp").alias("cy"))
    open_ = edges.join(comps.select(F.col("c").alias("x"), F.col("comp").alias("cx")), "x", "left").join(side, "y", "left")
    open_ = staged(open_.where("coalesce(cx, x) != coalesce(cy, y)").select("sig").distinct(), "open")
    n_open, tested, number = open_.count(), [pairs], 0
    if not n_open:
        return Links(sets, links, comps)
    members = edges.join(small_side(open_, n_open, 16), "sig").select("sig", F.explode(F.array("x", "y")).alias("c")).distinct()
    members = still_open(members, comps)
    while True:  # rounds of pivots, while they link many of the classes
        number += 1
        more = pivot_pairs(members, number).join(x, F.col("x") == F.col("a.c")).join(y, F.col("y") == F.col("b.c"))
        more = more.where(close(join, "a", "b")).select("x", "y")
        more = staged(reduce(lambda m, t: m.join(t, ["x", "y"], "left_anti"), tested, more), "pivot-pairs")
        if more.isEmpty():
            break
        tested.append(more)
        again = staged(verify(docs, bounded(docs, sets, more, join), classes, join, text_col), "pivot-links")
        found = again.count()
        if found:
            links = staged(links.unionByName(again), "more-links")
            comps = staged(components(links), "more-comps")
            members = still_open(members, comps)
        if found < MANY_LINKS * members.select("c").distinct().count():
            break

    # what no pivot has linked: all pairs of a bucket's classes in different components
    members = members.join(classes.drop("h"), "c")
    more = members.alias("a").join(members.alias("b"), "sig").where(
        "a.c < b.c and a.comp != b.comp and " + close(join, "a", "b")).selectExpr("a.c x", "b.c y").distinct()
    more = staged(more, "near")
    more = staged(reduce(lambda m, t: m.join(t, ["x", "y"], "left_anti"), tested, more), "more")
    if not more.isEmpty():
        again = verify(docs, bounded(docs, sets, more, join), classes, join, text_col)
        links = staged(links.unionByName(again), "all-links")
        comps = staged(components(links), "all-comps")
    return Links(sets, links, comps)


def ngram_jaccard(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id reachable
    by links), ``class_id`` (documents of one class have equal sets),
    ``component_class`` (smallest class reachable) and ``text_hash``."""
    found = similarity_links(docs, join, id_col, text_col)
    # smallest id of each class, then of each component: partial aggregates
    sets = found.sets
    heads = sets.where("n > 0").groupBy("c").agg(F.min("id").alias("low"))
    heads = heads.join(found.comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lows = heads.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = staged(heads.join(lows, "comp").select("c", "comp", "component_id"), "class-components")
    out = sets.join(small_side(by_class, by_class.count(), 48), "c", "left")
    empty = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(~empty, F.col("c")).alias("class_id"), F.when(~empty, F.col("comp")).alias("component_class"),
        F.col("h").alias("text_hash"))
