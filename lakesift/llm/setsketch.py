"""Near duplicates by SetSketch registers.

The sketch of a set has 256 registers.  Each element throws points of a Poisson
process at random registers; a register keeps the smallest point that hits it
from any element, an exponential minimum, and stores it as the truncated
logarithm ``floor(1 - log_b(min))`` in one byte.  Registers of a union are the
maxima of the registers (sketches merge), and similar sets agree in many.

* Candidates: 51 bands of five registers.  Two linked sets (similarity 0.8, of
  any sizes) agree in a register with probability 0.81 at least, so all 51 bands
  miss them with probability below 3e-10; more similar ones far less.
* First bounds in the join itself: the lowest bits of all registers differ in
  few places, and parity bits of the sets prove no distance beyond the one that
  linked sets can have (this one is exact).  Then the numbers of registers that are larger, equal and smaller
  give the joint likelihood of the similarity, with both sizes known exactly;
  a pair goes on unless its likelihood at the similarity asked for is below its
  maximum by a factor of e**-``DROP``.  Both bounds together lose a linked
  pair with probability below 1e-8.
* Links are confirmed on the full sets, then joined to components.

A bucket (one band's registers) never expands into pairs at first: documents
with equal sets are one class; within a task and then over all tasks each class
meets the bucket's smallest class only, first the one it shares most bands
with.  Buckets whose classes are not in one component afterwards are open:
there all pairs from different components are compared, by their bits within
the join.  So a large group of near copies costs a few comparisons a member.

Edge cases: null, blank and empty texts have an empty set and no links; equal
texts and repeated rows share a class; a null id counts for no component id
(a component of null ids only has a null one and keeps its rows, as a document
without words does); very long texts are one row of hashes of bounded chunks;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm import ngram_join
from lakesift.llm.common import mix, on_workers, runs, small_side, staged
from lakesift.llm.ngram_join import SET_BYTES, Join, Links, bucket_edges, components, digest, parity, sets_of, verify

#: Registers, the base of their exponential spacing, and the offset that keeps
#: sets of one element above zero.
REGISTERS, BASE, START = 256, 1.15, 20.0
#: Registers of a band; the last of the 256 is in none.
BAND = 5
BANDS = REGISTERS // BAND
#: Lowest bits of two linked sets' registers differ in so many places at most,
#: but for one pair in 10**9 (mean 26, deviation 4.8).
MAX_BITS = 60
#: Logarithm of the likelihood ratio beyond which a pair is dropped.
DROP = 18.0
#: Band rows that a worker combines before it sends them.
CHUNK_ROWS = 1 << 19
BITS = tuple(f"b{i}" for i in range(REGISTERS // 64))
PARITY = ngram_join.BITS
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- sketches -------------------------------------------------------------------

def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (rows of bytes) of non-empty sets of 64-bit hashes.

    Points of an element come in ascending order.  Elements go on in blocks of
    points until their last one lies above their set's largest register
    minimum; a point is one hash, its low byte the register and the rest the
    step from the point before."""
    n = len(sets)
    least = np.full((n, REGISTERS), np.inf)
    sizes = np.array([len(s) for s in sets])
    flat = least.reshape(-1)
    # about what it takes to hit every register, shared by the elements
    block = np.clip(REGISTERS * 8 // np.maximum(sizes, 1), 2, 64)
    block = 1 << np.ceil(np.log2(block)).astype(np.int64)
    for size in np.unique(block):
        own = np.flatnonzero(block == size)
        x = np.concatenate([sets[i] for i in own])
        owner = np.repeat(own, sizes[own])
        last = np.zeros(len(x))
        number = 0
        while len(x):
            step = np.arange(number + 1, number + size + 1, dtype=np.uint64) * _STEP
            h = mix(x[:, None] + step[None, :])
            gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            at = last[:, None] + np.cumsum(gap, axis=1)
            place = owner[:, None] * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64)
            keep = at < least.max(axis=1)[owner][:, None]
            np.minimum.at(flat, place[keep], at[keep])
            last = at[:, -1]
            on = last < least.max(axis=1)[owner]
            x, owner, last = x[on], owner[on], last[on]
            number += int(size)
    return np.clip(np.floor(1.0 - np.log(least / START) / log(BASE)), 0, 255).astype(np.uint8)


def _less(x: np.ndarray) -> np.ndarray:
    """Probability that a register of the one set is larger, where the share ``x``
    of both sizes' sum is in that set only."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)


def log_likelihood(more, fewer, u, similarity):
    """Of register counts (larger, smaller), with ``u`` the one set's share of both sizes."""
    same = REGISTERS - more - fewer
    p, q = _less(u - (1 - u) * similarity), _less((1 - u) - u * similarity)
    tiny = 1e-12
    return more * np.log(p + tiny) + fewer * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))


def likely(more, fewer, n_x, n_y, similarity: float):
    """Maximum-likelihood similarity of pairs, and whether ``similarity`` or more
    is plausible: the maximum lies there, or is not higher by ``DROP``."""
    u = n_x / (n_x + n_y)
    low, high = np.zeros(len(u)), np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    ceiling = high.copy()
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):  # golden sections: the likelihood has one maximum
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        up = log_likelihood(more, fewer, u, a) < log_likelihood(more, fewer, u, b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    best = (low + high) / 2
    at = np.clip(np.maximum(best, similarity), 0, ceiling)
    gap = log_likelihood(more, fewer, u, best) - log_likelihood(more, fewer, u, at)
    return best, (gap <= DROP) & (ceiling >= similarity - 1e-12)


# --- tables ---------------------------------------------------------------------

def sketch_table(docs: DataFrame, join: Join, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, hash of the text, size of the set, class ``c``, a second
    digest, and the registers ``k`` followed by the parity bits (null where no
    other set can be linked)."""
    kind, n = docs.schema[id_col].dataType.simpleString(), join.words
    least = alone(join)

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            sizes, first, second, regs = [], [], [], []
            for a, b in runs(texts, SET_BYTES):
                sets = sets_of(texts[a:b], n)
                names = [digest(s, seed) for s in sets]
                sizes += [len(s) for s in sets]
                first += [x for x, _ in names]
                second += [x for _, x in names]
                # one sketch for equal sets of the run
                place = {c: i for i, ((c, _), s) in enumerate(zip(names, sets)) if len(s) >= least}
                made = registers([sets[i] for i in place.values()]) if place else ()
                row = {c: k.tobytes() + parity(sets[i]).tobytes() for (c, i), k in zip(place.items(), made)}
                regs += [row.get(c) for c, _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(regs, pa.binary())],
                ["id", "h", "n", "c", "d", "k"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h bigint, n bigint, c bigint, d bigint, k binary")


def alone(join: Join) -> int:
    """Smaller sets are linked with equal ones only."""
    n = 1
    while 100 * n < join.pct * (n + 1):
        n += 1
    return n


def _matrix(column) -> np.ndarray:
    """Registers of the rows of a column, without what follows them."""
    width = REGISTERS + 8 * len(PARITY)
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), width)[:, :REGISTERS]


def with_bits(classes: DataFrame) -> DataFrame:
    """``classes`` with the lowest bits of their registers and the parity bits as longs."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bits = np.packbits(_matrix(batch.column(3)) & 1, axis=1).view(np.int64)
                after = np.frombuffer(b"".join(x.as_py()[REGISTERS:] for x in batch.column(3)), np.int64).reshape(-1, len(PARITY))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(m[:, i].copy()) for m in (bits, after) for i in range(m.shape[1]))],
                    ["c", "h", "n", "k", *BITS, *PARITY])

    kinds = "c bigint, h bigint, n bigint, k binary, " + ", ".join(f"{b} bigint" for b in (*BITS, *PARITY))
    return classes.select("c", "h", "n", "k").mapInArrow(run, kinds)


def band_rows(classes: DataFrame) -> DataFrame:
    """(sig, c, low): classes that share a band within a worker's chunk come with
    the chunk's smallest class, which alone stands for the chunk (low null).  A
    band's registers and its number make the signature, without hashing."""

    def run(batches):
        held, rows = [], 0

        def flush():
            sig, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, sig))
            sig, c = sig[order], c[order]
            head = np.concatenate([[True], sig[1:] != sig[:-1]])
            low = c[head][np.cumsum(head) - 1]
            for a in range(0, len(sig), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(sig[s]), pa.array(c[s]), pa.array(low[s], mask=head[s])], ["sig", "c", "low"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = _matrix(batch.column(1))[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.int64)
            sig = np.arange(BANDS)[None, :]
            for i in range(BAND):
                sig = (sig << 8) | k[:, :, i]
            held.append((sig.reshape(-1), np.repeat(batch.column(0).to_numpy(), BANDS)))
            rows += sig.size
            if rows >= CHUNK_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return classes.select("c", "k").mapInArrow(run, "sig bigint, c bigint, low bigint")


def close(join: Join, a: str, b: str) -> str:
    """SQL condition that linked sets fulfil, on their sizes, lowest bits and parity bits."""
    bits = " + ".join(f"bit_count({a}.{p} ^ {b}.{p})" for p in BITS)
    return f"{ngram_join.close(join, a, b)} and {bits} <= {MAX_BITS}"


def near(pairs: DataFrame, bits: DataFrame, join: Join) -> DataFrame:
    """The pairs (x, y) that their sizes and bits leave."""
    x, y = bits.alias("a"), bits.alias("b")
    both = pairs.join(x, F.col("x") == F.col("a.c")).join(y, F.col("y") == F.col("b.c"))
    return both.where(close(join, "a", "b")).select(*pairs.columns)


def plausible(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (x, y) whose registers make the similarity plausible."""
    goal = join.pct / 100

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k, m = _matrix(batch.column(3)), _matrix(batch.column(5))
            sizes = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 4))
            _, good = likely((k > m).sum(axis=1), (k < m).sum(axis=1), *sizes, goal)
            yield batch.filter(pa.array(good)).select([0, 1])

    own = lambda end: classes.select(F.col("c").alias(end), F.col("n").alias(f"n{end}"), F.col("k").alias(f"k{end}"))
    both = pairs.join(own("x"), "x").join(own("y"), "y").select("x", "y", "nx", "kx", "ny", "ky")
    return both.mapInArrow(run, "x bigint, y bigint")


# --- links ----------------------------------------------------------------------

def sketch_links(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> Links:
    """Classes, confirmed links and components of a table of documents."""
    on_workers(docs.sparkSession)
    seed = 0
    while True:
        sets = staged(sketch_table(docs, join, seed, id_col, text_col), "sketches")
        clash = sets.groupBy("c").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a != b")
        if clash.isEmpty():
            break
        seed += 1  # two sets share a name: name all anew
    first = sets.where("k is not null").groupBy("c").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("k").alias("k"))
    classes = staged(with_bits(first), "classes")
    bits = classes.select("c", "n", *BITS, *PARITY)

    edges = staged(bucket_edges(band_rows(classes)), "bucket-edges")
    shared = staged(near(edges.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")), bits, join), "shared")
    # of each class, first the meeting with the most bands
    best = Window.partitionBy("y").orderBy(F.desc("m"), F.asc("x"))
    first = staged(shared.withColumn("place", F.row_number().over(best)).where("place = 1").select("x", "y"), "first")
    links = verify(docs, staged(plausible(first, classes, join), "plausible"), classes, join, text_col)
    comps = staged(components(links), "comps")

    def ends(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y), and whether their classes are in different components."""
        own = [comps.select(F.col("c").alias(e), F.col("comp").alias(f"c{e}")) for e in "xy"]
        both = pairs.join(own[0], "x", "left").join(own[1], "y", "left")
        return both.withColumn("apart", F.expr("coalesce(cx, x) != coalesce(cy, y)")).drop("cx", "cy")

    def more(pairs: DataFrame) -> None:
        nonlocal links, comps
        again = verify(docs, staged(plausible(pairs, classes, join), "plausible"), classes, join, text_col)
        if not again.isEmpty():
            links = staged(links.unionByName(again), "links")
            comps = staged(components(links), "comps")

    rest = ends(shared.select("x", "y").join(first, ["x", "y"], "left_anti")).where("apart").select("x", "y")
    rest = staged(rest, "rest")
    if not rest.isEmpty():
        more(rest)

    # buckets of two classes have no pair that wasn't met
    open_ = ends(edges).groupBy("sig").agg(F.count(F.lit(1)).alias("met"), F.max("apart").alias("apart"))
    open_ = staged(open_.where("apart and met > 1").select("sig"), "open")
    n_open = open_.count()
    if n_open:
        members = edges.join(small_side(open_, n_open, 16), "sig").select("sig", F.explode(F.array("x", "y")).alias("c")).distinct()
        members = members.join(bits, "c").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        members = staged(members, "members")
        pairs = members.alias("a").join(members.alias("b"), "sig").where(
            "a.c < b.c and a.comp != b.comp and " + close(join, "a", "b")).selectExpr("a.c x", "b.c y").distinct()
        pairs = staged(pairs.join(shared, ["x", "y"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            more(pairs)
    return Links(sets, links, comps)


def near_duplicates(docs: DataFrame, join: Join = Join(words=5, pct=80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id reachable
    by links), ``kept`` (the document is that one) and ``class_id`` (documents of
    one class have equal sets)."""
    found = sketch_links(docs, join, id_col, text_col)
    sets = found.sets
    heads = sets.where("n > 0").groupBy("c").agg(F.min("id").alias("low"))
    heads = heads.join(found.comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lows = heads.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = staged(heads.join(lows, "comp").select("c", "component_id"), "class-components")
    out = sets.join(small_side(by_class, by_class.count(), 48), "c", "left")
    empty = F.col("n") == 0
    component = F.when(empty, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), F.when(~empty, F.col("c")).alias("class_id"))
