"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network routes the words of the patterns to the sources' quotas:
the arcs of a pattern are its epochs, each with the pattern's words as
capacity and a higher cost than the one before, so no pattern is repeated
while another could still serve the source once.  The flow of a pattern to a
source is then realised by documents: seeded order within the pattern, whole
documents, full epochs first.

Targets: each source's share of ``share`` times all words by weight, stopped
at ``epochs`` times the words it can draw on; the excess is shared again by
weight until no source is above.

Scale: the network has a node for each pattern and source, whatever the number
of documents; only these totals reach the driver.  Documents are never sorted
as a whole: their seeded keys fall into buckets fine enough that the one
bucket in which a quota ends is small, and only that bucket is ordered.

Edge cases: null text has size 0 and takes 0 words; a null source is a source
of its own, last in order; repeated rows and ids count row by row, equal rows
are interchangeable; documents of no source take nothing; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import WORD, small_side

#: Documents that the ordered bucket of a quota holds on average at most.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)   # by source in order, repeating
    share: float = 1.5                             # of all words
    epochs: int = 2                                # most uses of a document
    seed: int = 0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], total: float, epochs: int) -> list[float]:
    """Water filling: ``total`` by weight, each at most ``epochs`` times its size."""
    caps = [epochs * s for s in sizes]
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = min(float(total), float(sum(caps)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] * weight <= left * weights[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(caps[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def min_cost_flow(supply: dict, quota: dict, members: dict, epochs: int) -> dict:
    """Words routed from each pattern to each of its sources, as
    ``{(pattern, source): words}``.  Successive shortest paths with potentials;
    the e-th epoch of a pattern costs ``e`` a word.  Amounts are whole words."""
    graph: dict = {}

    def arc(a, b, cap, cost):
        graph.setdefault(a, []).append([b, cap, cost, len(graph.setdefault(b, []))])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, words in supply.items():
        for e in range(epochs):
            arc("s", ("p", p), words, e)
        for s in members[p]:
            arc(("p", p), ("q", s), words * epochs, 0)
    for s, words in quota.items():
        arc(("q", s), "t", words, 0)
    potential = dict.fromkeys(graph, 0)
    while "s" in graph and "t" in graph:
        dist, back, heap, order = {"s": 0}, {}, [(0, 0, "s")], 0
        done = set()
        while heap:
            d, _, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for k, (b, cap, cost, _) in enumerate(graph[a]):
                nd = d + cost + potential[a] - potential[b]
                if cap > 0 and b not in done and nd < dist.get(b, float("inf")):
                    dist[b], back[b] = nd, (a, k)
                    order += 1
                    heapq.heappush(heap, (nd, order, b))
        if "t" not in dist:
            break
        far = dist["t"]
        for v in graph:
            potential[v] += min(dist.get(v, far), far)
        flow, v = None, "t"
        while v != "s":
            a, k = back[v]
            flow = graph[a][k][1] if flow is None else min(flow, graph[a][k][1])
            v = a
        v = "t"
        while v != "s":
            a, k = back[v]
            graph[a][k][1] -= flow
            graph[v][graph[a][k][3]][1] += flow
            v = a
    return {
        (p, b[1]): words * epochs - cap
        for p, words in supply.items()
        for b, cap, _, _ in graph.get(("p", p), ()) if isinstance(b, tuple) and b[0] == "q"
    }


def mix(docs: DataFrame, plan: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: bool = False) -> DataFrame:
    """Per document: id, ``size``, ``source_size``, ``target``, ``taken`` and
    ``copies``.  ``source_col`` holds one source or an array of them; for an
    array, ``source_size`` and ``target`` are those of its first source in
    order.  With ``keep`` all columns of ``docs`` stay and only ``mix_copies``
    is added."""
    many = docs.schema[source_col].dataType.typeName() == "array"
    sources = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(F.col(source_col))
    sized = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc") if keep else F.col(id_col).alias("id"),
        sources.alias("pattern"), size_of(F.col(text_col)).alias("size"),
        # seeded key: equal for equal rows, so that they are interchangeable
        F.sha2(F.concat_ws(":", F.lit(str(plan.seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                           F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 256).alias("key"))
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        out = sized.select(*_columns(keep, id_col, "size", F.lit(0).cast("long"), F.lit(0.0), F.lit(0).cast("long"), F.lit(0)))
        return out.select("doc.*", "mix_copies") if keep else out

    pattern_of = [tuple(r["pattern"] or ()) for r in totals]
    words = dict(zip(pattern_of, (r["words"] for r in totals)))
    names = sorted({s for p in pattern_of for s in p}, key=lambda s: (s is None, s if s is not None else ""))
    sizes = [sum(words[p] for p in pattern_of if s in p) for s in names]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(names))]
    aims = targets(sizes, weights, plan.share * sum(words.values()), plan.epochs)
    flow = min_cost_flow(words, {s: int(a + 0.5) for s, a in zip(names, aims)}, {p: sorted(p, key=repr) for p in pattern_of}, plan.epochs)
    routed = {p: sum(flow.get((p, s), 0) for s in p) for p in pattern_of}

    # a pattern's words: full epochs of all documents, then the seeded first part
    digits = 1
    while max(r["n"] for r in totals) > BUCKET_ROWS * 16 ** digits:
        digits += 1
    rows = []
    for r, p in zip(totals, pattern_of):
        full, rest = divmod(routed[p], words[p]) if words[p] else (0, 0)
        first = names.index(min(p, key=names.index)) if p else None
        size, aim = (sizes[first], aims[first]) if p else (0, 0.0)
        rows.append((r["pattern"], int(full), int(rest), int(size), float(aim)))
    spark = docs.sparkSession
    kind = sized.schema["pattern"].dataType.simpleString()
    quotas = spark.createDataFrame(rows, f"pattern {kind}, full int, rest bigint, source_size bigint, target double")
    # the bucket in which each pattern's rest ends, and the words before it
    bucket = F.substring("key", 1, digits)
    sums = sized.groupBy("pattern", bucket.alias("b")).agg(F.sum("size").alias("w"))
    before = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    same = F.col("s.pattern").eqNullSafe(F.col("q.pattern"))
    ends = sums.alias("s").join(F.broadcast(quotas.where("rest > 0")).alias("q"), same).where("before < rest and before + w >= rest")
    ends = ends.select("s.pattern", F.col("b").alias("end_b"), "before")
    ends = {tuple(r["pattern"] or ()): (r["end_b"], r["before"]) for r in ends.collect()}
    table = [(*r, *ends.get(tuple(r[0] or ()), ("", 0))) for r in rows]
    quotas = spark.createDataFrame(
        table, f"pattern {kind}, full int, rest bigint, source_size bigint, target double, end_b string, before bigint")
    # one row for each pattern, as many as the network has
    quotas = small_side(quotas, len(table), 200).alias("q")
    placed = sized.alias("s").join(quotas, same).select("s.*", "q.full", "q.rest", "q.source_size", "q.target", "q.end_b", "q.before", bucket.alias("b"))

    order = Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # a document of the last bucket is taken if more than half of it fits
    last = placed.where("b = end_b").withColumn("upto", F.col("before") + F.sum("size").over(order))
    last = last.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    others = placed.where("b != end_b").withColumn("more", ((F.col("end_b") != "") & (F.col("b") < F.col("end_b"))).cast("int"))
    chosen = others.unionByName(last)
    copies = (F.col("full") + F.col("more")).cast("int")
    out = chosen.select(*_columns(keep, id_col, "size", F.col("source_size"), F.col("target"), copies * F.col("size"), copies))
    return out.select("doc.*", "mix_copies") if keep else out


def _columns(keep: bool, id_col: str, size: str, source_size: Column, target: Column, taken: Column, copies: Column) -> list[Column]:
    if keep:
        return [F.col("doc"), copies.alias("mix_copies")]
    return [F.col("id").alias(id_col), F.col(size), source_size.alias("source_size"), target.alias("target"),
            taken.cast("long").alias("taken"), copies.cast("int").alias("copies")]


def repeated(docs: DataFrame, plan: Mix = Mix(), **names) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    out = mix(docs, plan, keep=True, **names)
    # documents without words cost nothing and keep their one row
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(1), F.col("mix_copies"))).alias("mix_copy")).drop("mix_copy")
