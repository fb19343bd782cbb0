"""Source divergence audit with minimal acyclic transducers as the vocabulary.

A first pass over the texts counts, for each language, the documents that hold
a term; terms of enough documents are kept.  The kept terms, sorted, are cut
into ranges, and a task builds from each range a minimal acyclic transducer
whose ordinals follow the byte order of the terms.  A second pass streams all
texts through the transducers and recounts by (language, source, ordinal).
From then on terms are ordinals: they break ties, and only the terms of the
final ranks are read back from the transducers.

Plan: both passes combine counts within a task before the shuffle, so a
source or a word with a third of all rows is no hot key.  Transducers are
broadcast in groups of ``PASS_BYTES`` at most, measured by the executors; a
larger vocabulary takes several passes over the texts.  Distances of sources
are sums over blocks of terms: a group of the block kernel holds two blocks of
sources and one block of terms, so that neither sources nor terms meet as a
whole, and no pair of terms or rows is ever made.

Edge cases: null text, language or source counts as empty; repeated rows are
documents of their own; very long texts are a row of work, streamed in whole;
a language without kept terms gives pair rows of value 0 and no term rows; a
language with one source gives no pair rows; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakesift.llm.common import byte_map, on_workers, runs, small_side, staged, word_spans
from lakesift.llm.transducer import Builder, Transducers, first_key

#: Terms are runs of ASCII letters and of all characters beyond ASCII.
TERMS_MAP = byte_map([b for b in range(128) if not chr(b).isalpha()])

#: Terms of a transducer, about.
SHARD_TERMS = 1 << 16
#: Bytes of transducers that a pass over the texts broadcasts at most.
PASS_BYTES = 64 << 20
#: Counted rows that a worker combines before it sends them.
CHUNK_ROWS = 1 << 19
#: Terms and sources of a block of the distance kernel.
TERM_BLOCK = 2048
SOURCE_BLOCK = 256


@dataclass(frozen=True)
class Audit:
    """Terms of ``min_docs`` documents of a language are kept; shares are whole
    parts of ``scale`` with ``smooth`` added to each count; ``top`` ranks of terms."""

    min_docs: int = 30
    scale_steps: int = 3   # the scale is 1000 to this power
    smooth: int = 5
    top: int = 50


def _spans(texts: list[bytes]):
    return word_spans([t.translate(TERMS_MAP) for t in texts])


def _bytes(column) -> list[bytes]:
    return [x.as_py().encode() for x in column]


# --- first pass: document frequencies ------------------------------------------

def term_documents(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of a language that hold a term, by task."""

    def merged(tables):
        return pa.concat_tables(tables).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            langs, texts = batch.column(0), _bytes(batch.column(1))
            for a, b in runs(texts):
                buf, starts, ends, offsets = _spans(texts[a:b])
                if not len(starts):
                    continue
                places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(buf[buf != 32]))
                coded = words.dictionary_encode()
                code, size = coded.indices.to_numpy(), len(coded.dictionary)
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                pair = np.unique(doc * size + code)
                lang = langs.slice(a, b - a).dictionary_encode()
                key, n = np.unique(lang.indices.to_numpy()[pair // size].astype(np.int64) * size + pair % size, return_counts=True)
                held.append(pa.table({
                    "lang": lang.dictionary.take(pa.array(key // size)).cast(pa.string()),
                    "term": coded.dictionary.take(pa.array(key % size)).cast(pa.string()), "n": pa.array(n, pa.int64())}))
                rows += len(key)
                if rows >= CHUNK_ROWS:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > CHUNK_ROWS // 2:
                        yield from held[0].to_batches(1 << 16)
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches(1 << 16)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")


# --- transducers ----------------------------------------------------------------

def build_transducers(kept: DataFrame, n_kept: int) -> DataFrame:
    """(lang, key, n, blob): a transducer for each range of a language's sorted
    terms.  Ranges are cut between terms whose first eight bytes differ."""
    shards = max(1, -(-n_kept // SHARD_TERMS))
    ranged = kept.select("lang", "term").withColumn("start", F.substring(F.encode("term", "utf-8"), 1, 8))
    ranged = ranged.repartitionByRange(shards, "lang", "start").sortWithinPartitions("lang", "term")

    def run(batches):
        lang = builder = key = None

        def done():
            return pa.RecordBatch.from_pydict({
                "lang": [lang], "key": [key.to_bytes(8, "big")], "n": pa.array([builder.terms], pa.int64()), "blob": [builder.finish()]})

        for batch in batches:
            for a, term in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                at = first_key(term)
                full = builder is not None and builder.terms >= SHARD_TERMS and at != first_key(builder.last)
                if builder is None or a != lang or full:
                    if builder is not None:
                        yield done()
                    lang, builder, key = a, Builder(), at
                builder.add(term)
        if builder is not None:
            yield done()

    return ranged.select("lang", "term").mapInArrow(run, "lang string, key binary, n bigint, blob binary")


def passes_of(shards: DataFrame) -> list[list[tuple]]:
    """Names of the transducers (lang, key, ordinal of the first term) in groups
    of ``PASS_BYTES`` at most; one row of this for 65,536 terms comes to the driver."""
    heads = shards.select("lang", "key", "n", F.octet_length("blob").alias("size")).collect()
    out, size, base, lang = [], 0, 0, None
    for r in sorted(heads, key=lambda r: (r["lang"].encode(), bytes(r["key"]))):
        base, lang = (base if r["lang"] == lang else 0), r["lang"]
        if not out or size + r["size"] > PASS_BYTES:
            out.append([])
            size = 0
        out[-1].append((r["lang"], bytes(r["key"]), base))
        size += r["size"]
        base += r["n"]
    return out


def broadcast_pass(shards: DataFrame, names: list[tuple]):
    """Broadcast the transducers of one pass (their bytes were measured)."""
    base = {(lang, key): start for lang, key, start in names}
    wanted = shards.sparkSession.createDataFrame([(lang, bytearray(key)) for lang, key, _ in names], "lang string, key binary")
    rows = shards.join(F.broadcast(wanted), ["lang", "key"]).select("lang", "key", "blob").collect()
    parts = [(r["lang"], int.from_bytes(r["key"], "big"), base[r["lang"], bytes(r["key"])], bytes(r["blob"])) for r in rows]
    return shards.sparkSession.sparkContext.broadcast(parts)


# --- second pass: recount ---------------------------------------------------------

def recount(docs: DataFrame, parts) -> DataFrame:
    """(lang, source, ord, n): occurrences of the terms of these transducers, by task."""

    def run(batches):
        vocabulary = Transducers(parts.value)
        groups: dict[tuple[str, str], int] = {}
        held, rows = [], 0

        def merged():
            g, o, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((o, g))
            g, o, n = g[order], o[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])]))
            return g[head], o[head], np.add.reduceat(n, head)

        def send(g, o, n):
            names = list(groups)
            langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            for a in range(0, len(g), 1 << 16):
                s = slice(a, a + (1 << 16))
                at = pa.array(g[s])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(at), sources.take(at), pa.array(o[s]), pa.array(n[s])], ["lang", "source", "ord", "n"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = _bytes(batch.column(2))
            for a, b in runs(texts):
                buf, starts, ends, offsets = _spans(texts[a:b])
                found = vocabulary.ordinals(buf, starts, ends, langs[a:b], offsets)
                group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs[a:b], sources[a:b])], np.int64)
                good = np.flatnonzero(found >= 0)
                if not len(good):
                    continue
                o, g = found[good], np.repeat(group, np.diff(offsets))[good]
                top = int(o.max()) + 1
                key, n = np.unique(g * top + o, return_counts=True)
                held.append((key // top, key % top, n.astype(np.int64)))
                rows += len(key)
                if rows >= CHUNK_ROWS:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > CHUNK_ROWS // 2:
                        yield from send(*held[0])
                        held, rows = [], 0
        if held:
            yield from send(*merged())

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ord bigint, n bigint")


def terms_of(rows: DataFrame, parts) -> DataFrame:
    """``rows`` with the term of their (lang, ord), as far as these transducers have it."""
    columns = rows.columns
    at = columns.index("lang"), columns.index("ord")

    def run(batches):
        vocabulary = Transducers(parts.value)
        for batch in batches:
            terms = [vocabulary.term(lang, o) for lang, o in zip(*(batch.column(i).to_pylist() for i in at))]
            terms = pa.array([t.decode() if t is not None else None for t in terms], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], [*columns, "term"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("term", StringType())])).where("term is not null")


# --- shares and distances -----------------------------------------------------------

def share(count: str, total: str, audit: Audit) -> Column:
    """1 + floor(scale * (count + smooth) / total) of two long columns, exact:
    long division by steps of 1000, which no count below 2**63 / 1000 overflows."""
    rest, out = f"({count} + {audit.smooth})", "0L"
    for _ in range(audit.scale_steps):
        out = f"({out} * 1000 + ({rest} * 1000) div {total})"
        rest = f"(({rest} * 1000) % {total})"
    return F.expr(f"{out} + 1")


def shares(count: np.ndarray, total: np.ndarray, audit: Audit) -> np.ndarray:
    """The same for arrays of longs."""
    total = np.maximum(total, 1)
    rest, out = count + audit.smooth, 0
    for _ in range(audit.scale_steps):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _distance_kernel(audit: Audit):
    """Sums of share distances of the sources of two blocks over one block of terms."""

    def run(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0].as_py()
        a, b, block = (rows[c][0].as_py() for c in ("a", "b", "block"))
        width = max(0, min(TERM_BLOCK, rows["v"][0].as_py() - block * TERM_BLOCK))
        named = rows["source"].combine_chunks().dictionary_encode()
        at, names = named.indices.to_numpy(), named.dictionary
        side, total = np.zeros(len(names), np.int64), np.ones(len(names), np.int64)
        side[at], total[at] = rows["side"].to_numpy(), rows["total"].to_numpy()
        p = np.repeat(shares(np.zeros(len(names), np.int64), total, audit)[:, None], width, axis=1)
        n = rows["n"].to_numpy()
        some = n > 0
        place = rows["ord"].to_numpy()[some] - block * TERM_BLOCK
        p[at[some], place] = shares(n[some], total[at[some]], audit)
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        # rows come in any order: a pair has the same order in all blocks of terms
        left = left[np.argsort(names.take(pa.array(left)).to_numpy(zero_copy_only=False), kind="stable")]
        out = []
        for i, s in enumerate(left):
            others = left[i + 1:] if a == b else right
            if len(others):
                out.append((np.full(len(others), s), others, np.abs(p[others] - p[s]).sum(axis=1)))
        s, t, f = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "source": names.take(pa.array(s)).cast(pa.string()),
                         "item": names.take(pa.array(t)).cast(pa.string()), "value": pa.array(f, pa.int64())})

    return run


def distances(groups: DataFrame, counts: DataFrame, audit: Audit) -> DataFrame:
    """(lang, source, item, value) for both orders of all pairs of a language's sources."""
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("long").alias("sides"))
    sides = groups.join(sides, "lang").withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")))
    sides = staged(sides, "audit-sides")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(v + {TERM_BLOCK - 1}) div {TERM_BLOCK} - 1")))
    no = F.lit(0).cast("long")
    every = sides.select("*", F.explode(blocks).alias("block"), no.alias("ord"), no.alias("n"))
    some = counts.join(small_side(sides, sides.count(), 128), ["lang", "source"]).withColumn("block", F.expr(f"ord div {TERM_BLOCK}"))
    rows = every.unionByName(some.select(every.columns))
    rows = rows.withColumn("other", F.explode(F.sequence(no, F.col("sides") - 1)))
    rows = rows.withColumns({"a": F.least("side", "other"), "b": F.greatest("side", "other")})
    near = rows.select("lang", "a", "b", "block", "source", "side", "total", "v", "ord", "n").groupBy("lang", "a", "b", "block").applyInArrow(
        _distance_kernel(audit), "lang string, source string, item string, value bigint")
    sums = staged(near.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "audit-distances")
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence_audit(
    docs: DataFrame, audit: Audit = Audit(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of the sources of each
    language (part ``pair``) and the terms that a source has more of than its
    language (part ``term``)."""
    spark = docs.sparkSession
    on_workers(spark)
    empty = F.lit("")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(F.col(text_col), empty).alias("text"))
    kept = term_documents(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= audit.min_docs)
    kept = staged(kept.select("lang", "term"), "audit-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    shards = staged(build_transducers(kept, kept.count()), "audit-transducers")

    passes = passes_of(shards)
    counted = []
    for names in passes:
        parts = broadcast_pass(shards, names)
        found = recount(docs, parts).groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))
        counted.append(staged(found, "audit-counts"))
        parts.destroy()
    counts = reduce(DataFrame.unionByName, counted) if counted else spark.createDataFrame(
        [], "lang string, source string, ord bigint, n bigint")

    def totals(rows, *keys):
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"))

    zero = F.lit(0).cast("long")
    whole = lambda n: (F.coalesce(n, zero) + audit.smooth * F.coalesce("v", zero)).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals(counts, "lang", "source"), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = staged(groups.select("lang", "source", whole(F.col("n")).alias("total"), F.coalesce("v", zero).alias("v")), "audit-groups")
    langs = totals(counts, "lang").join(sizes, "lang").select("lang", whole(F.col("n")).alias("lang_total"))

    by_group = Window.partitionBy("lang", "source")
    pairs = distances(groups, counts, audit).withColumn(
        "rank", F.row_number().over(by_group.orderBy(F.desc("value"), F.asc("item"))))

    everywhere = totals(counts, "lang", "ord").join(langs, "lang").select("lang", "ord", share("n", "lang_total", audit).alias("q"))
    terms = counts.join(everywhere, ["lang", "ord"]).join(small_side(groups, groups.count(), 128), ["lang", "source"])
    terms = terms.withColumn("value", share("n", "total", audit) - F.col("q")).where("value > 0")
    terms = terms.select("lang", "source", "ord", "value").withColumn(
        "rank", F.row_number().over(by_group.orderBy(F.desc("value"), F.asc("ord")))).where(F.col("rank") <= audit.top)
    terms = staged(terms, "audit-ranks")
    named = []
    for names in passes:
        parts = broadcast_pass(shards, names)
        named.append(staged(terms_of(terms, parts).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"), "audit-named"))
        parts.destroy()
    return reduce(DataFrame.unionByName, named, pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
