"""Brown class-based bigram language model.

Exchange clustering makes the classes from the most frequent words; then every
other training word joins the class where the likelihood of the class bigrams is
largest, given the classes of its frequent neighbours and the shapes of the others.
A word that no training document holds has the class of most single words of its
shape.  A text's probability is the product over its tokens of class transition and
word emission; both are smoothed, and both count all training tokens by the final
classes.

All counts are exact and cover all training documents.  The vocabulary grows
with the corpus, so it is never broadcast: documents form blocks of a fixed
number of rows of a file, each block asks for the words it holds, the requests
are joined with the counts and classes, and the answers meet their block again in
a cogroup, which leaves the class of each token for the transitions.  What is broadcast or reaches the driver is bounded by the model's
parameters (``words`` and ``classes``), not by the corpus: the frequent words,
the matrix of their bigrams, and the class tables.

Edge cases: null, blank and empty texts have one token, the end; a null id
counts as the empty text in the held-out rule; repeated rows count and score
row by row; a corpus without training documents scores by smoothing alone; a
block is bounded in rows, and its texts are hashed in runs of bounded bytes;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import WORDS_MAP, on_workers, runs, span_hashes, staged, word_spans

#: Rows of a file that form a block.
BLOCK_ROWS = 2048
#: Bytes of text hashed at once.
TEXT_BYTES = 2 << 20
#: Shapes of words.
SHAPES = 8
#: Tokens whose neighbours a worker combines before it sends them.
CHUNK_ROWS = 1 << 21
#: Name of the end token among word hashes.
END = 0x656E64


@dataclass(frozen=True)
class Model:
    """Parameters: words that make the classes, number of classes (255 at most),
    weight of the class prior in transitions, count added to emissions."""

    words: int = 1024
    classes: int = 48
    prior: float = 5.0
    added: float = 0.5


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class by shape: digits first, non-letters last, script, length."""
    first, last, size = buf[starts], buf[ends - 1], ends - starts
    out = np.minimum(3, (size - 1) // 3)                       # 0-3: length
    out = np.where(first >= 128, np.minimum(5, 4 + size // 8), out)  # 4-5: not ASCII
    out = np.where((last < 97) & (last < 128), 6, out)         # 6: ends in a mark
    return np.where((first >= 48) & (first < 58), 7, out)      # 7: a number


def _tokens(texts: list[bytes]):
    """For runs of texts: start and end index, word hashes, shapes, offsets."""
    mapped = [t.translate(WORDS_MAP) for t in texts]
    for a, b in runs(mapped, TEXT_BYTES):
        buf, starts, ends, offsets = word_spans(mapped[a:b])
        yield a, b, span_hashes(buf, starts, ends).view(np.int64), shapes(buf, starts, ends), offsets


def _with_ends(values: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts with the end token after each, and the texts' bounds."""
    stops = offsets[1:] - offsets[0]
    return np.insert(values[offsets[0]: offsets[-1]], stops, end), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


# --- counts ------------------------------------------------------------------------

def requests(docs: DataFrame) -> DataFrame:
    """(block, w, r, n): words of each block, their shape, occurrences in
    training documents (0 if only others hold the word).  A block's rows come
    one after another, so a worker holds one block; a block that two tasks
    read comes in two parts."""

    def part(words, kinds, n):
        w, at, back = np.unique(words, return_index=True, return_inverse=True)
        return w, kinds[at], np.bincount(back, n, len(w)).astype(np.int64)

    def merged(block, held):
        w, r, n = part(*(np.concatenate(x) for x in zip(*held)))
        for a in range(0, len(w), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(w[b]), block)), pa.array(w[b]), pa.array(r[b].astype(np.int32)), pa.array(n[b])],
                ["block", "w", "r", "n"])

    def run(batches):
        current, held = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            for a, b, words, kinds, offsets in _tokens(texts):
                all_words, bounds = _with_ends(words, offsets, END)
                all_kinds, _ = _with_ends(kinds, offsets, SHAPES)
                doc = np.repeat(np.arange(a, b), np.diff(bounds))
                of, learned = blocks[doc], train[doc]
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                for x, y in zip(cuts, [*cuts[1:], len(of)]):
                    if held and of[x] != current:
                        yield from merged(current, held)
                        held = []
                    current = of[x]
                    held.append(part(all_words[x:y], all_kinds[x:y], learned[x:y]))
        if held:
            yield from merged(current, held)

    return docs.select("block", "train", "text").mapInArrow(run, "block bigint, w bigint, r int, n bigint")


def bigrams(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(code, n) of training documents: bigrams of frequent words (by index),
    shapes and the end; code is previous * size + current."""
    k, size = len(frequent), len(frequent) + SHAPES + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(0)]
            for _, _, words, kinds, offsets in _tokens(texts):
                ids, bounds = _with_ends(_ids(words, kinds, frequent), offsets, k + SHAPES)
                before = np.roll(ids, 1)
                before[bounds[:-1]] = k + SHAPES
                total += np.bincount(before * size + ids, minlength=size * size)
        found = np.flatnonzero(total)
        for a in range(0, len(found), 1 << 16):
            code = found[a: a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    pairs = docs.where("train").select("text").mapInArrow(run, "code bigint, n bigint")
    return pairs.groupBy("code").agg(F.sum("n").alias("n"))


def _ids(words: np.ndarray, kinds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index of frequent words (sorted hashes); others by their shape."""
    if not len(frequent):
        return kinds.astype(np.int64)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at, len(frequent) + kinds).astype(np.int64)


# --- clustering ----------------------------------------------------------------------

def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(pairs: np.ndarray, n_words: int, n_classes: int, passes: int | None = None) -> np.ndarray:
    """Classes of all rows of a bigram matrix.  The first ``n_words`` rows move
    between ``n_classes`` classes, each to where the likelihood of the class
    bigrams is largest, until no word moves (or for so many passes); the others
    keep their own.  Each move raises that likelihood, so the moves end."""
    size = len(pairs)
    n_classes = min(n_classes, max(1, n_words))
    order = np.argsort(-pairs[:n_words].sum(axis=1), kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(n_words) % n_classes
    of[n_words:] = n_classes + np.arange(size - n_words)
    width = n_classes + size - n_words
    pick = np.zeros((size, width))
    pick[np.arange(size), of] = 1
    pairs = pairs.astype(np.float64)
    table = pick.T @ pairs @ pick
    right, left = pairs @ pick, pairs.T @ pick     # of each word, by class of its neighbour
    rows, columns, logs = table.sum(axis=1), table.sum(axis=0), _xlogx(table)
    k = n_classes
    least = 1e-9 + 1e-12 * float(_xlogx(pairs.sum()))  # gains below are rounding

    def put(c, sign, p, q, own):
        table[c] += sign * p
        table[:, c] += sign * q
        table[c, c] += sign * own
        # a class's sums count its own words, whatever class their neighbours have
        rows[c] += sign * (p.sum() + own)
        columns[c] += sign * (q.sum() + own)
        logs[c], logs[:, c] = _xlogx(table[c]), _xlogx(table[:, c])

    for _ in count() if passes is None else range(passes):
        moved = 0
        for w in order:
            a, own = of[w], pairs[w, w]
            p, q = right[w].copy(), left[w].copy()
            p[a] -= own
            q[a] -= own
            put(a, -1, p, q, own)
            gain = (_xlogx(table[:k] + p) - logs[:k]).sum(axis=1) + (_xlogx(table[:, :k] + q[:, None]) - logs[:, :k]).sum(axis=0)
            d = np.diagonal(table)[:k]
            gain += _xlogx(d + p[:k] + q[:k] + own) + _xlogx(d) - _xlogx(d + p[:k]) - _xlogx(d + q[:k])
            out, into = p.sum() + own, q.sum() + own
            gain -= _xlogx(rows[:k] + out) - _xlogx(rows[:k]) + _xlogx(columns[:k] + into) - _xlogx(columns[:k])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            put(b, 1, p, q, own)
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return of


# --- the other words ---------------------------------------------------------------

def contexts(docs: DataFrame, frequent: np.ndarray, of: np.ndarray) -> DataFrame:
    """(w, code, n) of training documents: the words that aren't frequent, with
    shape, class before and class after in the code."""
    k, width, end = len(frequent), int(of.max()) + 1, of[-1]

    def run(batches):
        held, rows = [], 0

        def flush():
            w, code = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, w))
            w, code = w[order], code[order]
            at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (code[1:] != code[:-1])]))
            n = np.diff(np.append(at, len(w)))
            for a in range(0, len(at), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[at[part]]), pa.array(code[at[part]].astype(np.int32)), pa.array(n[part].astype(np.int32))], ["w", "code", "n"])

        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(0)]
            for _, _, words, kinds, offsets in _tokens(texts):
                ids, bounds = _with_ends(_ids(words, kinds, frequent), offsets, k + SHAPES)
                names, _ = _with_ends(words, offsets, END)
                classes = of[ids]
                before, after = np.roll(classes, 1), np.roll(classes, -1)
                before[bounds[:-1]] = end
                rest = (ids >= k) & (ids < k + SHAPES)
                if rest.any():
                    held.append((names[rest], ((ids[rest] - k) * width + before[rest]) * width + after[rest]))
                    rows += len(held[-1][0])
                if rows >= CHUNK_ROWS:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    return docs.where("train").select("text").mapInArrow(run, "w bigint, code int, n int")


def best_classes(before: np.ndarray, after: np.ndarray, table: np.ndarray, n_classes: int) -> np.ndarray:
    """For each word, by its counts of the classes before and after it, the class
    (of the first ``n_classes``) that it raises the likelihood of the class bigrams
    ``table`` most in."""
    gain = np.zeros((len(before), n_classes))
    for counts, cells in ((after, table[:n_classes].T), (before, table[:, :n_classes])):
        i, j = np.nonzero(counts)
        more = _xlogx(cells[j] + counts[i, j][:, None]) - _xlogx(cells)[j]
        gain += np.add.reduceat(more, np.flatnonzero(np.diff(i, prepend=-1)))
    d = np.diagonal(table)
    i, j = np.nonzero((before[:, :n_classes] > 0) & (after[:, :n_classes] > 0))
    p, q = after[i, j], before[i, j]
    gain[i, j] += _xlogx(d[j] + p + q) + _xlogx(d[j]) - _xlogx(d[j] + p) - _xlogx(d[j] + q)
    sizes, back = np.unique(after.sum(axis=1), return_inverse=True)
    for total in (table[:n_classes].sum(axis=1), table[:, :n_classes].sum(axis=0)):
        gain -= (_xlogx(total + sizes[:, None]) - _xlogx(total))[back]
    return np.argmax(gain, axis=1)


def assigned(rows: DataFrame, table: np.ndarray, n_classes: int) -> DataFrame:
    """(w, r, c, k): shape, occurrences and class of the words of :func:`contexts`."""
    width = len(table)

    def best(w, code, n):
        head = np.concatenate([[True], w[1:] != w[:-1]])
        at, word = np.flatnonzero(head), np.cumsum(head) - 1
        after, before = (
            np.bincount(word * width + side, n, len(at) * width).reshape(-1, width) for side in (code % width, code // width % width))
        k = best_classes(before, after, table, n_classes)
        return pa.RecordBatch.from_arrays(
            [pa.array(w[at]), pa.array((code[at] // width ** 2).astype(np.int32)), pa.array(after.sum(axis=1).astype(np.int64)), pa.array(k.astype(np.int32))],
            ["w", "r", "c", "k"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy() for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on
            if cut:
                yield best(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held:
            yield best(*held)

    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(run, "w bigint, r int, c bigint, k int")


@dataclass
class Trained:
    """All that scoring needs besides the words' counts and classes, and the
    transitions."""

    n_classes: int             # the end has the next one
    unseen: np.ndarray         # class of words that no training document holds, by shape
    denominator: np.ndarray    # of the classes' emissions, log10
    added: float
    n: int
    v: int


def classes_of(docs: DataFrame, vocabulary: DataFrame, model: Model) -> tuple[DataFrame, int]:
    """(w, r, c, k): ``vocabulary`` (w, r, c of the training tokens) with the class of
    every word, and the number of classes."""
    spark = docs.sparkSession
    top = vocabulary.where(F.col("r") < SHAPES).orderBy(F.desc("c"), "w").limit(model.words).collect()
    top = sorted(top, key=lambda r: r["w"])
    frequent = np.array([r["w"] for r in top], np.int64)
    k, size = len(frequent), len(frequent) + SHAPES + 1
    pairs = np.zeros(size * size, np.int64)
    # at most size**2 rows, whatever the corpus
    counted = bigrams(docs, frequent).toArrow()
    pairs[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    pairs = pairs.reshape(size, size)
    of = exchange(pairs, k, model.classes)
    n_classes = int(of[k])
    pick = np.zeros((size, int(of.max()) + 1))
    pick[np.arange(size), of] = 1
    rest = assigned(contexts(docs, frequent, of), pick.T @ pairs @ pick, n_classes)
    known = spark.createDataFrame([(r["w"], r["r"], r["c"], int(of[i])) for i, r in enumerate(top)], "w bigint, r int, c bigint, k int")
    end = vocabulary.where(F.col("r") == SHAPES).select("w", "r", "c", F.lit(n_classes).alias("k"))
    return staged(rest.unionByName(known).unionByName(end), "lm-classes"), n_classes


def train(words: DataFrame, n_classes: int, model: Model) -> Trained:
    """``words``: all training words as :func:`classes_of` gives them."""
    totals = words.groupBy("r", "k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()
    n, v, once = np.zeros(n_classes + 1), np.zeros(n_classes + 1), np.zeros((SHAPES + 1, n_classes + 1))
    for r in totals:
        n[r["k"]] += r["n"]
        v[r["k"]] += r["v"]
        once[r["r"], r["k"]] = r["once"]
    # shapes without single words: by those of all shapes
    unseen = np.argmax(once[:SHAPES, :n_classes] + 1e-9 * once[:SHAPES, :n_classes].sum(axis=0), axis=1)
    return Trained(n_classes, unseen, np.log10(n[:n_classes] + model.added * (v[:n_classes] + 1)), model.added,
                   sum(r["n"] for r in totals), sum(r["v"] for r in totals))


# --- scores --------------------------------------------------------------------------

def score_texts(texts: list[bytes], asked: np.ndarray, counts: np.ndarray, classes: np.ndarray, t: Trained):
    """Per text: tokens, known tokens, base score, log10 probability of its words
    given their classes, and the classes as bytes.  ``asked``: sorted hashes of the
    training words among the texts'; with them their counts and classes."""
    out, named = [[], [], [], []], []
    for _, _, words, kinds, offsets in _tokens(texts):
        names, bounds = _with_ends(words, offsets, END)
        shape, _ = _with_ends(kinds, offsets, SHAPES)
        c, k = np.zeros(len(names), np.int64), np.append(t.unseen, t.n_classes)[shape]
        if len(asked):
            at = np.minimum(np.searchsorted(asked, names), len(asked) - 1)
            known = asked[at] == names
            c[known], k[known] = counts[at[known]], classes[at[known]]
        emission = np.zeros(len(names))
        word = shape < SHAPES
        emission[word] = np.log10(c[word] + t.added) - t.denominator[k[word]]
        base = np.log10((c + 1) / (t.n + 1 * (t.v + 1)))
        first = bounds[:-1]
        for values, part in zip(out, (
            np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(emission, first),
        )):
            values.append(part)
        k = k.astype(np.uint8).tobytes()
        named += [k[a:b] for a, b in zip(bounds, bounds[1:])]
    return [*(np.concatenate(x) if x else np.empty(0) for x in out), named]


def _steps(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams (previous * width + current) of rows of classes, and where each
    row starts; a row has a token at least, and the end comes before its first."""
    rows = rows.to_pylist()
    first = np.cumsum([0, *map(len, rows)])[:-1]
    k = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    before = np.roll(k, 1)
    before[first] = width - 1
    return before * width + k, first


def transitions(judged: DataFrame, n_classes: int, model: Model) -> np.ndarray:
    """log10 of class given previous class, from the classes of training documents."""
    width = n_classes + 1

    def run(batches):
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_steps(batch.column(0), width)[0], minlength=width * width)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    pairs = judged.where("not held_out").select("classes").mapInArrow(run, "code bigint, n bigint")
    counted = pairs.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    table = table.reshape(width, width)
    prior = (table.sum(axis=0) + 1) / (table.sum() + width)
    return np.log10((table + model.prior * prior) / (table.sum(axis=1, keepdims=True) + model.prior))


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def of(df):
        return df.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col))).alias("train"),
            F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block"))

    try:
        return of(docs)
    except AnalysisException:  # not read from files as it is
        return of(staged(docs.select(id_col, text_col), "lm-docs"))


def score(docs: DataFrame, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` and ``perplexity``."""
    spark = docs.sparkSession
    on_workers(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = _blocks(docs, id_col, text_col)
    asked = staged(requests(docs), "lm-requests")
    vocabulary = staged(asked.groupBy("w", "r").agg(F.sum("n").alias("c")).where("c > 0"), "lm-vocabulary")
    words, n_classes = classes_of(docs, vocabulary, model)
    trained = train(words, n_classes, model)
    # count and class in one number
    answers = asked.select("block", "w").join(words.select("w", F.expr("c * 256 + k").alias("ck")), "w")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        texts = [(x.as_py() or "").encode() for x in rows.column("text")]
        # a block that two tasks read asks twice
        w, at = np.unique(found.column("w").to_numpy(), return_index=True)
        ck = found.column("ck").to_numpy()[at]
        tokens, known, base, emission, classes = score_texts(texts, w, ck >> 8, ck & 255, trained)
        return pa.table({
            "id": rows.column("id"), "held_out": compute.invert(rows.column("train")), "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()),
            "emission": pa.array(emission, pa.float64()), "classes": pa.array(classes, pa.binary()),
        })

    judged = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary")
    judged = staged(judged, "lm-judged")
    log = transitions(judged, n_classes, model).reshape(-1)

    def ended(batches):
        for batch in batches:
            step, first = _steps(batch.column(6), n_classes + 1)
            own = np.add.reduceat(log[step], first) + batch.column(5).to_numpy() if len(first) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own, pa.float64())], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = judged.mapInArrow(ended, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(trained.n).cast("bigint").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
