"""Helpers shared by the training-data operators: table access, staged tables, word hashing."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.plans.util import remove_path, scratch_path, ship_package

#: White space and words of the text contracts (ASCII white space only).
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting to remove shuffle files when their query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Largest side that a join may broadcast, after its bytes were measured.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other scripts stay as they are."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")


#: Folders that :func:`staged` wrote within each open :func:`scratch`.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Remove the tables staged within, but those staged with ``keep``, at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove_path(spark, path)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder of the session and read it back: the
    plan is cut there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    # the written table replaces the plan, so its shuffle files can go at once
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a staged table of ``rows`` counted rows if it fits the
    limit; else the plain table, so that the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def input_bytes(df: DataFrame) -> int:
    """Size of the files below ``df`` as the planner knows it (no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Spark's bound on the bytes of a batch for a Python worker, and the one set here.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and bound their
    batches by bytes, unless the session does: texts differ much in length."""
    ship_package(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


# --- word hashing of whole Arrow batches (numpy, no per-word Python) ---------

_SEED = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D | 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps around on purpose."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SEED)


BYTE_HASH = _byte_table()
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Texts are hashed in runs of about this many bytes, so that memory is bounded.
RUN_BYTES = 4 << 20


def byte_map(spaces, lower: bool = True) -> bytes:
    """Translation table: ``spaces`` become a blank, A-Z lower case."""
    t = list(range(256))
    if lower:
        for a in range(65, 91):
            t[a] = a + 32
    for b in spaces:
        t[b] = 32
    return bytes(t)


#: Words are runs without ASCII white space; upper case folds to lower.
WORDS_MAP = byte_map([0x20, *range(0x09, 0x0E)])


def runs(texts: list[bytes], limit: int = RUN_BYTES):
    """Cut a list of texts into (start, end) runs of about ``limit`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the joined texts (mapped by ``byte_map``: one blank or more
    between words), starts and ends of all words, offsets of each text's words."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = buf == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)]) + 1
    return buf, starts, ends, np.searchsorted(starts, bounds)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: differences of one running polynomial sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_HASH[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _SEED))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of mapped texts, and the offsets of each text's words."""
    buf, starts, ends, offsets = word_spans(texts)
    return span_hashes(buf, starts, ends), offsets


def gram_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams of word hashes: one for each word position of the
    run (grams that leave their text are garbage) and, for each text, the
    offsets of its valid ones as (first, last + 1) in ``words`` positions."""
    n = len(words)
    g = np.zeros(n, np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(_BASE) + words[j: n - k + 1 + j] + np.uint64(j + 1))
        g[: n - k + 1] = acc
    first, last = offsets[:-1], np.maximum(offsets[1:] - (k - 1), offsets[:-1])
    return g, np.stack([first, last], axis=1)
