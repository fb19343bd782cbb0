"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves recursively.  Leaves are encoded plainly; neighbours
are joined by re-encoding a window around their boundary that grows until
what lies outside provably stands:

* *Pieces* (matches of the split pattern).  A match depends only on the text
  from its start to ``LOOKAHEAD`` characters after its end.  So the left
  side's pieces that end that far before the boundary stand, and once the
  re-split window ends where a piece of the right side begins, the rest of
  the right side stands too.
* *Tokens of a piece*.  A token sequence is the encoding of its bytes exactly
  if every two neighbours are the encoding of their joint bytes.  So a join
  is final once both seams of the re-encoded window hold such pairs.

Decoding looks every id up and concatenates, which is associative.

Edge cases: a null text counts as empty (no ids, empty bytes); repeated rows
and null ids are encoded row by row; other columns are ignored; an empty
table gives an empty result.  Each row is encoded on its own, nothing is
shuffled, and memory is bounded by a few texts and a bounded piece cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import on_workers

#: Characters after its end that can decide a match of the split pattern
#: (contractions look at two, a run of white space at one).
LOOKAHEAD = 3
#: Leaves of the text tree, in characters, and of a piece's tree, in bytes.
TEXT_LEAF = 1 << 14
PIECE_LEAF = 24
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 200_000
#: Runs up to this length are merged plainly, longer ones with an agenda, or all
#: places of a pair at once if there are so few different pairs.
PLAIN_BYTES = 96
ALIKE_PAIRS = 64
#: Larger than any rank.
NO_RANK = 1 << 62
#: Rows are given back in batches of about this many bytes.
OUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pieces(dict):
    """Ids of pieces, encoded when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[tuple[int, int], bool] = {}
        self.bytes_of = {v: k for k, v in ranks.items()}

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.tree(raw)
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Encoding of a run: the lowest rank first, leftmost of equals."""
        if len(raw) > PLAIN_BYTES:
            return self.merge_alike(raw) or self.merge_agenda(raw)
        rank, never = self.ranks.get, NO_RANK
        parts = [raw[i: i + 1] for i in range(len(raw))]
        scores = [rank(raw[i: i + 2], never) for i in range(len(raw) - 1)]
        while scores:
            low = min(scores)
            if low == never:
                break
            i = scores.index(low)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], never)
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], never)
        return [self.ranks[p] for p in parts]

    def merge_agenda(self, raw: bytes) -> list[int]:
        """The same for a long run: pairs in a heap by (rank, place), parts in a
        linked list; n log n."""
        rank, n = self.ranks.get, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; end 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i: i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            # still two neighbours whose joint bytes end there
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i: end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := rank(raw[before[i]: stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i: end[i]]])
            i = end[i]
        return out

    def merge_alike(self, raw: bytes) -> list[int] | None:
        """The same for a long run of few different pairs, such as a rule of equal
        characters: all places of the lowest pair at once.  None where there are
        many pairs, or where a merge makes a pair of lower rank, which would come
        before the pair's other places."""
        of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        parts, bytes_of, never = of[np.frombuffer(raw, np.uint8)], self.bytes_of, NO_RANK
        ranks: dict[int, int] = {}

        def rank(pairs):
            for key in pairs.tolist():
                if key not in ranks:
                    ranks[key] = self.ranks.get(bytes_of[key >> 32] + bytes_of[key & 0xFFFFFFFF], never)
            return np.array([ranks[key] for key in pairs.tolist()], np.int64)

        while len(parts) > 1:
            pairs = (parts[:-1] << 32) | parts[1:]
            names = np.unique(pairs)
            if len(names) > ALIKE_PAIRS:
                return None
            scores = rank(names)
            low = int(scores.argmin())
            if scores[low] == never:
                break
            at = np.flatnonzero(pairs == names[low])
            if (names[low] >> 32) == (names[low] & 0xFFFFFFFF):
                # overlapping places in a row: every other one, from the left
                head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                place = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
                at = at[place % 2 == 0]
            made = np.int64(scores[low])
            left, right = at[at > 0], at[at + 2 < len(parts)]
            left_of = np.where(np.isin(left - 2, at), made, parts[left - 1])
            new = np.unique(np.concatenate([(left_of << 32) | made, (made << 32) | parts[right + 2]]))
            if len(new) and rank(new).min() <= made:
                return None
            parts[at] = made
            parts = np.delete(parts, at + 1)
        return parts.tolist()

    def tree(self, raw: bytes, seen: dict[bytes, list[int]] | None = None) -> list[int]:
        if len(raw) <= PIECE_LEAF:
            return self.merge(raw)
        seen = {} if seen is None else seen
        if raw not in seen:  # equal halves, as in a rule of equal characters, once
            half = len(raw) // 2
            seen[raw] = self.join(self.tree(raw[:half], seen), self.tree(raw[half:], seen))
        return seen[raw]

    def stands(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their joint bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PIECES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joint bytes of two encodings."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(self.bytes_of[t] for t in chain(left[i:], right[:j])))
            if (not i or self.stands(left[i - 1], window[0])) and (j == len(right) or self.stands(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2


def join_pieces(left: list[str], right: list[str], pattern) -> list[str]:
    """Pieces of the joint text of two split texts."""
    if not left or not right:
        return left or right
    keep, tail = len(left), 0
    while keep and (tail < LOOKAHEAD or keep == len(left)):
        keep -= 1
        tail += len(left[keep])
    text = "".join(chain(left[keep:], right))
    # where the pieces of the right side begin, as far as the window has come
    at, j, new = tail, 0, []
    for m in pattern.finditer(text):
        new.append(m.group())
        end = m.end()
        while at < end and j < len(right):
            at += len(right[j])
            j += 1
        if at == end and end > tail:
            return left[:keep] + new + right[j:]
    return left[:keep] + new


def split_text(text: str, pattern, leaf: int = TEXT_LEAF) -> list[str]:
    """All matches of the pattern, by the tree."""
    if len(text) <= leaf:
        return pattern.findall(text)
    half = len(text) // 2
    return join_pieces(split_text(text[:half], pattern, leaf), split_text(text[half:], pattern, leaf), pattern)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``OUT_BYTES`` from rows."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= OUT_BYTES or len(held) >= 4096:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens`` and ``ids`` (binary: the ids as
    little-endian unsigned 32-bit integers).  The rank file is read once, on
    the driver; its size is that of the vocabulary, whatever the input."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = docs.schema[id_col].dataType

    def run(batches):
        import regex

        split, pieces = regex.compile(pattern), Pieces(shared.value)
        schema = None

        def rows():
            for batch in batches:
                nonlocal schema
                schema = schema or pa.schema([("id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary())])
                for key, text in zip(batch.column(0), batch.column(1)):
                    found = split_text(text.as_py() or "", split)
                    ids = np.fromiter(chain.from_iterable(map(pieces.__getitem__, found)), "<u4")
                    yield key.as_py(), len(ids), ids.tobytes()

        first = rows()
        for row in first:
            yield from _batches(chain([row], first), schema, lambda r: len(r[2]) + 32)

    types = f"id {kind.simpleString()}, n_tokens bigint, ids binary"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, types)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, ``decoded`` (binary) and the other columns of ``tokens``."""
    spark = tokens.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = tokens.columns
    at = names.index(ids_col)
    fields = ", ".join(f"`{n}` {tokens.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        ranks = shared.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            # in slices, so that memory holds a few texts only
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                decoded = [
                    b"".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist()))
                    for x in part.column(at)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, f"{fields}, decoded binary")
