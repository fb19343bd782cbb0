"""Minimal acyclic transducers over sorted terms, and streaming of text through them.

A transducer maps each of its terms to the term's place among all of them in
byte order (its ordinal): every edge carries the number of terms that come
before the ones behind it, and the outputs along a path add up.  It is built
from sorted terms in one pass that keeps only the path of the last term open;
equal states are merged at once, so the automaton is minimal.

In memory it is a few flat arrays, with three bitmap words of 64 bytes values
for each state (no term holds a byte below 0x40), so that a whole batch of
words moves along its edges together, one byte at a time.
"""

from __future__ import annotations

import numpy as np

#: Bitmap words of a state: bytes 0x40-0x7F, 0x80-0xBF and 0xC0-0xFF.
PAGES = 3


class Builder:
    """Takes terms (bytes, ascending, distinct) and gives the minimal transducer."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []      # frozen: (final, byte, target, byte, target, ...)
        self.open: list[list] = [[False]]  # states on the path of the last term
        self.last = b""
        self.terms = 0

    def add(self, term: bytes) -> None:
        shared = 0
        for a, b in zip(term, self.last):
            if a != b:
                break
            shared += 1
        self._freeze(shared)
        for byte in term[shared:]:
            self.open[-1] += [byte, -1]
            self.open.append([False])
        self.open[-1][0] = True
        self.last = term
        self.terms += 1

    def _freeze(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            number = self._number(tuple(self.open.pop()))
            self.open[-1][-1] = number

    def _number(self, state: tuple) -> int:
        number = self.register.get(state)
        if number is None:
            number = self.register[state] = len(self.states)
            self.states.append(state)
        return number

    def finish(self) -> bytes:
        """The transducer as bytes; its root is the last state."""
        self._freeze(0)
        # the root comes last, also where another state equals it (no terms)
        self.states.append(tuple(self.open.pop()))
        n = len(self.states)
        below = [0] * n
        bits = np.zeros((n, PAGES), np.uint64)
        first = np.zeros((n, PAGES), np.int32)
        target, output = [], []
        for i, state in enumerate(self.states):
            count = int(state[0])
            seen = [0] * PAGES
            start = len(target)
            for byte, to in zip(state[1::2], state[2::2]):
                page = (byte >> 6) - 1
                bits[i, page] |= np.uint64(1 << (byte & 63))
                seen[page] += 1
                target.append(to)
                output.append(count)
                count += below[to]
            below[i] = count
            for page in range(PAGES):
                first[i, page] = start
                start += seen[page]
        final = np.array([s[0] for s in self.states], np.uint8)
        head = np.array([n, len(target)], np.int64)
        parts = (head, bits, first, final, np.array(target, np.int32), np.array(output, np.int64))
        return b"".join(x.tobytes() for x in parts)


def _load(blob: bytes):
    n, e = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, out = 16, []
    for kind, size in ((np.uint64, n * PAGES), (np.int32, n * PAGES), (np.uint8, n), (np.int32, e), (np.int64, e)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    return out


class Transducers:
    """Several transducers side by side: (label, first key, ordinal of the first
    term, bytes) each, where those of a label cover ascending ranges of terms
    that start at their keys (the first eight bytes of the first term)."""

    def __init__(self, parts: list[tuple[str, int, int, bytes]]):
        parts = sorted(parts, key=lambda p: (p[0], p[1]))
        arrays, states, edges, self.roots, self.bases = [], 0, 0, [], []
        for _, _, base, blob in parts:
            bits, first, final, target, output = _load(blob)
            arrays.append((bits, first.astype(np.int64) + edges, final, target.astype(np.int64) + states, output))
            states += len(final)
            edges += len(target)
            self.roots.append(states - 1)
            self.bases.append(base)
        self.bits, self.first, self.final, self.target, self.output = (
            (np.concatenate(x) for x in zip(*arrays)) if arrays else (np.zeros(0, np.int64),) * 5)
        self.roots, self.bases = np.array(self.roots, np.int64), np.array(self.bases, np.int64)
        self.parts: dict[str, tuple[int, np.ndarray]] = {}
        for i, (label, key, _, _) in enumerate(parts):
            start, keys = self.parts.get(label, (i, []))
            self.parts[label] = (start, [*keys, key])
        self.parts = {k: (s, np.array(keys, np.uint64)) for k, (s, keys) in self.parts.items()}

    def ordinals(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: list[str], offsets) -> np.ndarray:
        """Ordinals of the words ``buf[starts:ends]`` (-1: not a term).  Text
        ``i`` has the label ``labels[i]`` and the words ``offsets[i:i + 2]``."""
        part = np.full(len(starts), -1, np.int64)
        for label, a, b in zip(labels, offsets[:-1], offsets[1:]):
            if label in self.parts and b > a:
                start, keys = self.parts[label]
                part[a:b] = start if len(keys) == 1 else (
                    start + np.searchsorted(keys, first_keys(buf, starts[a:b], ends[a:b]), "right") - 1)
                if len(keys) > 1:
                    np.maximum(part[a:b], start, out=part[a:b])
        found = np.full(len(starts), -1, np.int64)
        word = np.flatnonzero(part >= 0)
        at, end, state, total = starts[word], ends[word], self.roots[part[word]], self.bases[part[word]].copy()
        while len(word):
            over = at == end
            if over.any():
                good = over & (self.final[state] > 0)
                found[word[good]] = total[good]
                on = ~over
                word, at, end, state, total = word[on], at[on], end[on], state[on], total[on]
            byte = buf[at]
            low = (byte & 63).astype(np.uint64)
            page = state * PAGES + (byte >> 6) - 1
            bits = self.bits[page]
            on = (bits >> low) & np.uint64(1) > 0
            if not on.all():
                word, at, end, total, page, bits, low = word[on], at[on], end[on], total[on], page[on], bits[on], low[on]
            edge = self.first[page] + np.bitwise_count(bits & ((np.uint64(1) << low) - np.uint64(1)))
            total = total + self.output[edge]
            state = self.target[edge]
            at = at + 1
        return found

    def term(self, label: str, ordinal: int) -> bytes | None:
        """The term with this ordinal, or None if none of these transducers has it."""
        if label not in self.parts:
            return None
        start, keys = self.parts[label]
        i = start + int(np.searchsorted(self.bases[start: start + len(keys)], ordinal, "right")) - 1
        if i < start:
            return None
        state, rest, out = int(self.roots[i]), ordinal - int(self.bases[i]), bytearray()
        while True:
            if self.final[state] and rest == 0:
                return bytes(out)
            edges = [(64 + 64 * p + b, int(self.first[state * PAGES + p]) + k) for p in range(PAGES)
                     for k, b in enumerate(_bits(int(self.bits[state * PAGES + p])))]
            step = [(byte, e) for byte, e in edges if self.output[e] <= rest]
            if not step:
                return None
            byte, e = step[-1]
            out.append(byte)
            rest -= int(self.output[e])
            state = int(self.target[e])


def _bits(word: int) -> list[int]:
    return [b for b in range(64) if word >> b & 1]


def first_key(term: bytes) -> int:
    return int.from_bytes(term[:8].ljust(8, b"\0"), "big")


def first_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as numbers in byte order."""
    key = np.zeros(len(starts), np.uint64)
    for i in range(8):
        at = starts + i
        byte = np.where(at < ends, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint64)
        key = (key << np.uint64(8)) | byte
    return key
