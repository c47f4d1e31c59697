"""Byte-pair merges fitted on all rows of a table.

The rows' segments are strings of two-byte token numbers with a separator between
segments; the strings never leave the executors. A pass over them counts adjacent
pairs, and for the pairs that were most frequent before also what stands to their left
and right. From these the driver takes several merges at once, with bounds of every
pair's count, as long as one pair's least count is above all others' most; else the
next pass begins. The merges are those of one merge a pass.

The driver sees one row for each pair of tokens, and each neighbour of CANDIDATES of
them, at most. Every EVERY passes the strings are checkpointed, so that a pass applies
a bounded number of merges only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABET
from .homology import checkpointed

#: The separator; token numbers go from 1 to MOST.
GAP, MOST = 0, (1 << 16) - 1
#: Passes between two checkpoints, and pairs whose neighbours are counted.
EVERY, CANDIDATES = 6, 400
#: Letters of a string of segments, about.
CHUNK = 1 << 20


def merged(x: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    """x with each a, b made c, from left to right."""
    at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
    if not len(at):
        return x
    if a == b:  # in a run of hits every second one overlaps the one before
        first = np.append(True, np.diff(at) != 1)
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        at = at[(np.arange(len(at)) - start) % 2 == 0]
    x = x.copy()
    x[at] = c
    keep = np.ones(len(x), bool)
    keep[at + 1] = False
    return x[keep]


def _strings(rows: DataFrame, letters: int) -> DataFrame:
    pattern, numbers = re.compile(rb"[%s]{1,%d}" % (ALPHABET.encode(), letters)), bytes.maketrans(ALPHABET.encode() + b"-", bytes([*range(1, len(ALPHABET) + 1), GAP]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts):
            x = np.frombuffer(b"-".join(parts).translate(numbers), np.uint8).astype(np.uint16)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

        parts, size = [], 0
        for batch in batches:
            for s in batch.column(0):
                found = pattern.findall((s.as_py() or "").encode())
                parts += found
                size += letters * len(found)
                if size >= CHUNK:
                    yield one(parts)
                    parts, size = [], 0
        if parts:
            yield one(parts)

    return rows.select("canonical_sequence").mapInArrow(run, "x binary")


def _applied(value, steps: list[tuple[int, int, int]]) -> np.ndarray:
    x = np.frombuffer(value.as_py(), np.uint16)
    for step in steps:
        x = merged(x, *step)
    return x


def _merge(strings: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for s in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_applied(s, steps).tobytes()], pa.binary())], ["x"])

    return strings.mapInArrow(run, "x binary")


def _counts(strings: DataFrame, steps: list[tuple[int, int, int]], near: list[tuple[int, int]]) -> tuple[dict, dict, dict]:
    """Of the strings after the steps: counts of pairs, of (left, a, b) and of (a, b, right) for the pairs (a, b) of near."""
    wanted = np.sort(np.array([a << 16 | b for a, b in near], np.int64))

    def run(batches):
        for batch in batches:
            for s in batch.column(0):
                x = _applied(s, steps).astype(np.int64)
                pair = x[:-1] << 16 | x[1:]
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair) if len(wanted) else np.zeros(0, np.int64)
                left, right = at[at > 0], at[at < len(x) - 2]
                kinds = [pair[(x[:-1] != GAP) & (x[1:] != GAP)], x[left - 1] << 32 | pair[left], pair[right] << 16 | x[right + 2]]
                for kind, codes in enumerate(kinds):
                    found, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found), pa.array(n.astype(np.int64))], ["kind", "code", "n"])

    counts = strings.mapInArrow(run, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (counts.column(c).to_numpy() for c in ("kind", "code", "n"))
    out = []
    for k in range(3):
        parts = [(code >> shift & MOST).tolist() for shift in ((16, 0) if k == 0 else (32, 16, 0))]
        out.append({t[:-1]: t[-1] for t, yes in zip(zip(*parts, n.tolist()), kind == k) if yes})
    return tuple(out)


class Ahead:
    """The merges that follow from one pass's counts, each with what it leaves certain.

    pairs holds [least, most] of each pair's count. A merge of a, b takes from the pairs (x, a) as many as there
    are x, a, b, and from (b, y) as many as there are a, b, y, and gives them to the new token. These numbers are
    those of the pass, less at the most what later merges took from them.
    """

    def __init__(self, tokens: list[str], pairs: dict, left: dict, right: dict, near: set):
        self.tokens, self.left, self.right, self.near = tokens, left, right, near
        self.number = {t: k for k, t in enumerate(tokens)}
        self.pairs = {p: [n, n] for p, n in pairs.items()}
        self.old = set(range(len(tokens)))  # tokens that stand where they stood in the pass
        self.by_first: dict[int, list[tuple[int, int]]] = {}  # merges of this pass
        self.by_second: dict[int, list[tuple[int, int]]] = {}
        self.before: dict[int, set[int]] = {}
        self.after: dict[int, set[int]] = {}
        for a, b in pairs:
            self.before.setdefault(b, set()).add(a)
            self.after.setdefault(a, set()).add(b)
        # only these can be the next; the others count no more than least
        some = sorted(pairs.values(), reverse=True)[: 4 * CANDIDATES]
        self.least = some[-1] if len(some) == 4 * CANDIDATES else 0
        self.top = {p for p, n in pairs.items() if n >= self.least}

    def rank(self, pair, end=1):
        return self.pairs[pair][end], self.tokens[pair[0]], self.tokens[pair[1]]

    def _give(self, pair, least: int, most: int) -> None:
        if most <= 0:
            return
        own = self.pairs.setdefault(pair, [0, 0])
        own[0] += least
        own[1] += most
        self.before.setdefault(pair[1], set()).add(pair[0])
        self.after.setdefault(pair[0], set()).add(pair[1])
        if own[1] >= self.least:
            self.top.add(pair)

    def _take(self, pair, least: int, most: int) -> None:
        own = self.pairs[pair]
        own[0], own[1] = max(0, own[0] - most), own[1] - least
        if own[1] <= 0:
            del self.pairs[pair]
            self.top.discard(pair)

    def _beside(self, x: int, pair: tuple[int, int], on_left: bool, most: int) -> tuple[int, int]:
        """Bounds of how often x stands to the left (right) of the pair, which occurs most times at the most."""
        a, b = pair
        ends = self.pairs.get((x, a) if on_left else (b, x))
        most = min(most, ends[1]) if ends else 0
        if pair not in self.near or not {x, a, b} <= self.old:
            return 0, most
        counted = (self.left.get((x, a, b), 0)) if on_left else self.right.get((a, b, x), 0)
        lost = 0
        # the outer letters may have gone into a merge with what is beyond them
        for p, q in self.by_second.get(x if on_left else a, ()):
            lost += self.right.get((p, q, a if on_left else b), 0) if (p, q) in self.near else counted
        for p, q in self.by_first.get(b if on_left else x, ()):
            lost += self.left.get((a if on_left else b, p, q), 0) if (p, q) in self.near else counted
        most = min(most, counted)
        return min(most, max(0, counted - lost)), most

    def next(self) -> tuple[int, int, int] | None:
        """The next merge, as (first, second, new) token, if it is certain."""
        first, second = None, (0, "", "")
        for pair in self.top:
            rank = self.rank(pair)
            if first is None or rank > first[0]:
                first, second = (rank, pair), first[0] if first else second
            elif rank > second:
                second = rank
        if first is None or self.rank(first[1], 0) <= second or self.pairs[first[1]][0] < self.least:
            return None
        a, b = merge = first[1]
        word = self.tokens[a] + self.tokens[b]
        c = self.number.setdefault(word, len(self.tokens))
        if c == len(self.tokens):
            self.tokens.append(word)
        _, most = self.pairs.pop(merge)
        self.top.discard(merge)
        changes = []
        for x in self.before.get(a, ()):
            if (x, a) in self.pairs and x != b:
                changes.append(((x, a), (x, c), *self._beside(x, merge, True, most)))
        for y in self.after.get(b, ()):
            if (b, y) in self.pairs and y != a:
                changes.append(((b, y), (c, y), *self._beside(y, merge, False, most)))
        if a == b:
            changes = [(old, new, 0, high) for old, new, _, high in changes]
            run = self.right.get((a, a, a), 0) if merge in self.near and a in self.old else most
            changes += [(None, (c, a), 0, run), (None, (c, c), 0, run)]
        elif (b, a) in self.pairs:
            on_left, on_right = self._beside(b, merge, True, most), self._beside(a, merge, False, most)
            own = self.pairs[(b, a)]
            changes += [(None, (b, c), 0, on_left[1]), (None, (c, a), 0, on_right[1]), (None, (c, c), 0, min(on_left[1], on_right[1]))]
            own[0], own[1] = max(0, own[0] - on_left[1] - on_right[1]), own[1] - max(on_left[0], on_right[0])
            if own[1] <= 0:
                del self.pairs[(b, a)]
                self.top.discard((b, a))
        for old, new, low, high in changes:
            if old:
                self._take(old, low, high)
            self._give(new, low, high)
        self.old -= {c}
        if a == b:
            self.old -= {a}
        self.by_first.setdefault(a, []).append(merge)
        self.by_second.setdefault(b, []).append(merge)
        return a, b, c


def fit_bpe_rows(rows: DataFrame, merges: int, letters: int, said: list | None = None) -> list[tuple[str, str]]:
    """functions.tokenizers.fit_bpe over the segments of `letters` letters of all rows (column canonical_sequence).

    Merges in order: the most frequent pair each time, of equals the greatest. Pairs across segments do not count.
    said: gets the number of merges of each pass.
    """
    if merges > MOST - len(ALPHABET):
        raise ValueError("token numbers are two bytes")
    strings = checkpointed(_strings(rows, letters))
    tokens, order, steps, near, passes = ["", *ALPHABET], [], [], [(a, b) for a in range(1, 5) for b in range(1, 5)], 0
    while len(order) < merges:
        ahead = Ahead(tokens, *_counts(strings, steps, near), set(near))
        passes, n = passes + 1, len(order)
        while len(order) < merges and (step := ahead.next()):
            order.append((tokens[step[0]], tokens[step[1]]))
            steps.append(step)
        if said is not None:
            said.append(len(order) - n)
        if len(order) == n:
            break
        # what was most frequent, or may be
        near = sorted(ahead.pairs, key=ahead.rank, reverse=True)[:CANDIDATES]
        if passes % EVERY == 0 and len(order) < merges:
            strings, steps = checkpointed(_merge(strings, steps)), []
    return order
