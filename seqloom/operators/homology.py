"""Similar sequences by k-mer containment, and their clusters.

The rule: two sequences are linked if the distinct k-mers they share are at
least `least` of the distinct k-mers of the smaller set. It replaces an aligner
and is stated as it is: containment, not identity over an alignment.

Sequences are dealt to cells (group of A, group of B) at two bits a letter, once for
each group; neither k-mers nor candidate pairs are shuffled. In a cell candidates come
from a prefix filter: if the smaller set A has n k-mers and shares at least `need` of
them with B, then among any n - need + c k-mers of A c are shared. Taking those that
are rarest in the cell keeps frequent k-mers out of the join without dropping any pair;
pairs with fewer than c are no links, the others are compared. A cell keeps its
letters packed and the probes of a slab of A, and reads B in slices, so groups can be
large and few. Every two groups meet: work grows with the square of the letters over
SLAB, and what is sent with their square over GROUP.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters of a group of sequences, and groups at least; letters indexed and read at once, and k-mers compared at once.
GROUP, GROUPS, SLAB, SLICE, NEEDLES = 128_000_000, 8, 64_000_000, 1_000_000, 1_000_000
#: Roles of a sequence: it may be the smaller and the larger one, only a query, only a target.
BOTH, QUERY, TARGET = 0, 1, 2


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a single machine where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "checkpoints"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(rows: DataFrame, ident: str, k: int) -> DataFrame:
    """id, letters (their number), n (distinct k-mers), bits (two a letter) for rows with canonical_sequence of k letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = np.zeros(256, np.uint8)
        digit[np.frombuffer(b"ACGU", np.uint8)] = range(4)
        for batch in batches:
            bits, sizes = [], []
            for seq in batch.column(1):
                x = digit[np.frombuffer(seq.as_buffer(), np.uint8)]
                sizes.append(len(x))
                x = np.pad(x, (0, -len(x) % 4)).reshape(-1, 4)
                bits.append((x[:, 0] << 6 | x[:, 1] << 4 | x[:, 2] << 2 | x[:, 3]).tobytes())
            sizes, known = np.array(sizes, np.int32), pa.array(bits, pa.large_binary())
            n = [np.bincount(_distinct(known.slice(s.start, s.stop - s.start), sizes[s], k)[0], minlength=s.stop - s.start) for s in _slices(sizes, SLICE)]
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *n]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), n, pa.array(bits, pa.binary())], ["id", "letters", "n", "bits"])

    rows = rows.where(F.length("canonical_sequence") >= k).select(F.col(ident).cast("long").alias("id"), "canonical_sequence")
    return rows.mapInArrow(run, "id long, letters int, n long, bits binary")


def _slices(letters: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of places that have about `most` letters in all, one place at least."""
    group = np.cumsum(letters, dtype=np.int64) // most
    starts = np.flatnonzero(_new(group)).tolist()
    yield from map(slice, starts, [*starts[1:], len(letters)])


def _kmers(bits: pa.Array, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the sequence, k-mer as a base-4 number) of all k-mers in order (k up to 31)."""
    kind = np.uint32 if k <= 16 else np.uint64
    if not len(bits):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    at = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
    raw = np.frombuffer(bits.buffers()[2], np.uint8)[at[0] : at[-1]]
    x = (raw[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(kind)
    code, have = x, 1
    for bit in bin(k)[3:]:
        code, have = code[:-have] << kind(2 * have) | code[have:], 2 * have
        if bit == "1":
            code, have = code[:-1] << kind(2) | x[have:], have + 1
    n = letters.astype(np.int64) - k + 1
    place = np.repeat(np.arange(len(n)), n)
    return place, code[np.arange(len(place)) + np.repeat((at[:-1] - at[0]) * 4 - (np.cumsum(n) - n), n)]


def _distinct(bits: pa.Array, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the sequence, k-mer as a base-4 number) of the distinct k-mers, sorted."""
    place, code = _kmers(bits, letters, k)
    if 2 * k + len(letters).bit_length() <= 64:
        key = np.sort(place.astype(np.uint64) << np.uint64(2 * k) | code)
        key = key[_new(key)]
        return (key >> np.uint64(2 * k)).astype(np.int64), (key & np.uint64((1 << 2 * k) - 1)).astype(code.dtype)
    order = np.lexsort((code, place))
    place, code = place[order], code[order]
    new = _new(place) | _new(code)
    return place[new], code[new]


def _new(x: np.ndarray) -> np.ndarray:
    """Where x differs from the element before."""
    return np.r_[np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    """The smallest number of shared k-mers that is `least` of n."""
    need = np.ceil(n * least).astype(np.int64)
    return need - ((need - 1) / np.maximum(n, 1) >= least)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _short(code: np.ndarray) -> np.ndarray:
    """32 bits of a k-mer: itself up to 16 letters, else a hash, which can only make more candidates."""
    return code if code.dtype == np.uint32 else (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _spread(short: np.ndarray, bits: int) -> np.ndarray:
    return short * np.uint32(2654435761) >> np.uint32(32 - bits)


def _room(letters: int, most: int) -> int:
    """Bits of a table with a few places a letter."""
    return min(most, max(10, int(letters).bit_length() + 2))


class _Cell:
    """Sequences of a cell at two bits a letter, by (role, group, number of k-mers, id); they are named by their places."""

    def __init__(self, seqs: pa.Table, k: int, least: float):
        seqs = seqs.sort_by([(name, "ascending") for name in ("role", "g", "n", "id")])
        self.k, self.ids, self.letters, self.n = k, seqs["id"].to_numpy(), seqs["letters"].to_numpy(), seqs["n"].to_numpy()
        self.role, self.group = seqs["role"].to_numpy(), seqs["g"].to_numpy()
        self.bits = pa.concat_arrays([x.cast(pa.large_binary()) for x in seqs["bits"].chunks]) if len(seqs) else pa.array([], pa.large_binary())
        self.need = np.maximum(1, _needed(self.n, least))
        # of any n - need + c k-mers of a set a linked larger one has c
        self.c = np.minimum(1 + self.n // 16, self.need)
        self.probes = np.minimum(self.n, self.n - self.need + self.c)

    def parts(self, s: slice, most: int) -> Iterator[slice]:
        """Slices of s with about `most` letters."""
        for t in _slices(self.letters[s], most):
            yield slice(s.start + t.start, s.start + t.stop)

    def of(self, s: slice, how) -> tuple[np.ndarray, np.ndarray]:
        """_kmers or _distinct of a slice; places are those of the cell."""
        place, code = how(self.bits.slice(s.start, s.stop - s.start), self.letters[s], self.k)
        return place + s.start, code

    def often(self, ys: slice) -> np.ndarray:
        """About how often a k-mer is in ys: it only ranks k-mers, any ranks give all links."""
        bits = _room(self.letters[ys].sum(dtype=np.int64), 23)
        out = np.zeros(1 << bits, np.uint32)
        for s in self.parts(ys, SLICE):
            np.add.at(out, _spread(_short(self.of(s, _kmers)[1]), bits), np.uint32(1))
        return out

    def rarest(self, xs: slice, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each set the probes that are rarest: k-mers in order, where each one's places begin (and the end), places."""
        bits, out, done = len(often).bit_length() - 1, np.empty(self.probes[xs].sum(), np.uint64), 0
        for s in self.parts(xs, SLICE):
            place, code = self.of(s, _distinct)
            short = _short(code)
            rank, at = np.minimum(often[_spread(short, bits)], (1 << 20) - 1).astype(np.uint64), len(place).bit_length()
            if (s.stop - s.start).bit_length() + 20 + at <= 64:  # sorted as one number, much faster
                order = np.sort(((place - s.start).astype(np.uint64) << np.uint64(20) | rank) << np.uint64(at) | np.arange(len(place), dtype=np.uint64))
                order = (order & np.uint64((1 << at) - 1)).astype(np.int64)
            else:
                order = np.lexsort((rank, place))
            order = order[_runs(np.cumsum(self.n[s]) - self.n[s], self.probes[s])]
            out[done : done + len(order)] = short[order].astype(np.uint64) << np.uint64(32) | place[order].astype(np.uint64)
            done += len(order)
        out.sort()
        start = np.flatnonzero(_new(out >> np.uint64(32)))
        return (out[start] >> np.uint64(32)).astype(np.uint32), np.r_[start, len(out)], out.astype(np.uint32)

    def links(self, xs: slice, ys: slice, ordered: bool, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, shared) of linked sets, each once; ordered: only where x is the smaller one, then the one of the smaller id.

        skip(x, y) tells which candidates need not be compared."""
        often, low = self.often(ys), np.uint64(0xFFFFFFFF)
        for slab in self.parts(xs, SLAB):
            probed, begin, owner = self.rarest(slab, often)
            bits = _room(len(probed), 25)
            seen = np.zeros(1 << bits, bool)
            seen[_spread(probed, bits)] = True
            larger = int(np.searchsorted(self.n[ys], self.n[slab.start])) if ordered else 0
            for s in self.parts(slice(ys.start + larger, ys.stop), SLICE):
                place, code = self.of(s, _kmers)
                short = _short(code)
                there = seen[_spread(short, bits)]
                key = np.sort(short[there].astype(np.uint64) << np.uint64(32) | place[there].astype(np.uint64))
                key = key[_new(key)]
                new = _new(key >> np.uint64(32))
                code = (key[new] >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(probed, code), len(probed) - 1)
                size, which = np.where(probed[at] == code, begin[at + 1] - begin[at], 0), np.cumsum(new) - 1
                lo, size, y = begin[at][which], size[which], (key & low).astype(np.int64)
                hit = np.flatnonzero(size)
                near = y[hit] - s.start
                hit = hit[np.argsort(near.astype(np.uint16) if s.stop - s.start <= 1 << 16 else near, kind="stable")]
                lo, size, y = lo[hit], size[hit], y[hit]
                have = np.unique(y)
                edge = np.r_[np.searchsorted(y, have), len(y)]
                hits = np.add.reduceat(size, edge[:-1]) if len(have) else size
                sets = None
                for t in _slices(hits, NEEDLES):
                    e = slice(edge[t.start], edge[t.stop])
                    x, v = owner[_runs(lo[e], size[e])].astype(np.int64), np.repeat(y[e], size[e])
                    if ordered:
                        good = (self.n[x] < self.n[v]) | (self.n[x] == self.n[v]) & (self.ids[x] < self.ids[v])
                        x, v = x[good], v[good]
                    pair, n = np.unique(v * len(self.n) + x, return_counts=True)
                    v, x = np.divmod(pair, len(self.n))
                    good = n >= self.c[x]
                    x, v = x[good], v[good]
                    if skip is not None:
                        good = ~skip(x, v)
                        x, v = x[good], v[good]
                    if len(x):
                        sets = sets or self.sets(s)
                        yield from self.compared(x, v, s.start, sets)

    def sets(self, s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct k-mers of a slice, their ranks set by set, and where the set of each place begins (and the last one's end)."""
        place, code = self.of(s, _distinct)
        codes, rank = np.unique(code, return_inverse=True)
        return codes, rank, np.searchsorted(place, np.arange(s.start, s.stop + 1))

    def compared(self, x: np.ndarray, y: np.ndarray, first: int, sets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, shared) of those pairs that are linked; the sets are of a slice that begins at first and has all y."""
        codes, ranks, bounds = sets
        bounds, mark = bounds.tolist(), np.zeros(len(codes), bool)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        mine = np.unique(x)
        for t in _slices(self.letters[mine], SLICE):
            part = mine[t]
            place, code = _distinct(self.bits.take(pa.array(part)), self.letters[part], self.k)
            rank = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            there = codes[rank] == code
            place, rank = place[there], rank[there]
            n = np.bincount(place, minlength=len(part))
            start = np.cumsum(n) - n
            u, v = (z[slice(*np.searchsorted(x, [part[0], part[-1] + 1]))] for z in (x, y))
            at = np.searchsorted(part, u)
            could = np.flatnonzero(n[at] >= self.need[u])
            could = could[np.argsort(v[could], kind="stable")]
            u, v, at = u[could], v[could], at[could]
            for p in _slices(n[at], NEEDLES):
                size = n[at[p]]
                ends = np.cumsum(size)
                needle = rank[_runs(start[at[p]], size)]
                run = np.flatnonzero(_new(v[p]))
                edges = [*(ends - size)[run].tolist(), len(needle)]
                for i, one in enumerate((v[p][run] - first).tolist()):
                    its = ranks[bounds[one] : bounds[one + 1]]
                    mark[its] = True
                    needle[edges[i] : edges[i + 1]] = mark[needle[edges[i] : edges[i + 1]]]
                    mark[its] = False
                shared = np.add.reduceat(needle, ends - size)
                good = shared >= self.need[u[p]]
                yield u[p][good], v[p][good], shared[good]


def _cells(seqs: DataFrame, k: int, least: float) -> tuple[DataFrame, Callable]:
    """The sequences (packed, with role) dealt to cells, grouped by cell; a function (table of a cell) -> (cell, sides to be searched)."""
    seqs = checkpointed(seqs)
    groups = max(GROUPS, math.ceil((seqs.agg(F.sum("letters")).first()[0] or 0) / GROUP))
    g, every = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.sequence(F.lit(0), F.lit(groups - 1))
    cells = F.when(F.col("role") == BOTH, F.transform(every, lambda j: F.least(g, j) * groups + F.greatest(g, j)))
    cells = cells.when(F.col("role") == QUERY, F.transform(every, lambda j: g * groups + j)).otherwise(F.transform(every, lambda j: j * groups + g))

    def opened(batches: Iterator[pa.RecordBatch]) -> tuple[_Cell, list[tuple[slice, slice, bool]]]:
        table = pa.Table.from_batches(list(batches))
        number, cell = table["cell"][0].as_py(), _Cell(table, k, least)
        if (cell.role != BOTH).any():
            n = int(np.searchsorted(cell.role, TARGET))
            return cell, [(slice(0, n), slice(n, len(cell.n)), False)]
        n = int(np.searchsorted(cell.group, number // groups, "right"))
        a, b = slice(0, n), slice(n, len(cell.n))
        return cell, [(a, b, True), (b, a, True)] if number % (groups + 1) else [(a, a, True)]

    sent = seqs.withColumn("g", g).withColumn("cell", F.explode(cells)).repartition(groups * groups, "cell")
    return sent.groupBy("cell"), opened


def links(seqs: DataFrame, k: int, least: float) -> DataFrame:
    """x, y, shared, n (of x): all x that share `least` of their k-mers with y. seqs: packed, with role; each link once."""
    cells, opened = _cells(seqs, k, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = opened(batches)
        for side in sides:
            for x, y, shared in cell.links(*side):
                yield pa.RecordBatch.from_pydict({"x": cell.ids[x], "y": cell.ids[y], "shared": shared, "n": cell.n[x]})

    return cells.applyInArrow(run, "x long, y long, shared long, n long")


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Puts the sets of x and y together; root has the first place of each place's set."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = (v[apart] for v in (x, y, a, b))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def forest(seqs: DataFrame, k: int, least: float) -> DataFrame:
    """a, b: pairs with the components of links(); of a cell's links a forest, so fewer rows than it has sequences."""
    cells, opened = _cells(seqs, k, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = opened(batches)
        root = np.arange(len(cell.n))
        for side in sides:
            for x, y, _ in cell.links(*side, skip=lambda x, y: root[x] == root[y]):
                _joined(root, x, y)
        below = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_pydict({"a": cell.ids[root[below]], "b": cell.ids[below]})

    return cells.applyInArrow(run, "a long, b long")


def containment_pairs(rows: DataFrame, ident: str = "ord", k: int = 16, least: float = 0.8) -> DataFrame:
    """a, b (a < b), shared, containment of all linked pairs."""
    found = links(packed(rows, ident, k).withColumn("role", F.lit(BOTH)), k, least)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", (F.col("shared") / F.col("n")).alias("containment"))


def containment_components(rows: DataFrame, ident: str = "ord", k: int = 16, least: float = 0.8) -> DataFrame:
    """components() of containment_pairs, which are not made: only forests of them leave the cells."""
    rows = checkpointed(rows.select(ident, "canonical_sequence"))
    pairs = forest(packed(rows, ident, k).withColumn("role", F.lit(BOTH)), k, least)
    return components(rows.select(F.col(ident).alias("ident")), pairs)


def cross_hits(queries: DataFrame, targets: DataFrame, ident: str = "ord", k: int = 16, least: float = 0.8) -> DataFrame:
    """Distinct query idents that share `least` of their distinct k-mers with some target."""
    sides = packed(queries, ident, k).withColumn("role", F.lit(QUERY)).union(packed(targets, ident, k).withColumn("role", F.lit(TARGET)))
    cells, opened = _cells(sides, k, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = opened(batches)
        found = np.zeros(len(cell.n), bool)
        for side in sides:
            for x, _, _ in cell.links(*side, skip=lambda x, y: found[x]):
                found[x] = True
        yield pa.RecordBatch.from_pydict({"q": cell.ids[found]})

    return cells.applyInArrow(run, "q long").distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """ident, cluster_id (smallest ident reachable) for each row of nodes (column ident).

    Minimum labels with pointer jumping; each round is aggregated and checkpointed. Linked
    groups are whole components, larger than the stars of a greedy set cover can be.
    """
    ends = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("ab", "ba")]  # one read of pairs, which may be costly
    both = checkpointed(pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v").distinct())
    labels = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    before = None
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"))
        jump = step.select(F.col("u").alias("w"), F.col("label").alias("further"))
        step = step.join(jump, F.col("label") == F.col("w"), "left").select("u", F.least("label", F.coalesce("further", "label")).alias("label"))
        labels = checkpointed(step)
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if total == before:
            break
        before = total
    return nodes.join(labels.withColumnRenamed("u", "ident"), "ident", "left").select("ident", F.coalesce("label", "ident").alias("cluster_id"))
