"""Counts and scores of letters given the letters before them, in Arrow batches.

A context is the last `order` letters before a letter, fewer after a start: that of the
sequence, or of a segment where a column of boundaries is given. There are
(4^(order+1) - 1) / 3 contexts, so the table of counts is bounded by the order, which is
checked. A batch sends on one row for each of its contexts and letters, and a sequence
gets its bits without a row for a letter or a shuffle.

Sequences are of A, C, G, U; a null or empty one has 0 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.sequence import ALPHABET
from . import scans

#: Largest order: 4^11 counts, 32 MB of them.
MOST_ORDER = 10
DIGIT = np.zeros(256, np.int64)
DIGIT[np.frombuffer(ALPHABET.encode(), np.uint8)] = range(4)


def contexts(seqs: list[str | None], order: int, boundaries: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, letter) of all letters of the sequences, one after another, and the sequences' lengths."""
    sizes = np.array([len(s or "") for s in seqs], np.int64)
    x = DIGIT[np.frombuffer("".join(s or "" for s in seqs).encode(), np.uint8)]
    at = np.arange(len(x))
    begins = np.zeros(len(x), bool)
    ends = np.cumsum(sizes)
    begins[(ends - sizes)[sizes > 0]] = True
    if boundaries is not None:
        begins |= np.concatenate([np.zeros(0, np.int64), *(np.asarray(b, np.int64) for b in boundaries)]) > 0
    since = np.minimum(at - np.maximum.accumulate(np.where(begins, at, 0)), order) if len(x) else at
    code, value = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for n in range(1, order + 1):
        value[n:] += x[:-n] * 4 ** (n - 1) if n <= len(x) else 0
        code = np.where(since == n, value + (4**n - 1) // 3, code)
    return code, x, sizes


def _columns(rows: DataFrame, boundary: Column | None) -> list[Column]:
    return [F.col("canonical_sequence").alias("seq"), *([boundary.alias("cuts")] if boundary is not None else [])]


def _check(order: int) -> int:
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 0 to {MOST_ORDER}")
    return (4 ** (order + 1) - 1) // 3


def letter_counts(rows: DataFrame, order: int, boundary: Column | None = None) -> np.ndarray:
    """Counts of each letter after each context: an array of (contexts, 4)."""
    n = _check(order)

    def run(batches):
        for batch in batches:
            code, x, _ = contexts(batch.column(0).to_pylist(), order, batch.column(1).to_pylist() if batch.num_columns > 1 else None)
            found, counts = np.unique(code * 4 + x, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["at", "n"])

    counts = rows.select(*_columns(rows, boundary)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * n, np.int64)
    out[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    return out.reshape(n, 4)


def letter_bits(rows: DataFrame, key: str, counts: np.ndarray, order: int, boundary: Column | None = None, alpha: float = 1.0) -> DataFrame:
    """key, nll_bits of each sequence under add-alpha smoothed counts."""
    bits = -np.log2((counts + alpha) / (counts.sum(axis=1, keepdims=True) + 4 * alpha))
    return table_bits(rows, key, {"nll_bits": bits}, order, boundary)


def context_entropies(counts: np.ndarray, order: int) -> np.ndarray:
    """Entropy in nats of the smoothed letters after each context; log 4 after one that is short."""
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + 4)
    out = -(p * np.log(p)).sum(axis=1)
    out[: (4**order - 1) // 3] = np.log(4.0)
    return out


def mean_entropy(rows: DataFrame, counts: np.ndarray, order: int) -> float:
    """Mean over all letters of rows; 0 without any."""
    entropy = context_entropies(counts, order)

    def run(batches):
        for batch in batches:
            code, _, _ = contexts(batch.column(0).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([pa.array([float(entropy[code].sum())]), pa.array([len(code)], pa.int64())], ["total", "n"])

    sums = rows.select(*_columns(rows, None)).mapInArrow(run, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    return sums[0] / sums[1] if sums[1] else 0.0


def gated(values: list[float], gate: float) -> list[int]:
    """1 at 0, and where the sum since the last boundary has reached the gate."""
    out, total = [], gate
    for e in values:
        cut = total >= gate or not out
        total = e if cut else total + e
        out.append(int(cut))
    return out


def entropy_boundaries(rows: DataFrame, keep: list[str], counts: np.ndarray, order: int, gate: float) -> DataFrame:
    """keep (with canonical_sequence) and boundary: 1 at 0, and where the entropy since the last boundary reaches the gate."""
    entropy = context_entropies(counts, order)
    names = [*keep, "boundary"]

    def run(batches):
        for batch in batches:
            code, _, sizes = contexts(batch.column(keep.index("canonical_sequence")).to_pylist(), order)
            values, ends = entropy[code], np.cumsum(sizes)
            cuts = [gated(values[e - n : e].tolist(), gate) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.list_(pa.int32()))], names)

    part = rows.select(*keep)
    return part.mapInArrow(run, StructType([*part.schema.fields, StructField("boundary", ArrayType(IntegerType()))]))


def stream_patches(rows: DataFrame, by: list[str], counts: np.ndarray, order: int, gate: float) -> DataFrame:
    """length, n of the patches that the gate cuts from all sequences as one stream, in order of by; the last patch counts too."""
    entropy, at = context_entropies(counts, order), rows.columns.index("canonical_sequence")

    def items(batch):
        code, _, sizes = contexts(batch.column(at).to_pylist(), order)
        values, ends = entropy[code], np.cumsum(sizes)
        return [values[e - n : e].tolist() for e, n in zip(ends.tolist(), sizes.tolist())]

    out, last = scans.resetting_scan(rows, by, items, scans.gate_rule(gate))
    sizes = out.select(F.explode("closed").alias("length"))
    if last:
        sizes = sizes.union(rows.sparkSession.range(1).select(F.lit(last[1]).cast("long")))
    return sizes.groupBy("length").agg(F.count("*").alias("n"))


def nested_counts(rows: DataFrame, order: int) -> np.ndarray:
    """Counts of each letter after each context of 0 to order letters, each letter once for every length of context that it has."""
    n = _check(order)

    def run(batches):
        for batch in batches:
            total = np.zeros(4 * n, np.int64)
            seqs = batch.column(0).to_pylist()
            for d in range(order + 1):
                code, x, _ = contexts(seqs, d)
                full = code >= (4**d - 1) // 3
                total += np.bincount(code[full] * 4 + x[full], minlength=4 * n)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["at", "n"])

    counts = rows.select(*_columns(rows, None)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * n, np.int64)
    out[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    return out.reshape(n, 4)


def ppm_bits(rows: DataFrame, key: str, counts: np.ndarray, order: int) -> DataFrame:
    """key, nll_bits, nt by partial matching with escape method C, from nested_counts.

    Contexts of order, order - 1, ... 0 letters are tried in turn; near the start of a sequence the same short
    context is met at several orders and escapes each time; a letter that order 0 has not seen costs 2 bits. The
    figure is a proxy, not a code length.
    """
    seen = counts.sum(axis=1)
    kinds = (counts > 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit_bits = np.where(counts > 0, np.log2(counts / (seen + kinds)[:, None]), 0.0)
        escape_bits = np.where(seen > 0, np.log2(kinds / (seen + kinds)), 0.0)

    def run(batches):
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            log_p, done = None, None
            for d in range(order, -1, -1):
                code, x, sizes = contexts(seqs, d)
                if log_p is None:
                    log_p, done = np.zeros(len(x)), np.zeros(len(x), bool)
                hit = counts[code, x] > 0
                log_p = np.where(done, log_p, log_p + np.where(hit, hit_bits[code, x], escape_bits[code]))
                done |= hit
            each = np.zeros(len(x) + 1)
            np.cumsum(np.where(done, -log_p, 2.0), out=each[1:])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each[ends] - each[ends - sizes]), pa.array(sizes)], [key, "nll_bits", "nt"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *_columns(rows, None)).mapInArrow(run, f"`{key}` {kind}, nll_bits double, nt long")


def entropy_steps(rows: DataFrame, key: str, counts: np.ndarray, order: int, gate: float | None = None) -> DataFrame:
    """key, pos, entropy of each letter, and boundary where a gate is given; a row a letter, made where the sequences are read."""
    entropy = context_entropies(counts, order)
    names = [key, "pos", "entropy", *(["boundary"] if gate is not None else [])]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):  # so that the letters of a few sequences are held
                part = batch.slice(begin, 64)
                code, _, sizes = contexts(part.column(1).to_pylist(), order)
                ends = np.cumsum(sizes)
                values = entropy[code]
                at = np.arange(len(code)) - np.repeat(ends - sizes, sizes)
                owner = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                columns = [owner, pa.array(at.astype(np.int32)), pa.array(values)]
                if gate is not None:
                    cuts: list[int] = []
                    for e, n in zip(ends.tolist(), sizes.tolist()):
                        cuts += gated(values[e - n : e].tolist(), gate)
                    columns.append(pa.array(cuts, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, pos int, entropy double" + (", boundary int" if gate is not None else "")
    return rows.select(key, *_columns(rows, None)).mapInArrow(run, schema)


def table_bits(rows: DataFrame, key: str, tables: dict[str, np.ndarray], order: int, boundary: Column | None = None) -> DataFrame:
    """key, and for each name the sum over a sequence's letters of its (contexts, 4) table of bits."""
    _check(order)
    names = list(tables)

    def run(batches):
        for batch in batches:
            code, x, sizes = contexts(batch.column(1).to_pylist(), order, batch.column(2).to_pylist() if batch.num_columns > 2 else None)
            ends, sums = np.cumsum(sizes), []
            for name in names:
                each = np.zeros(len(x) + 1)
                np.cumsum(tables[name][code, x], out=each[1:])
                sums.append(pa.array(each[ends] - each[ends - sizes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], [key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *_columns(rows, boundary)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in names))
