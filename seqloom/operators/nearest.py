"""The nearest of many rows to each query, exactly, block by block.

Rows lie in cells, and both sides of a cell are dealt into blocks of about BLOCK rows by
a hash; a task compares one block of queries with one block of rows in numpy and keeps
each query's best, so a cell that a third of all rows are in is only more blocks, and no
pair is ever a row. A query first meets its own cell, and then the cells that can hold
something nearer than what it found, by the triangle bound on the cell's pivot; the
others are skipped. The pivots come from a bounded sample, which bears on speed only.

Vectors that are null, zero or hold null or non-finite components have no neighbour and
are none. Of equally near rows the one with the smallest id is taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .homology import checkpointed

BLOCK = 2048
#: Cells of vectors.
PIVOTS = 128
#: Slack of a bound, more than what rounding can do to a distance.
SLACK = 1e-6


def _visited(queries: DataFrame, rows: DataFrame, compare: Callable, block: int = BLOCK) -> DataFrame:
    """query, near, value, compared: the best of each query in each pair of blocks. Both sides have cell, id, item."""
    sides = []
    counts = [x.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for x, n in ((queries, "q_blocks"), (rows, "r_blocks"))]
    cells = checkpointed(counts[0].join(counts[1], "cell"))  # a row a cell
    for x, own, other in ((queries, "q", "r"), (rows, "r", "q")):
        x = x.join(F.broadcast(cells), "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int"))
        sides.append(x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).select("cell", "q", "r", "id", "item"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, other = a["id"].to_numpy(), b["id"].to_numpy()
        near, value = compare(ids, a["item"].combine_chunks(), other, b["item"].combine_chunks())
        some = near >= 0
        return pa.table({"query": ids[some], "near": other[near[some]], "value": value[some], "compared": np.full(int(some.sum()), len(other), np.int64)})

    key = ["cell", "q", "r"]
    return sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInArrow(run, "query long, near long, value double, compared long")


def _best(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("value", (-F.col("near")).alias("less"))).alias("b")
    return found.groupBy("query").agg(best, F.sum("compared").alias("compared")).select("query", (-F.col("b.less")).alias("near"), "b.value", "compared")


def _matrix(items: pa.Array) -> np.ndarray:
    return np.stack(items.to_numpy(zero_copy_only=False)).astype(np.float64) if len(items) else np.zeros((0, 0))


def _cosines(ids, a, other, b):
    """Of each vector of a the nearest one of b that is not itself, by cosine to nine digits, then the smaller id."""
    order = np.argsort(other, kind="stable")
    x, y = _matrix(a), _matrix(b)[order]
    x, y = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (x, y))
    near, value = np.full(len(x), -1), np.zeros(len(x))
    for i in range(0, len(x), 256):
        cosine = np.round(x[i : i + 256] @ y.T, 9)
        cosine[ids[i : i + 256, None] == other[order][None]] = -np.inf
        at = cosine.argmax(axis=1)
        value[i : i + 256] = cosine[np.arange(len(at)), at]
        near[i : i + 256] = np.where(np.isfinite(value[i : i + 256]), order[at], -1)
    return near, value


def _sound(vectors: DataFrame) -> DataFrame:
    """id, item of the vectors that have a direction."""
    item = F.col("embedding").cast("array<double>")
    good = F.forall(item, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))) & F.exists(item, lambda e: e != 0)
    return vectors.where(good).select(F.col("vec_id").alias("id"), item.alias("item"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, neighbour, cosine, compared: the closest other vector of each query, and with how many it was compared."""
    all_of = _sound(vectors)
    some = all_of.orderBy(F.xxhash64("id")).limit(pivots).select("item").toArrow()
    centres = _matrix(some["item"].combine_chunks())
    if not len(centres):
        return queries.sparkSession.createDataFrame([], "vec_id long, neighbour long, cosine double, compared long")
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))

    def distances(items: pa.Array) -> np.ndarray:
        x = _matrix(items)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.sqrt(np.maximum(0, 2 - 2 * x @ centres.T))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                far = distances(batch.column(1))
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "item", "cell", "far"]
                )

    schema = "id long, item array<double>, cell int, far double"
    rows = checkpointed(all_of.mapInArrow(assign, schema))
    asked = checkpointed(_sound(queries).mapInArrow(assign, schema))
    radius = np.full(len(centres), -np.inf)
    for r in rows.groupBy("cell").agg(F.max("far").alias("radius")).collect():  # a row a cell
        radius[r.cell] = r.radius
    first = checkpointed(_best(_visited(asked, rows, _cosines, block)))

    def further(batches):
        for batch in batches:
            if batch.num_rows:
                value = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                found = np.where(np.isnan(value), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.nan_to_num(value))))
                open_ = distances(batch.column(1)) - radius[None] <= found[:, None] + SLACK
                open_[np.arange(batch.num_rows), batch.column(2).to_numpy()] = False
                at, cell = np.nonzero(open_)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32))], ["id", "item", "cell"])

    more = asked.join(first.select(F.col("query").alias("id"), "value"), "id", "left").select("id", "item", "cell", "value")
    second = _visited(more.mapInArrow(further, "id long, item array<double>, cell int"), rows, _cosines, block)
    best = _best(first.unionByName(second))
    return best.select(F.col("query").alias("vec_id"), F.col("near").alias("neighbour"), F.col("value").alias("cosine"), "compared")


def _identities(ids, a, other, b):
    """Of each sequence of a the one of b with the largest share of agreeing letters over the shorter length, then the smaller id."""
    order = np.argsort(other, kind="stable")
    texts = [(t or "").encode() for t in b.take(pa.array(order)).to_pylist()]
    sizes = np.array([len(t) for t in texts])
    flat, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
    near, value = np.full(len(ids), -1), np.zeros(len(ids))
    for k, s in enumerate(a.to_pylist()):
        x = np.frombuffer((s or "").encode(), np.uint8)
        n = np.minimum(sizes, len(x))
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) if len(n) else np.zeros(0, np.int64)
        same = np.zeros(len(at) + 1, np.int64)
        np.cumsum(flat[np.repeat(begins, n) + at] == x[at], out=same[1:])
        share = np.where(n > 0, (same[ends] - same[ends - n]) / np.maximum(n, 1), 0.0)
        best = int(share.argmax())
        near[k], value[k] = order[best], share[best]
    return near, value


def nearest_sequences(queries: DataFrame, rows: DataFrame, block: int = BLOCK // 4) -> DataFrame:
    """query, near, value, compared by positional identity; both sides have id, item (a sequence). All blocks are met."""
    one = [x.select(F.lit(0).alias("cell"), "id", "item") for x in (queries, rows)]
    return _best(_visited(*one, _identities, block))
