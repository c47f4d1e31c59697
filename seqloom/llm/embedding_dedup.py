"""Near-duplicate vectors of equal label by an epsilon grid order join.

Unit vectors a and b have cosine >= t exactly if |a - b| <= eps = sqrt(2 - 2t).
An orthogonal projection only brings points closer, so on the leading principal
dimensions (of the second moments of all vectors) partners lie within eps in
every coordinate. Vectors are sorted by label and the grid cells (of side eps)
of these coordinates, and the sorted sequence is cut into blocks that know the
box of their coordinates.

Blocks are joined in two steps: runs of blocks (strips) whose boxes are farther
apart than eps are skipped, then single blocks of the strips left. Strips are
dealt in a triangular grid: a pair of strips is one group, to which each block
that has a near block on the other side is sent once, so in a dense cell a
vector is moved once for each near strip of up to STRIP blocks, not for each
near block. In a task the two sorted intervals are joined recursively: halved
until their boxes are provably distant or small enough for one matrix product in
double precision. A pair of strips sends on the number of links of each vector
and a spanning forest of the links, never the links.

Rows with equal label and vector are one point with a weight. Vectors that are
null, zero, or hold null or non-finite components, and rows with a null label,
link with nothing: n_links 0, component_id = vec_id. Rows that repeat an id are
each returned, equal ones as links of each other. Vectors of different lengths
do not link. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, changes, checkpointed, partitions, whole_groups
from .components import connected_components

LEADING = 6
BLOCK = 2048
STRIP = 16
#: Tasks over which the strip pairs of one label are dealt.
LABEL_SALTS = 64
TILE = 256
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, all lists of one length, as a double matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal(points: DataFrame, size: int) -> np.ndarray:
    """The leading axes of the second moments of all unit vectors of a given length, size x LEADING."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total))], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([_matrix(table["row"]).sum(axis=0)], pa.list_(pa.float64()))})

    parts = points.select("vector").mapInArrow(moments, "i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()  # size x size numbers
    total = np.array([r.row for r in sorted(rows, key=lambda r: r.i)])
    return np.linalg.eigh(total)[1][:, ::-1][:, :LEADING]


def _boxes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return y.min(axis=0), y.max(axis=0)


def _apart(a, b) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def _blocks(axes: np.ndarray, eps: float):
    """Points sorted in grid order -> the same with block numbers and coordinates."""

    def run(batches):
        from pyspark import TaskContext

        base, count, label, filled = TaskContext.get().partitionId() << 32, -1, None, 0
        for batch in batches:
            n = batch.num_rows
            numbers, labels = np.empty(n, np.int64), batch.column("label").to_numpy()
            for i in range(n):
                if count < 0 or labels[i] != label or filled == BLOCK:
                    # strips hold one label: a new label starts a new strip
                    count = count + 1 if labels[i] == label or count < 0 else (count // STRIP + 1) * STRIP
                    label, filled = labels[i], 0
                numbers[i], filled = base + count, filled + 1
            y = pa.array(list(_unit(_matrix(batch.column("vector"))) @ axes), pa.list_(pa.float64()))
            own = [batch.column(c) for c in ("label", "node", "weight", "vector")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(numbers), y], ["label", "node", "weight", "vector", "block", "y"])

    return run


def _join_pairs(threshold: float, eps2: float):
    """Rows sorted by pair and side -> (u, null, w): u links with weight w here; (u, v, null): a link of the forest."""

    def pair(x, y, w, split: int):
        """split: rows of the first side; all rows are one side if that is none."""
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        whole = np.arange(len(x))
        todo = [(whole, whole)] if split == len(x) else [(whole[:split], whole[split:])]
        while todo:
            a, b = todo.pop()
            if a is not b and _apart(_boxes(y[a]), _boxes(y[b])) > eps2:
                continue
            if max(len(a), len(b)) > TILE:
                if a is b:
                    p, q = a[: len(a) // 2], a[len(a) // 2 :]
                    todo += [(p, p), (q, q), (p, q)]
                elif len(a) >= len(b):
                    todo += [(a[: len(a) // 2], b), (a[len(a) // 2 :], b)]
                else:
                    todo += [(a, b[: len(b) // 2]), (a, b[len(b) // 2 :])]
                continue
            near = x[a] @ x[b].T >= threshold
            if a is b:
                np.fill_diagonal(near, False)
                links[a] += near @ w[a]
                near = np.triu(near)
            else:
                links[a] += near @ w[b]
                links[b] += near.T @ w[a]
            p, q = np.nonzero(near)
            forest.add(a[p], b[q])
        return links, forest.links

    def run(batches):
        for table in whole_groups(batches, ["a", "b"]):
            bounds = np.flatnonzero(changes(table["a"].to_numpy(), table["b"].to_numpy()))
            for i, j in zip(bounds, np.append(bounds[1:], len(table))):
                part = table.slice(int(i), int(j - i))
                node = part["node"].to_numpy()
                split = int((part["side"].to_numpy() == 0).sum())
                links, forest = pair(_unit(_matrix(part["vector"])), _matrix(part["y"]), part["weight"].to_numpy(), split)
                some = np.flatnonzero(links)
                p, q = np.array(forest).T if forest else np.zeros((2, 0), int)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([node[some], node[p]])),
                        pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[q])]),
                        pa.concat_arrays([pa.array(links[some]), pa.nulls(len(p), pa.int64())]),
                    ],
                    ["u", "v", "w"],
                )

    return run


def _linked(points: DataFrame, size: int, threshold: float) -> DataFrame:
    """(u, v, w) for the points of one vector length; see _join_pairs."""
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    axes = _principal(points, size)
    axis_rows = [F.array(*[F.lit(float(v)) for v in axes[:, k]]) for k in range(axes.shape[1])]
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    cells = [
        F.floor(F.aggregate(F.zip_with("vector", a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norm / eps).alias(f"c{k}")
        for k, a in enumerate(axis_rows)
    ]
    order = ["label", *[f"c{k}" for k in range(len(cells))], "node"]
    spark = points.sparkSession
    sorted_ = points.select("*", *cells).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kind = points.schema["label"].dataType.simpleString()
    schema = f"label {kind}, node bigint, weight bigint, vector array<float>, block bigint, y array<double>"
    blocks = checkpointed(sorted_.select("label", "node", "weight", "vector").mapInArrow(_blocks(axes, eps), schema))
    dims = range(axes.shape[1])
    box = [F.min(F.get("y", F.lit(k))).alias(f"lo{k}") for k in dims] + [F.max(F.get("y", F.lit(k))).alias(f"hi{k}") for k in dims]
    one = blocks.groupBy("label", "block").agg(*box).withColumn("strip", F.floor(F.col("block") / STRIP))
    strips = one.groupBy("label", "strip").agg(*[F.min(f"lo{k}").alias(f"lo{k}") for k in dims], *[F.max(f"hi{k}").alias(f"hi{k}") for k in dims])

    def close(a: str, b: str) -> Column:
        gap = [F.greatest(F.lit(0.0), F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}")) for k in dims]
        return sum((g * g for g in gap), F.lit(0.0)) <= eps * eps

    same = lambda a, b: F.col(f"{a}.label") == F.col(f"{b}.label")
    # a label that a third of all vectors share is dealt over LABEL_SALTS tasks: one side by its strip, the other to each
    one_salt = strips.withColumn("salt", F.pmod(F.col("strip"), F.lit(LABEL_SALTS)).cast("int"))
    all_salts = strips.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    s = one_salt.alias("s").join(all_salts.alias("t"), same("s", "t") & (F.col("s.salt") == F.col("t.salt")) & (F.col("s.strip") <= F.col("t.strip")) & close("s", "t"))
    s = s.select(F.col("s.label").alias("label"), F.col("s.strip").alias("strip_a"), F.col("t.strip").alias("strip_b"))
    a = s.join(one.alias("p"), (F.col("strip_a") == F.col("p.strip")) & (s["label"] == F.col("p.label"))).select("strip_b", "p.*")
    pairs = (
        a.alias("p")
        .join(one.alias("q"), (F.col("p.strip_b") == F.col("q.strip")) & same("p", "q") & (F.col("p.block") <= F.col("q.block")) & close("p", "q"))
        .select(F.col("p.strip").alias("a"), F.col("q.strip").alias("b"), F.array("p.block", "q.block").alias("both"))
    )
    # each block once for a pair of strips, and only if it has a near one there; within one strip both are side 0
    sides = pairs.select("a", "b", F.posexplode("both").alias("side", "block"))
    sides = sides.withColumn("side", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("side"))).distinct()
    rows = blocks.drop("label").join(sides, "block")
    rows = rows.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "side", "block", "node").drop("block")
    return rows.mapInArrow(_join_pairs(threshold, eps * eps), "u bigint, v bigint, w bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", "embedding", _usable(F.col("embedding")).alias("usable"))
    rows = rows.withColumn("usable", F.col("usable") & F.col("label").isNotNull())
    # a zero has one sign
    rows = rows.withColumn("vector", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("float"))).drop("embedding")
    keys = [F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit(1), "vector", "label").alias("k2")]
    usable = rows.where("usable").select("vec_id", "label", "vector", *keys)
    points = usable.groupBy("k1", "k2", "label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    points = checkpointed(points.withColumn("node", F.monotonically_increasing_id()))
    sizes = [r.n for r in points.select(F.size("vector").alias("n")).distinct().collect()]  # lengths of vectors: one, as a rule
    found = None
    for n in sizes:
        part = _linked(points.where(F.size("vector") == n), n, threshold)
        found = part if found is None else found.union(part)
    plain = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = checkpointed(found)
        links = found.where("w is not null").groupBy("u").agg(F.sum("w").alias("w"))
        components = connected_components(found.where("v is not null").select("u", "v"))
        named = (
            points.select("k1", "k2", "node", "weight", "first")
            .join(links, F.col("node") == F.col("u"), "left")
            .drop("u")
            .join(components.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left")
            .select("k1", "k2", "first", F.coalesce("component", "node").alias("key"), (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        )
        least = named.groupBy("key").agg(F.min("first").alias("component_id"))
        linked = usable.select("vec_id", "k1", "k2").join(named.join(least, "key"), ["k1", "k2"])
        plain = plain.unionByName(linked.select("vec_id", "n_links", "component_id"))
    return plain.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
