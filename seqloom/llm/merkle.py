"""Merkle dataset manifest: one tree of digests for each source, one over the sources.

Digests of rows are computed in SQL where the rows are read; texts are never
shuffled. Only (source, id, digests) is range-partitioned and sorted, a leaf's
place in its source being counted through the sorted partitions: of what comes
before a partition only the first source in it needs to know, one number each.

A source's leaves are cut into aligned blocks of 3^7. Each block is one small
tree: a recursive traversal in postorder returns a subtree's digest, and while it
unwinds appends each node's siblings to the leaves that the node contains. The
roots of the blocks are the leaves of the next such traversal, until one node a
tree is left; a source with a third of all rows is so as many tasks as it has
blocks, and only its block roots meet in the next round. A tree's height depends
on its number of leaves, so a last, short block is lifted as high as the others.
Coming down, siblings of a block's root are joined to the leaves of the block.
The roots of the sources, ordered by source (null first), are one more such tree.

Null values have a leaf's place of their own (`-`), a null source is a source, a
null id comes before all ids and is never tampered with. Rows that repeat each
other are leaves of their own, side by side; equal ids go by their leaves. Texts
of any length are hashed whole. An empty table gives no rows. Extra columns of
docs are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import changes, checkpointed, partitions, whole_groups

#: Children of a node; levels of a block, which has ARITY ** LEVELS leaves.
ARITY, LEVELS = 3, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels from n leaves to one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def traverse(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """Root of the leaves after so many levels, and each leaf's siblings from the lowest level up, left to right in each."""
    paths: list[list[str]] = [[] for _ in leaves]

    def visit(level: int, begin: int) -> tuple[str, int]:
        """(digest, end of the leaves) of the node of a level whose leaves begin there."""
        if level == 0:
            return leaves[begin], begin + 1
        children, end, spans = [], begin, []
        while len(children) < ARITY and end < len(leaves):
            child, after = visit(level - 1, end)
            children.append(child)
            spans.append((end, after))
            end = after
        for k, (a, b) in enumerate(spans):
            others = children[:k] + children[k + 1 :]
            for path in paths[a:b] if others else ():
                path += others
        return digest(children), end

    return visit(levels, 0)[0], paths


def fold(leaf: str, place: int, size: int, siblings: list[str]) -> str:
    """Root over a leaf at a place among so many, from the siblings of its path."""
    node, at = leaf, 0
    while size > 1:
        begin = place - place % ARITY
        n = min(ARITY, size - begin) - 1
        run = siblings[at : at + n]
        run.insert(place - begin, node)
        node, at = digest(run), at + n
        place, size = place // ARITY, -(-size // ARITY)
    return node


def placed(nodes: DataFrame, *order: Column) -> DataFrame:
    """nodes (with a string column tree) with place, their number within the tree from 0, and size, the tree's number of nodes."""
    by = [F.col("tree"), *order]
    rows = checkpointed(nodes.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by))

    def ends(batches):
        from pyspark import TaskContext

        pid, first, last, n_first, n_last = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            counts = batch.column(0).value_counts()
            for tree, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                first = tree if first is None else first
                n_first += n if tree == first else 0
                n_last = n_last + n if tree == last else n
                last = tree
        if first is not None:
            yield pa.RecordBatch.from_pydict({"pid": [pid], "first": [first], "n_first": [n_first], "last": [last], "n_last": [n_last]})

    # one row a partition: how much of its first tree lies in the partitions before
    parts = rows.select("tree").mapInArrow(ends, "pid long, first string, n_first long, last string, n_last long").collect()
    begin, tree, seen = {}, None, 0
    for p in sorted(parts, key=lambda p: p.pid):
        begin[p.pid] = seen if p.first == tree else 0
        seen = begin[p.pid] + p.n_first if p.first == p.last else p.n_last
        tree = p.last

    names = [*rows.columns, "place", "pid"]

    def number(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        at, tree = begin.get(pid, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("tree").dictionary_encode()
            runs = codes.indices.to_numpy()
            starts = np.flatnonzero(np.diff(runs, prepend=-1))
            place = np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))
            first = codes.dictionary[0].as_py()
            if tree is not None and first != tree:
                at = 0
            stop = starts[1] if len(starts) > 1 else len(runs)
            place[:stop] += at
            at, tree = int(place[-1]) + 1, codes.dictionary[int(runs[-1])].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(len(place), pid, np.int32))], names)

    numbered = rows.mapInArrow(number, StructType([*rows.schema.fields, StructField("place", LongType()), StructField("pid", IntegerType())]))
    # a tree's size is joined by partition, as one tree may have a third of all rows
    counts = rows.groupBy("tree", F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n"))
    sizes = counts.select("tree", "pid").join(counts.groupBy("tree").agg(F.sum("n").alias("size")), "tree")
    return numbered.join(sizes, ["tree", "pid"]).drop("pid")


def climbed(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, place, size, digest, more) with path, all siblings up to the root of the tree, and top, that root."""
    spark, size_of_block, columns = nodes.sparkSession, ARITY**levels, [*nodes.columns, "block"]

    def blocks(batches):
        for table in whole_groups(batches, ["key", "block"]):
            key, block, size = (table[c].to_numpy() for c in ("key", "block", "size"))
            leaves = table["digest"].to_pylist()
            starts = np.flatnonzero(changes(key, block))
            paths, roots = [], []
            trees = table["tree"].to_pylist()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                # trees whose hashed keys collide alternate in place, but never in a block
                for tree in dict.fromkeys(trees[a:b]):
                    own = [k for k in range(a, b) if trees[k] == tree]
                    root, path = traverse([leaves[k] for k in own], min(levels, height(int(size[own[0]]))))
                    paths += path
                    roots += [root] * len(own)
            out = table.select(columns).append_column("path", pa.array(paths, pa.list_(pa.string()))).append_column("root", pa.array(roots, pa.string()))
            yield from out.to_batches(max_chunksize=4096)

    block = F.expr(f"place div {size_of_block}")
    rows = nodes.withColumn("block", block).withColumn("key", F.xxhash64("tree"))
    dealt = rows.repartition(partitions(spark), "tree", "block").sortWithinPartitions("key", "block", "tree", "place")
    more = [("block", LongType()), ("path", ArrayType(StringType())), ("root", StringType())]
    schema = StructType([*nodes.schema.fields, *(StructField(*x) for x in more)])
    low = checkpointed(dealt.mapInArrow(blocks, schema))
    if not low.where(f"size > {size_of_block}").limit(1).count():
        return low.withColumnRenamed("root", "top").select(*nodes.columns, "path", "top")
    upper = low.where(f"place % {size_of_block} = 0").select("tree", F.col("block").alias("place"), F.expr(f"(size + {size_of_block - 1}) div {size_of_block}").alias("size"), F.col("root").alias("digest"))
    high = climbed(upper, levels).select("tree", F.col("place").alias("block"), F.col("path").alias("over"), "top")
    joined = low.join(high, ["tree", "block"])
    return joined.select(*nodes.columns, F.concat("path", "over").alias("path"), "top")


def tampered(docs: DataFrame) -> Column:
    """Rows whose text has lost its line ends: those whose id has an even CRC-32."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaf_of(docs: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row: `-` for a null, else the bytes of the value, `:` and the value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    values = [text if name == "text" and text is not None else docs[name] for name in FIELDS]
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, place, size, leaf, subroot, root, source_place, n_sources, siblings: what it takes to verify each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf_of(docs).alias("leaf"))
    return _proofs(rows, levels).drop("changed")


def _proofs(leaves: DataFrame, levels: int) -> DataFrame:
    """doc_id, source, leaf, changed (whatever else) -> a row each with its place, roots and siblings."""
    # a null source comes first, then sources by their bytes
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))).withColumnRenamed("leaf", "digest").drop("source")
    named = checkpointed(named)
    low = checkpointed(climbed(placed(named, F.asc_nulls_first("doc_id"), F.col("digest")), levels)).withColumn("block", F.expr(f"place div {ARITY**levels}"))
    sources = low.where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), F.col("top").alias("digest"))
    high = climbed(placed(sources, F.col("source_tree")), levels)
    high = high.select(F.col("source_tree").alias("tree"), F.col("place").alias("source_place"), F.col("size").alias("n_sources"), F.col("path").alias("over"), F.col("top").alias("root"))
    # joined by block, as one source may have a third of all rows
    blocks = low.where(f"place % {ARITY**levels} = 0").select("tree", "block").join(high, "tree")
    both = low.join(blocks, ["tree", "block"]).drop("block").withColumnRenamed("top", "subroot").withColumnRenamed("digest", "leaf")
    source = F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
    return both.withColumn("source", source).withColumn("siblings", F.concat("path", "over")).drop("tree", "path", "over")


def _verify(batches):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        proofs, folded = [], []
        columns = [batch.column(c).to_pylist() for c in ("leaf", "changed", "place", "size", "source_place", "n_sources", "siblings")]
        for leaf, changed, place, size, source_place, n_sources, siblings in zip(*columns):
            proofs.append(digest(siblings))
            own = path_length(place, size)
            node = fold(changed or leaf, place, size, siblings[:own])
            folded.append(fold(node, source_place, n_sources, siblings[own:]))
        root = batch.column("root")
        same = pa.array([a == b for a, b in zip(folded, root.to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("leaf"), batch.column("subroot"), root, pa.array(proofs, pa.string()), pa.array(folded, pa.string()), same], names
        )


def path_length(place: int, size: int) -> int:
    """Siblings on the path of a leaf."""
    n = 0
    while size > 1:
        n += min(ARITY, size - (place - place % ARITY)) - 1
        place, size = place // ARITY, -(-size // ARITY)
    return n


def manifest_report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs.

    Where the id's CRC-32 is even the folded root is that of the text without its line ends.
    """
    changed = F.when(tampered(docs) & docs["text"].contains("\n"), leaf_of(docs, F.replace(docs["text"], F.lit("\n"))))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf_of(docs).alias("leaf"), changed.alias("changed"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    columns = ["doc_id", "leaf", "changed", "subroot", "root", "place", "size", "source_place", "n_sources", "siblings"]
    return _proofs(rows, levels).select(*columns).mapInArrow(_verify, schema)
