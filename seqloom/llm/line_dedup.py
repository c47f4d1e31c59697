"""Line deduplication across documents by range-partitioned line hashes.

Each line becomes one row of fixed width: a 128-bit hash of its key, the
document and the position. The rows are range-partitioned and sorted by (hash,
document, position), so a line that a third of all documents hold is spread
over as many partitions as its rows fill. One streaming pass over a partition
sees every hash as one run, its first occurrences first, and counts its
documents; rows leave as soon as the run has enough of them, so at most the
lines of the first few documents of one run are held. Only the first and the last run of a partition can go on elsewhere:
their partial counts (at most two rows per partition) are summed and broadcast,
the one table that is broadcast, bounded by the number of partitions. What is
left are the positions to drop, from which each document gets a compressed
bitmap of the lines it keeps; text is read again only to apply the bitmaps.

A document is a distinct (id, text): rows that repeat both count once and get
the same bitmap. A null id is an id like any other, null text one empty line.
Empty keys are never dropped. Texts of any length are cut whole. An empty table
gives no rows. Other columns of docs may have any names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import changes, checkpointed, partitions, sliced, text_of, whole_row

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
LINES = "doc_id bigint, text_hash bigint, n_lines int, pos int, h1 bigint, h2 bigint"
RUNS = LINES + ", pid int, state int, n_docs bigint, first_doc bigint, last_doc bigint"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def _explode(min_points: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches, 1):
            docs, counts, sizes, positions, hashes = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                lines = text.as_py().encode().split(b"\n")
                keys = [(i, key) for i, line in enumerate(lines) if (key := line.strip(WHITE).lower())]
                if min_points > 1:
                    keys = [(i, key) for i, key in keys if len(key.decode()) >= min_points]
                docs.append(k)
                counts.append(len(keys))
                sizes.append(len(lines))
                positions += [i for i, _ in keys]
                hashes += [digest(key) for _, key in keys]
            take = pa.array(np.repeat(docs, counts).astype(np.int64)) if docs else pa.array([], pa.int64())
            two = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(2).take(take),
                    pa.array(np.repeat(sizes, counts).astype(np.int32)) if sizes else pa.array([], pa.int32()),
                    pa.array(positions, pa.int32()),
                    pa.array(two[:, 0].astype(np.int64)),
                    pa.array(two[:, 1].astype(np.int64)),
                ],
                ["doc_id", "text_hash", "n_lines", "pos", "h1", "h2"],
            )

    return run


def _stream_runs(min_docs: int):
    """Sorted rows of a partition -> rows to drop (state 1), and the other rows (0) and partial counts (2) of its end runs.

    A run with min_docs documents in this partition alone is dropped whatever other partitions hold, so from
    then on its rows are sent on as they come; until then they wait, as they are those of fewer documents.
    """

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        names = [x.split(" ")[0] for x in RUNS.split(", ")]
        waiting: list[pa.Table] = []  # rows of the run at hand that are not sent on yet
        n_docs, first_row, last_row, first_run = 0, None, None, True

        def rows(tables: list[pa.Table], state: int):
            for table in tables:
                n = len(table)
                more = [pa.array(np.full(n, v, np.int32)) for v in (pid, state)] + [pa.nulls(n, pa.int64())] * 3
                yield from pa.Table.from_arrays([*table.columns, *more], names=names).to_batches()

        def close(at_end: bool):
            """What is still to be said of the run at hand when it is over."""
            if first_run or at_end:
                yield from rows(waiting, 0)
                more = [pa.array([pid], pa.int32()), pa.array([2], pa.int32()), pa.array([n_docs], pa.int64()), first_row["doc_id"], last_row["doc_id"]]
                yield from pa.Table.from_arrays([*first_row.columns, *more], names=names).to_batches()

        def same(a, b, columns):
            return all(a[c][0].as_py() == b[c][0].as_py() for c in columns)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            value, null = pc.fill_null(table["doc_id"], 0).to_numpy(), table["doc_id"].is_null().to_numpy()
            starts = np.flatnonzero(changes(table["h1"].to_numpy(), table["h2"].to_numpy()))
            sizes = np.diff(np.append(starts, len(table)))
            new_doc = changes(value, null)
            new_doc[starts] = True
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            head = table.slice(0, 1)
            goes_on = last_row is not None and same(head, last_row, ("h1", "h2"))
            if last_row is not None and not goes_on:
                yield from close(False)
                first_run = False
            # the first run of the batch, which may go on from before
            part = table.slice(0, int(sizes[0]))
            if goes_on:
                n_docs += int(docs[0]) - same(head, last_row, ("doc_id",))
                waiting.append(part)
            else:
                n_docs, waiting, first_row = int(docs[0]), [part], head
            if n_docs >= min_docs:
                yield from rows(waiting, 1)
                waiting = []
            if len(starts) > 1:
                last_row = part.slice(len(part) - 1)
                yield from close(False)
                first_run = False
                # runs that begin and end in this batch
                drop = np.repeat(docs >= min_docs, sizes)
                drop[: starts[1]] = drop[starts[-1] :] = False
                if drop.any():
                    yield from rows([table.filter(pa.array(drop))], 1)
                part = table.slice(int(starts[-1]))
                n_docs, waiting, first_row = int(docs[-1]), [part], part.slice(0, 1)
                if n_docs >= min_docs:
                    yield from rows(waiting, 1)
                    waiting = []
            last_row = table.slice(len(table) - 1)
        if last_row is not None:
            yield from close(True)

    return run


def _bitmaps(batches):
    """Dropped positions sorted by document -> one row per document with its keep bitmap."""
    held = None

    def emit(table: pa.Table):
        if not len(table):
            return
        doc, text = table["doc_id"], table["text_hash"].to_numpy()
        value, null = pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy()
        starts = np.flatnonzero(changes(value, null, text))
        pos, sizes = table["pos"].to_numpy(), table["n_lines"].to_numpy()
        maps, dropped = [], []
        for a, b in zip(starts, np.append(starts[1:], len(table))):
            bits = np.ones(sizes[a], bool)
            bits[pos[a:b]] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            dropped.append(int(sizes[a] - bits.sum()))
        at = table.take(pa.array(starts))
        yield from pa.Table.from_arrays(
            [at["doc_id"], at["text_hash"], at["n_lines"], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"],
        ).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        last = table.slice(len(table) - 1)
        same = pc.and_(
            pc.equal(table["text_hash"], last["text_hash"][0]),
            table["doc_id"].is_null() if last["doc_id"][0].as_py() is None else pc.fill_null(pc.equal(table["doc_id"], last["doc_id"][0]), False),
        ).to_numpy()
        other = np.flatnonzero(~same)
        begin = int(other[-1]) + 1 if len(other) else 0
        yield from emit(table.slice(0, begin))
        held = table.slice(begin)
    if held is not None:
        yield from emit(held)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_lines, n_dropped, keep for each document that loses a line.

    keep is the zlib-compressed packed bitmap (first line in the highest bit) of the lines that stay.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lines = rows.mapInArrow(_explode(min_points), LINES)
    order = ["h1", "h2", "doc_id", "text_hash", "pos"]
    dealt = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    runs = checkpointed(dealt.mapInArrow(_stream_runs(min_docs), RUNS))
    # Partial counts of runs at partition borders; a document on both sides of a border counts once.
    before = Window.partitionBy("h1", "h2").orderBy("pid", "first_doc", "last_doc")
    split = (
        runs.where("state = 2")
        .withColumn("again", F.lag("last_doc").over(before).eqNullSafe(F.col("first_doc")) & (F.row_number().over(before) > 1))
        .groupBy("h1", "h2")
        .agg(F.sum(F.col("n_docs") - F.col("again").cast("long")).alias("total"))
        .where(F.col("total") >= min_docs)
        .select("h1", "h2")
    )
    columns = ["doc_id", "text_hash", "n_lines", "pos"]
    dropped = (
        runs.where("state = 1")
        .select(*columns)
        .union(runs.where("state = 0").join(F.broadcast(split), ["h1", "h2"], "left_semi").select(*columns))
    )
    by = ["doc_id", "text_hash"]
    dealt = dropped.repartition(partitions(spark), *by).sortWithinPartitions(*by, "pos")
    return dealt.mapInArrow(_bitmaps, "doc_id bigint, text_hash bigint, n_lines int, n_dropped int, keep binary")


def _apply(batches):
    for batch in sliced(batches, 1):
        sizes, dropped, digests = [], [], []
        for text, keep in zip(batch.column(1), batch.column(2)):
            lines, keep = text.as_py().encode().split(b"\n"), keep.as_py()
            sizes.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
                lines = [x for x, b in zip(lines, bits) if b]
            dropped.append(sizes[-1] - len(lines))
            digests.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def _joined(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """row (all columns of docs), text, keep; the bitmaps are the hashed side, the texts stream past and are not sorted."""
    d = docs.select(F.col("doc_id").alias("id"), text_of(docs).alias("text"), whole_row(docs).alias("row"))
    d = d.withColumn("text_hash", F.xxhash64("text")).alias("d")
    m = maps.select(F.col("doc_id").alias("id"), "text_hash", "keep").hint("shuffle_hash").alias("m")
    joined = d.join(m, F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.text_hash") == F.col("m.text_hash")), "left")
    return joined.select("d.id", "d.text", "d.row", "m.keep")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """docs with the text that stays: lines whose key is in min_docs documents or more are gone from all."""

    columns = docs.columns

    def cut(batches):
        for batch in sliced(batches, 0):
            out = []
            for text, keep in zip(batch.column(0), batch.column(1)):
                text, keep = text.as_py(), keep.as_py()
                if keep is not None:
                    lines = text.split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
                    text = "\n".join(x for x, b in zip(lines, bits) if b)
                out.append(text)
            own = dict(zip(columns, batch.column(2).flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else own[n] for n in columns], columns)

    joined = _joined(docs, keep_bitmaps(docs, min_docs, min_points))
    return joined.select("text", "keep", "row").mapInArrow(cut, docs.schema)


def line_report(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs."""
    joined = _joined(docs, keep_bitmaps(docs, min_docs, min_points)).select("id", "text", "keep")
    return joined.mapInArrow(_apply, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
