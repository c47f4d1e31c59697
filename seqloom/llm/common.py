"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D], as a Java/RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null counting as empty."""
    return F.coalesce(docs[column], F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text (or of other long values) that a batch function works on at a time, but for a single longer row.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose values of a string or binary column hold up to limit bytes, or are one row.

    What a function makes of a batch is then bounded whatever the length of the texts, and the session's
    own batch size can stay as it is.
    """
    for batch in batches:
        values = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, n = 0, batch.num_rows
        if not n:
            yield batch
        while begin < n:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of a helper column can clash with one of theirs."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only on a single machine (a local master, tests) a temporary folder is made where that is unset; on a
    cluster nobody else would see it, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seqloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Parts of the rows of one key, for keys that many rows share.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str, spread: str) -> DataFrame:
    """rows with the smallest value of their key as column name; null values count as none.

    A key that a third of all rows hold is no task of its own: rows are dealt by (key, salt), a hash of
    the column spread, and each such part asks for the key's minimum as one row.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name))
    return salted.join(parts.select(key, "salt").join(least, key), [key, "salt"]).drop("salt")


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column; the first row is True."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that together are the batches, none of which ends within a run of equal (non-null) keys.

    A group must fit in memory; callers bound its size.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        last = [h[-1] for h in columns]
        if held and all(held[0][k][0].as_py() == v for k, v in zip(keys, last)) and all(c[0] == v for c, v in zip(columns, last)):
            held.append(table)
            continue
        begin = int(np.flatnonzero(changes(*columns))[-1])
        if begin or held and any(held[0][k][0].as_py() != v for k, v in zip(keys, last)):
            yield pa.concat_tables([*held, table.slice(0, begin)]).combine_chunks()
            held = []
        held.append(table.slice(begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Forest:
    """Union-find over n nodes that remembers which links joined two trees: a spanning forest of all links seen."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            ra, rb = roots[a], roots[b]
            new = ra != rb
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            if not len(a):
                return
            # of all links into a tree one is taken at a time, so that taken links form no circle
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, one = np.unique(high, return_index=True)
            self.parent = roots.copy()
            self.parent[high[one]] = low[one]
            self.links += zip(a[one].tolist(), b[one].tolist())
