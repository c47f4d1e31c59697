"""Exact deduplication on normalised text.

Rows are grouped by a 128-bit content hash together with the normalised bytes,
so the hash aggregate compares the bytes of every group itself and two texts
that only share the hash never meet in one group. The aggregate combines on the
map side: a group of copies that holds a third of all rows reaches the shuffle
as one row per map task. The smallest id of each group is then joined back by
(128-bit hash, SHA-256), columns of 48 bytes; the texts are shuffled once.

Null ids sort after all others, so a row with a null id stays only if the whole
group has none. Rows that repeat an id and a text belong to one group and are
each returned; null text counts as empty. Texts of any length are hashed and
compared whole. An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, whole_row


def normalised(text: Column) -> Column:
    """text with each run of white space replaced by one space; null gives the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"))
    # Fixed-width digests stand for the text wherever bytes need not be compared.
    rows = rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h128"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    groups = (
        rows.groupBy("h128", "sha", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("norm")
    )
    return (
        rows.select("doc_id", "h128", "sha")
        .join(groups, ["h128", "sha"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns untouched.

    A row that repeats both id and text of another is a copy as well; one of them stays. The row travels
    with its group, so there is one shuffle, in which copies are combined on the map side, and no join.
    """
    rows = docs.select(F.col(id_column).alias("id"), normalised(F.col(text_column)).alias("norm"), whole_row(docs).alias("row"))
    key = [F.unhex(F.md5("norm")).alias("h128"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm")]
    first = F.min_by("row", F.struct(F.col("id").isNull(), F.col("id")))  # a null id comes last
    return rows.groupBy(*key).agg(first.alias("row")).select("row.*")
