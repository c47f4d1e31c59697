"""Writers: FASTA, alphabet-split Parquet, JSON and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_fasta(rows: DataFrame, path: str, ident: str = "accession", seq: str = "canonical_sequence") -> None:
    rows.select(F.concat(F.lit(">"), F.col(ident).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_by_alphabet(rows: DataFrame, path: str) -> None:
    """One Parquet table partitioned by alphabet_status: a scan of one kind reads only that."""
    rows.write.mode("overwrite").partitionBy("alphabet_status").parquet(path)


def write_table(rows: DataFrame, schema: T.StructType, path: str) -> None:
    """Parquet with the given schema, also where there are no rows."""
    rows.to(schema).write.mode("overwrite").parquet(path)


def write_report(row: DataFrame, path: str) -> None:
    """A small table as JSON lines."""
    row.coalesce(1).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, order: list[str], limit: int = 1000) -> str:
    """A report table (limit rows at most, which is what the format is for) as Markdown."""
    cells = rows.orderBy(*order).limit(limit).collect()
    line = lambda xs: "| " + " | ".join("-" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, cells)])
