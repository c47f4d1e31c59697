"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import canonical, length_bin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nucleotide records: the letters ACGTU of the text, in canonical form, with hashes and length.

    Letters are picked before upper-casing, since some other characters have an upper case within the alphabet.
    """
    raw = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[^ACGTUacgtu]", "")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("URS"), F.col("doc_id")).alias("accession"),
        F.col("lang").alias("rna_type"),
        F.col("source").alias("source_database"),
        (F.col("doc_id") % 5).alias("release"),
        raw.alias("raw"),
    )
    docs = docs.withColumn("canonical_sequence", canonical(F.col("raw")))
    return docs.select(
        "ord", "accession", "rna_type", "source_database", "release",
        F.sha2("raw", 256).alias("raw_sequence_hash"),
        F.sha2("canonical_sequence", 256).alias("canonical_sequence_hash"),
        "canonical_sequence",
        F.length("canonical_sequence").cast("long").alias("length"),
        length_bin(F.length("canonical_sequence")).alias("length_bin"),
    )


#: The same view for DuckDB.
SEQS = r"""
raw_seqs AS (
  SELECT doc_id AS ord, 'URS' || doc_id AS accession, lang AS rna_type, source AS source_database, doc_id % 5 AS release,
         regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g') AS raw FROM documents),
seqs AS (
  SELECT ord, accession, rna_type, source_database, release, sha256(raw) AS raw_sequence_hash,
         sha256(translate(upper(raw), 'T', 'U')) AS canonical_sequence_hash, translate(upper(raw), 'T', 'U') AS canonical_sequence,
         length(raw) AS length,
         CASE WHEN length(raw) < 16 THEN '<16' WHEN length(raw) <= 4096 THEN '16-4096'
              WHEN length(raw) <= 16384 THEN '4097-16384' ELSE '>16384' END AS length_bin
  FROM raw_seqs)"""
