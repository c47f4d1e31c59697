"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept and returns the columns of
`documents`; the last returns one row per packed piece. `run` writes every
stage's rows as Parquet in the shared checkpoint folder and reads them again, so
a lost executor costs the stage at hand at most; a stage's rows are deleted once
the next one's are written.

    quality        rejects what the weak-label quality classifier finds bad
    exact_dedup    of equal normalised texts the smallest id stays
    near_dedup     of SimHash neighbours (five-word shingles, a similarity of 0.8: 20 of 128 bits) the smallest id stays
    mixing         sources at an entropy of 95 % of the largest, none read more than twice
    packing        sequences of 4096 tokens

Null texts count as empty, null ids and sources are values of their own; rows that
repeat each other are rows of their own until exact_dedup leaves the first, and texts
of any length are taken whole. Of equal or near texts the smallest id stays (a null id
only among null ids). An empty table passes through all stages and gives no rows.
Extra columns of docs, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.common import checkpoint_folder, table
from seqloom.llm.exact_dedup import drop_exact_copies
from seqloom.llm.mixing import mix
from seqloom.llm.packing import pack_documents
from seqloom.llm.quality import keep_good
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.simhash_dedup import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the fingerprint links have no SQL form; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs
