"""Readers of sequence and annotation files; every one is a plain Spark scan.

Where a rule depends on the order of lines, rows carry `file` and `line`: the
file's path and an orderable place in it. Files count in the order of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    *[T.StructField(n, t) for n, t in (
        ("phase", T.StringType()), ("run_id", T.StringType()), ("arm", T.StringType()), ("seed", T.IntegerType()), ("device", T.StringType()),
        ("scale", T.StringType()), ("status", T.StringType()), ("final_nt", T.LongType()), ("best_val_loss", T.DoubleType()),
        ("best_checkpoint", T.StringType()), ("params", T.LongType()), ("non_embedding_params", T.LongType()),
        ("throughput_nt_s", T.DoubleType()), ("peak_vram_mb", T.DoubleType()), ("cpu_fallback_count", T.IntegerType()),
    )],
    T.StructField("config", T.StructType([T.StructField("budget_nt", T.LongType()), T.StructField("batch_nt", T.LongType())])),
    T.StructField("checkpoints", T.ArrayType(T.StructType([T.StructField("nt", T.LongType()), T.StructField("path", T.StringType()), T.StructField("val_loss", T.DoubleType())]))),
])


def read_fasta(spark: SparkSession, path: str | list[str], spread: int | None = None) -> DataFrame:
    """header, seq of each record of plain or gzip FASTA files.

    Lines are stripped and wrapped ones joined; blank lines and records without a sequence are left out.
    Gzip files cannot be split; `spread` deals their records over that many partitions.
    """
    # a record starts at a line that begins with >
    records = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"^\s*>", "")
    lines = F.transform(F.split(record, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " ")))
    out = records.select(F.get(lines, F.lit(0)).alias("header"), F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1)), "").alias("seq"))
    out = out.where("seq <> ''")
    return out.repartition(spread) if spread else out


def header_fields(header: Column) -> list[Column]:
    """accession (first word) and rna_type (second word, or unknown)."""
    words = F.split(F.trim(header), r"\s+")
    return [F.get(words, F.lit(0)).alias("accession"), F.coalesce(F.get(words, F.lit(1)), F.lit("unknown")).alias("rna_type")]


def read_lines(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """file, line (an orderable place in the file), f (array of the fields) of text files."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
        F.split("value", sep, -1).alias("f"),
    )


def read_family_hits(spark: SparkSession, path: str) -> DataFrame:
    """urs, model, score, file, line; lines of fewer than three fields are left out, a bad score is 0."""
    rows = read_lines(spark, path).where(F.size("f") >= 3)
    return rows.select(F.col("f")[0].alias("urs"), F.col("f")[1].alias("model"), F.coalesce(F.expr("try_cast(f[2] AS double)"), F.lit(0.0)).alias("score"), "file", "line")


def read_family_clans(spark: SparkSession, path: str) -> DataFrame:
    """family, clan: the last line of a family counts."""
    rows = read_lines(spark, path).where(F.size("f") >= 2).select(F.col("f")[0].alias("family"), F.col("f")[1].alias("clan"), "file", "line")
    return rows.groupBy("family").agg(F.max_by("clan", F.struct("file", "line")).alias("clan"))


def read_db_mapping(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """accession, database, rna_type, file, line of lines with an accession URS... and a database; no type is unknown."""
    field = lambda i: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit("")))
    rows = read_lines(spark, path).where(F.size("f") >= 6)
    rows = rows.select(field(0).alias("accession"), field(1).alias("database"), F.coalesce(F.nullif(field(4), F.lit("")), F.lit("unknown")).alias("rna_type"), "file", "line")
    return rows.where("accession like 'URS%' and database <> ''")


def first_db_mapping(rows: DataFrame) -> DataFrame:
    """accession, database: the first line in order of file names."""
    return rows.groupBy("accession").agg(F.min_by("database", F.struct("file", "line")).alias("database"))


def read_md5_index(spark: SparkSession, path: str) -> DataFrame:
    """accession (lower case), md5: the last line of an accession counts."""
    rows = read_lines(spark, path).where(F.size("f") >= 2).select(F.lower(F.col("f")[0]).alias("accession"), F.col("f")[1].alias("md5"), "file", "line")
    return rows.groupBy("accession").agg(F.max_by("md5", F.struct("file", "line")).alias("md5"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """rep, member (row numbers)."""
    return read_lines(spark, path).where(F.size("f") >= 2).select(F.col("f")[0].cast("long").alias("rep"), F.col("f")[1].cast("long").alias("member"))


def with_clusters(rows: DataFrame, clusters: DataFrame, ident: str) -> DataFrame:
    """rows with cluster_id: the representative, or the row itself if no cluster lists it."""
    joined = rows.join(clusters.select(F.col("member").alias("_m"), F.col("rep").alias("_rep")), F.col(ident) == F.col("_m"), "left")
    return joined.withColumn("cluster_id", F.coalesce("_rep", F.col(ident)).cast("string")).drop("_m", "_rep")


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """query: the distinct query ids of a tabular search result."""
    return read_lines(spark, path).select(F.col("f")[0].alias("query")).where("query <> ''").distinct()


def read_removed(spark: SparkSession, path: str) -> DataFrame:
    """chunk, row_id from lists named ..._<chunk>.txt (files, or folders of files), one row number a line."""
    rows = read_lines(spark, path).select(F.regexp_extract("file", r"_(\d+)\.txt(?:/|$)", 1).cast("int").alias("chunk"), F.expr("try_cast(trim(f[0]) AS bigint)").alias("row_id"))
    return rows.where("row_id is not null").distinct()


def without_removed(rows: DataFrame, removed: DataFrame, ident: str) -> DataFrame:
    """rows whose explicit row number is in none of the lists, however many chunks they come in."""
    return rows.join(removed.select(F.col("row_id").alias(ident)).distinct(), ident, "left_anti")


def missing_chunks(removed: DataFrame, expected: int) -> DataFrame:
    """chunk: the numbers below `expected` of which no list is there."""
    spine = removed.sparkSession.range(expected).select(F.col("id").cast("int").alias("chunk"))
    return spine.join(removed.select("chunk").distinct(), "chunk", "left_anti")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests (one JSON object a file) with run_dir, the name of their directory."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_matching(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """All Parquet tables whose paths match a pattern (or several), columns matched by name."""
    return spark.read.option("mergeSchema", True).parquet(*([pattern] if isinstance(pattern, str) else pattern))


def union_releases(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames, columns matched by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
