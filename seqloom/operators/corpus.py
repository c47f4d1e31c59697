"""Canonical records: ingest, exact dedup, composition, subsampling, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import alphabet_status, canonical, continuation_cut, length_bin


def canonicalise(records: DataFrame) -> DataFrame:
    """accession, raw sequence `seq`, rna_type -> the canonical table."""
    canon = canonical(F.col("seq"))
    return records.select(
        "accession", "rna_type",
        F.sha2("seq", 256).alias("raw_sequence_hash"), F.sha2(canon, 256).alias("canonical_sequence_hash"),
        canon.alias("canonical_sequence"), alphabet_status(canon).alias("alphabet_status"),
        F.length("seq").cast("long").alias("length"), length_bin(F.length("seq")).alias("length_bin"),
    )


def exact_dedup(records: DataFrame, order: str = "ord") -> DataFrame:
    """One row per canonical hash: first row's values, number and tab-joined list of accessions in order.

    The list holds every accession of the sequence; a caller that only needs the count drops the column
    and the aggregate shrinks to fixed-width partial sums.
    """
    first = lambda c: F.min_by(c, order).alias(c)
    names = F.transform(F.array_sort(F.collect_list(F.struct(order, "accession"))), lambda x: x["accession"])
    return records.groupBy("canonical_sequence_hash").agg(
        first("canonical_sequence"), first("rna_type"), first("length"), first("length_bin"),
        F.count("*").alias("num_accessions"), F.array_join(names, "\t").alias("accessions"), F.min(order).alias(order),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given total order, as an aggregate with map-side combine (no window sort)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def composition(rows: DataFrame, keys: list[str]) -> DataFrame:
    """label (keys joined by |) and n for each combination that occurs."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).select(F.concat_ws("|", *keys).alias("label"), "n")


def strata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for each value of each column: one pass, unpivoted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def strata_summary(rows: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """strata() and one more row (value null) with the number of distinct clusters."""
    distinct = rows.select(cluster).distinct().agg(F.count(cluster).alias("n"))
    return strata(rows, columns).union(distinct.select(F.lit(cluster), F.lit(None).cast("string"), "n"))


def chunk_of(row: Column, n: int, chunks: int) -> Column:
    """Number of the chunk of ceil(n / chunks) rows that an explicit row number from 0 falls into."""
    return F.floor(row / max(1, -(-n // chunks))).cast("long")


def stratified_subsample(rows: DataFrame, cluster: str, ident: str, per_cluster: int, limit: int) -> DataFrame:
    """The per_cluster smallest idents of each cluster, then the first rows by (cluster, ident) up to the limit."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(ident))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= per_cluster).drop("_rank").orderBy(cluster, ident).limit(limit)


def selection_hash(rows: DataFrame, ident: str) -> DataFrame:
    """n and the SHA-256 over the sorted idents; for selections of bounded size."""
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(ident)), ""), 256).alias("selection_hash"))


def within_budget(rows: DataFrame, size: str, order: str, budget: int, block: int = 4096) -> DataFrame:
    """Rows in order up to and including the one that reaches the budget, with the size read before each (`seen`).

    order: a non-negative whole number. Running sums are taken over blocks of it first, then inside each block.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(order) / block))
    sums = dealt.groupBy("_block").agg(F.sum(size).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")).where(F.col("_ahead") < budget)
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("_ahead") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return dealt.join(sums, "_block").withColumn("seen", seen).where(F.col("seen") < budget).drop("_block", "_ahead")


def cuts(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """One row for each row and ratio that has a continuation cut: ratio, prefix_len, actual_ratio."""
    out = rows.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    out = out.withColumn("prefix_len", continuation_cut(F.col("length"), F.col("ratio")))
    return out.where("prefix_len is not null").withColumn("actual_ratio", F.col("prefix_len") / F.col("length"))


def continuation_manifest(rows: DataFrame, ratios: list[float], seed: int, n: int) -> DataFrame:
    """The first n entries of each ratio in seeded-hash order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("canonical_sequence_hash")), 256)
    rank = F.row_number().over(Window.partitionBy("ratio").orderBy("_key", "canonical_sequence_hash"))
    return cuts(rows, ratios).withColumn("_key", key).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_key", "_rank")


def manifest_hash(entries: DataFrame) -> DataFrame:
    """n and the SHA-256 over the lines hash|length|prefix_len in order of ratio and hash."""
    line = F.concat_ws("|", "canonical_sequence_hash", "length", "prefix_len")
    rows = F.array_sort(F.collect_list(F.struct("ratio", "canonical_sequence_hash", line.alias("line"))))
    return entries.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("manifest_hash"))


def hash_sample(rows: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded-hash order: a repeatable stand-in for a reservoir."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256), ident).limit(n)


def integrity(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of rows (accession, seq) whose MD5 matches the index (accession, md5), differs, or is not listed."""
    listed = index.select(F.lower("accession").alias("_key"), F.lower("md5").alias("_md5"))
    joined = rows.withColumn("_key", F.lower("accession")).join(listed, "_key", "left")
    same = F.md5("seq") == F.col("_md5")
    return joined.agg(
        F.count("*").alias("checked"), F.count_if(same).alias("matched"),
        F.count_if(~same).alias("mismatched"), F.count_if(F.col("_md5").isNull()).alias("no_lookup"),
    )
