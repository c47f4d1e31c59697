"""Family-aware splits, leakage gates and release-shift filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import is_primary, stable_bucket

#: Shares of the hash buckets (fixed values).
FAMILY_BUCKETS = [("family_test", 0.10), ("family_validation", 0.10), ("train", 0.80)]
CLUSTER_BUCKETS = [("train", 0.98), ("validation", 0.01), ("test", 0.01)]
SPLITS = ("train", "validation", "test", "family_test", "family_validation")


def best_hit(hits: DataFrame, key: str, model: str, score: str, order: str) -> DataFrame:
    """The best-scoring model of each key; of equal scores the first."""
    return hits.groupBy(key).agg(F.max_by(model, F.struct(F.col(score), -F.col(order))).alias(model), F.max(score).alias(score))


def first_mapping(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first value seen for each key."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def eligible_families(rows: DataFrame, min_sequences: int = 100, min_clusters: int = 10) -> DataFrame:
    """family, n_seq, n_clusters, eligible."""
    stats = rows.where("family_annotation is not null").groupBy("family_annotation")
    stats = stats.agg(F.count("*").alias("n_seq"), F.countDistinct("cluster_id").alias("n_clusters"))
    return stats.withColumn("eligible", (F.col("n_seq") >= min_sequences) & (F.col("n_clusters") >= min_clusters))


def assign_splits(rows: DataFrame, min_sequences: int = 100, min_clusters: int = 10) -> DataFrame:
    """Adds eligible_family and split_membership to rows with cluster_id and family_annotation.

    Each eligible family is hashed as fam:<family>; a cluster that holds a held-out family goes with it
    (test before validation), any other cluster is hashed as cl:<cluster>.
    """
    families = eligible_families(rows, min_sequences, min_clusters).where("eligible")
    families = families.select("family_annotation", stable_bucket(F.concat(F.lit("fam:"), F.col("family_annotation")), FAMILY_BUCKETS).alias("_fate"))
    rows = rows.join(families, "family_annotation", "left")
    clusters = rows.groupBy("cluster_id").agg(
        F.coalesce(F.bool_or(F.col("_fate") == "family_test"), F.lit(False)).alias("_t"),
        F.coalesce(F.bool_or(F.col("_fate") == "family_validation"), F.lit(False)).alias("_v"),
    )
    hashed = stable_bucket(F.concat(F.lit("cl:"), F.col("cluster_id").cast("string")), CLUSTER_BUCKETS)
    split = F.when(F.col("_t"), "family_test").when(F.col("_v"), "family_validation").otherwise(hashed)
    clusters = clusters.select("cluster_id", split.alias("split_membership"))
    return rows.withColumn("eligible_family", F.col("_fate").isNotNull()).drop("_fate").join(clusters, "cluster_id")


def pairwise_overlap(rows: DataFrame, ident: str = "canonical_sequence_hash") -> DataFrame:
    """split_a, split_b, n: distinct idents that two splits share; pairs without any are listed with 0.

    An ident's splits are one small array, so the join is with the few splits, not of idents with each other.
    """
    pairs = [(a, b) for i, a in enumerate(sorted(SPLITS)) for b in sorted(SPLITS)[i + 1 :]]
    sets = rows.groupBy(ident).agg(F.collect_set("split_membership").alias("s"))
    counts = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
    listed = F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"p{k}").alias("n")) for k, (a, b) in enumerate(pairs)])
    return sets.agg(*counts).select(F.explode(listed).alias("p")).select("p.*")


def crossing_clusters(rows: DataFrame) -> DataFrame:
    """n: clusters with rows in more than one split."""
    return rows.groupBy("cluster_id").agg(F.countDistinct("split_membership").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))


def exact_overlap(rows: DataFrame, train: DataFrame, ident: str = "canonical_sequence_hash") -> DataFrame:
    """n: distinct idents of rows that train holds too."""
    return rows.select(ident).distinct().join(train.select(ident), ident, "left_semi").agg(F.count("*").alias("n"))


def leakage_gates(rows: DataFrame, temporal: DataFrame | None = None) -> DataFrame:
    """exact_ok, cluster_ok, temporal_ok, all_ok. Without a temporal set its gate is null, and so is all_ok unless another fails."""
    worst = pairwise_overlap(rows).agg(F.max("n").alias("exact"))
    out = worst.crossJoin(crossing_clusters(rows).withColumnRenamed("n", "crossing"))
    if temporal is None:
        out = out.withColumn("temporal", F.lit(None).cast("long"))
    else:
        out = out.crossJoin(exact_overlap(temporal, rows.where("split_membership = 'train'")).withColumnRenamed("n", "temporal"))
    gates = [(F.col(c) == 0).alias(f"{n}_ok") for n, c in (("exact", "exact"), ("cluster", "crossing"), ("temporal", "temporal"))]
    return out.select(*gates).withColumn("all_ok", F.col("exact_ok") & F.col("cluster_ok") & F.col("temporal_ok"))


def classify_release(candidates: DataFrame, known: DataFrame, train: DataFrame) -> DataFrame:
    """Adds keep and reason: in_release22, ambiguous, exact_overlap_train or new, tested in that order."""
    out = candidates.join(known.select("accession").distinct().withColumn("_known", F.lit(True)), "accession", "left")
    out = out.join(train.select("canonical_sequence_hash").distinct().withColumn("_train", F.lit(True)), "canonical_sequence_hash", "left")
    reason = F.when(F.col("_known"), "in_release22").when(~is_primary(F.col("canonical_sequence")), "ambiguous")
    reason = reason.when(F.col("_train"), "exact_overlap_train").otherwise("new")
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason") == "new").drop("_known", "_train")


def cluster_anti(candidates: DataFrame, members: DataFrame, labels: DataFrame, ident: str = "ident") -> DataFrame:
    """Candidates whose cluster holds no train row; an ident without a row in members is its own cluster.

    members: rep, member; labels: ident, is_train.
    """
    tainted = members.join(labels.where("is_train"), F.col("member") == F.col("ident"), "left_semi").select("rep").distinct()
    mapped = candidates.join(members.select(F.col("member").alias("_m"), F.col("rep").alias("_rep")), F.col(ident) == F.col("_m"), "left")
    mapped = mapped.withColumn("_rep", F.coalesce("_rep", F.col(ident)))
    return mapped.join(tainted, F.col("_rep") == F.col("rep"), "left_anti").drop("_m", "_rep")


def longest_per_cluster(rows: DataFrame) -> DataFrame:
    """The longest row of each cluster, of equals the smallest hash."""
    rest = [c for c in rows.columns if c != "cluster_id"]
    best = rows.groupBy("cluster_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("length"), F.col("canonical_sequence_hash"))).alias("r"))
    return best.select("cluster_id", *[F.col(f"r.{c}") for c in rest])


def removal_counts(rows: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """keys, candidates, removed, kept of rows that a filter marks with a column that is null where it keeps."""
    return rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count(flag).alias("removed"), F.count_if(F.col(flag).isNull()).alias("kept"))
