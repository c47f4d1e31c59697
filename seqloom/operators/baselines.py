"""Compression baselines and score sums.

Counts are one aggregate over exploded (context, symbol) positions, with
map-side combine; they are tables of at most 5 * 4^order rows, so scoring joins
them as small sides. Sums stay sums until the last projection: bits over
letters, never a mean of per-sequence ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABET, is_primary

UNIFORM_BITS = 2.0
SUMS = ("nll_bits", "valid_nt", "sequence_count", "invalid_count", "truncation_count")


def positions(rows: DataFrame, keys: list[str], order: int, start: int) -> DataFrame:
    """keys, pos (from 0), ctx, sym, from canonical_sequence.

    ctx are the `order` letters before; start is 0 (fewer letters near the start) or order (positions
    with a full context only).
    """
    seq = F.col("canonical_sequence")
    filled = seq if start == order else F.concat(F.lit("^" * order), seq)
    windows = F.regexp_extract_all(filled, F.lit(f"(?=([ACGU^]{{{order + 1}}}))"), F.lit(1))
    out = rows.where(is_primary(seq)).select(*keys, F.posexplode(windows).alias("_at", "_w"))
    return out.select(
        *keys, (F.col("_at") + start).alias("pos"), F.ltrim(F.substring("_w", 1, order), F.lit("^")).alias("ctx"), F.substring("_w", order + 1, 1).alias("sym")
    )


def context_counts(positions_: DataFrame) -> DataFrame:
    """ctx, nA, nC, nG, nU, n."""
    per = [F.count_if(F.col("sym") == s).alias(f"n{s}") for s in ALPHABET]
    return positions_.groupBy("ctx").agg(*per, F.count("*").alias("n"))


def markov_fit(train: DataFrame, order: int) -> DataFrame:
    """Counts of an order-k model; the first k positions of a sequence have no full context and are left out."""
    return context_counts(positions(train, [], order, order))


def _count_of(sym: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for s in ALPHABET:
        out = out.when(sym == s, F.coalesce(F.col(f"n{s}"), F.lit(0)))
    return out


def markov_bits(rows: DataFrame, counts: DataFrame, keys: list[str], order: int, alpha: float = 1.0) -> DataFrame:
    """keys, pos, bits of each position from `order` on, with add-alpha smoothing."""
    joined = positions(rows, keys, order, order).join(counts, "ctx", "left")
    p = (_count_of(F.col("sym")) + alpha) / (F.coalesce("n", F.lit(0)) + 4 * alpha)
    return joined.select(*keys, "pos", (-F.log2(p)).alias("bits"))


def bits_per_letter(bits: DataFrame) -> DataFrame:
    """bpn (NaN without positions) and n."""
    total = F.sum("bits") / F.count("*")
    return bits.agg(F.coalesce(total, F.lit(math.nan)).alias("bpn"), F.count("*").alias("n"))


def score_sums(rows: DataFrame, bits: DataFrame, key: str, max_len: int = 4096) -> DataFrame:
    """Mergeable sums of each row: nll_bits, nll_nats, valid_nt, sequence_count, invalid_count, truncation_count.

    Letters from max_len on count as cut off: they are not scored.
    """
    per = bits.where(F.col("pos") < max_len).groupBy(key).agg(F.sum("bits").alias("nll_bits"), F.count("*").alias("valid_nt"))
    invalid = ~is_primary(F.col("canonical_sequence"))
    out = rows.select(key, invalid.alias("_bad"), (F.length("canonical_sequence") > max_len).alias("_long")).join(per, key, "left")
    bits_ = F.when(F.col("_bad"), 0.0).otherwise(F.coalesce("nll_bits", F.lit(0.0)))
    return out.select(
        key, bits_.alias("nll_bits"), (bits_ / math.log2(math.e)).alias("nll_nats"),
        F.when(F.col("_bad"), 0).otherwise(F.coalesce("valid_nt", F.lit(0))).alias("valid_nt"),
        F.lit(1).alias("sequence_count"), F.col("_bad").cast("int").alias("invalid_count"), F.col("_long").cast("int").alias("truncation_count"),
    )


def aggregate_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and bpn = total bits / total letters (null without letters)."""
    totals = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    return totals.withColumn("bpn", F.when(F.col("valid_nt") > 0, F.col("nll_bits") / F.col("valid_nt")))


def suffix_bits(entries: DataFrame, counts: DataFrame, key: list[str], order: int) -> DataFrame:
    """key, suffix_nt, bpn of the true suffix after prefix_len letters, under an order-k model that sees the prefix."""
    bits = markov_bits(entries, counts, [*key, "prefix_len", "length"], order)
    out = bits.where("pos >= prefix_len").groupBy(*key).agg(F.sum("bits").alias("b"), F.first(F.col("length") - F.col("prefix_len")).alias("suffix_nt"))
    return out.select(*key, "suffix_nt", (F.col("b") / F.col("suffix_nt")).alias("bpn"))


def probabilities(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """ctx, probs: the smoothed distribution of each context."""
    return counts.select("ctx", F.array(*[(F.col(f"n{s}") + alpha) / (F.col("n") + 4 * alpha) for s in ALPHABET]).alias("probs"))
