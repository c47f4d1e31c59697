"""Scores over token paths: the same sums for letters, overlapping k-mers and any list of tokens.

Token models are count tables of (previous token, token), one aggregate with map-side combine; scoring is
an equi-join, so vocabularies need not fit a broadcast. Everything stays a sum until the report.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import quantise
from ..functions.sequence import is_primary, sequence_id
from ..functions.tokenizers import tokenizer
from . import arms, letters, segments
from .baselines import positions

MAX_LEN = 4096
#: Letters of its own patch that a letter is scored by; order of the model whose entropy cuts patches.
PATCH_ORDER, ENTROPY_ORDER = 5, 2
#: Shares of the lengths 1, 2, ... of patches drawn at random, and their seed.
PATCH_LENGTHS, PATCH_SEED = [0.1, 0.2, 0.3, 0.2, 0.1, 0.1], 17
SUMS = ("nll_bits", "valid_nt")


def truncated(rows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds invalid and truncated; canonical_sequence is cut to max_len letters, and of invalid rows it is empty."""
    seq = F.col("canonical_sequence")
    out = rows.withColumn("invalid", ~is_primary(seq)).withColumn("truncated", ~F.col("invalid") & (F.length(seq) > max_len))
    return out.withColumn("canonical_sequence", F.when(F.col("invalid"), "").otherwise(F.substring(seq, 1, max_len)))


def token_steps(rows: DataFrame, keys: list[str], tokens: Column, before: Column | None = None) -> DataFrame:
    """keys, pos, ctx (the token before; before or '' for the first), token."""
    first = F.array(F.coalesce(before, F.lit("")) if before is not None else F.lit(""))
    pairs = F.arrays_zip(F.concat(first, tokens).alias("ctx"), tokens.alias("token"))
    out = rows.select(*keys, F.posexplode(pairs).alias("pos", "x")).select(*keys, "pos", "x.ctx", "x.token")
    return out.where("token is not null")


def token_model(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ctx, token, c) and (ctx, n)."""
    pairs = steps.groupBy("ctx", "token").agg(F.count("*").alias("c"))
    return pairs, pairs.groupBy("ctx").agg(F.sum("c").alias("n"))


def token_bits(steps: DataFrame, model: tuple[DataFrame, DataFrame], vocabulary: int, alpha: float = 1.0) -> DataFrame:
    """Adds bits of each token under add-alpha smoothing; infinite where its probability is 0."""
    pairs, totals = model
    out = steps.join(pairs, ["ctx", "token"], "left").join(totals, "ctx", "left")
    count, total = F.coalesce("c", F.lit(0)) + F.lit(alpha), F.coalesce("n", F.lit(0)) + F.lit(alpha * vocabulary)
    return out.withColumn("bits", F.when(count > 0, -F.log2(count / total)).otherwise(F.lit(math.inf))).drop("c", "n")


def canonical_path(rows: DataFrame, keys: list[str], tokens: Column, model: tuple[DataFrame, DataFrame], vocabulary: int, alpha: float = 1.0) -> DataFrame:
    """keys, nll_bits of the path through the rows' own tokens, given the token before each."""
    return token_bits(token_steps(rows, keys, tokens), model, vocabulary, alpha).groupBy(*keys).agg(F.sum("bits").alias("nll_bits"))


def overlap_path(train: DataFrame, rows: DataFrame, key: str, k: int) -> DataFrame:
    """key, nll_bits: each letter once, given the k - 1 letters before it; no mass is lost to illegal moves."""
    return letters.letter_bits(rows, key, letters.letter_counts(train, k - 1), k - 1)


def patch_path(train: DataFrame, rows: DataFrame, key: str, boundary: Column | str) -> DataFrame:
    """key, nll_bits: each letter given those before it in its patch, PATCH_ORDER at the most."""
    cuts = F.col(boundary) if isinstance(boundary, str) else boundary
    return letters.letter_bits(rows, key, letters.letter_counts(train, PATCH_ORDER, cuts), PATCH_ORDER, cuts)


def arm_path(arm: str, train: DataFrame, rows: DataFrame, key: str, vocabulary: list[str] | None = None, merges: list | None = None) -> DataFrame:
    """key, nll_bits of an arm: its tokens, or its patches with the boundaries of its policy, counted on train.

    vocabulary: of a Unigram arm; merges: of a BPE arm. train and rows are from truncated().
    """
    backbone, kind, size, k = arms.ARMS[arm]
    seq = F.col("canonical_sequence")
    if backbone == "blt":
        if kind == "fixed_patch":
            return patch_path(train, rows, key, segments.fixed_boundaries(F.length(seq), k or arms.PATCH))
        if kind == "random_patch":
            drawn = segments.random_boundaries(PATCH_LENGTHS, PATCH_SEED)(F.length(seq), sequence_id(seq))
            return patch_path(train, rows, key, F.when(F.length(seq) > 0, drawn).otherwise(F.array().cast("array<int>")))
        counts = letters.letter_counts(train, ENTROPY_ORDER)
        gate = arms.PATCH * letters.mean_entropy(train, counts, ENTROPY_ORDER)
        cut = lambda x: letters.entropy_boundaries(x, [key, "canonical_sequence"], counts, ENTROPY_ORDER, gate)
        return patch_path(cut(train), cut(rows), key, "boundary")
    if kind == "NUC":
        return overlap_path(train, rows, key, 2)
    if kind == "overlap_mer":
        return overlap_path(train, rows, key, k)
    tokens, _ = tokenizer(kind, k, vocabulary, merges)
    model = token_model(token_steps(train, [key], tokens(seq)))
    return canonical_path(rows, [key], tokens(seq), model, size)


def score_arms(train: DataFrame, rows: DataFrame, key: str, names: list[str], split: str, vocabulary: list[str] | None = None, merges: list | None = None) -> DataFrame:
    """arm_report of the named arms over rows."""
    return arm_report(rows, {arm: arm_path(arm, train, rows, key, vocabulary, merges) for arm in names}, key, split)


def arm_report(rows: DataFrame, paths: dict[str, DataFrame], key: str, split: str) -> DataFrame:
    """One row for each arm: its metric, counts, sums and bits per letter.

    rows: from truncated(); paths: arm -> (key, nll_bits) of that arm's way of scoring.
    """
    scored = None
    for arm, path in paths.items():
        one = path.select(F.lit(arm).alias("arm"), key, "nll_bits")
        scored = one if scored is None else scored.union(one)
    spine = rows.select(key, "invalid", "truncated", F.length("canonical_sequence").alias("nt"), F.explode(F.array(*map(F.lit, paths))).alias("arm"))
    out = spine.join(scored, ["arm", key], "left").groupBy("arm").agg(
        F.count("*").alias("n_sequences"), F.count_if("invalid").alias("n_invalid"), F.count_if("truncated").alias("n_truncated"),
        F.coalesce(F.sum("nll_bits"), F.lit(0.0)).alias("nll_bits_sum"), F.sum("nt").cast("long").alias("valid_nt_count"),
    )
    return out.select(
        "arm", F.lit(split).alias("split"), arms.metric(F.col("arm")).alias("metric"), "n_sequences", "n_invalid", "n_truncated", "nll_bits_sum",
        (F.col("nll_bits_sum") / math.log2(math.e)).alias("nll_nats_sum"), "valid_nt_count",
        (F.col("nll_bits_sum") / F.greatest(F.lit(1), "valid_nt_count")).alias("bpn"),
    )


def suffix_code_length(entries: DataFrame, key: list[str], tokenizer, model: tuple[DataFrame, DataFrame], vocabulary: int, alpha: float = 0.0) -> DataFrame:
    """key, suffix_nt, bpn: bits of the suffix's tokens per letter of the suffix, given the prefix's last token.

    Prefix and suffix are tokenised on their own. tokenizer: a function from a column to its tokens. bpn is
    NaN unless 0 < prefix_len < length, and infinite where the model gives a token no probability.
    """
    seq, cut = F.col("canonical_sequence"), F.col("prefix_len").cast("int")
    good = (cut > 0) & (cut < F.length(seq))
    rows = entries.withColumn("good", good).withColumn("suffix_nt", F.when(good, F.length(seq) - cut))
    parts = rows.where("good").select(*key, F.substr(seq, F.lit(1), cut).alias("prefix"), F.substr(seq, cut + 1, F.length(seq)).alias("suffix"))
    parts = parts.select(*key, F.element_at(tokenizer(F.col("prefix")), -1).alias("last"), tokenizer(F.col("suffix")).alias("tokens"))
    bits = token_bits(token_steps(parts, key, F.col("tokens"), F.col("last")), model, vocabulary, alpha).groupBy(*key).agg(F.sum("bits").alias("b"))
    return rows.join(bits, key, "left").select(*key, "suffix_nt", F.when(F.col("good"), F.col("b") / F.col("suffix_nt")).otherwise(F.lit(math.nan)).alias("bpn"))


#: The counters of a coded or scored set, all of them sums.
CODEC_SUMS = (
    "coded_bits", "quantized_nll_bits", "canonical_nll_bits", "next_base_nll_bits", "valid_nt", "eos_nll", "sequence_count", "attempted_count",
    "decoded_count", "valid_count", "invalid_count", "early_eos_count", "truncation_count", "overshoot_count", "illegal_transition_mass",
)


def codec_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The fifteen counters summed (a missing one is 0) and their four ratios per letter (NaN without letters)."""
    have = [F.sum(c).alias(c) if c in rows.columns else F.lit(0).alias(c) for c in CODEC_SUMS]
    out = rows.groupBy(*keys).agg(*have)
    ratios = {"canonical_code_length_bpn": "coded_bits", "canonical_code_nll_bpn": "canonical_nll_bits", "quantized_cdf_nll_bpn": "quantized_nll_bits", "next_base_bpn": "next_base_nll_bits"}
    return out.select("*", *[F.when(F.col("valid_nt") > 0, F.col(c) / F.col("valid_nt")).otherwise(F.lit(math.nan)).alias(name) for name, c in ratios.items()])


def diagnostic_sums(rows: DataFrame, tables: DataFrame, key: str, order: int) -> DataFrame:
    """Counters of each row that need no coding: model bits and bits of the quantised distribution, letter by letter.

    rows: from truncated(); tables: ctx, probs, cdf of each full context. A context that is short or not in
    the table is uniform, whose quantised form is exact.
    """
    letters = F.translate("sym", "ACGU", "0123").cast("int")
    at = positions(rows, [key], order, 0).withColumn("s", letters).join(tables.select("ctx", "probs", "cdf"), "ctx", "left")
    model = -F.log2(F.get("probs", F.col("s")))
    share = (F.get("cdf", F.col("s") + 1) - F.get("cdf", F.col("s"))) / F.element_at("cdf", -1)
    per = at.groupBy(key).agg(F.sum(F.coalesce(model, F.lit(2.0))).alias("nll"), F.sum(F.coalesce(-F.log2(share), F.lit(2.0))).alias("quantized_nll_bits"))
    return _counters(rows.join(per.withColumnRenamed("quantized_nll_bits", "quantized"), key, "left"), F.col("nll"), F.col("quantized"))


def patch_diagnostics(train: DataFrame, rows: DataFrame, key: str, boundary: Column | str) -> DataFrame:
    """Counters of each row of a patch arm that need no coding; every context has its quantised distribution.

    train, rows: from truncated(). Contexts are those of patch_path.
    """
    cuts = F.col(boundary) if isinstance(boundary, str) else boundary
    counts = letters.letter_counts(train, PATCH_ORDER, cuts)
    probs = (counts + 1) / (counts.sum(axis=1, keepdims=True) + 4)
    cdf = np.array([quantise(p) for p in probs.tolist()])
    tables = {"nll": -np.log2(probs), "quantized": -np.log2(np.diff(cdf, axis=1) / cdf[:, -1:])}
    per = letters.table_bits(rows, key, tables, PATCH_ORDER, cuts)
    return _counters(rows.join(per, key, "left"), F.col("nll"), F.col("quantized"))


def _counters(rows: DataFrame, nll: Column, quantised_bits: Column) -> DataFrame:
    good = ~F.col("invalid")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "*", zero(nll).alias("canonical_nll_bits"), zero(nll).alias("next_base_nll_bits"), zero(quantised_bits).alias("quantized_nll_bits"),
        F.length("canonical_sequence").alias("valid_nt"), F.lit(1).alias("sequence_count"), F.lit(1).alias("attempted_count"),
        good.cast("int").alias("valid_count"), (~good).cast("int").alias("invalid_count"), F.col("truncated").cast("int").alias("truncation_count"),
    )
