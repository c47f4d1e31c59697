"""Sequence functions: canonical form, alphabets, length bins, k-mers, comparison, hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGU"
#: Upper bounds of the length bins, with the labels below and above them (fixed values).
LENGTH_BINS = [(15, "<16"), (4096, "16-4096"), (16384, "4097-16384")]
LONGEST_BIN = ">16384"
#: Bounds of the reporting bins and of the balance-audit strata (fixed values).
REPORT_BINS = [("L1", 16, 127), ("L2", 128, 511), ("L3", 512, 4096), ("L4", 4097, 16384)]
AUDIT_STRATA = [(16, 127), (128, 511), (512, 2047), (2048, 4096), (4097, 16384)]


def canonical(seq: Column) -> Column:
    """Upper case with T as U."""
    return F.translate(F.upper(seq), "T", "U")


def is_primary(canon: Column) -> Column:
    """True if the canonical sequence holds A, C, G and U only; the empty one does."""
    return canon.rlike(r"^[ACGU]*\z")  # a $ would let a line end through


def strict_canonical(seq: Column) -> Column:
    """The canonical form; a sequence outside the alphabet is an error of the query."""
    canon = canonical(seq)
    return F.when(is_primary(canon), canon).otherwise(F.raise_error(F.concat(F.lit("not a primary sequence: "), F.substring(seq, 1, 60))).cast("string"))


def alphabet_status(canon: Column) -> Column:
    return F.when(is_primary(canon), "primary").otherwise("ambiguous")


def length_bin(n: Column) -> Column:
    out = F.when(n <= LENGTH_BINS[0][0], LENGTH_BINS[0][1])
    for top, name in LENGTH_BINS[1:]:
        out = out.when(n <= top, name)
    return out.otherwise(LONGEST_BIN)


def report_bin(n: Column) -> Column:
    """Reporting bin L1 to L4; null outside them."""
    out = F.when(F.lit(False), "")
    for name, low, high in REPORT_BINS:
        out = out.when(n.between(low, high), name)
    return out


def audit_stratum(n: Column) -> Column:
    """Number of the balance-audit stratum; null outside them."""
    out = F.when(F.lit(False), 0)
    for k, (low, high) in enumerate(AUDIT_STRATA):
        out = out.when(n.between(low, high), k)
    return out


def stable_fraction(digest: Column, seed: str = "20260808") -> Column:
    """A number in [0, 1] from the first 32 bits of SHA-256 of seed:digest."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), digest), 256), 1, 8)
    return F.conv(first, 16, 10).cast("double") / F.lit(4294967295.0)


def stable_bucket(digest: Column, buckets: list[tuple[str, float]], seed: str = "20260808") -> Column:
    """First bucket whose cumulative share exceeds the digest's fraction, else the last."""
    r, total = stable_fraction(digest, seed), 0.0
    out = F.when(F.lit(False), "")
    for name, share in buckets:
        total += share
        out = out.when(r < total, name)
    return out.otherwise(buckets[-1][0])


def reverse_complement(canon: Column) -> Column:
    return F.reverse(F.translate(canon, "ACGU", "UGCA"))


def kmers(canon: Column, k: int) -> Column:
    """All k-mers in order, repeats included; none for sequences shorter than k.

    One pass of a look-ahead pattern: taking substrings by position would walk each string anew.
    """
    return F.regexp_extract_all(canon, F.lit(f"(?=([ACGU]{{{k}}}))"), F.lit(1))


def matches(a: Column, b: Column) -> Column:
    """Positions at which the two agree, over the shorter one."""
    n = F.least(F.length(a), F.length(b))
    letters = lambda c: F.split(F.substr(c, F.lit(1), n), "")
    same = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, same).otherwise(F.lit(0))


def nucleotide_accuracy(pred: Column, ref: Column) -> Column:
    """Agreeing positions over the length of ref; 0 for an empty ref."""
    return F.when(F.length(ref) > 0, matches(pred, ref) / F.length(ref)).otherwise(F.lit(0.0))


def positional_identity(a: Column, b: Column) -> Column:
    """Agreeing positions over the shorter length; 0 if that is 0."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, matches(a, b) / n).otherwise(F.lit(0.0))


def kmer_recovery(pred: Column, ref: Column, k: int = 5) -> Column:
    """Share of ref's distinct k-mers that pred has; 0 if ref has none."""
    want = F.array_distinct(kmers(ref, k))
    shared = F.size(F.array_intersect(want, F.array_distinct(kmers(pred, k))))
    return F.when(F.size(want) > 0, shared / F.size(want)).otherwise(F.lit(0.0))


def bits_of_nats(x: Column) -> Column:
    return x * F.lit(math.log2(math.e))


def softmax(log_probs: Column) -> Column:
    top = F.array_max(log_probs)
    e = F.transform(log_probs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def entropy_nats(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(p)).otherwise(0.0))


def symbol_bits(cdf: Column, symbol: Column, total: int = 1 << 24) -> Column:
    """-log2 of the symbol's share under a quantised cumulative distribution."""
    freq = F.get(cdf, symbol + 1) - F.get(cdf, symbol)
    return -F.log2(F.greatest(F.lit(1), freq) / F.lit(float(total)))


def find_symbol(cdf: Column, target: Column) -> Column:
    """The symbol whose range holds target."""
    return F.size(F.filter(cdf, lambda x: x <= target)) - 1


def bin_of(edges: Column, x: Column) -> Column:
    """Number of the bin [edge k, edge k+1) that holds x, clamped to the first and last."""
    return F.greatest(F.lit(0), F.least(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.size(edges) - 2))


def continuation_cut(n: Column, ratio: Column) -> Column:
    """Prefix length: the largest multiple of 6 within ratio * n; null unless 0 < cut < n."""
    cut = (F.floor(n * ratio / 6) * 6).cast("long")
    return F.when((cut > 0) & (cut < n), cut)


def sequence_id(canon: Column) -> Column:
    """CRC-32 of the sequence."""
    return F.crc32(canon)


def within(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    return F.abs(a - b) / a <= tolerance


def attention_flops(q: Column, k: Column, v: Column) -> Column:
    return 2 * q * k * v


def token_flops(n_tokens: Column, d_model: int, n_layers: int) -> Column:
    """Six operations for each parameter of the blocks (12 d^2 a layer) and token."""
    return n_tokens.cast("double") * F.lit(6.0 * 12.0 * d_model * d_model * n_layers)


def learning_rate(step: Column, warmup: int, total: int, base: float) -> Column:
    """Linear warm-up, then half a cosine."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, F.lit(base) * (step + 1) / warmup).otherwise(F.lit(base) * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), progress))))


def run_id(arm: Column, seed: Column, scale: Column, batch_nt: Column) -> Column:
    return F.format_string("%s_s%d_%s_b%d", arm, seed, scale, batch_nt)


def formatted(x: Column, digits: int = 4) -> Column:
    """A number with fixed digits, - for null."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def prefix_edges(max_len: int, bins: int = 8) -> list[int]:
    """Log-spaced edges of prefix lengths from 0 to max_len."""
    if max_len <= bins:
        return list(range(max_len + 1))
    top = math.log10(max(2, max_len))
    edges = sorted({0} | {x for x in (int(10 ** (top * k / bins)) for k in range(bins + 1)) if 0 < x <= max_len})
    return edges if edges[-1] >= max_len else [*edges, max_len]
