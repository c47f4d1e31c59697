"""Arms of a comparison: what each one's tokens, metric and boundaries are.

An arm is a row of data; everything that depends on it is a lookup, so that it runs as a CASE expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arm -> (backbone, tokenizer, vocabulary, k).
ARMS = {
    "F1": ("flat", "NUC", 4, 1),
    "F2": ("flat", "BPE", 1024, None),
    "F3": ("flat", "Unigram", 1024, None),
    "F4": ("flat", "overlap_mer", 64, 3),
    "F5": ("flat", "overlap_mer", 4096, 6),
    "F6": ("flat", "nonoverlap_mer", 84, 3),
    "F7": ("flat", "nonoverlap_mer", 5460, 6),
    "P1": ("blt", "fixed_patch", 4, None),
    "P2": ("blt", "random_patch", 4, None),
    "P3": ("blt", "entropy_patch", 4, None),
    "B1": ("blt", "fixed_patch", 4, 1),
}
# Mean length of a patch; width of a feed-forward layer in widths of the model.
PATCH, FF_FACTOR = 6, 4


def by_arm(arm: Column, values: dict) -> Column:
    """The value of each arm, null for an unknown one."""
    out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for name, value in values.items():
        out = out.when(arm == name, F.lit(value))
    return out


def metric(arm: Column) -> Column:
    """Which likelihood an arm reports."""

    def of(backbone: str, tokenizer: str) -> str:
        if tokenizer == "overlap_mer":
            return "overlap_path_BPN"
        return "next_base_BPN" if backbone == "blt" or tokenizer == "NUC" else "canonical_path_BPN"

    return by_arm(arm, {a: of(x[0], x[1]) for a, x in ARMS.items()})


def boundary_policy(arm: Column) -> list[Column]:
    """kind of the segment boundaries and length of fixed ones; null for arms without segments."""
    kinds = {a: x[1].removesuffix("_patch") for a, x in ARMS.items() if x[0] == "blt"}
    return [by_arm(arm, kinds).alias("kind"), by_arm(arm, {a: x[3] or PATCH for a, x in ARMS.items() if x[1] == "fixed_patch"}).alias("segment_length")]


def arm_rank(arm: Column) -> Column:
    """Place of an arm in reports; unknown ones come last."""
    return F.coalesce(by_arm(arm, {a: k for k, a in enumerate(ARMS)}), F.lit(99))


def attention_flops(batch: Column, length: Column, d_model: Column) -> Column:
    """Three products of length x length x width."""
    return 2.0 * batch * length * length * d_model * 3


def feed_forward_flops(d_model: Column, d_ff: Column, n_layers: Column, length: Column) -> Column:
    return 2.0 * n_layers * length * d_model * d_ff * 3


def arm_flops(d_model: Column, n_layers: Column, length: Column) -> Column:
    """Feed-forward and attention of all layers over a context."""
    return feed_forward_flops(d_model, FF_FACTOR * d_model, n_layers, length) + 12.0 * d_model * length * n_layers


def sealed(rows: DataFrame, split: str, opened: bool = False, closed: tuple[str, ...] = ("test",)) -> DataFrame:
    """rows of a split; those of a closed one only if it has been opened."""
    if split in closed and not opened:
        raise PermissionError(f"the split {split} is sealed")
    return rows.where(F.col("split") == split)
