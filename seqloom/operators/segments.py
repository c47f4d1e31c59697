"""Segment (patch) boundaries: fixed, random, entropy-gated, conditional; their counts, means and audits."""

from __future__ import annotations

import math
import random
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.sequence import AUDIT_STRATA, audit_stratum, bin_of, token_flops
from ..functions.splitmix import splitmix_draw
from .homology import checkpointed

#: Bounds of the boundary rates that count as supported, and the coverage they must have (fixed values).
SUPPORT_LOW, SUPPORT_HIGH, SUPPORT_COVERAGE = 0.05, 0.95, 0.8


def fixed_boundaries(n: Column, size: int) -> Column:
    """1 at every size-th position from 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i % size == 0).cast("int"))).otherwise(F.array().cast("array<int>"))


def random_boundaries(pmf: list[float], seed: int):
    """A column function (length, sequence id) -> boundaries with segment lengths drawn from pmf.

    The generator is the standard library's, seeded by seed and sequence id, so that a prefix of a
    sequence gets a prefix of its boundaries.
    """

    def one(n: int, ident: int) -> list[int]:
        rng, out = random.Random(seed << 32 ^ ident), []
        out.append(1)
        while len(out) < n:
            draw, total, length = rng.random(), 0.0, 0
            for p in pmf:
                total, length = total + p, length + 1
                if draw <= total:
                    break
            out += [0] * (length - 1) + [1]
        return out[:n]

    @pandas_udf("array<int>")
    def run(n: pd.Series, ident: pd.Series) -> pd.Series:
        return pd.Series([one(int(a), int(b)) for a, b in zip(n, ident)])

    return run


def gated_boundaries(entropy: Column, gate: float) -> Column:
    """1 at 0, and wherever the entropy summed since the last boundary (its position included) reaches the gate."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        first = F.size(s["out"]) == 0
        cut = first | (s["sum"] >= gate)
        return F.struct((F.when(cut, 0.0).otherwise(s["sum"]) + e).alias("sum"), F.concat(s["out"], F.array(cut.cast("int"))).alias("out"))

    return F.aggregate(entropy, start, step)["out"]


def gated_boundaries_arrow(gate: float):
    """The same for long sequences: linear in their length."""

    @pandas_udf("array<int>")
    def run(entropy: pd.Series) -> pd.Series:
        def one(values):
            out, total = [], 0.0
            for e in values:
                cut = not out or total >= gate
                total = (0.0 if cut else total) + e
                out.append(int(cut))
            return out

        return entropy.map(one)

    return run


def segment_lengths(boundaries: DataFrame, key: str) -> DataFrame:
    """length, n, share over all segments of all rows (array column boundary)."""
    starts = F.filter(F.transform("boundary", lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.lit(0), F.size(starts) - 1)), F.array(F.size("boundary")))
    sizes = boundaries.where(F.array_contains("boundary", 1)).select(F.explode(F.zip_with(ends, starts, lambda e, s: e - s)).alias("length"))
    counts = sizes.groupBy("length").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("length", "n", (F.col("n") / F.col("total")).alias("share"))


def running_means(values: DataFrame, key: str) -> DataFrame:
    """Adds segment and mean: the mean of value from the segment's start to each position (columns key, pos, boundary, value)."""
    order = Window.partitionBy(key).orderBy("pos")
    out = values.withColumn("segment", F.sum("boundary").over(order))
    inside = Window.partitionBy(key, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("mean", F.avg("value").over(inside))


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Linear quantiles of a column's values (nulls left out), exact at any size; NaN without values.

    Distinct values are counted first and sorted by range; the driver sees the count of each partition, and only
    the partitions that hold a wanted rank are looked into, each for itself.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counts.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a partition
    before = dict(zip(sorted(sizes), accumulate([0] + [sizes[p] for p in sorted(sizes)])))
    total = sum(sizes.values())
    if not total:
        return [math.nan] * len(shares)
    wanted = sorted({r for q in shares for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))})
    owner = {r: max(p for p in before if before[p] <= r) for r in wanted}
    starts = F.create_map(*[F.lit(x) for p in sorted(set(owner.values())) for x in (p, before[p])])
    inside = dealt.where(F.col("part").isin(*set(owner.values())))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + starts[F.col("part")]
    ranked = inside.withColumn("upto", upto).withColumn("rank", F.explode(F.array(*map(F.lit, wanted))))
    hit = ranked.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    value = {r.rank: r.value for r in hit.select("rank", "value").collect()}  # a row a rank
    out = []
    for q in shares:
        at = (total - 1) * q
        low, high = value[math.floor(at)], value[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def entropy_edges(entropy: DataFrame, bins: int = 8) -> DataFrame:
    """One row: edges, the exact linear quantiles at 0, 1/bins, ... 1, the last a little raised."""
    cuts = exact_quantiles(entropy, "entropy", [k / bins for k in range(bins + 1)])
    return entropy.sparkSession.range(1).select(F.array(*[F.lit(x + 1e-9 if k == bins else x) for k, x in enumerate(cuts)]).alias("edges"))


def rate_table(at: DataFrame, prefix_edges: list[int], edges: DataFrame) -> DataFrame:
    """prefix_bin, entropy_bin, n, boundaries, q, supported from (pos, entropy, boundary) rows."""
    binned = at.crossJoin(F.broadcast(edges))  # one row
    binned = binned.select(
        bin_of(F.array(*map(F.lit, prefix_edges)), F.col("pos")).alias("prefix_bin"), bin_of(F.col("edges"), F.col("entropy")).alias("entropy_bin"), "boundary"
    )
    table = binned.groupBy("prefix_bin", "entropy_bin").agg(F.count("*").alias("n"), F.sum("boundary").alias("boundaries"))
    table = table.withColumn("q", F.col("boundaries") / F.greatest(F.lit(1), F.col("n")))
    return table.withColumn("supported", F.col("q").between(SUPPORT_LOW, SUPPORT_HIGH))


def coverage(table: DataFrame) -> DataFrame:
    """position_coverage, boundary_coverage, passes."""
    share = lambda c: F.sum(F.when(F.col("supported"), F.col(c)).otherwise(0)) / F.greatest(F.lit(1), F.sum(c))
    out = table.agg(share("n").alias("position_coverage"), share("boundaries").alias("boundary_coverage"))
    return out.withColumn("passes", (F.col("position_coverage") >= SUPPORT_COVERAGE) & (F.col("boundary_coverage") >= SUPPORT_COVERAGE))


def conditional_boundaries(at: DataFrame, table: DataFrame, prefix_edges: list[int], edges: DataFrame, seed: int) -> DataFrame:
    """Adds drawn: 1 at position 0; in supported bins a draw below q (of columns seq_id, pos); else the given boundary."""
    binned = at.crossJoin(F.broadcast(edges))  # one row
    binned = binned.withColumn("prefix_bin", bin_of(F.array(*map(F.lit, prefix_edges)), F.col("pos"))).withColumn("entropy_bin", bin_of(F.col("edges"), F.col("entropy")))
    joined = binned.join(F.broadcast(table.select("prefix_bin", "entropy_bin", "q", "supported")), ["prefix_bin", "entropy_bin"], "left")  # a fixed number of bins
    draw = splitmix_draw(seed)(F.col("seq_id"), F.col("pos").cast("long"))
    drawn = F.when(F.col("pos") == 0, 1).when(F.col("supported"), (draw < F.col("q")).cast("int")).otherwise(F.col("boundary"))
    return joined.withColumn("drawn", drawn).drop("edges")


def balance_audit(pairs: DataFrame, table: DataFrame | None, d_model: int = 768, n_layers: int = 12) -> DataFrame:
    """One row of gates that compares boundary (reference) with drawn.

    pairs: key, length, pos, boundary, drawn, prefix_bin, entropy_bin, supported; table: see rate_table.
    Strata count segments; the number of sequences with any segment is reported beside them.
    """
    err = lambda a, b: F.abs(a - b) / F.greatest(F.lit(1), b) * 100
    total = pairs.agg(F.sum("drawn").alias("drawn"), F.sum("boundary").alias("given"))
    total = total.select("drawn", "given", (err(F.col("drawn"), F.col("given")) <= 0.5).alias("gate_total"))
    flops = [token_flops(F.col(c), d_model, n_layers) for c in ("drawn", "given")]
    total = total.withColumn("gate_flops", err(*flops) <= 5)
    spine = pairs.sparkSession.range(len(AUDIT_STRATA)).select(F.col("id").cast("int").alias("stratum"))
    by = pairs.withColumn("stratum", audit_stratum(F.col("length"))).groupBy("stratum").agg(F.sum("drawn").alias("d"), F.sum("boundary").alias("g"))
    by = spine.join(by, "stratum", "left").select(err(F.coalesce("d", F.lit(0)), F.coalesce("g", F.lit(0))).alias("e"))
    by = by.agg((F.max("e") <= 2).alias("gate_strata"))
    rates = pairs.groupBy("prefix_bin", "entropy_bin").agg((F.abs(F.sum("drawn") - F.sum("boundary")) / F.count("*") * 100).alias("pp"))
    rates = rates.agg((F.coalesce(F.max("pp"), F.lit(0.0)) <= 2).alias("gate_rates"))
    replay = pairs.where("pos > 0 and not coalesce(supported, false)").agg(F.count_if(F.col("drawn") != F.col("boundary")).alias("replay_failures"))
    out = total.crossJoin(by).crossJoin(rates).crossJoin(replay).withColumn("gate_replay", F.col("replay_failures") == 0)
    if table is not None:
        out = out.crossJoin(coverage(table).select(F.col("passes").alias("gate_coverage")))
    else:
        out = out.withColumn("gate_coverage", F.lit(False))
    gates = [c for c in out.columns if c.startswith("gate_")]
    all_ok = F.lit(True)
    for g in gates:
        all_ok = all_ok & F.coalesce(F.col(g), F.lit(True))
    return out.withColumn("all_pass", all_ok)
