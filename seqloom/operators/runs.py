"""Run records: acceptance, registries, best checkpoints, result tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import within

# Fixed value: directory names of runs are phase4, arm, seed, time stamp, and restart for a run that was taken up again.
RUN_NAME = r"^phase4_(F[1-7]|P[1-3]|B1)_s(\d+)_(\d{8}T\d{6})(_restart)?$"


def parse_run_name(name: Column) -> list[Column]:
    """arm, seed, stamp and restarted of a run directory's name; null if it is none."""
    is_run = name.rlike(RUN_NAME)
    field = lambda k: F.when(is_run, F.regexp_extract(name, RUN_NAME, k))
    return [field(1).alias("arm"), field(2).cast("int").alias("seed"), field(3).alias("stamp"), (field(4) != "").alias("restarted")]


def latest_run(runs: DataFrame, keys: list[str], name: str = "run_dir") -> DataFrame:
    """One run per cell: the last by name, whose stamp sorts by time."""
    return furthest(runs, keys, name, name)


def finished_means(cells: DataFrame, value: str) -> DataFrame:
    """arm, mean, n over the cells that have a value."""
    return cells.where(F.col(value).isNotNull()).groupBy("arm").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


#: What makes a manifest unacceptable: a code and, given the wanted arm and seed, the condition. Nulls are faults.
FAULTS = {
    "not_done": lambda arm, seed: ~F.col("status").eqNullSafe("DONE"),
    "other_arm": lambda arm, seed: ~F.col("arm").eqNullSafe(arm),
    "other_seed": lambda arm, seed: ~F.col("seed").eqNullSafe(seed),
    "no_budget": lambda arm, seed: F.col("budget_nt").isNull() | F.col("final_nt").isNull(),
    "under_budget": lambda arm, seed: F.col("final_nt") < F.col("budget_nt"),
    "cpu_fallback": lambda arm, seed: ~F.col("cpu_fallback_count").eqNullSafe(0),
    "no_loss": lambda arm, seed: F.col("best_val_loss").isNull(),
    "no_checkpoint": lambda arm, seed: F.coalesce("best_checkpoint", F.lit("")) == "",
    "no_params": lambda arm, seed: ~(F.coalesce("params", F.lit(0)) > 0),
}


def issues(arm: Column, seed: Column) -> Column:
    """Codes of the faults of a manifest row that should be of the given arm and seed; empty if it passes."""
    return F.array_compact(F.array(*[F.when(rule(arm, seed), code) for code, rule in FAULTS.items()]))


def ledger(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One run per cell: the first that is DONE, else the first."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.where("status is not null").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("status") != "DONE", F.col(order))).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in rest])


def furthest(runs: DataFrame, keys: list[str], progress: str, order: str) -> DataFrame:
    """One run per cell: the furthest, of equals the last by order."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(progress, order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in rest])


def best_checkpoint(checkpoints: DataFrame, keys: list[str], loss: str, order: str) -> DataFrame:
    """keys, the order value of the first smallest loss, and that loss."""
    at = F.min_by(F.col(order), F.struct(loss, order)).alias(order)
    return checkpoints.where(F.col(loss).isNotNull()).groupBy(*keys).agg(at, F.min(loss).alias(loss))


def closure(spine: DataFrame, runs: DataFrame, keys: list[str], live: DataFrame | None = None) -> DataFrame:
    """Every cell of the spine with its status: RUNNING if live, the run's, or NOT_STARTED."""
    out = spine.join(runs, keys, "left")
    status = F.coalesce("status", F.lit("NOT_STARTED"))
    if live is not None:
        out = out.join(live.select(*keys).distinct().withColumn("_live", F.lit(True)), keys, "left")
        status = F.when(F.col("_live"), "RUNNING").otherwise(status)
    return out.withColumn("status", status).drop("_live")


def main_table(spine: DataFrame, runs: DataFrame, likelihood: DataFrame, generation: DataFrame) -> DataFrame:
    """Means per arm over the seeds of the spine that have a value, and how many seeds are missing.

    spine: arm, seed; the others are left-joined, so a cell without results stays visible.
    """
    cells = spine.join(runs, ["arm", "seed"], "left").join(likelihood, ["arm", "seed"], "left").join(generation, ["arm", "seed"], "left")
    status = F.when(F.col("status").isNull(), "MISSING_RUN_DIR").when(F.col("best_checkpoint").isNull(), "NO_BEST_CKPT").otherwise(F.col("status"))
    cells = cells.withColumn("status", status)
    means = ["bpn", "best_val_loss", "params", "throughput_nt_s", "uniqueness"]
    return cells.groupBy("arm").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means], F.count("*").alias("seeds"), F.count_if(F.col("status") == "MISSING_RUN_DIR").alias("missing"),
        F.count_if(F.col("status") == "NO_BEST_CKPT").alias("no_checkpoint"),
    )


def missing_cells(spine: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return spine.join(done.select(*keys), keys, "left_anti")


def factor_choice(reports: DataFrame) -> DataFrame:
    """arm, factor with the smallest loss (first of equals), reports (how many factors were tried)."""
    return reports.groupBy("arm").agg(F.min_by("factor", F.struct("loss", "factor")).alias("factor"), F.min("loss").alias("loss"), F.count("*").alias("reports"))


def fairness(rows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: same_params (one distinct non-embedding count), in_tolerance, no_fallback, all_ok."""
    base = F.min("params")
    out = rows.agg(
        (F.countDistinct("non_embedding_params") == 1).alias("same_params"),
        within(base, F.max("params"), tolerance).alias("in_tolerance"), (F.max("cpu_fallback_count") == 0).alias("no_fallback"),
    )
    return out.withColumn("all_ok", F.col("same_params") & F.col("in_tolerance") & F.col("no_fallback"))


def exposure(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Letters of the targets that count: the weights of targets other than -100, by key."""
    used = F.aggregate(F.zip_with("weight", "target", lambda w, t: F.when(t != -100, w).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return rows.groupBy(*keys).agg(F.sum(used).alias("valid_nt"), F.count("*").alias("sequences"))
