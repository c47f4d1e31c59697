"""SplitMix64 draws; 64-bit wrap-around arithmetic runs as an Arrow function, so that ANSI mode can stay on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

# Fixed values of the published generator.
INCREMENT, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(INCREMENT)
        for shift, factor in ((30, FIRST), (27, SECOND)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def draw(seq_id: np.ndarray, position: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on sequence id, position and seed only."""
    state = (seq_id.astype(np.uint64) << np.uint64(32)) ^ np.uint64(seed) ^ position.astype(np.uint64)
    return (mix(state) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def splitmix_draw(seed: int):
    """A column function (sequence id, position) -> double."""

    @pandas_udf("double")
    def run(seq_id: pd.Series, position: pd.Series) -> pd.Series:
        return pd.Series(draw(seq_id.to_numpy(), position.to_numpy(), seed))

    return run
