"""Nearest rows against all pairs."""

import math
import random

import numpy as np

from seqloom.operators.nearest import nearest_sequences, nearest_vectors


def test_nearest_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6))
    x = {k: (centres[k % 8] + rng.normal(size=6) * 0.05).tolist() for k in range(400)}
    x |= {1000 + k: x[k] for k in range(5)}  # equal vectors: the smaller id
    odd = {2000: None, 2001: [0.0] * 6, 2002: [math.nan] + [1.0] * 5, 2003: [None] + [1.0] * 5, 2004: [math.inf] + [0.0] * 5}
    rows = [(k, v, "c", 7) for k, v in (x | odd).items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, item int").repartition(3)
    got = {r.vec_id: r for r in nearest_vectors(df.where("vec_id % 5 = 0"), df, block=32, pivots=12).collect()}
    ids = sorted(x)
    m = np.array([x[k] for k in ids])
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    cosine = np.round(m @ m.T, 9)
    np.fill_diagonal(cosine, -np.inf)
    for q in (k for k in ids if k % 5 == 0):
        row = cosine[ids.index(q)]
        assert (got[q].neighbour, got[q].cosine) == (ids[int(row.argmax())], row.max())
    assert set(got) == {k for k in ids if k % 5 == 0}
    assert sum(r.compared for r in got.values()) < 0.6 * len(got) * len(ids)
    plan = nearest_vectors(df.where("vec_id % 5 = 0"), df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert nearest_vectors(df.limit(0), df).count() == 0 and nearest_vectors(df, df.limit(0)).count() == 0
    assert nearest_vectors(df, df.where("vec_id = 3")).where("vec_id = 3").count() == 0


def test_nearest_sequences_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = {k: "".join(rng.choices("ACGU", k=rng.randint(0, 40))) for k in range(120)}
    queries = {k: "".join(rng.choices("ACGU", k=rng.randint(0, 60))) for k in range(30)} | {30: rows[7], 31: ""}

    def identity(a, b):
        n = min(len(a), len(b))
        return sum(x == y for x, y in zip(a, b)) / n if n else 0.0

    as_df = lambda d: spark.createDataFrame(list(d.items()), "id long, item string")
    got = {r.query: (r.near, r.value, r.compared) for r in nearest_sequences(as_df(queries), as_df(rows), 16).collect()}
    for q, s in queries.items():
        best = max((identity(s, t), -k) for k, t in rows.items())
        assert got[q] == (-best[1], best[0], len(rows))
