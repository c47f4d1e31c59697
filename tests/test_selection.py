"""Exact quantiles, pattern sets, and tables that are kept up to date."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.metrics import contained_items
from seqloom.operators.segments import exact_quantiles
from seqloom.streaming import ingest


@pytest.mark.parametrize("n", [1, 4, 19])
def test_quantiles(spark, n):
    rng = random.Random(n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    for values in ([rng.random() for _ in range(501)], [1.386] * 400 + [0.5, 2.0], [rng.choice([0.1, 0.2, 0.9]) for _ in range(100)], [7.0]):
        shares = [k / 8 for k in range(9)] + [0.333]
        got = exact_quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x", shares)
        assert got == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-15)
    assert all(map(math.isnan, exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5])))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_contained_items_in_all_ways(spark):
    rng = random.Random(5)
    words = ["é", "aa", "b", "ccc", "日本", "a", "", "x\ny"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 9, 10, 14, 30])))) for k in range(60)] + [(900, None), (901, ""), (902, "aa aa"), (903, "aa aa")]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 40])) + [t or "" for _, t in rng.sample(items, 2)])) for k in range(120)] + [(500, None), (501, ""), (502, "aa aa")]
    want = {(d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t}
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 400, 0x7FFFFFFF):
        assert {tuple(r) for r in contained_items(a, b, most=most).collect()} == want
    assert len(want) > 200 and contained_items(a, b.limit(0)).count() == 0 and contained_items(a.limit(0), b).count() == 0


def test_best_so_far_writes_changed_keys_only(spark, tmp_path):
    rng = random.Random(6)
    for part in range(3):
        keys = range(40) if part == 0 else range(part)
        rows = [(part * 1000 + k, k, "t", rng.random()) for k in keys]
        spark.createDataFrame(rows, "event_id long, user_id int, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = ingest.stream_table(spark, str(tmp_path / "in"), 1)
    versions = ingest.run_to_table(ingest.best_so_far(events, ["user_id", "event_type"]), str(tmp_path / "out"), "update")
    assert sorted(r["count"] for r in versions.groupBy("version").count().collect()) == [1, 2, 40]
    got = {(r.user_id, r.event_id, r.value) for r in ingest.latest(versions, ["user_id", "event_type"]).collect()}
    best = spark.read.parquet(str(tmp_path / "in")).groupBy("user_id").agg(F.min_by("event_id", "value"), F.min("value"))
    assert got == {tuple(r) for r in best.collect()}
