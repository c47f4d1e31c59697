"""Resetting scans against one walk over all rows, for any number of partitions."""

import random
from collections import Counter

import numpy as np
import pytest

from seqloom.operators import letters, scans


def walk(rows, rule):
    """(number, cuts, closed) of each row, and the last state, in one walk."""
    state, size, total, out = None, 0, 0, []
    for row in rows:
        flags, closed, number = [], [], None
        for x in row:
            cut, after = (True, rule.begin(x)) if state is None else rule.step(state, x)
            if cut and state is not None:
                closed.append(size)
            state, size, total = after, 1 if cut else size + 1, total + cut
            number = total - 1 if number is None else number
            flags.append(int(cut))
        out.append((number, flags, closed))
    return out, None if state is None else [state, size, total]


def make(seed, n=80):
    rng = random.Random(seed)
    return [[rng.choice([0.1, 0.7, 1.386, 1.0, 0.0, 5.0]) for _ in range(rng.choice([0, 1, 3, 30]))] for _ in range(n)]


def test_pieces_joined_are_one_walk():
    for seed in range(30):
        rng = random.Random(seed)
        rule = scans.gate_rule(rng.choice([0.5, 3.0, 8.3])) if seed % 2 else scans.budget_rule(rng.choice([5, 40, 400]))
        items = [rng.choice([0.1, 0.7, 1.386, 0.0, 5.0]) if seed % 2 else rng.randint(0, 30) for _ in range(rng.randint(0, 300))]
        _, want = walk([items], rule)
        at = None
        begin = 0
        while begin < len(items):
            end = begin + rng.choice([1, 2, 5, 50])
            at = scans.follow(at, *scans.survey(iter(items[begin:end]), rule), rule)
            begin = end
        assert (at and list(at)) == want


@pytest.mark.parametrize("n", [1, 4, 23])
def test_scan_equals_one_walk(spark, n):
    rows = make(n)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "ord long, x array<double>").repartition(5)
    for rule in (scans.gate_rule(4.0), scans.gate_rule(1000.0), scans.gate_rule(0.0)):
        out, last = scans.resetting_scan(df, ["ord"], lambda batch: batch.column(1).to_pylist(), rule, n)
        want, end = walk(rows, rule)
        assert [(r.number, r.cuts, r.closed) for r in sorted(out.collect(), key=lambda r: r.ord)] == want and list(last) == end
    sizes = [(k, random.Random(k).randint(0, 90)) for k in range(300)]
    out, _ = scans.resetting_scan(spark.createDataFrame(sizes, "ord long, length long"), ["ord"], lambda b: [[x] for x in b.column(1).to_pylist()], scans.budget_rule(500), n)
    got, end = {}, walk([[x] for _, x in sizes], scans.budget_rule(500))
    for r in out.collect():
        got.setdefault(r.number, []).append((r.ord, r.length))
    assert len(got) == end[1][2] and all(len(g) * max(x for _, x in g) <= 500 for g in got.values())
    assert {r.ord: r.number for r in out.collect()} == {k: w[0] for (k, _), w in zip(sizes, end[0])}
    none, last = scans.resetting_scan(df.limit(0), ["ord"], lambda batch: batch.column(1).to_pylist(), scans.gate_rule(1.0), n)
    assert none.count() == 0 and last is None


def test_stream_of_patches(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGU", [8, 1, 1, 1], k=rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(seqs)), "ord long, canonical_sequence string")
    counts = letters.letter_counts(df, 2)
    assert counts.sum() == sum(map(len, seqs)) and counts[0].sum() == sum(1 for s in seqs if s)
    entropy = letters.context_entropies(counts, 2)
    code, _, sizes = letters.contexts(seqs, 2)
    flat = entropy[code].tolist()
    gate = 6 * letters.mean_entropy(df, counts, 2)
    assert gate == pytest.approx(6 * float(np.mean(flat)))
    rows, end = walk([flat], scans.gate_rule(gate))
    want = Counter(rows[0][2]) + Counter([end[1]])
    assert {r.length: r.n for r in letters.stream_patches(df, ["ord"], counts, 2, gate).collect()} == dict(want)
    assert letters.stream_patches(df.limit(0), ["ord"], counts, 2, gate).count() == 0
