"""Linear clusters and representative search against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from seqloom.operators.clusters import FACTOR, PRIME, covered, linear_clusters, linear_links, search, seeds

K, SENT, VOTES = 14, 40, 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def kmers(seq, sent):
    first = {}
    for i in range(len(seq or "") - K + 1):
        first.setdefault(seq[i : i + K], i)
    code = {m: int("".join(str("ACGU".index(c)) for c in m), 4) for m in first}
    order = sorted(first, key=lambda m: ((code[m] * FACTOR + 11) % PRIME, code[m]))
    return {m: first[m] for m in order[:sent]}


def pairs(members, centres, sent):
    top = {}
    for d, s in centres.items():
        for m, p in kmers(s, sent).items():
            if m not in top or (len(s), -d) > (len(centres[top[m][0]]), -top[m][0]):
                top[m] = d, p
    out = {}
    for d, s in members.items():
        votes = Counter((top[m][0], top[m][1] - p) for m, p in kmers(s, SENT).items() if m in top)
        for c in {c for (c, _), n in votes.items() if n >= VOTES}:
            diagonal = min((-n, g) for (x, g), n in votes.items() if x == c)[1]
            begin = max(0, -diagonal)
            end = min(len(s), len(centres[c]) - diagonal)
            n = end - begin
            if n * 100 < len(s) * 80:
                continue
            far = distance(s[begin:end], centres[c][begin + diagonal : end + diagonal])
            if far <= n * 20 // 100:
                out[d, c] = round(1 - far / n, 9), round(n / len(s), 9)
    return out


def plain_clusters(rows):
    found = {k: v for k, v in pairs(rows, rows, SENT).items() if k[0] != k[1]}
    size = Counter(c for _, c in found)
    rank = {d: i for i, d in enumerate(sorted(rows, key=lambda d: (-size[d], -len(rows[d] or ""), d)))}
    rep = {}
    for d in sorted(rows, key=rank.get):
        near = [c for m, c in found if m == d and rank[c] < rank[d] and rep[c] == c]
        rep[d] = min(near, key=rank.get) if near else d
    return {(d, r, *found.get((d, r), (1.0, 1.0))) for d, r in rep.items()}


def mutated(rng, seq, rate):
    out = []
    for c in seq:
        x = rng.random()
        out.append("" if x < rate / 3 else c + rng.choice("ACGU") if x < 2 * rate / 3 else rng.choice("ACGU") if x < rate else c)
    return "".join(out)


def make(seed, n=90):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ACGU", k=rng.randint(40, 160))) for _ in range(6)]
    rows = {}
    for d in range(n):
        s = mutated(rng, rng.choice(base), rng.choice([0, 0.02, 0.06, 0.15]))
        a = rng.randint(0, 20)
        rows[d * 3 + 1] = s[a : len(s) - rng.randint(0, 30)] + rng.choice(["", "", base[0][:30], "A" * 40])
    return rows | {1001: "", 1002: "ACGU", 1003: None, 1004: "A" * 13, 1005: "A" * 60, 1006: "A" * 200, 1007: "AC" * 50}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, s, "x") for d, s in rows.items()], "id long, seq string, member string").repartition(parts)


def as_set(df):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


def test_linear_clusters_equal_a_plain_version(spark):
    sizes = []
    for seed in (1, 2):
        rows = make(seed)
        got = linear_clusters(frame(spark, rows))
        assert got.columns == ["id", "representative", "identity", "coverage"]
        assert as_set(got) == plain_clusters(rows)
        sizes.append(got.select("representative").distinct().count())
    assert all(6 < n < 60 for n in sizes)
    assert linear_clusters(frame(spark, make(1)).limit(0)).count() == 0


def test_search_equals_a_plain_version(spark):
    queries, targets = make(3, 40), make(3, 70)
    found = pairs(queries, targets, None)
    best = {}
    for (q, t), how in found.items():
        best[q] = max(best.get(q, (0, 0, 0)), (*how, -t))
    assert as_set(search(frame(spark, queries), frame(spark, targets))) == {(q, -t, i, c) for q, (i, c, t) in best.items()}
    assert 20 < len(best)


def test_near_copies_give_fewer_links_than_rows(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("ACGU", k=300))
    rows = frame(spark, {d: mutated(rng, base, 0.004) for d in range(2000)})
    links = linear_links(rows)
    assert links.count() <= 40 * 2000 and seeds(rows).count() <= 40 * 2000
    sizes = linear_clusters(rows).groupBy("representative").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert sizes[0] > 1900 and sizes[1] < 50


def test_cover_of_a_chain(spark):
    """Each is linked to the one before; every second one is taken."""
    links = spark.createDataFrame([(k + 1, k, 100 - k - 1, 100 - k) for k in range(9)], "member long, centre long, member_length long, centre_length long")
    got = covered(spark.range(12).select(F.col("id")), links).collect()
    assert {(r.id, r.representative) for r in got} == {(k, k - k % 2) for k in range(10)} | {(10, 10), (11, 11)}
