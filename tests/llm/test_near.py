"""Near-duplicate operators against brute force over all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import Row

from seqloom.llm.components import connected_components
from seqloom.llm.embedding_dedup import near_vectors
from seqloom.llm.simhash_dedup import Shards, drop_near_copies, fingerprint, hamming_links, masks, near_copies


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_circles(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    pairs += [(400 + rng.randrange(200), 400 + rng.randrange(200)) for _ in range(120)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components(600, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: want[k] for k in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in ["", " \n", "One", "a b c", "A b C d", "É x\ty z É w", "x y z w x y z w", "word " * 70_000]:
        assert fingerprint(t.encode()) == plain_fingerprint(t) if len(t) < 1000 else fingerprint(t.encode()) == plain_fingerprint("word word word word"), t


def hamming_rows(rng, n):
    points = [rng.getrandbits(64) for _ in range(n)]
    for c in points[:12]:
        near = c
        for _ in range(40):
            near ^= 1 << rng.randrange(64)
            points.append(near)
    core = points[20]
    points += [core ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    return sorted(set(points))


def test_hamming_links_join_the_same_components(spark):
    rng = random.Random(9)
    points = hamming_rows(rng, 1500)
    x = np.array(points, np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)).tolist()
    want = components(len(points), pairs)
    signed = x.view(np.int64).tolist()
    place = {s: k for k, s in enumerate(signed)}
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for limit, target in ((20_000, 2_048), (50, 2_048), (20_000, 20), (30, 1)):
        links = [(place[r.u], place[r.v]) for r in hamming_links(frame, shard_limit=limit, target=target).collect()]
        assert all(bin(points[a] ^ points[b]).count("1") <= 4 for a, b in links)
        assert components(len(points), links) == want


def test_masks_join_every_pair():
    rng = random.Random(5)
    for points in (1, 2_048, 9_000, 10**6, 10**8, 10**10, 10**12):
        metrics = masks(points)
        assert len(metrics) == len(set(metrics))
        for _ in range(300):
            different = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(different & m == 0 for m in metrics)
        metrics = masks(points, 10, 8_192)
        for _ in range(100):
            different = sum(1 << b for b in rng.sample(range(64), 10))
            assert any(different & m == 0 for m in metrics)


def test_the_tree_prunes_and_loses_no_link():
    import pyarrow as pa

    rng = random.Random(6)
    points = hamming_rows(rng, 1000)
    x = np.array(points, np.uint64)
    shards = Shards(4, masks(len(points)))
    zero = np.zeros(len(x), np.int64)
    found = shards.links(pa.table({"fp": x.view(np.int64), "metric": zero.astype(np.int32), "shard": zero, "part": zero}))
    place = {s: k for k, s in enumerate(x.view(np.int64).tolist())}
    links = [(place[a], place[b]) for a, b in zip(found.column(0).to_pylist(), found.column(1).to_pylist())]
    pairs = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)).tolist()
    assert components(len(x), links) == components(len(x), pairs)
    assert shards.pruned > 0.2 * len(x) ** 2 / 2 and shards.pruned + shards.compared == len(x) * (len(x) - 1) // 2


def test_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(60):
        own = base[k % 10].split(" ")
        own[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(own)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE "), (305, base[0].upper()), (5, base[5]), (None, base[6]), (None, "alone here"), (306, "x " * 100_000)]
    prints = [fingerprint((t or "").encode()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = components(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root)]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    assert sorted((tuple(r)[:3] for r in near_copies(docs).collect()), key=str) == sorted(want, key=str)
    kept = drop_near_copies(docs, 4, 4, 1)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, c in want if d == c), key=str)
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def wide_rows(rng):
    points = [rng.getrandbits(128) for _ in range(500)]
    for c in points[:10]:
        near = c
        for _ in range(30):
            near ^= sum(1 << b for b in rng.sample(range(128), 9))
            points.append(near)
    points += [points[20] ^ sum(1 << b for b in rng.sample(range(128), rng.choice([4, 10, 20]))) for _ in range(300)]
    points += [points[30] ^ (1 << 64 + b) for b in range(30)]  # equal first words
    return sorted(set(points))


def test_wide_fingerprints_join_the_same_components(spark):
    points = wide_rows(random.Random(12))
    words = [[p & (1 << 64) - 1 for p in points], [p >> 64 for p in points]]
    pairs = [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 20]
    want = components(len(points), pairs)
    signed = [np.array(w, np.uint64).view(np.int64).tolist() for w in words]
    frame = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(zip(*signed))], "fp long, fp1 long, node long")
    for limit, target in ((20_000, 8_192), (20_000, 100), (60, 100)):
        links = [(r.u, r.v) for r in hamming_links(frame, 20, limit, target, 2).collect()]
        assert set(links) <= {(a, b) for p in pairs for a, b in (p, p[::-1])}
        assert components(len(points), links) == want


def test_a_dense_component_is_walked(spark):
    import pyarrow as pa

    rng = random.Random(13)
    core = rng.getrandbits(128)
    points = list({core ^ sum(1 << b for b in rng.sample(range(128), 5)) for _ in range(4_000)}) + [rng.getrandbits(128) for _ in range(500)]
    x = [np.array([p >> s & (1 << 64) - 1 for p in points], np.uint64).view(np.int64) for s in (0, 64)]
    zero = np.zeros(len(points), np.int64)
    shards = Shards(20, [0, 0], 2)
    found = shards.links(pa.table({"fp": x[0], "fp1": x[1], "node": np.arange(len(points)), "metric": zero, "shard": zero, "part": zero}))
    dense = len(points) - 500
    assert components(len(points), list(zip(*(c.to_pylist() for c in found.columns)))) == [0] * dense + list(range(dense, len(points)))
    assert shards.compared < 0.5 * len(points) ** 2 / 2 and shards.pruned + shards.compared == len(points) * (len(points) - 1) // 2


def test_drop_near_copies_at_a_similarity_of_0_8(spark):
    rng = random.Random(14)
    words = [f"w{k}" for k in range(3_000)]
    base = [rng.choices(words, k=400) for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        own = t[:]
        for at in (50, 150, 250, 350)[: 3 if k < 40 else 4]:
            own[at] = "changed"
        # 15 of 396 shingles differ: a similarity of 0.93; or a whole fourth of the text does: 0.6 at most
        rows.append((100 + k, " ".join(own if k < 40 else own[:290] + rng.choices(words, k=110))))
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(60))
    assert len(kept & set(range(100, 140))) <= 2 and len(kept & set(range(140, 160))) >= 18


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        centers = rng.normal(size=(12, 8))
        for c in centers:
            rows += [(c + rng.normal(scale=rng.choice([0.02, 0.1]), size=8), label) for _ in range(9)]
    rows += [(rows[0][0], 0)] * 5 + [(rows[0][0] * 3, 0), (rows[0][0], 1), (-rows[1][0], 0)]
    rows += [(None, 0), (np.zeros(8), 0), (np.full(8, np.nan), 0), (np.full(8, np.inf), 1), (np.ones(3), 0), (np.ones(3) * 2, 0), (np.zeros(0), 0), (np.full(8, 3e38), 0), (np.full(8, 1e-38), 0)]
    vectors = [None if v is None else np.float32(v) for v, _ in rows]
    listed = [None if v is None else v.tolist() for v in vectors]
    listed[7] = [None, *listed[7][1:]]
    labels = [x for _, x in rows]
    ok = [v is not None and None not in v and len(v) > 0 and np.isfinite(v).all() and any(v) and x is not None for v, x in zip(listed, labels)]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and labels[a] == labels[b] and len(listed[a]) == len(listed[b]):
                p, q = np.float64(listed[a]), np.float64(listed[b])
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    pairs.append((a, b))
    root = components(len(rows), pairs)
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    want = [(k, int(degree[k]), root[k], root[k] == k) for k in range(len(rows))]
    frame = spark.createDataFrame(
        [Row(vec_id=k, embedding=v, label=x, node="n", w=1) for k, (v, x) in enumerate(zip(listed, labels))],
        "vec_id long, embedding array<float>, label int, node string, w int",
    )
    assert sorted(map(tuple, near_vectors(frame).collect())) == want
    assert near_vectors(frame.limit(0)).count() == 0
