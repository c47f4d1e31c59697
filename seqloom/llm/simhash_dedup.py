"""SimHash near-duplicates by vantage-point trees over the Hamming metric.

A fingerprint has one or more words of 64 bits. near_copies has one and a radius
of 4 unless told otherwise; drop_near_copies has two, over five-word shingles, and
a radius of 20: at equal sizes a Jaccard similarity of 0.8 is a cosine of 0.889
and 15.2 % of differing bits, 19.4 of 128. So links are made where the estimated
similarity is 0.8 or more; near that border an estimate can fall on either side.
Fingerprints of unrelated texts are within 20 of 128 bits once in some 10^15 pairs.

Only distinct fingerprints are searched; copies of a text are one point.

Partition. Two fingerprints within the radius differ in at most radius // words
bits of one word. The bits of each word form blocks, in groups, such that any two
fingerprints so near agree on some m blocks of one group; each such choice of m
blocks of a word is a masked Hamming metric, used on its first bits only, as many
as leave about TARGET points in a ball of radius 0. That ball is a shard: under at
least one of the metrics linked points have distance 0, so by the triangle bound
their distances to every vantage point are the same and both lie in one shard. The
number of bits grows with the logarithm of the number of points, and the number of
metrics with the bits: 5 of them up to 12 bits at a radius of 4; nothing else
changes with the size.

Search. In a shard a vantage-point tree over the unmasked metric splits the
points at the median distance from a vantage point. Partners across the cut lie
within the radius of it on both sides, by the triangle bound; all others are
pruned, and the two borders are compared exactly. (On 64 random-looking bits
distances to any vantage point lie within a few bits of 32, so a level keeps
about 0.73 of the pairs. As the only structure the tree would grow almost with
the square of the points; this is why shards come first. At 20 of 128 bits the borders hold nearly all
points, and shards are compared in tiles unless the texts gather.) A pair is taken up
only under the first metric that joins it, and of all links of a shard only a
spanning forest is sent on, so a group of near copies gives links in proportion
to its size, not to its square.

Oversized shards (more than SHARD_LIMIT points: distinct near copies of one
text) are split by the rings of unmasked distance to one vantage point; a point
whose radius-4 ball overlaps the next ring is also sent there, so that every
pair meets in the ring of its outer point. A ring that is still oversized is
dealt into pairs of hash blocks.

Dense components. Where a point is linked to a sixteenth of its shard or more, its
whole component is walked first: each of its points is compared with those not yet
reached, so a large group of near copies costs its size, not its square.

Null text counts as empty; no words give fingerprint zero. Texts of any length
are fingerprinted whole. Rows that repeat an id, or an id and a text, are each
returned. A null id never is the smallest unless all ids of its component are
null. An empty table gives no rows. Other columns of docs may have any names.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, changes, checkpointed, partitions, sliced, text_of, whole_groups, whole_row, with_least
from .components import connected_components

RADIUS = 4
#: Words of a fingerprint, shingle width and radius for a similarity of 0.8.
WORDS, WIDTH, WIDE = 2, 5, 20
#: Points of a shard that the number of masked bits aims at, and those from which a shard is split.
TARGET, SHARD_LIMIT = 2_048, 20_000
#: The same for fingerprints of several words, which have many more metrics.
TARGET_WORDS = 8_192
#: Points of a leaf of the tree, which are compared with each other.
LEAF = 256
#: Points of the two sides of one comparison in numpy, which stays in a core's cache.
ROWS, TILE = 128, 768


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash for each: the finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, width: int = 4, size: int = 1) -> int:
    """SimHash of the word shingles of UTF-8 text, A-Z lower-cased, in size words of 64 bits, the first one lowest."""
    import xxhash

    words = text.lower().split()  # bytes split at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        n = len(words) - width + 1
        pieces = map(joined.__getitem__, map(slice, [0, *ends[: n - 1]], [e - 1 for e in ends[width - 1 :]]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), "<u8", n)
    out = 0
    for word in range(size):
        counts = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out |= int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) << 64 * word
        hashes = _mixed(hashes)
    return out


def _names(size: int) -> list[str]:
    """The columns of a fingerprint's words."""
    return ["fp", *(f"fp{k}" for k in range(1, size))]


def fingerprints(docs: DataFrame, width: int = 4, size: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs; fp (and fp1 ...) hold 64 bits each as a signed long, text_hash is xxhash64."""
    names = _names(size)

    def run(batches):
        for batch in sliced(batches, 1):
            found = b"".join(fingerprint(t.as_py().encode(), width, size).to_bytes(8 * size, "little") for t in batch.column(1))
            prints = np.frombuffer(found, "<i8").reshape(-1, size)
            words = [pa.array(np.ascontiguousarray(prints[:, k])) for k in range(size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *words], ["doc_id", "text_hash", *names])

    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", "text_hash bigint", *(f"{n} bigint" for n in names)]))


def masks(points: int, radius: int = RADIUS, target: int = TARGET) -> list[int]:
    """The masks of the metrics of one word, as unsigned 64-bit numbers, for a number of points.

    With g groups of blocks and g (m - 1) + 1 blocks more than the radius, some group has m blocks without a
    difference. Of all g and m that have enough bits, those of the fewest metrics are taken.
    """
    bits = max(0, math.ceil(math.log2(max(1, points / target))))
    best = None
    for m in range(1, 6):
        for g in range(1, radius + 2):
            blocks = radius + g * (m - 1) + 1
            if blocks > 64 or m == 1 and g > 1:
                continue
            edges = [round(64 * k / blocks) for k in range(blocks + 1)]
            cuts = [round(blocks * k / g) for k in range(g + 1)]
            number = sum(math.comb(hi - lo, m) for lo, hi in zip(cuts, cuts[1:]))
            room = m * (64 // blocks)
            # enough bits first, then few metrics; where none has enough, the most bits
            rank = (min(room, bits), -number)
            if number <= 2_000 and (best is None or rank > best[0]):
                best = rank, m, edges, cuts
    _, m, edges, cuts = best
    chosen = [c for lo, hi in zip(cuts, cuts[1:]) for c in combinations(range(lo, hi), m)]
    return list(dict.fromkeys(sum(1 << b for b in [b for x in c for b in range(edges[x], edges[x + 1])][:bits]) for c in chosen))


class Shards:
    """Finds a spanning forest of the links in each (metric, shard) of sorted points.

    metrics: the masks of the first word, then those of the second, and so on; the number of words divides them.
    compared and pruned count the pairs that were compared and those that the triangle bound or a walk spared.
    """

    def __init__(self, radius: int, metrics: list[int], size: int = 1):
        self.radius, self.masks, self.size = radius, np.array(metrics, np.uint64), size
        self.compared = self.pruned = 0

    def _own(self, x: np.ndarray, y: np.ndarray, metric: int) -> np.ndarray:
        """Pairs (rows of words) that no metric before theirs joins."""
        different, own = x ^ y, np.ones(len(x), bool)
        far = np.bitwise_count(different) > self.radius // self.size
        each = len(self.masks) // self.size
        for k in range(metric):
            own &= (different[:, k // each] & self.masks[k] != 0) | far[:, k // each]
        return own

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all points of a from all of b."""
        far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
        for k in range(1, self.size):
            far = far + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
        return far

    def _cross(self, x, a, b, metric, forest) -> None:
        """Compares all of a with all of b, or a with itself, in tiles.

        A metric answers for pairs within radius // size in its own word; only these are compared in all words.
        """
        same = b is None
        b = a if same else b
        self.compared += len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)
        word = metric * self.size // len(self.masks)
        xa, xb = x[a, word], x[b, word]
        for i in range(0, len(a), ROWS):
            for j in range(i if same else 0, len(b), TILE):
                near = np.bitwise_count(xa[i : i + ROWS, None] ^ xb[None, j : j + TILE]) <= self.radius // self.size
                p, q = np.divmod(np.flatnonzero(near), near.shape[1])
                p, q = p + i, q + j
                if same:
                    p, q = p[p < q], q[p < q]
                p, q = a[p], b[q]
                if self.size > 1:
                    near = np.bitwise_count(x[p] ^ x[q]).sum(axis=1) <= self.radius
                    p, q = p[near], q[near]
                own = self._own(x[p], x[q], metric)
                forest.add(p[own], q[own])

    def _walk(self, x, metric, forest) -> np.ndarray:
        """Walks the dense components of a shard; returns the points of the others.

        A link that an earlier metric joins is left out: its ends are connected in that metric's shard.
        """
        rest = np.arange(len(x))
        for tried in range(4):
            if len(rest) <= LEAF:
                break
            seed = rest[len(rest) * tried // 4]
            if np.count_nonzero(self._far(x[seed : seed + 1], x[rest]) <= self.radius) < len(rest) / 16:
                continue
            rest, queue = rest[rest != seed], [np.array([seed])]
            while queue:
                part = queue.pop()
                if len(part) > 64:  # small steps first, while most points are not reached
                    queue.append(part[64:])
                part = part[:64]
                if not len(rest):
                    break
                self.compared += len(part) * len(rest)
                near = self._far(x[part], x[rest]) <= self.radius
                hit = near.any(axis=0)
                if hit.any():
                    p, q = part[near.argmax(axis=0)[hit]], rest[hit]
                    own = self._own(x[p], x[q], metric)
                    forest.add(p[own], q[own])
                    queue.append(q)
                    rest = rest[~hit]
        return rest

    def _tree(self, x, metric, forest) -> None:
        before, compared = len(x) * (len(x) - 1) // 2, self.compared
        rest = self._walk(x, metric, forest) if len(x) > LEAF else np.arange(len(x))
        self.pruned += before - len(rest) * (len(rest) - 1) // 2 - (self.compared - compared)
        todo = [rest]
        while todo:
            of = todo.pop()
            if len(of) <= LEAF:
                self._cross(x, of, None, metric, forest)
                continue
            far = self._far(x[of], x[of[len(of) // 2]][None])[:, 0].astype(np.int64)
            cut = int(np.median(far))
            low, high = of[far <= cut], of[far > cut]
            # the triangle bound: partners across the cut lie within radius of each other in distance
            edge_low, edge_high = of[(far <= cut) & (far > cut - self.radius)], of[(far > cut) & (far <= cut + self.radius)]
            if not len(high) or len(edge_low) * len(edge_high) > 0.45 * len(of) ** 2 / 2:
                self._cross(x, of, None, metric, forest)
                continue
            self.pruned += len(low) * len(high) - len(edge_low) * len(edge_high)
            todo += [low, high]
            self._cross(x, edge_low, edge_high, metric, forest)

    def links(self, table: pa.Table):
        x = np.stack([table[n].to_numpy().view(np.uint64) for n in _names(self.size)], axis=1)
        node = table["node"].to_numpy() if "node" in table.column_names else table["fp"].to_numpy()
        metric = table["metric"].to_numpy()
        starts = np.flatnonzero(changes(metric, *(table[c].to_numpy() for c in ("shard", "part"))))
        u, v = [], []
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(x)).tolist()):
            own, forest = x[a:b], Forest(b - a)
            self._tree(own, int(metric[a]), forest)
            if forest.links:
                p, q = np.array(forest.links).T
                u.append(node[a:b][p])
                v.append(node[a:b][q])
        u, v = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def hamming_links(points: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, target: int = TARGET, size: int = 1) -> DataFrame:
    """(u, v): links between distinct fingerprints at most radius bits apart, enough of them to join every component.

    points: the words of a fingerprint, and node, the number to name it by (fp where there is none).
    """
    words = _names(size)
    columns = [*words, *(["node"] if "node" in points.columns else [])]
    metrics = masks(points.count(), radius // size, target)
    signed = [m - (1 << 64) if m >> 63 else m for m in metrics]
    metrics = metrics * size
    keyed = points.select(*columns, F.posexplode(F.array(*[F.col(w).bitwiseAND(F.lit(m)) for w in words for m in signed])).alias("metric", "shard"))
    least = F.min(F.struct(*words)).alias("vantage")
    large = keyed.groupBy("metric", "shard").agg(F.count("*").alias("n"), least).where(F.col("n") > shard_limit)
    large = checkpointed(large)
    if large.isEmpty():
        dealt = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        width = radius + 1
        near = keyed.join(large.select("metric", "shard", "vantage"), ["metric", "shard"])
        far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"vantage.{w}"))) for w in words), F.lit(0))
        near = near.withColumn("ring", F.floor(far / width).cast("int")).withColumn("over", (far % width) > 0)
        near = near.withColumn("ring", F.explode(F.when(F.col("over"), F.array(F.col("ring"), F.col("ring") + 1)).otherwise(F.array("ring"))))
        sizes = near.groupBy("metric", "shard", "ring").agg(F.ceil(F.count("*") / shard_limit).cast("int").alias("b"))
        near = near.join(sizes, ["metric", "shard", "ring"]).withColumn("own", F.pmod(F.xxhash64(*words), F.col("b")).cast("int"))
        pair = lambda o: (F.col("ring").cast("long") * 4294967296 + F.least("own", o) * F.col("b") + F.greatest("own", o) + 1)
        near = near.select(*columns, "metric", "shard", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("b") - 1), pair))).alias("part"))
        rest = keyed.join(large, ["metric", "shard"], "left_anti").withColumn("part", F.lit(0).cast("long"))
        dealt = rest.unionByName(near)
    order = ["metric", "shard", "part"]
    dealt = dealt.repartition(partitions(points.sparkSession), *order).sortWithinPartitions(*order, *words)

    def run(batches):
        shards = Shards(radius, metrics, size)
        for table in whole_groups(batches, order):
            yield shards.links(table)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_copies(docs: DataFrame, width: int = 4, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, size: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word), component_id (smallest doc_id reachable), text_hash for each row of docs."""
    words = _names(size)
    rows = checkpointed(fingerprints(docs, width, size))
    points = rows.groupBy(*words).agg(F.min("doc_id").alias("first"))
    points = checkpointed(points.withColumn("node", F.monotonically_increasing_id()))
    links = hamming_links(points.select(*words, "node"), radius, shard_limit, TARGET if size == 1 else TARGET_WORDS, size)
    found = connected_components(links).withColumnRenamed("node", "of")
    named = points.join(found, points.node == found.of, "left").select(*words, "first", F.coalesce("component", "node").alias("key"))
    names = with_least(named, "key", "first", "component_id", "fp").select(*words, "component_id")
    digits = F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in reversed(words)]).alias("fingerprint")
    return rows.join(names, words).select("doc_id", digits, "component_id", "text_hash")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, radius: int = WIDE, size: int = WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, all columns untouched."""
    kept = near_copies(docs, width, radius, size=size).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("id"), "text_hash").distinct().hint("shuffle_hash").alias("k")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of(docs)).alias("text_hash"), whole_row(docs).alias("row")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    return rows.join(kept, same, "left_semi").select("row.*")
