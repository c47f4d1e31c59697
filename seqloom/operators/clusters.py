"""Clusters of similar sequences in linear work, and search against their representatives.

Every sequence sends a fixed number of its k-mers, those with the smallest hashes.
The longest sequence that sends a k-mer is that k-mer's centre; only (centre,
member) pairs are looked at, so there are never more pairs than k-mers sent, however
many copies a sequence has. A pair with VOTES k-mers on one diagonal is aligned in the
overlap on its most frequent diagonal, by an edit distance whose band is as wide as the identity allows:

    coverage   overlap / length of the member     at least `coverage` per cent
    identity   1 - edit distance / overlap        at least `identity` per cent

Links become clusters by a greedy set cover: sequences in falling number of linked
members (then length, then id) become representatives unless one before them took
them; a member goes to the first representative that it is linked to. Every round
decides all sequences whose centres are decided.

Searches meet the targets in the same way: a query's smallest-hash k-mers, each with
the longest target that has it anywhere.

Ids are whole numbers without repeats; sequences are of A, C, G, U. One shorter than k
letters, and a null, is a cluster of its own. Rows of one k-mer are dealt by (k-mer,
salt) when they look for its centre, so a k-mer that a third of all sequences send is
no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .homology import checkpointed

K, SENT = 14, 40
#: Shared k-mers on one diagonal that a pair must have to be aligned: one is often a matter of a common word.
VOTES = 2
#: hash of a k-mer, as a base-4 number: (code * FACTOR + 11) % PRIME.
FACTOR, PRIME = 48271, 2147483647
SALTS = 32


def first_kmers(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-mers of a sequence as base-4 numbers, and where each is first."""
    digit = np.zeros(256, np.int64)
    digit[np.frombuffer(b"ACGU", np.uint8)] = range(4)
    x = digit[np.frombuffer(seq.encode(), np.uint8)]
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code * 4 + x[i : i + n]
    return np.unique(code, return_index=True)


def seeds(rows: DataFrame, k: int = K, sent: int | None = SENT) -> DataFrame:
    """id, length, code, pos of the `sent` smallest-hash k-mers (all of them if None) of rows with id, seq."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[np.ndarray, ...]] = []
            for ident, seq in zip(frame["id"].to_numpy(), frame["seq"]):
                code, pos = first_kmers(seq or "", k)
                if sent is not None and len(code) > sent:
                    least = np.lexsort((code, (code * FACTOR + 11) % PRIME))[:sent]
                    code, pos = code[least], pos[least]
                out.append((np.full(len(code), ident), np.full(len(code), len(seq or "")), code, pos))
            yield pd.DataFrame(dict(zip(["id", "length", "code", "pos"], map(np.concatenate, zip(*out))))) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "length", "code", "pos")})

    return rows.select("id", "seq").mapInPandas(run, "id long, length long, code long, pos long")


def _centres(members: DataFrame, among: DataFrame) -> DataFrame:
    """member, centre, diagonal, votes: the most frequent diagonal of each member with each centre of its k-mers."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    # the longest sequence with the k-mer, of these the one with the smallest id
    tops = among.groupBy("code").agg(F.max(F.struct("length", (-F.col("id")).alias("less"), "pos")).alias("top"))
    # the k-mers that a salt's members send, each once, ask for the centre in their place
    asked = salted.select("code", "salt").distinct().join(tops, "code")
    met = salted.join(asked, ["code", "salt"]).select(F.col("id").alias("member"), (-F.col("top.less")).alias("centre"), (F.col("top.pos") - F.col("pos")).alias("diagonal"))
    votes = met.groupBy("member", "centre", "diagonal").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.col("diagonal")).alias("less"))).alias("best")
    return votes.where(F.col("votes") >= VOTES).groupBy("member", "centre").agg(best).select("member", "centre", (-F.col("best.less")).alias("diagonal"), F.col("best.votes").alias("votes"))


def _aligned(pairs: DataFrame, members: DataFrame, centres: DataFrame, identity: int, coverage: int) -> DataFrame:
    """pairs that hold, with identity, coverage and both lengths."""
    m = members.select(F.col("id").alias("member"), F.col("seq").alias("a"), F.length("seq").cast("long").alias("member_length"))
    c = centres.select(F.col("id").alias("centre"), F.col("seq").alias("b"), F.length("seq").cast("long").alias("centre_length"))
    begin = F.greatest(F.lit(0), -F.col("diagonal"))
    overlap = F.least("member_length", F.col("centre_length") - F.col("diagonal")) - F.greatest(F.lit(0), -F.col("diagonal"))
    both = pairs.join(m, "member").join(c, "centre").withColumn("begin", begin).withColumn("overlap", overlap)
    both = both.where(F.col("overlap") * 100 >= F.col("member_length") * coverage)
    # few bytes, much work: dealt to all tasks whatever the sizes say
    both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "member", "centre")
    distance = F.expr(
        f"levenshtein(substr(a, int(begin + 1), int(overlap)), substr(b, int(begin + diagonal + 1), int(overlap)), int(overlap * {100 - identity} div 100))"
    )
    held = both.withColumn("distance", distance).where("distance >= 0")
    return held.select(
        "member", "centre", "member_length", "centre_length", (1 - F.col("distance") / F.col("overlap")).alias("identity"), (F.col("overlap") / F.col("member_length")).alias("coverage")
    )


def linear_links(rows: DataFrame, identity: int = 80, coverage: int = 80, k: int = K, sent: int = SENT) -> DataFrame:
    """member, centre, lengths, identity, coverage of the aligned (centre, member) pairs of rows with id, seq."""
    each = checkpointed(seeds(rows, k, sent))
    pairs = _centres(each, each).where("member <> centre")
    return _aligned(pairs, rows, rows, identity, coverage)


def covered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, representative for each row of nodes (column id), by greedy set cover of the links."""
    size = links.groupBy("centre").agg(F.count("*").alias("n"))
    own = links.join(size.withColumnRenamed("n", "n_centre"), "centre").join(size.select(F.col("centre").alias("member"), F.col("n").alias("n_member")), "member", "left")
    first = F.struct(F.col("n_centre").alias("n"), F.col("centre_length").alias("length"), (-F.col("centre")).alias("less"))
    then = F.struct(F.coalesce("n_member", F.lit(0).cast("long")).alias("n"), F.col("member_length").alias("length"), (-F.col("member")).alias("less"))
    # a centre that comes after its member is of no use to it
    open_ = checkpointed(own.where(first > then).select("member", "centre", first.alias("place")))
    decided = checkpointed(nodes.select("id").join(open_.select(F.col("member").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("representative")))
    while open_.limit(1).count():
        known = decided.select(F.col("id").alias("centre"), "representative")
        seen = open_.join(known, "centre", "left")
        best = F.max(F.when(F.col("representative") == F.col("centre"), F.col("place"))).alias("best")
        state = seen.groupBy("member").agg(F.count_if(F.col("representative").isNull()).alias("waiting"), best)
        new = checkpointed(state.where("waiting = 0").select(F.col("member").alias("id"), F.coalesce(-F.col("best.less"), "member").alias("representative")))
        decided = decided.unionByName(new)
        open_ = checkpointed(open_.join(new.select(F.col("id").alias("member")), "member", "left_anti"))
    return decided


def linear_clusters(rows: DataFrame, identity: int = 80, coverage: int = 80, k: int = K, sent: int = SENT) -> DataFrame:
    """id, representative, identity, coverage for each of rows with id, seq; a representative has 1.0 of itself."""
    rows = checkpointed(rows.select("id", "seq"))
    links = checkpointed(linear_links(rows, identity, coverage, k, sent))
    found = covered(rows, links)
    how = links.select(F.col("member").alias("id"), F.col("centre").alias("representative"), "identity", "coverage")
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    return found.join(how, ["id", "representative"], "left").select("id", "representative", one("identity"), one("coverage"))


def search(queries: DataFrame, targets: DataFrame, identity: int = 80, coverage: int = 80, k: int = K, sent: int = SENT) -> DataFrame:
    """query, target, identity, coverage: the best hit of each query that has one, by identity, coverage and the smaller target.

    Both have id, seq; the coverage is the query's.
    """
    queries, targets = checkpointed(queries.select("id", "seq")), checkpointed(targets.select("id", "seq"))
    pairs = _centres(seeds(queries, k, sent), seeds(targets, k, None))
    held = _aligned(pairs, queries, targets, identity, coverage)
    best = F.max(F.struct("identity", "coverage", (-F.col("centre")).alias("less"))).alias("best")
    return held.groupBy(F.col("member").alias("query")).agg(best).select("query", (-F.col("best.less")).alias("target"), "best.identity", "best.coverage")
