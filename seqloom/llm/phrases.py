"""Phrase collocation mining by suffix-sigma.

A suffix is the words from one word to the end of its piece, cut after max_n
words. Each batch writes its suffixes with how often it saw them, keyed
`lang w1 w2 ... `: every word ends in a space, so all keys that share their
first words are neighbours in any byte order. The keys are dealt to ranges
and sorted in falling byte order, by language and first word before all else; a
word or phrase that a third of all suffixes begin with is so spread over as many
partitions as its suffixes fill. The ranges come from the suffixes of a sample
of the documents; they decide where a suffix is counted, never whether. One pass over a partition keeps one stack with
an open prefix for each length, 0 (the language alone) to max_n; a row whose
common prefix with the row before is shorter closes the longer ones, and a
closed prefix with too few occurrences is forgotten at once. Only the first and
the last prefix of each length can go on in another partition; these leave with
whatever count they have, and counts are added up over partitions.

The frequent phrases that remain are joined with the counts of their parts and
with the longer phrases that hold them, in SQL with exact decimals.

Null text counts as empty, null lang as `und`; neither needs an id, and rows that
repeat each other all count. Texts of any length are read whole, empty ones have
no words. Ties in score and count go by the bytes of the phrase. An empty table
gives no rows. Other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, checkpointed, partitions, sliced, text_of

SUFFIXES = "part int, key binary, n bigint"
PREFIXES = "lang string, words int, phrase string, n bigint"

SPACE, BREAK = 0x20, 0x0A
#: Share of the documents whose suffixes set the ranges, and the bytes of a key that place it. Both bear on balance only.
SAMPLE, EDGE = 0.01, 40
#: A-Z in lower case, \t as space, the characters that end a piece as \n.
FOLD = bytes(
    BREAK if c in b".,;:!?\n\x0b\x0c\r" else SPACE if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)


def suffixes(joined: bytes, max_n: int, head: bytes = b"") -> pa.Array:
    """The suffix at every word of texts that are joined by \\n: head, then each word followed by one space."""
    a = np.frombuffer(joined.translate(FOLD) + b"\n", np.uint8)
    inside = (a != SPACE) & (a != BREAK)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    piece = np.cumsum(a == BREAK, dtype=np.int32)[starts]
    # words with the one byte behind them
    text = np.where(inside, a, np.uint8(SPACE))[inside | before]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts + 1, out=at[1:])
    stop = np.minimum(np.arange(len(starts)) + max_n, np.searchsorted(piece, piece, side="right"))
    # they overlap, so their bytes are copied; those before a suffix make room for the head
    sizes = at[stop] - at[:-1] + np.int32(len(head))
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    take = np.repeat(at[:-1] - offsets[:-1], sizes)
    take += np.arange(offsets[-1], dtype=np.int32)
    data = np.concatenate([np.frombuffer(head, np.uint8), text])[take]
    for k, c in enumerate(head):
        data[offsets[:-1] + k] = c
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _count_suffixes(max_n: int, bounds: list[bytes]):
    """lang, text -> the suffixes of each slice with their counts, and the range between the bounds that each falls in."""
    edges = np.array(bounds, f"S{EDGE}")

    def run(batches):
        for batch in sliced(batches, 1):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pa.array(codes == code)).to_pylist()
                found = suffixes("\n".join(texts).encode(), max_n, quote(lang, safe="").encode() + b" ").value_counts()
                keys, counts = found.field("values"), found.field("counts")
                ranges = np.zeros(len(keys), np.int32)
                if len(edges) and len(keys):
                    fronts = np.array(pc.binary_slice(keys, 0, EDGE).to_pylist(), f"S{EDGE}")
                    ranges = np.searchsorted(edges, fronts, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ranges), keys, counts.cast(pa.int64())], ["part", "key", "n"])

    return run


def _common_words(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each key, words at its front that the key before has too), all of whole words."""
    sizes = np.diff(offsets)
    spaces = np.zeros(len(a) + 1, np.int64)
    np.cumsum(a == SPACE, out=spaces[1:])
    words = spaces[offsets[1:]] - spaces[offsets[:-1]]
    least = np.minimum(sizes[1:], sizes[:-1])
    at = np.zeros(len(least) + 1, np.int64)
    np.cumsum(least, out=at[1:])
    ramp = np.arange(at[-1]) - np.repeat(at[:-1], least)
    other = np.flatnonzero(a[np.repeat(offsets[1:-1], least) + ramp] != a[np.repeat(offsets[:-2], least) + ramp])
    other = np.append(other, at[-1])
    same = np.minimum(other[np.searchsorted(other, at[:-1])] - at[:-1], least)
    common = np.zeros(len(sizes), np.int64)
    common[1:] = spaces[offsets[1:-1] + same] - spaces[offsets[1:-1]]
    return words, common


def _count_prefixes(max_n: int, min_count: int):
    """Sorted suffixes of a partition -> prefixes with enough occurrences, and the end prefixes with any number."""

    def run(batches):
        depths = range(max_n + 1)
        top = None  # the last key seen; its first d + 1 words are the open prefix of depth d
        counts, at_front = [0] * len(depths), [True] * len(depths)  # of the open prefixes

        def prefixes(a, offsets, rows, depth, n):
            """The first words of the keys at rows, as output."""
            texts = []
            for r in rows.tolist():
                head, *words = a[offsets[r] : offsets[r + 1]].tobytes().split(b" ")[: depth + 1]
                texts.append((unquote(head.decode()), depth, b" ".join(words).decode(), 0))
            lang, words, phrase, _ = zip(*texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())],
                ["lang", "words", "phrase", "n"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0), batch.column(1).to_numpy()
            if top is not None:  # once more in front, for what it shares with the first key
                key, n = pa.concat_arrays([pa.array([top], pa.binary()), key]), np.concatenate([[0], n])
            raw = np.frombuffer(key.buffers()[1], np.int32, len(key) + 1, key.offset * 4).astype(np.int64)
            a, offsets = np.frombuffer(key.buffers()[2], np.uint8)[raw[0] : raw[-1]], raw - raw[0]
            words, common = _common_words(a, offsets)
            for depth in depths:
                has = words > depth
                starts = np.flatnonzero(has & (common <= depth))
                if not len(starts):
                    continue
                sums = np.add.reduceat(np.where(has, n, 0), starts)
                front = np.zeros(len(starts), bool)
                if starts[0] == 0:  # what was open, or what the partition begins with
                    sums[0] += counts[depth]
                    front[0] = at_front[depth]
                done = np.ones(len(starts), bool)
                if has[-1]:
                    done[-1], counts[depth], at_front[depth] = False, int(sums[-1]), bool(front[-1])
                else:
                    counts[depth], at_front[depth] = 0, False
                out = done & (front | (sums >= min_count) | (depth == 0))
                if out.any():
                    yield prefixes(a, offsets, starts[out], depth, sums[out])
            top = key[-1].as_py()
        if top is not None:
            a, offsets = np.frombuffer(top, np.uint8), np.array([0, len(top)])
            for depth in range(top.count(b" ")):
                yield prefixes(a, offsets, np.array([0]), depth, np.array([counts[depth]]))

    return run


def _bounds(sample: DataFrame, n: int) -> list[bytes]:
    """The least keys, EDGE bytes of each, of n ranges of about equal size in a sample; they stay the same if a task is run again."""
    ranged = sample.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("id")).agg(F.min(F.substring("key", 1, EDGE)).alias("least"))
    return sorted({bytes(r.least) for r in ranged.select("least").collect()})[1:][: n - 1]


def frequent_phrases(docs: DataFrame, max_n: int = 4, min_count: int = 30) -> DataFrame:
    """lang, words, phrase, n: phrases of 1 to max_n words that occur min_count times in their language; words 0: all its words."""
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    n = partitions(docs.sparkSession)
    bounds = _bounds(rows.sample(SAMPLE, 1).mapInArrow(_count_suffixes(max_n, []), SUFFIXES), n)
    counted = rows.mapInArrow(_count_suffixes(max_n, bounds), SUFFIXES)
    dealt = counted.repartitionById(n, "part").select("key", "n").sortWithinPartitions(F.col("key").desc())
    parts = dealt.mapInArrow(_count_prefixes(max_n, min_count), PREFIXES)
    total = parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return checkpointed(total.where((F.col("n") >= min_count) | (F.col("words") == 0)))


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is scored at its weakest cut, floor(2000000 a / (l + r)), the first of these. One that lies inside a
    longer phrase with at least cover per cent of its occurrences is left out. top phrases a language are returned.
    """
    counts = frequent_phrases(docs, max_n, min_count)
    parts = counts.where("words > 0").select("lang", "phrase", "n")
    long = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def some(begin, size):
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", some(F.lit(1), F.col("cut")).alias("first"), some(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    first = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    weakest = (
        cuts.join(first, ["lang", "first"])
        .join(rest, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("at"))
    )
    holds = (
        long.where("words > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .groupBy("lang", some(F.col("begin"), F.col("size")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = weakest.join(holds, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # the best of each of a language's parts first, so that no task sees a whole language
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
