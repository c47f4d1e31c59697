"""Generation and continuation metrics, contamination."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import is_primary, kmer_recovery, nucleotide_accuracy
from .nearest import nearest_sequences


def continuation_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means over pairs (pred, ref) of edit distance, accuracy and 5-mer recovery."""
    out = pairs.select(*keys, F.levenshtein("pred", "ref").alias("e"), nucleotide_accuracy(F.col("pred"), F.col("ref")).alias("a"), kmer_recovery(F.col("pred"), F.col("ref")).alias("k"))
    return out.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("e").alias("mean_edit_distance"), F.avg("a").alias("mean_accuracy"), F.avg("k").alias("mean_kmer_recovery")
    )


def nearest_identity_all(rows: DataFrame, train: DataFrame, key: str = "ord") -> DataFrame:
    """key, best: the largest positional identity with any of all training sequences, for a stated set of queries."""
    queries = rows.select(F.col(key).alias("id"), F.col("canonical_sequence").alias("item"))
    others = train.select(F.xxhash64("canonical_sequence").alias("id"), F.col("canonical_sequence").alias("item"))  # which one is not asked
    return nearest_sequences(queries, others).select(F.col("query").alias(key), F.col("value").alias("best"))


def generation_stats(generated: DataFrame, train: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """total, valid, invalid, unique, validity_rate, uniqueness, train_copies, and how many reach identity 1, 0.9, 0.8.

    generated: ord, sequence; train: canonical_sequence; best: ord, best.
    """
    rows = generated.withColumn("ok", is_primary(F.col("sequence")) & (F.length("sequence") > 0))
    known = train.select(F.col("canonical_sequence").alias("sequence")).distinct().withColumn("copied", F.lit(True))
    rows = rows.join(known, "sequence", "left")
    if best is not None:
        rows = rows.join(best, "ord", "left")
    else:
        rows = rows.withColumn("best", F.lit(None).cast("double"))
    reach = [F.count_if(F.col("ok") & (F.col("best") >= b)).alias(n) for b, n in ((1.0, "id_100"), (0.9, "id_90"), (0.8, "id_80"))]
    out = rows.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"),
        F.countDistinct(F.when(F.col("ok"), F.col("sequence"))).alias("unique_valid"),
        F.count_if(F.col("ok") & F.coalesce("copied", F.lit(False))).alias("train_copies"), *reach,
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("validity_rate", rate("valid", "total")).withColumn("uniqueness", rate("unique_valid", "total"))


#: Bytes of items that a task may hold as one pattern set, some 50 bytes of automaton for each.
MOST_PATTERN_BYTES = 4 << 20


def contained_items(docs: DataFrame, items: DataFrame, words: int = 8, most: int = MOST_PATTERN_BYTES) -> DataFrame:
    """doc_id, item_id where a document's text contains an item's whole text; null texts neither contain nor are contained.

    Items of at most `most` bytes in all are one pattern set, and each text is read once for all of them. Beyond that
    pairs are found by the hash of a run of `words` words (the item's second to the next ones), so only ids and hashes
    meet, and their texts are then brought back and compared; items of too few words still are pattern sets, one for
    each part of them that keeps to the bound.
    """
    items = items.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= most:
        return _scanned(docs, items)
    split = lambda c: F.split(c, " ")
    items = items.withColumn("w", split(F.col("text")))
    long = items.where(F.size("w") >= words + 2)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.slice("w", i, words)))
    d = docs.select("doc_id", split(F.col("text")).alias("w"))
    each = d.where(F.size("w") >= words).select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    found = each.join(long.select("item_id", F.xxhash64(F.slice("w", 2, words)).alias("run")), "run").select("doc_id", "item_id").distinct()
    met = found.join(long.select("item_id", F.col("text").alias("item")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    out = met.where(F.contains("text", "item")).select("doc_id", "item_id")
    short = items.where(F.size("w") < words + 2).withColumn("size", F.octet_length("text"))
    parts = -(-2 * (short.agg(F.sum("size")).first()[0] or 0) // most)
    for k in range(parts):
        out = out.union(_scanned(docs, short.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)))
    return out.distinct()


def _scanned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same by one automaton of all items, whose size the caller bounds."""
    patterns: dict[str, list[int]] = {}
    everywhere: list[int] = []
    for r in items.collect():
        (patterns.setdefault(r.text, []) if r.text else everywhere).append(r.item_id)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, ids in patterns.items():
            automaton.add_word(text, ids)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                ids = set(everywhere)
                if patterns:
                    for _, more in automaton.iter(text):
                        ids.update(more)
                rows += [k] * len(ids)
                found += ids
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long").distinct()
