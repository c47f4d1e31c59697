"""Language identification by a bit-sliced Bloom filter of n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one
space, and a text's n-grams are all windows of three and of four characters, ends
padded with a space. The n-grams of all learnt documents are counted by language
over the whole corpus, in batches first. A language holds an n-gram if at least
MIN_SHARE of its n-grams are that one, and at least RATIO of the share that it has
in any other language; quotations and wrong labels so stay out, and as shares of
at least MIN_SHARE are at most 1 / MIN_SHARE in number, so is what a language
puts into the filter, however large the corpus.

The filter has one row of language bits for each of SLOTS positions; an n-gram
sets its language's bit in PROBES of them. The AND of its rows are all languages
that hold it, with some false positives, known for each language from the share of
its bits that are set. A text's bits are counted by language, its expected false
positives taken off; the language with most left is the answer, and its n-grams'
share of the text's n-grams the score.

A null text, or one without a letter, is `und` with score 0, as is every text if
nothing is learnt. Null languages are not learnt. Equal counts (to a thousandth) go to the language
with most learnt n-grams, then to the first by name; a text none of whose n-grams
is known gets that language too, with score 0. Rows that repeat each other each
count. Texts of any length are read whole. An empty table gives no rows. Other
columns of docs are left alone, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced

SIZES = (3, 4)
MIN_SHARE = 1e-5
RATIO = 0.25
SLOTS, PROBES = 1 << 21, 3
#: The filter has SLOTS bytes for each eight languages; more than these would not be a bounded broadcast.
MOST_LANGUAGES = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of the texts, one text's after another's, and how many each text has)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = [f" {t.lower()} " if t else "  " for t in texts]
    a = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    a = np.where(letters()[a], a, np.uint32(32))
    # of a run of spaces one stays, the first and the last of a text always being one
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32) | (text[1:] != text[:-1])
    a, text = a[keep].astype(np.uint64), text[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(a) < n:
            continue
        h = np.full(len(a) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ a[k : len(a) - n + 1 + k]) * MIX
            h ^= h >> np.uint64(29)
        one = text[: len(h)] == text[n - 1 :]
        hashes.append(h[one])
        owners.append(text[: len(h)][one])
    hashes, owners = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.bincount(owners, minlength=len(texts))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The positions of n-grams in the filter."""
    second = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * second) % np.uint64(SLOTS)).astype(np.int64) for k in range(PROBES)]


def _count_grams(batches):
    """lang, text -> lang, gram, n of each slice."""
    for batch in sliced(batches, 1, SLICE_BYTES):
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary):
            found, n = np.unique(grams(batch.column(1).filter(pa.array(codes == code)).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )


class Filter:
    """Languages and, for each slot, the bits of those that set it."""

    def __init__(self, languages: list[str]):
        self.languages = languages  # most learnt first
        self.rows = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
        self.wrong = np.zeros(len(languages))

    def bits(self, k: int) -> tuple[np.ndarray, int]:
        return self.rows[k // 8], k % 8

    def add(self, k: int, hashes: np.ndarray) -> None:
        row, bit = self.bits(k)
        for s in slots(hashes):
            row[np.unique(s)] |= np.uint8(1 << bit)

    def close(self) -> None:
        for k in range(len(self.languages)):
            row, bit = self.bits(k)
            self.wrong[k] = float(((row >> bit) & 1).mean()) ** PROBES

    def holders(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each eight languages the bits of those that hold each n-gram."""
        at = slots(hashes)
        out = []
        for row in self.rows:
            mask = row[at[0]]
            for s in at[1:]:
                mask &= row[s]
            out.append(mask)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        known = [bool(t) and bool(letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        hashes, sizes = grams(texts)
        ends = np.cumsum(sizes)
        counts = np.zeros((len(texts), len(self.languages)))
        masks = self.holders(hashes)
        for k in range(len(self.languages)):
            seen = np.zeros(len(hashes) + 1, np.int64)
            np.cumsum((masks[k // 8] >> np.uint8(k % 8)) & 1, out=seen[1:])
            counts[:, k] = seen[ends] - seen[ends - sizes]
        right = np.maximum(0, (counts - sizes[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.999))).round(3)
        best = right.argmax(axis=1)
        score = np.minimum(1, right[np.arange(len(texts)), best] / np.maximum(sizes, 1))
        return [self.languages[b] if yes else "und" for b, yes in zip(best.tolist(), known)], np.where(known, score, 0.0)


def learn(docs: DataFrame, held_out: Column) -> Filter:
    """The filter of the documents that are not held out and have a language."""
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out).select("lang", "text")
    counts = checkpointed(rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = F.create_map(*[F.lit(x) for r in totals for x in (r.lang, 1.0 / r.total)]) if totals else None
    out = Filter([r.lang for r in totals])
    if totals:
        share = counts.select("lang", "gram", (F.col("n") * shares[F.col("lang")]).alias("share")).where(F.col("share") >= MIN_SHARE)
        most = share.groupBy("gram").agg(F.max("share").alias("most"))
        held = checkpointed(share.join(most, "gram").where(F.col("share") >= F.col("most") * RATIO).select("lang", "gram"))
        for k, r in enumerate(totals):  # at most 1 / MIN_SHARE n-grams a language
            found = held.where(F.col("lang") == r.lang).select("gram").toArrow()
            out.add(k, found.column("gram").to_numpy().astype(np.int64).view(np.uint64))
    out.close()
    return out


def is_held_out(docs: DataFrame) -> Column:
    """Every fifth document by the CRC-32 of its id; a null id is learnt from."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learnt from the rows that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, is_held_out(docs)))

    def run(batches):
        for batch in sliced(batches, 2, SLICE_BYTES):
            names, score = model.value.judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), is_held_out(docs).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
