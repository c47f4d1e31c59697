"""Sum-of-squares packing of tokenised documents into fixed-capacity sequences.

Tokenising keeps the library's ids exactly. The library splits a text at white
space and at letter/number/punctuation borders before it merges, so the ids of
a text are the concatenation of the ids of its pre-tokens; each worker keeps a
bounded table from pre-token to the little-endian bytes of its ids and asks the
library only for the ones it has not seen.

Packing works on lengths alone, and the text is never shuffled. Pieces of full
capacity are a sequence each and are numbered where they are. Of the others each
document has one at the most; they are dealt by a hash into shards of a bounded
number of documents, and each shard is packed by itself. Within a shard pieces go in falling length; each is put where
the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of open
bins with g free places (ties: the smallest gap; an open bin before a new one).
The rule keeps open bins of many gaps, so a few too many are left at the end. They
are repaired: the pieces of the least filled bins, of twice as many each time, are
packed anew by best fit until no bin is left over, all bins of the shard being the
last try. What a shard still wastes is then in its emptiest bin; the pieces of these
bins are dealt to shards again, and so on until one shard has them all.

Null text counts as empty and gives one piece of the end id alone; a null id is
carried through; repeated rows are packed each on its own; texts of any length
are tokenised whole. An empty table gives no rows. Other columns of docs may
have any names.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced, text_of

CAPACITY = 4096
#: Documents, and so pieces at the most, of one packing shard, about; a row of a shard is 40 bytes.
SHARD_DOCS = 60_000
#: Pre-tokens that a worker remembers.
TABLE_LIMIT = 400_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class PretokenTable:
    """ids of whole texts under a lower-casing word BPE, as bytes of little-endian unsigned 32-bit numbers.

    Texts made of characters below U+0250 (but the three whose lower case lies
    outside that range) are split here by the tokenizer's own rules; any other
    text, and any text that may hold a special string, is cut at ASCII white
    space only and the library does the rest for each chunk.
    """

    ODD = {0x130, 0x23A, 0x23E}
    #: ASCII white space other than the space; the library treats all of these alike.
    TO_SPACE = {ord(c): " " for c in "\t\n\r\x0b\x0c"}

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        plain = [chr(c) for c in range(0x250) if c not in self.ODD]
        of = lambda kind: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)
        letters, numbers = of("L"), of("N")
        white = "".join(re.escape(c) for c in plain if c in "\t\n\x0b\x0c\r \x85\xa0")
        self.plain = re.compile("[" + "".join(map(re.escape, plain)) + "]*")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order.
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in own]
        self.letters = [chr(b) if b in own else chr(0x100 + others.index(b)) for b in range(256)]

    def _pretoken(self, word: str) -> bytes:
        if len(self.pretokens) >= self.limit:
            self.pretokens.clear()
        mapped = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())
        out = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        self.pretokens[word] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        if len(self.chunks) >= self.limit // 4:
            self.chunks.clear()
        out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self.chunks[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.plain.fullmatch(text) and not self.special.search(text):
            get, words, miss = self.pretokens.get, self.split(text.lower()), self._pretoken
        else:
            get, words, miss = self.chunks.get, text.translate(self.TO_SPACE).split(" "), self._chunk
        return b"".join([get(w) or miss(w) for w in words if w])


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, cut only where it is longer than capacity."""
    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
        part = ids[4 * start : 4 * (start + capacity)]
        yield piece, start, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every row of docs; each document's ids are followed by end_id, so none is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table = PretokenTable(tokenizer)
        for batch in sliced(batches, 1):
            ids, out = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1)):
                out += [(doc, *x) for x in cut(table.encode(text.as_py()) + end, capacity)]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length (1 to capacity), placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:capacity])
        best, gap = (2 * count[capacity - s] + 1 if s < capacity else 0), capacity
        if len(gaps):
            here = count[gaps + s]
            change = 2 * (count[gaps] - here + 1)
            if gaps[0] == 0:
                change[0] = 1 - 2 * here[0]  # the bin closes
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(gaps[k]) + s
        if gap == capacity:
            bins[i], n = n, n + 1
        else:
            bins[i], offsets[i] = stacks[gap].pop(), capacity - gap
            count[gap] -= 1
        if gap > s:
            stacks[gap - s].append(int(bins[i]))
            count[gap - s] += 1
    return bins, offsets


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, placed in the order given into the smallest gap that holds it."""
    gaps, stacks, bins = 0, [[] for _ in range(capacity + 1)], np.empty(len(lengths), np.int64)  # gaps: a bit for each gap of an open bin
    n = 0
    for i, s in enumerate(lengths.tolist()):
        fitting = gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = stacks[gap].pop()
            if not stacks[gap]:
                gaps ^= 1 << gap
        else:
            gap, b, n = capacity, n, n + 1
        bins[i] = b
        if gap > s:
            stacks[gap - s].append(b)
            gaps |= 1 << gap - s
    return bins


def repaired(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """bins (numbers from 0) with the least filled ones packed anew where that saves some; lengths are falling."""
    n = int(bins.max()) + 1 if len(bins) else 0
    fewest, pool = -(-int(lengths.sum()) // capacity), 4
    while n > fewest and pool < 2 * n:
        used = np.bincount(bins, weights=lengths, minlength=n)
        low = np.zeros(n, bool)
        low[np.argsort(used, kind="stable")[:pool]] = True
        of_low = low[bins]
        again = best_fit(lengths[of_low], capacity)
        if again.max() + 1 < low.sum():
            number = np.cumsum(~low) - 1
            bins = np.where(of_low, 0, number[bins])
            bins[of_low] = again + int((~low).sum())
            n = int(bins.max()) + 1
        pool *= 2
    return bins


def offsets_in(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Place of each length in its bin, one after another in the order given."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    out = np.empty(len(lengths), np.int64)
    out[order] = begins - np.repeat(begins[first], np.diff(np.append(first, len(order))))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """pieces with sequence_id and offset: a gapless layout of sequences of at most capacity tokens.

    sequence_id is the round times 2^52, the shard times 2^32 and the bin's number in it added up; pieces of
    full capacity count down from -1.
    """
    pieces = checkpointed(pieces)  # 40 bytes a row: the texts are tokenised once for both kinds
    whole, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)

    def packer(turn: int, shards: int):
        def run(key, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            lengths = group["length"].to_numpy()
            bins = repaired(lengths, sum_of_squares(lengths, capacity)[0], capacity)
            group["offset"] = offsets_in(lengths, bins)
            group["sequence_id"] = (turn << 52) + (key[0] << 32) + bins
            emptiest = np.bincount(bins, weights=lengths).argmin()
            group["open"] = (bins == emptiest) & (shards > 1)
            return group.drop(columns="shard")

        return run

    out, turn = whole.select("*", F.lit(0).cast("long").alias("offset"), (-1 - F.monotonically_increasing_id()).alias("sequence_id")), 0
    while True:
        shards = max(1, -(-rest.count() // shard_docs))
        shard = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(turn)), F.lit(shards))
        packed = rest.withColumn("shard", shard).groupBy("shard").applyInPandas(packer(turn, shards), f"{PIECES}, offset bigint, sequence_id bigint, open boolean")
        if shards == 1:
            return out.unionByName(packed.drop("open"))
        packed, turn, before = checkpointed(packed), turn + 1, shards
        out = out.unionByName(packed.where("not open").drop("open"))
        rest = packed.where("open").drop("open", "offset", "sequence_id")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, offset, sequence_id."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity, shard_docs)
