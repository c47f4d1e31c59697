"""Lossless tokenizers of canonical sequences.

Fixed k-mer, overlapping k-mer and single-letter tokens, and greedy longest
match over a vocabulary, are Spark expressions. Byte-pair encoding merges step
by step: operators.bpe fits it on all rows of a table, fit_bpe on a small weighted
one in one process; an Arrow function that closes over the merge list applies it.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .sequence import ALPHABET, kmers


def base4(token: Column) -> Column:
    """The token read as a number in base 4, A first."""
    return F.conv(F.translate(token, ALPHABET, "0123"), 4, 10).cast("int")


def nuc_tokens(canon: Column) -> Column:
    return F.when(F.length(canon) > 0, F.split(canon, "")).otherwise(F.array().cast("array<string>"))


def overlap_tokens(canon: Column, k: int) -> Column:
    """k-mers at stride 1; an input shorter than k is filled up with A, an empty one gives none."""
    filled = F.when(F.length(canon) > 0, F.rpad(canon, F.greatest(F.length(canon), F.lit(k)), "A")).otherwise("")
    return kmers(filled, k)


def block_tokens(canon: Column, k: int) -> Column:
    """k-mers at stride k, then a shorter tail."""
    return F.regexp_extract_all(canon, F.lit(f"[ACGU]{{1,{k}}}"), F.lit(0))


def block_id(token: Column, k: int) -> Column:
    """Ids: full k-mers first, then tails by length and letters."""
    n = F.length(token)
    below = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, j: s + F.when(j > 0, F.pow(F.lit(4), j)).otherwise(0).cast("int"))
    return F.when(n == k, base4(token)).otherwise(F.lit(4**k) + below + base4(token))


def token_lengths(tokens: Column, overlap_k: int | None = None) -> Column:
    """Letters that each token accounts for; of overlapping k-mers the first k, the others 1."""
    if overlap_k is None:
        return F.transform(tokens, lambda t: F.length(t))
    return F.transform(tokens, lambda t, i: F.when(i == 0, overlap_k).otherwise(1))


def next_token_window(ids: Column, lengths: Column, context: int) -> Column:
    """Context and target of next-token prediction, the last `context` targets, with the letters of each target."""
    n = F.least(F.size(ids) - 1, F.lit(context))
    keep = lambda c, later: F.slice(c, F.size(c) - n + later, n)
    some = F.size(ids) > 1
    none = F.array().cast("array<int>")
    return F.struct(
        F.when(some, keep(ids, 0)).otherwise(none).alias("context"),
        F.when(some, keep(ids, 1)).otherwise(none).alias("target"),
        F.when(some, keep(lengths, 1)).otherwise(none).alias("weight"),
    )


def unigram_vocabulary(seqs: DataFrame, size: int, longest: int = 6) -> DataFrame:
    """token, n of the most frequent k-mers (k from 2 to longest) after the four letters; ties by token.

    seqs: column canonical_sequence. size counts the letters too. A batch sends on its counts, which are at
    most 4^2 + ... + 4^longest rows, and no k-mers.
    """

    def count(batches):
        digit = np.full(256, -1, np.int64)
        digit[np.frombuffer(ALPHABET.encode(), np.uint8)] = range(4)
        for batch in batches:
            # sequences end with a newline, which is no letter: no k-mer crosses it
            text = "".join(f"{s}\n" for s in batch.column(0).to_pylist() if s)
            x = digit[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
            tokens, counts = [], []
            for k in range(2, longest + 1):
                n = len(x) - k + 1
                if n < 1:
                    continue
                code, good = np.zeros(n, np.int64), np.ones(n, bool)
                for i in range(k):
                    code = code * 4 + x[i : i + n]
                    good &= x[i : i + n] >= 0
                found = np.bincount(code[good], minlength=4**k)
                some = np.flatnonzero(found)
                letters = (some[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3
                tokens += ["".join(ALPHABET[y] for y in row) for row in letters.tolist()]
                counts += found[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"])

    counts = seqs.select("canonical_sequence").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(size - len(ALPHABET))


def greedy_tokens(canon: Column, vocabulary: list[str]) -> Column:
    """Greedy longest match, a character that starts no token being passed over.

    One look-up for each length at each token's start, in Arrow batches: a pattern of alternatives would try
    them all at every letter.
    """
    known = {*vocabulary, *ALPHABET}
    lengths = sorted({len(t) for t in known}, reverse=True)

    def one(s: str) -> list[str]:
        out, i = [], 0
        while i < len(s):
            for n in lengths:
                token = s[i : i + n]
                if token in known:
                    out.append(token)
                    break
            i += len(token) if token in known else 1
        return out

    @pandas_udf("array<string>")
    def run(seqs: pd.Series) -> pd.Series:
        return seqs.map(one)

    return run(canon)


def fit_bpe(words: Counter, merges: int) -> list[tuple[str, str]]:
    """Merges in order: the most frequent pair each time, of equals the greatest.

    words: distinct sequences with their weights, a table small enough for one process.
    """
    parts = [list(w) for w in words]
    weight = list(words.values())
    count: Counter = Counter()
    where: defaultdict[tuple, set] = defaultdict(set)
    for k, p in enumerate(parts):
        for pair in zip(p, p[1:]):
            count[pair] += weight[k]
            where[pair].add(k)
    order = []
    while len(order) < merges:
        alive = [(n, pair) for pair, n in count.items() if n > 0]
        if not alive:
            break
        pair = max(alive)[1]
        order.append(pair)
        for k in where.pop(pair):
            old = parts[k]
            for x in zip(old, old[1:]):
                count[x] -= weight[k]
            new, i = [], 0
            while i < len(old):
                double = i + 1 < len(old) and (old[i], old[i + 1]) == pair
                new.append(old[i] + old[i + 1] if double else old[i])
                i += 1 + double
            parts[k] = new
            for x in zip(new, new[1:]):
                count[x] += weight[k]
                where[x].add(k)
        count.pop(pair, None)
    return order


def bpe_encode(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Lowest-ranked pair first, of equals the leftmost."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < len(parts) and (r := rank.get((parts[i], parts[j]))) is not None:
            heapq.heappush(heap, (r, i, j, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if parts[i] == a and after[i] == j and j < len(parts) and parts[j] == b:
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
    return [p for p in parts if p is not None]


def bpe_tokens(merges: list[tuple[str, str]]):
    """A column function from canonical sequence to its tokens."""
    rank = {pair: k for k, pair in enumerate(merges)}

    @pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: bpe_encode(w, rank))

    return run


def round_trip(tokens: Column, canon: Column) -> Column:
    return F.array_join(tokens, "") == canon


def spec(name: str, vocabulary: int, lossless: bool, **parameters) -> Column:
    """A tokenizer's record."""
    return F.struct(
        F.lit(name).alias("name"), F.lit(vocabulary).alias("vocab_size"), F.lit(lossless).alias("lossless"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())] or [F.lit(0).alias("none")])).alias("parameters"),
    )


def kmer_of(number: Column, k: int) -> Column:
    """The k-mer of a number in base 4, A first."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", ALPHABET)


def overlap_decode(ids: Column, k: int) -> Column:
    """The sequence of overlapping k-mers: the first one, then the last letter of each."""
    letters = F.transform(F.slice(ids, 2, F.greatest(F.lit(0), F.size(ids) - 1)), lambda x: F.substr(F.lit(ALPHABET), (x % 4 + 1).cast("int"), F.lit(1)))
    return F.when(F.size(ids) > 0, F.concat(kmer_of(F.get(ids, F.lit(0)), k), F.array_join(letters, ""))).otherwise("")


def block_token(number: Column, k: int) -> Column:
    """The token of a block id: full k-mers first, then tails by length and letters."""
    out, base = F.when(number < 4**k, kmer_of(number, k)), 4**k
    for n in range(1, k):
        out = out.when(number < base + 4**n, kmer_of(number - base, n))
        base += 4**n
    return out


def block_decode(ids: Column, k: int) -> Column:
    return F.array_join(F.transform(ids, lambda x: block_token(x, k)), "")


def listed_ids(tokens: Column, vocabulary: list[str]) -> Column:
    """Ids of tokens of a listed vocabulary (of fixed size), by place in the list."""
    table = F.create_map(*[x for k, t in enumerate(vocabulary) for x in (F.lit(t), F.lit(k))])
    return F.transform(tokens, lambda t: table[t])


def listed_decode(ids: Column, vocabulary: list[str]) -> Column:
    table = F.array(*map(F.lit, vocabulary))
    return F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")


def tokenizer(kind: str, k: int | None = None, vocabulary: list[str] | None = None, merges: list[tuple[str, str]] | None = None):
    """(tokens of a column, spec) of an arm's tokenizer; vocabulary and merges come from a fit on training rows."""
    if kind == "overlap_mer":
        return (lambda c: overlap_tokens(c, k)), spec(kind, 4**k, True, k=k)
    if kind == "nonoverlap_mer":
        return (lambda c: block_tokens(c, k)), spec(kind, sum(4**n for n in range(1, k + 1)), True, k=k)
    if kind == "Unigram":
        return (lambda c: greedy_tokens(c, vocabulary)), spec(kind, len({*vocabulary, *ALPHABET}), True)
    if kind == "BPE":
        return bpe_tokens(merges), spec(kind, len(ALPHABET) + len(merges), True, merges=len(merges))
    return nuc_tokens, spec("NUC", len(ALPHABET), True)  # segment arms see single letters
