"""Token counts under a SentencePiece BPE model by rank-synchronous array merging.

A text is cut into pre-tokens where no merge can cross (before a run of spaces,
and around characters that are part of no longer piece). The distinct pre-tokens
of a batch that are not yet known are laid out as one ragged numpy array of
symbols; in each step every sequence finds its lowest-ranked adjacent pair and
all sequences merge theirs at once, until none has a pair left. The count of a
sequence is the number of surviving symbols, a character outside the vocabulary
counting as its UTF-8 bytes.

All occurrences of a sequence's lowest pair are merged in one step only if no
pair that the merge creates can have the same or a lower rank; where one can
(runs of spaces, whose pieces share one score), only the leftmost is merged, as
the library does. Pre-tokens of LONG symbols and more, rare as they are, go
through the same rule with a heap, as a step of the arrays for each of their
merges would be quadratic; the counts are the same.

Null text counts as empty (0 tokens), a null id is carried through, and rows that
repeat an id or a text are each counted. Texts of any length are counted whole.
An empty table gives no rows. Other columns of docs may have any names.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Pre-tokens whose counts a worker remembers.
TABLE_LIMIT = 600_000
#: Characters of text that are cut up at a time.
SLICE_CHARS = 4_000_000
#: Symbols from which a pre-token is merged alone, with a heap.
LONG = 2_000
NONE = np.iinfo(np.int32).max
SPACE = "▁"


class RankMerger:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [
            i for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        chars = {c for piece in score for c in piece}
        self.symbols = {s: k for k, s in enumerate([*score, *sorted(chars - score.keys())])}
        self.known = np.array([s in score for s in self.symbols])
        pairs = {}
        for piece, value in score.items():
            for k in range(1, len(piece)):
                left, right = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = (ranks[value], self.symbols[piece])
        self.pairs = pairs
        self.base = len(self.symbols) + 1
        keys = np.array([(a + 1) * self.base + b + 1 for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # a guard at the end, so that a search never runs off
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array([r for r, _ in pairs.values()], np.int32)[order], NONE)
        self.made = np.append(np.array([m for _, m in pairs.values()], np.int32)[order], -1)
        # a merged piece is plain if every pair it is part of ranks above the merge that makes it
        rank_of = np.full(len(self.symbols), -1, np.int64)
        for rank, made in pairs.values():
            rank_of[made] = rank
        self.plain = np.ones(len(self.symbols) + 1, bool)
        for (a, b), (rank, _) in pairs.items():
            for x in (a, b):
                if rank <= rank_of[x]:
                    self.plain[x] = False
        self.code = np.full(0x110000, -1, np.int32)
        for s, k in self.symbols.items():
            if len(s) == 1:
                self.code[ord(s)] = k
        long = {c for piece in score if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in long)
        if any(SPACE in piece.lstrip(SPACE) for piece in score):
            self.split = lambda text: [text]
        elif alone:
            self.split = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]").findall
        else:
            self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def pretokens(self, text: str) -> list[str]:
        """The library's text form (a space before, spaces as U+2581), cut where no merge can cross."""
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in self.keys of the pairs; the last place stands for none."""
        want = (left.astype(np.int64) + 1) * self.base + right + 1
        at = np.searchsorted(self.keys, want)
        at[self.keys[at] != want] = len(self.keys) - 1
        return at

    def count(self, words: list[str]) -> list[int]:
        """Surviving symbols of each pre-token (none of them empty)."""
        out = np.zeros(len(words), np.int64)
        short = []
        for k, w in enumerate(words):
            if len(w) < LONG:
                short.append(k)
            else:
                out[k] = self._count_long(w)
        if not short:
            return out.tolist()
        words = [words[k] for k in short]
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.code[points]
        # tokens that a symbol counts for: its bytes unless it is a piece
        weight = np.where((symbols >= 0) & self.known[symbols], 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        of = np.repeat(np.array(short), [len(w) for w in words])  # the word of each symbol
        at = np.full(len(symbols), len(self.keys) - 1)  # the pair of each symbol with the next one
        same = np.flatnonzero((of[:-1] == of[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        at[same] = self._find(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            sizes = np.diff(np.append(starts, len(of)))
            rank = self.rank[at]
            least = np.minimum.reduceat(rank, starts)
            open_ = least < NONE
            if not open_.all():
                closed = np.flatnonzero(~open_)
                out[of[starts[closed]]] = np.add.reduceat(weight, starts)[closed]
                stay = np.repeat(open_, sizes)
                symbols, weight, of, at, rank = symbols[stay], weight[stay], of[stay], at[stay], rank[stay]
                if not len(symbols):
                    break
                sizes, least = sizes[open_], least[open_]
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            made = self.made[at[hit]]
            new_word = np.append(True, of[hit[1:]] != of[hit[:-1]])
            # of touching hits every second one merges; of a piece that is not plain only the word's leftmost
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | new_word[1:])
            run_start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run_start) % 2 == 0
            first = np.maximum.accumulate(np.where(new_word, np.arange(len(hit)), 0))
            take &= self.plain[made[first]] | new_word
            hit, made = hit[take], made[take]
            symbols[hit], weight[hit] = made, 1
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, weight, of, at = symbols[keep], weight[keep], of[keep], at[keep]
            hit = place[hit]
            touched = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            at[touched] = len(self.keys) - 1
            touched = touched[touched < len(symbols) - 1]
            touched = touched[(of[touched] == of[touched + 1]) & (symbols[touched] >= 0) & (symbols[touched + 1] >= 0)]
            at[touched] = self._find(symbols[touched], symbols[touched + 1])
        return out.tolist()

    def _count_long(self, word: str) -> int:
        symbols = [self.symbols.get(c, -1) for c in word]
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (pair := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (pair[0], i, j, symbols[i], symbols[j], pair[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if alive[i] and alive[j] and after[i] == j and symbols[i] == a and symbols[j] == b:
                symbols[i], alive[j], after[i] = made, False, after[j]
                if after[i] < n:
                    before[after[i]] = i
                offer(before[i], i)
                offer(i, after[i])
        return sum(
            1 if symbols[i] >= 0 and self.known[symbols[i]] else len(word[i].encode()) for i in range(n) if alive[i]
        )


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; null text counts as empty (0 tokens)."""

    def run(batches):
        merger, seen = RankMerger(model_file), {}

        def counts(texts: list[str]) -> list[int]:
            cut = [merger.pretokens(t) for t in texts]
            new = [w for w in {w for words in cut for w in words} if w not in seen]
            if len(seen) + len(new) > TABLE_LIMIT:
                seen.clear()
                new = list({w for words in cut for w in words})
            seen.update(zip(new, merger.count(new)))
            get = seen.__getitem__
            return [sum(map(get, words)) for words in cut]

        for batch in batches:
            out, texts, size = [], [], 0
            for text in batch.column(1):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= SLICE_CHARS:
                    out += counts(texts)
                    texts, size = [], 0
            out += counts(texts)
            tokens = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
