"""Token ids, counts and packing, against the tokenizer libraries and brute force."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from seqloom.llm.packing import PretokenTable, best_fit, offsets_in, pack_documents, repaired, sum_of_squares  # noqa: E402
from seqloom.llm.token_counts import RankMerger, token_counts  # noqa: E402

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\n", "a", "  a  b ", "don't we'LL I'd", "ÉÀ é́ Σίσυφος ΟΔΟΣ", "İstanbul Ⱥ", "日本語 テスト", "a b c\x85d",
    "<|startoftext|>x<|endoftext|> <s></s><unk> <0x0A>", "½ 10²³ x_y-z", "🙂🙂👩‍👩‍👧", "\x00\x01\x1c\x1f", "aaaaaaaaaaaaa" * 30, "a" * 5000,
    " " * 300 + "x", "\t\t\n\n\r\n  \t", "▁▁ ▁a▁", "https://x.y/z?q=%20&r=1", "ﬁ ﬂ ǅ ŉ ß ẞ", "1234567890 3.14", "thethethe" * 40,
]


def texts(n=400):
    rng = random.Random(5)
    alphabet = "  \n\t'.,aAbBeEtThHnNiIoOsS019é Üñ▁'sdmlre-"
    wide = alphabet + "ΣσςЖ日語🙂́ <|>"
    out = ["".join(rng.choices(alphabet if k % 2 else wide, k=rng.randint(0, 120))) for k in range(n)]
    return ODD + out


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    table, library = PretokenTable(WORD, limit=50), Tokenizer.from_file(WORD)
    for t in texts():
        assert np.frombuffer(table.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_counts_equal_the_library():
    import sentencepiece

    library, merger = sentencepiece.SentencePieceProcessor(model_file=PIECE), RankMerger(PIECE)
    for t in texts(1500):
        words = merger.pretokens(t)
        assert sum(merger.count(words)) == len(library.encode(t)), t
        assert sum(map(merger._count_long, words)) == len(library.encode(t)), t


def test_token_counts_operator(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(k, t, 1) for k, t in enumerate(texts(60))] + [(None, None, 2), (7, "w " * 5000, 3), (7, "w " * 5000, 3)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PIECE).collect()
    want = sorted((-1 if d is None else d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.n_tokens for r in got if r.over_limit} == {n for _, _, n in want if n > 4096} != set()
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECE).count() == 0


def test_sum_of_squares_layout_is_valid_and_tight():
    rng = np.random.default_rng(1)
    lengths = np.sort(np.minimum(4096, rng.lognormal(6.5, 1.2, 5000).astype(int) + 1))[::-1]
    bins, offsets = sum_of_squares(lengths, 4096)
    used = np.bincount(bins, weights=lengths)
    assert used.max() <= 4096
    for b in range(0, len(used), 37):
        at = np.sort(offsets[bins == b])
        assert at[0] == 0 and (np.append(at[1:], used[b]) - at == lengths[bins == b][np.argsort(offsets[bins == b])]).all()
    assert len(used) <= -(-lengths.sum() // 4096) * 1.005 + 1


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [(k, t, "x") for k, t in enumerate(texts(80))] + [(900, None, "x"), (901, "wx " * 9000, "x"), (902, "same", "x"), (902, "same", "x")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset string"), WORD).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]})
        assert pieces == [
            (k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))
        ]
    assert len(by_doc[902]) == 2
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(r.length for r in out) // 4096) + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def plain_sum_of_squares(lengths, capacity):
    """Tries each gap for each piece and counts the squares anew."""
    bins, out = [], []
    for s in lengths:
        counts = {}
        for b in bins:
            if b < capacity:
                counts[capacity - b] = counts.get(capacity - b, 0) + 1
        best = None
        for gap in sorted({g for g in counts if g >= s} | {capacity}):
            after = dict(counts)
            if gap < capacity:
                after[gap] -= 1
            if gap > s:
                after[gap - s] = after.get(gap - s, 0) + 1
            squares = sum(n * n for n in after.values())
            if best is None or squares < best[0]:
                best = squares, gap
        gap = best[1]
        if gap == capacity:
            bins.append(s)
        else:
            b = max(k for k, x in enumerate(bins) if capacity - x == gap)
            bins[b] += s
        out.append(capacity - gap)
    return len(bins), out


def test_sum_of_squares_against_a_plain_version():
    rng = np.random.default_rng(3)
    for capacity in (10, 37, 100):
        lengths = np.sort(rng.integers(1, capacity + 1, 120))[::-1]
        bins, offsets = sum_of_squares(lengths, capacity)
        n, plain = plain_sum_of_squares(lengths.tolist(), capacity)
        assert offsets.tolist() == plain and bins.max() + 1 == n


def test_packing_in_several_shards(spark):
    rows = [(k, "wx " * (k * 37 % 3000)) for k in range(300)] + [(400 + k, "wx " * 4095 * 2) for k in range(3)] + [(500, "same")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (pack_documents(docs, WORD, shard_docs=n).collect() for n in (10_000, 40))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, one)) == sorted(map(key, many))
    assert len({r.sequence_id >> 32 for r in many if r.sequence_id >= 0}) > 4
    for out in (one, many):
        sequences = {}
        for r in out:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
        assert all(len(parts) == 1 for s, parts in sequences.items() if s < 0)
        assert len(sequences) <= -(-sum(r.length for r in out) // 4096) + (1 if out is one else 9)


def test_best_fit_and_repair_against_plain_versions():
    rng = np.random.default_rng(7)
    for capacity, n in ((10, 60), (100, 300), (4096, 300), (4096, 5000)):
        lengths = np.sort(rng.integers(1, capacity, n))[::-1]
        used = []
        for s, b in zip(lengths.tolist(), best_fit(lengths, capacity).tolist()):
            fits = [capacity - u for u in used if capacity - u >= s]
            if n <= 300:
                assert (b < len(used)) == bool(fits) and (not fits or capacity - used[b] == min(fits))
            if b == len(used):
                used.append(0)
            used[b] += s
        before = sum_of_squares(lengths, capacity)[0]
        bins = repaired(lengths, before, capacity)
        full = np.bincount(bins, weights=lengths)
        assert full.max() <= capacity and full.min() > 0 and len(full) <= min(before.max() + 1, len(used))
        at = offsets_in(lengths, bins)
        for b in range(0, len(full), 29):
            o = np.argsort(at[bins == b])
            assert (np.cumsum(lengths[bins == b][o]) - lengths[bins == b][o] == at[bins == b][o]).all()
    assert len(repaired(np.array([], int), np.array([], int), 8)) == 0
