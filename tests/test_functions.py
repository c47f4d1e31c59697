"""Functions on hand-made rows, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import codec
from seqloom.functions import sequence as S
from seqloom.functions import tokenizers as K
from seqloom.functions.splitmix import draw, splitmix_draw


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_canonical_form_and_bins(spark):
    assert each(spark, S.canonical, ["acgtUGCA", "", "ACGNUR"]) == ["ACGUUGCA", "", "ACGNUR"]
    assert each(spark, S.alphabet_status, ["ACGU", "ACGNUR", ""]) == ["primary", "ambiguous", "primary"]
    sizes = [4, 15, 16, 4096, 4097, 16384, 16385]
    assert [one(spark, S.length_bin(F.lit(n))) for n in sizes] == ["<16", "<16", "16-4096", "16-4096", "4097-16384", "4097-16384", ">16384"]
    assert [one(spark, S.report_bin(F.lit(n))) for n in (10, 16, 512, 4096, 4097, 20000)] == [None, "L1", "L3", "L3", "L4", None]


def test_stable_buckets(spark):
    assert one(spark, S.stable_fraction(F.lit("cl:7"))) == pytest.approx(0.08545059060804792, abs=1e-15)
    assert one(spark, S.stable_bucket(F.lit("cl:7"), [("a", 0.08), ("b", 0.01), ("c", 0.91)])) == "b"


def test_comparisons(spark):
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    pair = lambda f, a, b: one(spark, f(F.lit(a), F.lit(b)))
    assert pair(S.nucleotide_accuracy, "ACGA", "ACGU") == 0.75 and pair(S.nucleotide_accuracy, "UUUU", "ACGU") == 0.25
    assert pair(S.nucleotide_accuracy, "A", "ACGU") == 0.25 and pair(S.positional_identity, "A", "ACGU") == 1.0
    assert pair(S.nucleotide_accuracy, "A", "") == 0.0
    assert pair(S.kmer_recovery, "ACGUACGU", "ACGUACGU") == 1.0 and pair(S.kmer_recovery, "AAAAAA", "CCCCCC") == 0.0
    assert each(spark, S.reverse_complement, ["AACGU", ""]) == ["ACGUU", ""]


def test_continuation_cut(spark):
    got = [one(spark, S.continuation_cut(F.lit(n), F.lit(r))) for n, r in ((100, 0.5), (200, 0.1), (5, 0.5), (6, 1.0), (100, 0.1), (100, 0.25))]
    assert got == [48, 18, None, None, 6, 24]


def test_bins_clamp(spark):
    edges = F.array(*map(F.lit, [0, 10, 100, 1000, 4096]))
    assert [one(spark, S.bin_of(edges, F.lit(x))) for x in (0, 5, 10, 50, 2000, 9999)] == [0, 0, 1, 1, 3, 3]
    ent = F.array(*map(F.lit, [0.0, 0.5, 1.0, 1.5, 2.0]))
    assert [one(spark, S.bin_of(ent, F.lit(x))) for x in (0.0, 1.2, 2.1)] == [0, 2, 3]


def test_splitmix(spark):
    ident = one(spark, S.sequence_id(F.lit("ACGU")))
    assert one(spark, splitmix_draw(20260815)(F.lit(ident), F.lit(7).cast("long"))) == pytest.approx(0.1667561521123222, abs=1e-15)
    many = draw(np.full(2000, ident), np.arange(2000), 1)
    assert 0 <= many.min() and many.max() < 1 and abs(many.mean() - 0.5) < 0.03


def test_rates_and_names(spark):
    assert one(spark, S.learning_rate(F.lit(0), 10, 110, 1.0)) == pytest.approx(0.1)
    assert one(spark, S.learning_rate(F.lit(110), 10, 110, 1.0)) == pytest.approx(0.0, abs=1e-12)
    assert one(spark, S.run_id(F.lit("F1"), F.lit(17), F.lit("100M"), F.lit(16384))) == "F1_s17_100M_b16384"
    assert one(spark, S.formatted(F.lit(None).cast("double"))) == "-" and one(spark, S.formatted(F.lit(1.23456))) == "1.2346"
    assert S.prefix_edges(5) == [0, 1, 2, 3, 4, 5] and S.prefix_edges(4096)[0] == 0 and S.prefix_edges(4096)[-1] == 4096
    assert one(spark, S.bits_of_nats(F.lit(math.log(2.0)))) == pytest.approx(1.0)
    assert one(spark, S.entropy_nats(F.array(*[F.lit(0.25)] * 4))) == pytest.approx(math.log(4))
    assert one(spark, S.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]


def test_tokenizers_are_lossless(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("ACGU", k=n)) for n in [*range(1, 14), 100, 652]] + ["A" * 30, "", "ACGUACG"]
    for k in (3, 6):
        tokens = each(spark, lambda c: K.block_tokens(c, k), words)  # noqa: B023
        assert ["".join(t) for t in tokens] == words
        lengths = each(spark, lambda c: K.token_lengths(K.block_tokens(c, k)), words)  # noqa: B023
        assert [sum(n) for n in lengths] == [len(w) for w in words]
    assert each(spark, lambda c: K.token_lengths(K.overlap_tokens(c, 6), 6), ["ACGUACGUAC"]) == [[6, 1, 1, 1, 1]]
    assert each(spark, lambda c: K.overlap_tokens(c, 3), ["AC", ""]) == [["ACA"], []]
    ids = {t: one(spark, K.block_id(F.lit(t), 3)) for t in ("AAA", "UUU", "A", "U", "AA", "UU")}
    assert ids == {"AAA": 0, "UUU": 63, "A": 64, "U": 67, "AA": 68, "UU": 83}


def test_greedy_tokens(spark):
    assert each(spark, lambda c: K.greedy_tokens(c, ["ACG", "CGU", "AC"]), ["ACGUCGUACA"]) == [["ACG", "U", "CGU", "AC", "A"]]


def naive_bpe(words, merges):
    parts, order = [list(w) for w in words], []
    for _ in range(merges):
        count = Counter()
        for p in parts:
            count.update(zip(p, p[1:]))
        if not count:
            break
        pair = max(count, key=lambda k: (count[k], k))
        order.append(pair)
        for p in parts:
            i = 0
            while i < len(p) - 1:
                if (p[i], p[i + 1]) == pair:
                    p[i : i + 2] = [p[i] + p[i + 1]]
                i += 1
    return order, parts


def test_bpe_equals_the_naive_form(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("ACGU", weights=[4, 2, 1, 1], k=rng.randint(1, 40))) for _ in range(60)] + ["AAAAAAA"] * 3
    order, parts = naive_bpe(words, 25)
    assert K.fit_bpe(Counter(words), 25) == order
    rank = {p: k for k, p in enumerate(order)}
    assert [K.bpe_encode(w, rank) for w in words] == parts
    assert each(spark, K.bpe_tokens(order), words[:10]) == parts[:10]


def test_bpe_is_fitted_on_all_segments(spark, tmp_path):
    from seqloom.operators.bpe import fit_bpe_rows
    from seqloom.plans.catalog import bpe_merges, parted

    rng = random.Random(9)
    words = ["".join(rng.choices("ACGU", weights=[4, 2, 1, 1], k=rng.randint(1, 90))) for _ in range(80)] + ["AAAAAAA", "A" * 64 + "AAAC", "", None]
    segments = Counter(w[k : k + 64] for w in words if w for k in range(0, len(w), 64))
    rows = spark.createDataFrame([(w,) for w in words], "canonical_sequence string")
    assert fit_bpe_rows(rows, 25, 64) == K.fit_bpe(segments, 25)
    assert fit_bpe_rows(rows.limit(0), 25, 64) == []
    # more segments than one process was given before, the later ones in order of letters unlike the first
    texts = ["A" + "".join(rng.choices("AC", k=63)) for _ in range(4_050)] + ["U" + "".join(rng.choices("GU", weights=[1, 3], k=63)) for _ in range(6_000)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    train = Counter(r.canonical_sequence for r in parted(spark, str(tmp_path))[0].collect())
    assert 7_000 < len(train) < 9_000 and set(train) < set(texts)
    passes = []
    assert fit_bpe_rows(parted(spark, str(tmp_path))[0], 40, 64, passes) == K.fit_bpe(train, 40) and len(passes) < 30
    assert bpe_merges(spark, str(tmp_path), merges=6) == K.fit_bpe(train, 6)


def test_many_merges_of_a_pass_are_those_of_one_merge_a_pass():
    import numpy as np

    from seqloom.operators import bpe

    for seed in range(8):
        rng = random.Random(seed)
        words = ["".join(rng.choices("ACGU", [5, 3, 2, 1] if seed % 2 else [1] * 4, k=rng.randint(1, 60))) for _ in range(100)]
        if seed > 5:
            words = ["AC" * rng.randint(1, 19) + "A" * rng.randint(0, 6) for _ in range(60)]
        x = np.array([v for w in words for v in [*map("_ACGU".index, w), bpe.GAP]], np.int64)
        tokens, order, near, passes = ["", *"ACGU"], [], [(a, b) for a in range(1, 5) for b in range(1, 5)], 0
        while len(order) < 90:
            all_of, n = x.tolist(), len(order)
            pairs = Counter(p for p in zip(all_of, all_of[1:]) if all(p))
            three = Counter(zip(all_of, all_of[1:], all_of[2:]))
            ahead = bpe.Ahead(tokens, dict(pairs), {t: c for t, c in three.items() if t[1:] in near}, {t: c for t, c in three.items() if t[:2] in near}, set(near))
            while len(order) < 90 and (step := ahead.next()):
                order.append((tokens[step[0]], tokens[step[1]]))
                x = bpe.merged(x, *step)
            near, passes = sorted(ahead.pairs, key=ahead.rank, reverse=True)[: bpe.CANDIDATES], passes + 1
            if len(order) == n:
                break
        assert order == K.fit_bpe(Counter(words), 90) and passes < len(order) / 3


def test_next_token_window(spark):
    ids, nt = F.array(*map(F.lit, [5, 6, 7, 8])), F.array(*map(F.lit, [3, 3, 3, 1]))
    full = one(spark, K.next_token_window(ids, nt, 10))
    assert (full.context, full.target, full.weight) == ([5, 6, 7], [6, 7, 8], [3, 3, 1])
    last = one(spark, K.next_token_window(ids, nt, 2))
    assert (last.context, last.target, last.weight) == ([6, 7], [7, 8], [3, 1])
    assert one(spark, K.next_token_window(F.array(F.lit(5)), F.array(F.lit(3)), 2)).target == []


def test_quantised_distributions():
    flat = codec.quantise([0.25] * 4)
    assert flat[0] == 0 and flat[-1] == 1 << 24 and all(abs(b - a - (1 << 22)) <= 1 for a, b in zip(flat, flat[1:]))
    spike = codec.quantise([1.0] + [0.0] * 1023)
    assert {b - a for a, b in zip(spike[1:], spike[2:])} == {1} and spike[-1] == 1 << 24
    rng = random.Random(3)
    for _ in range(200):
        p = [rng.random() ** rng.randint(1, 9) for _ in range(rng.randint(1, 300))]
        for scale in (1.0, 1 / sum(p), 0.0, 1e300):
            c = codec.quantise([x * scale for x in p])
            assert c[-1] == 1 << 24 and min(b - a for a, b in zip(c, c[1:])) >= 1


def test_symbol_search(spark):
    cdf = F.array(*map(F.lit, [0, 100, 150, 200, 256]))
    assert one(spark, S.symbol_bits(cdf, F.lit(0), 256)) == pytest.approx(-math.log2(100 / 256))
    assert [one(spark, S.find_symbol(cdf, F.lit(x))) for x in (0, 99, 100, 255)] == [0, 0, 1, 3]


def test_range_coder_round_trips():
    rng = random.Random(7)
    for size, n in ((4, 3000), (1024, 400), (2, 500)):
        p = [rng.random() ** 3 + 1e-6 for _ in range(size)]
        p = [x / sum(p) for x in p]
        rows = [rng.choices(range(size), p, k=n // 3) for _ in range(3)] + [[0] * 200, []]
        data, sums = codec.encode_stream(rows, lambda _: p)
        assert codec.decodes(data, rows, lambda _: p)
        gates = codec.consistency(sums, sums["token_count"], True)
        assert gates["status"] == "PASS_CLOSED" and 64 < gates["overhead_bits"] <= 73 and not gates["within_64_bits"]
        assert data[0] in (0, 1)  # the byte that takes the first symbol's carry
        broken = bytearray(data)
        broken[len(data) // 2] ^= 0x55
        assert not codec.decodes(bytes(broken), rows, lambda _: p)
    # a zero byte, the range's lower end, and zeros up to nine bytes
    assert codec.encode_stream([[1, 0, 1]], lambda _: [0.5, 0.5])[0].hex() == "009fffffffff000000"
    uniform = [[rng.randrange(4) for _ in range(8000)]]
    data, sums = codec.encode_stream(uniform, lambda _: [0.25] * 4)
    assert sums["nll_bits"] == pytest.approx(16_000) and abs(8 * len(data) / 8000 - 2.0) < 0.02
