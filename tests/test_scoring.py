"""Scores over token paths against plain Python, tokenizers back and forth, arms, and streams into files."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions import tokenizers as K
from seqloom.operators import arms, coding, corpus, scoring, segments
from seqloom.sources import readers
from seqloom.streaming import ingest


def rows_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "ord long, canonical_sequence string")


def letters(rng, n):
    return "".join(rng.choices("ACGU", k=n))


def blocks(s, k=3):
    return [s[i : i + k] for i in range(0, len(s), k)]


def test_paths_against_plain_python(spark):
    rng = random.Random(4)
    train, held = [letters(rng, 40) for _ in range(30)], [letters(rng, n) for n in (1, 2, 30, 80)] + ["ACGN", ""]
    rows = scoring.truncated(rows_of(spark, held), 50)
    pairs, totals = Counter(), Counter()
    for s in train:
        for a, b in zip(["", *blocks(s)], blocks(s)):
            pairs[a, b] += 1
            totals[a] += 1
    column = K.block_tokens(F.col("canonical_sequence"), 3)
    model = scoring.token_model(scoring.token_steps(rows_of(spark, train), ["ord"], column))
    got = {r.ord: r.nll_bits for r in scoring.canonical_path(rows, ["ord"], column, model, 84).collect()}
    cut = [s[:50] if set(s) <= set("ACGU") else "" for s in held]
    for k, s in enumerate(cut):
        want = sum(-math.log2((pairs[a, b] + 1) / (totals[a] + 84)) for a, b in zip(["", *blocks(s)], blocks(s)))
        assert got.get(k, 0.0) == pytest.approx(want)
    seen = Counter()
    for s in train:
        for i in range(len(s)):
            seen[s[max(0, i - 2) : i], s[i]] += 1
    path = {r.ord: r.nll_bits for r in scoring.overlap_path(rows_of(spark, train), rows, "ord", 3).collect()}
    for k, s in enumerate(cut):
        want = 0.0
        for i in range(len(s)):
            c = s[max(0, i - 2) : i]
            want -= math.log2((seen[c, s[i]] + 1) / (sum(seen[c, x] for x in "ACGU") + 4))
        assert path.get(k, 0.0) == pytest.approx(want)
    report = {r.arm: r for r in scoring.arm_report(rows, {"F6": scoring.canonical_path(rows, ["ord"], column, model, 84)}, "ord", "test").collect()}["F6"]
    assert (report.metric, report.n_sequences, report.n_invalid, report.n_truncated, report.valid_nt_count) == ("canonical_path_BPN", 6, 1, 1, sum(map(len, cut)))
    assert report.bpn == pytest.approx(sum(got.values()) / sum(map(len, cut)))


def plain_bits(train, held, steps, choices):
    """Bits of each sequence: steps gives its (context, symbol) pairs, out of so many symbols, smoothed by one."""
    pairs, totals = Counter(), Counter()
    for s in train:
        for c, x in steps(s):
            pairs[c, x] += 1
            totals[c] += 1
    return [sum(-math.log2((pairs[p] + 1) / (totals[p[0]] + choices)) for p in steps(s)) for s in held]


def test_all_arms_against_plain_python(spark):
    rng = random.Random(8)
    train, held = [letters(rng, n) for n in (5, 40, 90, 0, 1) * 6], [letters(rng, n) for n in (0, 1, 2, 30, 80, 200)]
    vocabulary, merges = ["AC", "GU", "ACG", "UUUUUU"], K.fit_bpe(Counter(train), 30)
    rank = {p: k for k, p in enumerate(merges)}

    def tokens_of(f):
        return lambda s: list(zip(["", *f(s)], f(s)))

    def greedy(s):
        out = []
        while s:
            out.append(next(s[:n] for n in range(6, 0, -1) if s[:n] in {*vocabulary, *"ACGU"}))
            s = s[len(out[-1]) :]
        return out

    def within(cuts, order=5):
        """Letters given those since the last cut."""

        def steps(s):
            begin = 0
            for i, cut in enumerate(cuts(s)):
                begin = i if cut else begin
                yield s[max(begin, i - order) : i], s[i]

        return lambda s: list(steps(s))

    counts = Counter((s[i - 2 : i], s[i]) for s in train for i in range(2, len(s)))

    def entropy(s, i):
        p = [(counts[s[i - 2 : i], x] + 1) / (sum(counts[s[i - 2 : i], y] for y in "ACGU") + 4) for x in "ACGU"] if i > 1 else [0.25] * 4
        return -sum(x * math.log(x) for x in p)

    every = [entropy(s, i) for s in train for i in range(len(s))]
    gate = 6 * sum(every) / len(every)

    def gated(s):
        out, total = [], math.inf
        for i in range(len(s)):
            out.append(total >= gate)
            total = entropy(s, i) + (0 if out[-1] else total)
        return out

    drawn = segments.random_boundaries(scoring.PATCH_LENGTHS, scoring.PATCH_SEED)
    df = rows_of(spark, sorted({*train, *held}))
    random_cuts = {r.canonical_sequence: r.b for r in df.select("canonical_sequence", drawn(F.length("canonical_sequence"), S.sequence_id(F.col("canonical_sequence"))).alias("b")).collect()}
    plain = {
        "F1": (within(lambda s: [0] * len(s), 1), 4), "F2": (tokens_of(lambda s: K.bpe_encode(s, rank)), 1024), "F3": (tokens_of(greedy), 1024),
        "F4": (within(lambda s: [0] * len(s), 2), 4), "F5": (within(lambda s: [0] * len(s), 5), 4), "F6": (tokens_of(blocks), 84), "F7": (tokens_of(lambda s: blocks(s, 6)), 5460),
        "P1": (within(lambda s: [i % 6 == 0 for i in range(len(s))]), 4), "P2": (within(lambda s: random_cuts[s][: len(s)]), 4), "P3": (within(gated), 4), "B1": (within(lambda s: [1] * len(s)), 4),
    }
    a, b = (scoring.truncated(rows_of(spark, x)) for x in (train, held))
    report = {r.arm: r for r in scoring.score_arms(a, b, "ord", list(plain), "x", vocabulary, merges).collect()}
    assert set(report) == set(plain)
    for arm, (steps, choices) in plain.items():
        assert report[arm].nll_bits_sum == pytest.approx(sum(plain_bits(train, held, steps, choices))), arm
        assert report[arm].valid_nt_count == sum(map(len, held))


def test_suffix_code_length(spark):
    train = rows_of(spark, ["ACGACGUUU", "ACGUUUACG"])
    tokens = lambda c: K.block_tokens(c, 3)
    model = scoring.token_model(scoring.token_steps(train, ["ord"], tokens(F.col("canonical_sequence"))))
    entries = spark.createDataFrame([(1, "ACGUUU", 3), (2, "ACGCCC", 3), (3, "ACGUUU", 0), (4, "ACGUUU", 6)], "ord long, canonical_sequence string, prefix_len int")
    got = {r.ord: r for r in scoring.suffix_code_length(entries, ["ord"], tokens, model, 84).collect()}
    assert got[1].bpn == pytest.approx(-math.log2(2 / 3) / 3) and got[1].suffix_nt == 3
    assert got[2].bpn == math.inf and math.isnan(got[3].bpn) and math.isnan(got[4].bpn)


def test_codec_sums(spark):
    rng = random.Random(5)
    rows = scoring.truncated(rows_of(spark, [letters(rng, 60), letters(rng, 5), "ACGX"]), 50)
    probs = {a + b: [0.1, 0.2, 0.3, 0.4] for a in "ACGU" for b in "ACGU"}
    tables = coding.quantised(spark.createDataFrame(list(probs.items()), "ctx string, probs array<double>"))
    total = scoring.codec_sums(scoring.diagnostic_sums(rows, tables, "ord", 2).withColumn("g", F.lit(1)), ["g"]).first()
    assert set(scoring.CODEC_SUMS) <= set(total.asDict()) and len(scoring.CODEC_SUMS) == 15
    assert (total.valid_nt, total.sequence_count, total.valid_count, total.invalid_count, total.truncation_count) == (55, 3, 2, 1, 1)
    want = 0.0
    for s in (r.canonical_sequence for r in rows.collect()):
        want += sum(2.0 if i < 2 else -math.log2(0.1 * ("ACGU".index(c) + 1)) for i, c in enumerate(s))
    assert total.canonical_nll_bits == pytest.approx(want) and total.quantized_nll_bits == pytest.approx(want, abs=1e-3)
    assert total.canonical_code_nll_bpn == pytest.approx(want / 55)
    none = scoring.codec_sums(rows.limit(0).select(F.lit(0).alias("valid_nt"), F.lit(1).alias("g")).union(spark.createDataFrame([(0, 1)], "valid_nt int, g int")), ["g"]).first()
    assert math.isnan(none.next_base_bpn)


def test_tokenizers_back_and_forth(spark):
    rng = random.Random(6)
    seqs = [letters(rng, n) for n in (0, 1, 2, 3, 4, 5, 6, 7, 29)]
    c = F.col("canonical_sequence")
    rows = rows_of(spark, seqs)
    for k in (3, 6):
        ids = F.transform(K.block_tokens(c, k), lambda t: K.block_id(t, k))
        assert rows.select(K.block_decode(ids, k).alias("x"), c).where("x <> canonical_sequence").count() == 0
        over = F.transform(K.overlap_tokens(c, k), K.base4)
        assert rows.where(F.length(c) >= k).select(K.overlap_decode(over, k).alias("x"), c).where("x <> canonical_sequence").count() == 0
    vocabulary = [*S.ALPHABET, "AC", "GU", "ACG"]
    tokens, spec = K.tokenizer("Unigram", vocabulary=vocabulary[4:])
    listed = K.listed_ids(tokens(c), vocabulary)
    assert rows.select(K.listed_decode(listed, vocabulary).alias("x"), c).where("x <> canonical_sequence").count() == 0
    specs = {kind: spark.range(1).select(K.tokenizer(kind, k=k, vocabulary=[], merges=[("A", "C")])[1].alias("s")).first().s for kind, k in (("NUC", None), ("overlap_mer", 3), ("nonoverlap_mer", 3), ("BPE", None), ("fixed_patch", None))}
    assert {kind: s.vocab_size for kind, s in specs.items()} == {"NUC": 4, "overlap_mer": 64, "nonoverlap_mer": 84, "BPE": 5, "fixed_patch": 4}
    assert rows.select(K.tokenizer("BPE", merges=[("A", "C")])[0](c).alias("t"), c).where(F.array_join("t", "") != c).count() == 0
    assert spark.range(1).select(spec.alias("s")).first().s.lossless


def test_arms(spark):
    df = spark.createDataFrame([(a,) for a in ("F1", "F3", "F5", "P1", "B1", "X")], "arm string")
    got = df.select(arms.metric(F.col("arm")).alias("m"), *arms.boundary_policy(F.col("arm"))).collect()
    assert [tuple(r) for r in got] == [
        ("next_base_BPN", None, None), ("canonical_path_BPN", None, None), ("overlap_path_BPN", None, None), ("next_base_BPN", "fixed", 6), ("next_base_BPN", "fixed", 1), (None, None, None),
    ]
    with pytest.raises(PermissionError):
        arms.sealed(df.withColumn("split", F.lit("test")), "test")
    assert arms.sealed(df.withColumn("split", F.lit("test")), "test", opened=True).count() == 6
    with pytest.raises(Exception, match="not a primary sequence"):
        df.select(S.strict_canonical(F.col("arm"))).collect()
    assert spark.createDataFrame([("acgt",)], "s string").select(S.strict_canonical(F.col("s"))).first()[0] == "ACGU"
    assert [r.c for r in spark.range(7).select(corpus.chunk_of(F.col("id"), 7, 3).alias("c")).collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_removed_rows_and_polling(spark, tmp_path):
    for k, rows in ((0, "1\n3\n"), (2, "3\n5\n")):
        (tmp_path / f"removed_{k}.txt").write_text(rows)
    removed = readers.read_removed(spark, str(tmp_path / "removed_*.txt"))
    assert sorted(r.id for r in readers.without_removed(spark.range(7), removed, "id").collect()) == [0, 2, 4, 6]
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), 1)
    assert ingest.run_to_table(stream, str(tmp_path / "a"), "append", poll="1 second").count() == 50
    assert ingest.run_to_table(stream.groupBy((F.col("id") % 2).alias("k")).count(), str(tmp_path / "b")).count() == 2


def test_fitted_arms_read_kept_tables(spark, monkeypatch):
    """Every arm reads both tables several times: they are kept, not made anew from the documents each time."""
    from seqloom.plans import scoring_queries as Q

    seen = []
    monkeypatch.setattr(Q, "bpe_merges", lambda *_: [])
    monkeypatch.setattr(Q.scoring, "score_arms", lambda train, rows, *_, **__: seen.extend([train, rows]) or spark.createDataFrame([(0.0, 0.0, 0.0)], ", ".join(f"{c} double" for c in Q.ROUNDED)))
    Q.score_fitted_arms(spark, "/root/testdata/sf0.001")
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in seen]
    assert len(plans) == 2 and all("parquet" not in p and "RDD" in p for p in plans), plans
