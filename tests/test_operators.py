"""Operators on hand-made rows with known results."""

import gzip
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import baselines, coding, corpus, homology, letters, metrics, runs, segments, splits
from seqloom.sources import readers, writers
from seqloom.streaming import ingest


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fasta(spark, tmp_path):
    path = str(tmp_path / "x.fa")
    with open(path, "w") as f:
        f.write(">URS1 tmRNA from 1 species\nACGU\n  ACGU \n\n>URS2\n\n>URS3 x\r\nAAAA\r\n")
    with gzip.open(path + ".gz", "wt") as f:
        f.write(">URS9\nGG\nCC\n")
    rows = readers.read_fasta(spark, [path, path + ".gz"])
    assert values(rows.select(*readers.header_fields(F.col("header")), "seq"), "accession", "rna_type", "seq") == [
        ("URS1", "tmRNA", "ACGUACGU"), ("URS3", "x", "AAAA"), ("URS9", "unknown", "GGCC"),
    ]
    out = str(tmp_path / "out.fa")
    writers.write_fasta(spark.createDataFrame([("a", "ACGU")], "accession string, canonical_sequence string"), out)
    assert values(readers.read_fasta(spark, out), "header", "seq") == [("a", "ACGU")]


def test_annotation_files(spark, tmp_path):
    def put(name, text):
        with open(tmp_path / name, "w") as f:
            f.write(text)
        return str(tmp_path / name)

    hits = readers.read_family_hits(spark, put("f.tsv", "URS1\tRF00177\t109.4\t1\nURS1\tRF00001\t200.0\nURS2\tRF9\tbad\nshort\tx\n"))
    assert values(hits, "urs", "model", "score") == [("URS1", "RF00001", 200.0), ("URS1", "RF00177", 109.4), ("URS2", "RF9", 0.0)]
    best = splits.best_hit(hits.withColumn("n", F.col("line.row")), "urs", "model", "score", "n")
    assert values(best, "urs", "model") == [("URS1", "RF00001"), ("URS2", "RF9")]
    assert values(readers.read_family_clans(spark, put("c.tsv", "RF1\tA\nRF1\tB\n")), "family", "clan") == [("RF1", "B")]
    os.mkdir(tmp_path / "db")
    put("db/b.tsv", "URS1\tSECOND\te\t9606\t\tg\n")
    put("db/a.tsv", "URS1\tFIRST\te\t9606\t\tg\n\nX1\tDB\te\t1\tt\tg\nURS2\tDB\te\n")
    mapping = readers.read_db_mapping(spark, str(tmp_path / "db"))
    assert values(mapping, "database", "rna_type") == [("FIRST", "unknown"), ("SECOND", "unknown")]
    assert values(readers.first_db_mapping(mapping), "accession", "database") == [("URS1", "FIRST")]
    index = readers.read_md5_index(spark, put("m.tsv", "URS1\tzz\nURS1\t" + "0" * 32 + "\n"))
    rows = spark.createDataFrame([("urs1", "A"), ("URS5", "C")], "accession string, seq string")
    got = corpus.integrity(rows, index).first()
    assert (got.checked, got.matched, got.mismatched, got.no_lookup) == (2, 0, 1, 1)
    clusters = readers.read_clusters(spark, put("k.tsv", "0\t0\n0\t2\n"))
    members = readers.with_clusters(spark.range(4), clusters, "id")
    assert values(members, "id", "cluster_id") == [(0, "0"), (1, "1"), (2, "0"), (3, "3")]
    assert values(readers.read_search_hits(spark, put("h.m8", "q1\tt1\nq1\tt2\nq2\tt1\n")), "query") == [("q1",), ("q2",)]
    put("removed_0.txt", "3\n4\n")
    put("removed_2.txt", "4\n9\n")
    removed = readers.read_removed(spark, str(tmp_path / "removed_*.txt"))
    assert values(removed, "chunk", "row_id") == [(0, 3), (0, 4), (2, 4), (2, 9)]
    assert values(readers.missing_chunks(removed, 4), "chunk") == [(1,), (3,)]
    os.mkdir(tmp_path / "F1_s17")
    put("F1_s17/manifest.json", '{"arm": "F1",\n "seed": 17, "status": "DONE", "config": {"budget_nt": 5}, "checkpoints": [{"nt": 1, "val_loss": 0.5}]}')
    run = readers.read_manifests(spark, str(tmp_path / "*" / "manifest.json")).first()
    assert (run.run_dir, run.config.budget_nt, run.checkpoints[0].val_loss) == ("F1_s17", 5, 0.5)
    assert readers.file_hashes(spark, str(tmp_path / "k.tsv")).first().bytes == 8


def canonical_rows(spark):
    rows = [(1, "U1", "hA"), (2, "U2", "hA"), (3, "U3", "hB"), (4, "U4", "hB"), (5, "U5", "hC")]
    rows = [(o, a, h, "S" + h, "t", 3, "<16") for o, a, h in rows]
    return spark.createDataFrame(rows, "ord long, accession string, canonical_sequence_hash string, canonical_sequence string, rna_type string, length long, length_bin string")


def test_dedup_and_composition(spark):
    got = corpus.exact_dedup(canonical_rows(spark))
    assert values(got, "canonical_sequence_hash", "num_accessions", "accessions") == [("hA", 2, "U1\tU2"), ("hB", 2, "U3\tU4"), ("hC", 1, "U5")]
    assert values(corpus.keep_first(canonical_rows(spark), ["canonical_sequence_hash"], ["ord"]), "ord") == [(1,), (3,), (5,)]
    rows = spark.createDataFrame([("M", "p", "x"), ("M", "p", "x"), ("C", "s", "y")], "a string, b string, c string")
    assert values(corpus.composition(rows, ["a", "b", "c"]), "label", "n") == [("C|s|y", 1), ("M|p|x", 2)]
    assert values(corpus.strata(rows, ["a", "b"]), "column", "value", "n") == [("a", "C", 1), ("a", "M", 2), ("b", "p", 2), ("b", "s", 1)]


def test_subsample_and_hashes(spark):
    rows = spark.createDataFrame([(c, f"{c}{k}") for c, n in (("1", 5), ("2", 3), ("3", 2)) for k in range(n)], "cluster string, h string")
    assert corpus.stratified_subsample(rows, "cluster", "h", 1, 99).count() == 3
    assert values(corpus.stratified_subsample(rows, "cluster", "h", 2, 3), "h") == [("10",), ("11",), ("20",)]
    a = corpus.selection_hash(rows.orderBy("h"), "h").first().selection_hash
    assert a == corpus.selection_hash(rows.orderBy(F.desc("h")), "h").first().selection_hash


def test_budget_overshoots_by_one_row(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(20)], "ord long, length long")
    for block in (1, 3, 4096):
        got = corpus.within_budget(rows, "length", "ord", 35, block)
        assert values(got, "ord", "seen") == [(0, 0), (1, 10), (2, 20), (3, 30)]


def test_splits_keep_clusters_together(spark):
    rows = [(f"h{k}", f"c{k % 40}", f"F{k % 40 % 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "canonical_sequence_hash string, cluster_id string, family_annotation string")
    got = splits.assign_splits(df, 20, 3)
    assert got.count() == 400
    assert splits.crossing_clusters(got).first().n == 0
    assert got.groupBy("family_annotation").agg(F.countDistinct("split_membership").alias("k")).agg(F.max("k")).first()[0] >= 1
    assert splits.leakage_gates(got).first().all_ok is None


@pytest.mark.parametrize(
    ("rows", "overlap", "crossing"),
    [([("h1", "train", "c1"), ("h2", "test", "c2")], 0, 0), ([("h1", "train", "c1"), ("h1", "test", "c2")], 1, 0), ([("h1", "train", "c1"), ("h2", "test", "c1")], 0, 1)],
)
def test_leakage(spark, rows, overlap, crossing):
    df = spark.createDataFrame(rows, "canonical_sequence_hash string, split_membership string, cluster_id string")
    pairs = splits.pairwise_overlap(df)
    assert pairs.count() == 10 and pairs.agg(F.sum("n")).first()[0] == overlap
    assert splits.crossing_clusters(df).first().n == crossing
    gate = splits.leakage_gates(df, df.where("split_membership = 'test'")).first()
    assert gate.exact_ok == (overlap == 0) and gate.cluster_ok == (crossing == 0) and gate.all_ok == (overlap == crossing == 0)


def test_release_filters(spark):
    c = spark.createDataFrame([("a", "ACGU", "h1"), ("b", "ACGNACGU", "h2"), ("c", "ACGU", "h3"), ("d", "GG", "h4")], "accession string, canonical_sequence string, canonical_sequence_hash string")
    known, train = c.where("accession = 'a'"), c.where("accession = 'c'")
    got = splits.classify_release(c, known, train)
    assert values(got, "accession", "reason") == [("a", "in_release22"), ("b", "ambiguous"), ("c", "exact_overlap_train"), ("d", "new")]
    assert splits.exact_overlap(c, train).first().n == 1


@pytest.mark.parametrize(("members", "kept"), [({0: 0, 1: 1, 2: 2, 3: 3}, [2, 3]), ({0: 0, 1: 1, 2: 0, 3: 3}, [3]), ({0: 2, 1: 1, 2: 2, 3: 3}, [3]), ({0: 0, 1: 0, 2: 0, 3: 0}, []), ({}, [2, 3])])
def test_cluster_anti(spark, members, kept):
    df = spark.createDataFrame([(r, m) for m, r in members.items()], "rep long, member long")
    labels = spark.createDataFrame([(k, k < 2) for k in range(4)], "ident long, is_train boolean")
    assert values(splits.cluster_anti(labels.where("not is_train").select("ident"), df, labels), "ident") == [(k,) for k in kept]


def test_homology(spark):
    base = "ACGUUGCAAGCUUACGGAUUCAGGCUAACGUAGCUAGGAUCCAAUCG"
    rows = spark.createDataFrame([(1, base), (2, base[:40]), (3, "A" + base[5:]), (4, "ACGU" * 12), (5, "UUUU")], "ord long, canonical_sequence string")
    pairs = homology.containment_pairs(rows)
    assert {(a, b) for a, b in values(pairs, "a", "b")} >= {(1, 2), (1, 3)}
    got = homology.components(rows.select(F.col("ord").alias("ident")), pairs)
    assert values(got, "ident", "cluster_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert values(homology.cross_hits(rows.where("ord = 2"), rows.where("ord <> 2")), "q") == [(2,)]


def kmers_of(s, k=16):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def test_homology_against_all_pairs(spark):
    """Sequences of all lengths, cut, changed and in common parts: the same links as by comparing all."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("ACGU", k=n))
    common, texts = letters(60), []
    for n in [16, 17, 18, 20, 25, 33, 40, 70, 120, 300, 700] * 2:
        one = letters(n)
        cut = rng.randrange(1 + n // 3)
        changed = "".join(rng.choice("ACGU") if rng.random() < 0.01 else c for c in one)
        texts += [one, one[cut:], letters(30) + one, changed, one[: n // 2] + common, common + changed + common, one * 2]
    texts = list(dict.fromkeys(t for t in texts if len(t) >= 16))
    rows = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), "ACG"), (len(texts) + 1, None)], "ord long, canonical_sequence string")
    sets = [kmers_of(t) for t in texts]
    shared = {(a, b): len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(len(sets)) if a != b}
    want = sorted((a, b, n, n / min(len(sets[a]), len(sets[b]))) for (a, b), n in shared.items() if a < b and n / min(len(sets[a]), len(sets[b])) >= 0.8)
    assert len(want) > 100 and values(homology.containment_pairs(rows), "a", "b", "shared", "containment") == want
    hits = sorted({(a,) for (a, b), n in shared.items() if a % 3 == 0 and b % 3 and n >= 0.8 * len(sets[a])})
    assert hits and values(homology.cross_hits(rows.where("ord % 3 = 0"), rows.where("ord % 3 <> 0")), "q") == hits
    assert homology.containment_pairs(rows.limit(0)).count() == homology.cross_hits(rows, rows.limit(0)).count() == 0


def test_homology_sends_no_set_per_pair(spark):
    """Thirty near copies of 20,000 letters: what is shuffled follows the sequences, not the k-mers of 435 pairs (34 MB here before)."""
    rng = random.Random(6)
    base = "".join(rng.choices("ACGU", k=20_000))
    copies = [(i, base[: 600 * i] + rng.choice("ACGU") + base[600 * i + 1 :]) for i in range(30)]
    copies = list({s: (i, s) for i, s in copies}.values())
    rows = spark.createDataFrame(copies, "ord long, canonical_sequence string")

    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    before, threshold = on_disk(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the table of sequences is no broadcast
    try:
        assert homology.containment_pairs(rows).count() == len(copies) * (len(copies) - 1) // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    used = on_disk() - before
    assert 0 < used < 15e6


def test_homology_cells_do_not_bound_sequences(spark, monkeypatch):
    """Groups are of many slabs and slices: sequences are sent once for each of few groups, and the links are those of all pairs."""
    assert homology.GROUP >= 10 * homology.SLICE and homology.GROUP > homology.SLAB  # a group was 8 million letters: 214 copies of 1.7 billion
    rng = random.Random(8)
    base = ["".join(rng.choices("ACGU", k=k)) for k in (400, 500, 900)]
    texts = [b[rng.randrange(40) :] + "".join(rng.choices("ACGU", k=rng.randrange(40))) for b in base for _ in range(12)] + ["ACGU" * 30, "A" * 50, "CA" * 40]
    texts = list(dict.fromkeys(texts))
    for k in (16, 20):  # k-mers over 16 letters are found by a hash
        table = spark.createDataFrame(list(enumerate(texts)), "ord long, canonical_sequence string")
        seqs = homology.packed(table, "ord", k).withColumn("role", F.lit(homology.BOTH)).withColumn("g", F.lit(0)).toArrow()
        sets = [kmers_of(t, k) for t in texts]
        want = {(a, b): len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(len(sets)) if (len(sets[a]), a) < (len(sets[b]), b)}
        want = {pair: n for pair, n in want.items() if n >= 0.8 * len(sets[pair[0]])}
        for name, most in (("SLAB", 3000), ("SLICE", 2000), ("NEEDLES", 700)):
            monkeypatch.setattr(homology, name, most)
        cell = homology._Cell(seqs, k, 0.8)
        every = slice(0, len(texts))
        found = [(int(cell.ids[a]), int(cell.ids[b]), int(n)) for x, y, m in cell.links(every, every, True) for a, b, n in zip(x, y, m)]
        assert len(want) > 100 and len(found) == len(want) and {(a, b): n for a, b, n in found} == want


def test_homology_components_send_forests(spark):
    """Of 40 near copies that are all linked a cell sends fewer rows than it has sequences; the components are those of all pairs."""
    rng = random.Random(9)
    base = "".join(rng.choices("ACGU", k=2000))
    texts = [base[: 40 * i] + "A" + base[40 * i :] for i in range(40)] + ["".join(rng.choices("ACGU", k=300)) for _ in range(20)] + ["ACG", ""]
    texts += [t[:200] for t in texts[45:50]]
    rows = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "ord long, canonical_sequence string")
    pairs = homology.checkpointed(homology.containment_pairs(rows))
    sent = homology.checkpointed(homology.forest(homology.packed(rows, "ord", 16).withColumn("role", F.lit(homology.BOTH)), 16, 0.8))
    assert pairs.count() > 700 and sent.count() < 0.5 * pairs.count()
    assert sent.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() <= sent.count()
    want = values(homology.components(rows.select(F.col("ord").alias("ident")), pairs), "ident", "cluster_id")
    assert values(homology.containment_components(rows), "ident", "cluster_id") == want
    assert len({c for _, c in want}) == 23


def test_homology_hits_are_sent_once_a_cell(spark):
    """Queries with many linked targets: what leaves the cells grows with the queries, not with the links."""
    rng = random.Random(10)
    base = "".join(rng.choices("ACGU", k=300))
    texts = [base[:i] + "A" + base[i:] for i in range(0, 300, 3)] + ["".join(rng.choices("ACGU", k=200))]
    rows = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "ord long, canonical_sequence string")
    hits = homology.cross_hits(rows.where("ord % 10 = 0"), rows.where("ord % 10 <> 0"))
    assert values(hits, "q") == [(q,) for q in range(0, rows.count() - 1, 10)]
    plan = hits._jdf.queryExecution().analyzed().toString()
    assert "shared" not in plan  # no row a link


def sequences(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "ord long, canonical_sequence string")


def test_markov_and_ppm(spark):
    cycle, flat = sequences(spark, "ACGU" * 500), sequences(spark, "A" * 500)
    bpn = lambda train, test, k: baselines.bits_per_letter(baselines.markov_bits(test, baselines.markov_fit(train, k), ["ord"], k)).first().bpn
    assert bpn(flat, flat, 0) < 0.1 and bpn(cycle, cycle, 0) > 1.9 and bpn(cycle, cycle, 1) <= bpn(cycle, cycle, 0) - 1
    assert bpn(flat, sequences(spark, "CCCC"), 1) == pytest.approx(2.0)
    assert math.isnan(bpn(flat, sequences(spark), 1))
    ppm = letters.ppm_bits(cycle, "ord", letters.nested_counts(cycle, 3), 3).agg((F.sum("nll_bits") / F.sum("nt")).alias("bpn"), F.sum("nt").alias("n")).first()
    assert ppm.bpn < 0.5 and ppm.n == 2000


def test_score_sums_never_average_ratios(spark):
    rows = sequences(spark, "ACGU" * 10, "A" * 400, "ACGNACGU", "")
    bits = baselines.markov_bits(rows, baselines.markov_fit(rows, 0), ["ord"], 0)
    sums = baselines.score_sums(rows, bits, "ord", max_len=100)
    total = baselines.aggregate_sums(sums.withColumn("g", F.lit(1)), ["g"]).first()
    assert (total.valid_nt, total.sequence_count, total.invalid_count, total.truncation_count) == (140, 4, 1, 1)
    assert total.bpn == pytest.approx(total.nll_bits / 140)  # of the long sequence the first 100 letters only


def test_segments(spark):
    rows = spark.createDataFrame([(1, [1.0] * 8)], "ord long, entropy array<double>")
    for f in (segments.gated_boundaries(F.col("entropy"), 2.0), segments.gated_boundaries_arrow(2.0)(F.col("entropy"))):
        assert rows.select(f.alias("b")).first().b == [1, 0] * 4
    b = spark.createDataFrame([(1, [1, 0, 1, 0, 0, 1])], "ord long, boundary array<int>")
    assert values(segments.segment_lengths(b, "ord"), "length", "n") == [(1, 1), (2, 1), (3, 1)]
    policy = segments.random_boundaries([0.25] * 4, 17)
    got = spark.createDataFrame([(50, 9), (20, 9)], "n int, i int").select("n", policy(F.col("n"), F.col("i")).alias("b")).collect()
    long, short = ({r.n: r.b for r in got}[k] for k in (50, 20))
    assert long[:20] == short and len(long) == 50
    values_ = spark.createDataFrame([(1, k, int(k == 0), float(k)) for k in range(6)], "k int, pos int, boundary int, value double")
    means = dict(values(segments.running_means(values_, "k"), "pos", "mean"))
    assert means[5] == 2.5 and means[2] == 1.0


def test_conditional_boundaries_and_audit(spark):
    rows = [(k, 60, k, p, float(p % 8) / 4, int(p % 6 == 0)) for k in range(60) for p in range(60)]
    at = spark.createDataFrame(rows, "ord long, length long, seq_id long, pos int, entropy double, boundary int")
    edges = segments.entropy_edges(at)
    table = segments.rate_table(at, [0, 10, 100], edges)
    assert table.agg(F.sum("n")).first()[0] == 3600 and segments.coverage(table).first().passes in (True, False)
    same = segments.conditional_boundaries(at, table, [0, 10, 100], edges, 1).withColumn("drawn", F.col("boundary"))
    audit = segments.balance_audit(same, table).first()
    assert audit.gate_total and audit.gate_strata and audit.gate_flops and audit.gate_rates and audit.replay_failures == 0
    every = segments.balance_audit(same.withColumn("drawn", F.lit(1)), table).first()
    assert not (every.gate_total or every.gate_flops or every.gate_rates or every.all_pass)
    drawn = segments.conditional_boundaries(at, table, [0, 10, 100], edges, 1)
    assert drawn.where("pos = 0 and drawn <> 1").count() == 0
    assert drawn.where("not supported and pos > 0 and drawn <> boundary").count() == 0
    assert segments.balance_audit(same.limit(0), None).count() == 1


def test_streams_of_codes(spark):
    rows = spark.createDataFrame([("s", 1, "ACGU" * 50), ("s", 0, "AAAC"), ("t", 0, "GGGG")], "stream_id string, ord long, canonical_sequence string")
    coded = coding.code_streams(rows, {}, 1)
    assert values(coded, "stream_id", "sequence_count", "valid_nt", "decoded") == [("s", 2, 204, True), ("t", 1, 4, True)]
    from seqloom.functions import codec

    rng, model = random.Random(1), {a + b: [0.7, 0.1, 0.1, 0.1] for a in "AC" for b in "ACGU"}
    many = [(f"s{k % 3}", k, "".join(rng.choices("ACGU", [6, 2, 1, 1], k=rng.choice([0, 1, 50, 4000])))) for k in range(120)]
    df = spark.createDataFrame(many, "stream_id string, ord long, canonical_sequence string").repartition(4)
    parts = coding.stream_parts(df, model, 2).collect()
    for name in ("s0", "s1", "s2"):
        seqs = [["ACGU".index(c) for c in s] for n, _, s in many if n == name]
        data, sums = codec.encode_stream(seqs, lambda c: model.get("".join("ACGU"[x] for x in c), [0.25] * 4), 2)
        own = sorted((r for r in parts if r.stream_id == name and r.part is not None), key=lambda r: r.part)
        assert b"".join(bytes(r.bits) for r in own) == data
        (end,) = (r for r in parts if r.stream_id == name and r.part is None)
        assert (end.sequence_count, end.valid_nt, end.stream_bits, end.decoded) == (sums["sequence_count"], sums["token_count"], 8 * len(data), True)
        assert end.quantised_bits == pytest.approx(sums["quantised_bits"]) and end.nll_bits == pytest.approx(sums["nll_bits"])
    total = coding.codec_totals(coded).first()
    assert total.nll_bpn == pytest.approx(2.0) and total.decoded


def test_generation_and_continuation(spark):
    train = sequences(spark, "ACGUACGU", "GGGGGGGG")
    made = spark.createDataFrame([(1, "ACGUACGU"), (2, "ACGUACGA"), (3, "ACGUACGA"), (4, "XXXX")], "ord long, sequence string")
    items = made.withColumnRenamed("sequence", "canonical_sequence")
    got = metrics.generation_stats(made, train, metrics.nearest_identity_all(items, train)).first()
    assert (got.total, got.valid, got.invalid, got.unique_valid, got.train_copies, got.id_100, got.id_80) == (4, 3, 1, 2, 1, 1, 3)
    pairs = spark.createDataFrame([("UUUU", "ACGU"), ("ACGU", "ACGU")], "pred string, ref string")
    row = metrics.continuation_metrics(pairs, []).first()
    assert row.mean_edit_distance == 1.5 and row.mean_accuracy == pytest.approx(0.625)


def test_nearest_identity_looks_at_whole_sequences(spark):
    items = spark.createDataFrame([(1, "A" * 70 + "CGU" * 10), (2, "C")], "ord long, canonical_sequence string")
    train = spark.createDataFrame([("G" * 70 + "CGU" * 10,), ("U",)], "canonical_sequence string")
    got = {r.ord: round(r.best, 9) for r in metrics.nearest_identity_all(items, train).collect()}
    assert got == {1: 0.3, 2: 0.0}
    assert not hasattr(metrics, "nearest_identity")  # it met candidates by the first 64 letters only


def test_contained_items(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, item[:-2]), (3, "short item"), (4, "no"), (5, "z" + item)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, "short item")], "item_id long, text string")
    assert values(metrics.contained_items(docs, items), "doc_id", "item_id") == [(1, 10), (3, 11), (5, 10)]


def manifest(**changes):
    good = {"arm": "F1", "seed": 17, "status": "DONE", "final_nt": 10, "budget_nt": 10, "cpu_fallback_count": 0, "best_val_loss": 1.0, "best_checkpoint": "c", "params": 5}
    return tuple({**good, **changes}.values())


def test_run_records(spark):
    schema = "arm string, seed int, status string, final_nt long, budget_nt long, cpu_fallback_count int, best_val_loss double, best_checkpoint string, params long"
    bad = [{"status": "FAILED"}, {"arm": "F2"}, {"seed": 29}, {"final_nt": 9}, {"final_nt": None}, {"cpu_fallback_count": 1}, {"best_val_loss": None}, {"best_checkpoint": None}, {"params": 0}]
    df = spark.createDataFrame([manifest(), *[manifest(**b) for b in bad]], schema)
    found = [r.i for r in df.select(runs.issues(F.lit("F1"), F.lit(17)).alias("i")).collect()]
    assert found[0] == [] and all(len(i) == 1 for i in found[1:])
    names = spark.createDataFrame([(n,) for n in ("phase4_F1_s17_20260809T101010", "phase4_B1_s29_20260810T000000_restart", "phase4_P4_s43_20260809T101010", "F1_s17", "phase4_F1_s17")], "n string")
    nothing = (None, None, None, None)
    assert [tuple(r) for r in names.select(*runs.parse_run_name(F.col("n"))).collect()] == [
        ("F1", 17, "20260809T101010", False), ("B1", 29, "20260810T000000", True), nothing, nothing, nothing,
    ]
    assert found[1:4] == [["not_done"], ["other_arm"], ["other_seed"]] and set(sum(found, [])) == set(runs.FAULTS)
    log = spark.createDataFrame([("F1", 17, "FAILED", 1), ("F1", 17, "DONE", 2), ("F1", 17, "FAILED", 3), ("F2", 17, "FAILED", 1), ("F2", 17, "RUNNING", 2)], "arm string, seed int, status string, d int")
    assert values(runs.ledger(log, ["arm", "seed"], "d"), "arm", "status", "d") == [("F1", "DONE", 2), ("F2", "FAILED", 1)]
    assert values(runs.furthest(log, ["arm", "seed"], "d", "status"), "arm", "d") == [("F1", 3), ("F2", 2)]
    spine = spark.createDataFrame([("F1", 17), ("F3", 17)], "arm string, seed int")
    closed = runs.closure(spine, runs.ledger(log, ["arm", "seed"], "d"), ["arm", "seed"], spine.where("arm = 'F3'"))
    assert values(closed, "arm", "status") == [("F1", "DONE"), ("F3", "RUNNING")]
    assert values(runs.missing_cells(spine, log, ["arm", "seed"]), "arm") == [("F3",)]
    cells = df.limit(1).withColumn("throughput_nt_s", F.lit(4600.0))
    none = spark.createDataFrame([], "arm string, seed int, bpn double")
    table = {r.arm: r for r in runs.main_table(spine, cells, none, none.select("arm", "seed", F.col("bpn").alias("uniqueness"))).collect()}
    assert table["F1"].mean_best_val_loss == 1.0 and table["F1"].mean_bpn is None and table["F3"].missing == 1
    fair = spark.createDataFrame([(100, 90, 0), (101, 90, 0)], "params long, non_embedding_params long, cpu_fallback_count int")
    assert runs.fairness(fair).first().all_ok is True
    assert "| F1 |" in writers.markdown(spine, ["arm"]).replace("17", "").replace("|  |", "|")


def test_two_sinks(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "acgt", "x"), ("b", "ACGN", "x"), ("c", "GG", "y")], "accession string, seq string, rna_type string").repartition(3).write.parquet(source)
    query = ingest.two_sinks(ingest.stream_table(spark, source, 1), str(tmp_path / "p"), str(tmp_path / "q"), str(tmp_path / "c"))
    query.awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "p")), "accession") == [("a",), ("c",)]
    assert values(spark.read.parquet(str(tmp_path / "q")), "accession") == [("b",)]
    rows = spark.read.parquet(str(tmp_path / "p"))
    writers.write_by_alphabet(rows, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where("alphabet_status = 'primary'").count() == 2


def test_homologs_with_different_starts_share_a_cluster_and_a_split(spark, tmp_path):
    import random

    from seqloom.plans import catalog

    rng = random.Random(8)
    base = ["".join(rng.choices("ACGU", k=300)) for _ in range(20)]
    texts = [*base, *["".join(rng.choices("ACGU", k=9)) + s[9:] for s in base], "ACGU", "ACGU", "", None]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1.0, 0.0) for k in range(40)], "doc_id long, quality double, toxic double").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog.assigned(spark, str(tmp_path)).select("ord", "cluster_id", "split_membership").collect()
    assert {r.ord: r.cluster_id for r in rows} == {k: k % 20 for k in range(40)} | {40: 40, 42: 42}
    assert len({(r.cluster_id, r.split_membership) for r in rows}) == 22
    old = {r.accession for r in catalog.releases(spark, str(tmp_path))[1].collect()}
    kept = {r.accession for r in catalog.cluster_anti(spark, str(tmp_path)).collect()}
    new = [k for k in range(44) if f"URS{k}" not in old]
    assert kept == {f"URS{k}" for k in new if k >= 40 or f"URS{(k + 20) % 40}" not in old}
