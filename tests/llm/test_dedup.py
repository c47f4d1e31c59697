"""Exact and line deduplication, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from seqloom.llm.exact_dedup import drop_exact_copies, exact_groups
from seqloom.llm.line_dedup import drop_common_lines, keep_bitmaps, line_key, line_report

DOCS = "doc_id long, text string, keep_id string, keep string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "extra", "column") for d, t in rows], DOCS)


def test_exact_groups(spark):
    rows = [(5, "a  b\n"), (3, "a b "), (9, "a b "), (1, ""), (2, None), (4, " "), (8, "x" * 200_000), (7, "x" * 200_000), (7, "x" * 200_000), (None, "n"), (None, "a b "), (6, "A b ")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    want = []
    for d, t in rows:
        group = groups[norm(t)]
        keep = min((x for x in group if x is not None), default=None)
        want.append((d, keep, len(group), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = drop_exact_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "keep"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 9, 1, 4, 7, None, 6], key=str)
    assert exact_groups(frame(spark, [])).count() == 0 == drop_exact_copies(frame(spark, [])).count()


def line_rows():
    common = ["Home | About", "  home | ABOUT\t", "HOME | about"]
    rows = [(k, f"{common[k % 3]}\nown line {k}\n\nÉTÉ {k % 2}\n{common[0]}") for k in range(30)]
    rows += [(100 + k, "nine only") for k in range(9)] + [(200 + k, "ten times\n ten times ") for k in range(10)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "rep\n" * 50), (None, "ten times\nz"), (None, None), (0, rows[0][1])]
    return rows + [(400, "word " * 50_000 + "\nHome | About")]


def brute(rows):
    seen = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if key := line_key(line.encode()):
                seen.setdefault(key, set()).add(d)
    drop = {k for k, v in seen.items() if len(v) >= 10}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x.encode()) not in drop]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    rows = line_rows()
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = line_report(frame(spark, rows)).collect()
        want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    kept = drop_common_lines(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "keep"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, _, _, t in brute(rows))
    assert line_report(frame(spark, [])).count() == 0


def test_bitmaps_are_compressed_and_per_document(spark):
    maps = {r.doc_id: r for r in keep_bitmaps(frame(spark, line_rows())).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[1].keep), np.uint8), count=maps[1].n_lines)
    # of 5 lines the first and last are common to 31 documents, the empty and the others stay (30 share ÉTÉ lines in halves)
    assert bits.tolist() == [0, 1, 1, 0, 0] and maps[1].n_dropped == 3
    assert 303 not in maps and 100 not in maps


def test_a_line_of_all_rows_in_small_batches(spark):
    """Runs that fill whole batches and partitions, long ones of one document, and documents at partition borders."""
    rows = [(k, f"common to all\n{'pair ' if k % 7 else ''}line {k // 3}") for k in range(400)]
    rows += [(1000 + k, "again\n" * 70 + "again") for k in range(9)] + [(2000, "alone\n" * 95), (None, "common to all")]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        spark.conf.set(batch, 10)
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, line_report(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set(batch, before)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
