"""Repeated byte strings against brute force."""

import hashlib
import random

import pyarrow as pa

from seqloom.llm import suffix_dedup
from seqloom.llm.suffix_dedup import CONTEXTS, _name_runs, _narrowed, remove_repeats, repeat_report


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\x01" * length
    out = []
    for (d, _), t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((d, len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out, gone


def make(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))[: 5 * n]
    passages = [prose(rng.randint(60, 200)) for _ in range(6)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += [prose(rng.randint(5, 120)), rng.choice(passages)[rng.randint(0, 60) :]]
        rows.append((k, "".join(parts)))
    for k in range(20):  # near copies
        t = list(rows[k % 4][1])
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = "#"
        rows.append((100 + k, "".join(t)))
    rows += [(200 + k, rows[7][1]) for k in range(5)] + [(7, rows[7][1]), (7, "other"), (None, rows[3][1]), (None, None), (301, ""), (302, "a" * 399)]
    rows += [(303, "b" * 401), (304, "xy" * 900), (305, "x" + "yx" * 300), (306, passages[0] + "|" + passages[0])]
    return rows


def test_repeats(spark):
    for length, gram in ((400, 64), (80, 16)):
        rows = make(length)
        docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, lo int, ends string")
        want, gone = brute(rows, length)
        for n, few in ((1, 2), (4, 256), (23, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [tuple(r) for r in repeat_report(docs, length, gram, few).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert any(0 < w[2] < w[1] for w in want)
        kept = remove_repeats(docs, length, gram)
        assert kept.columns == docs.columns
        texts = [bytes(b for b, x in zip((t or "").encode(), g) if not x).decode(errors="replace") for (_, t), g in zip(rows, gone)]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for (d, _), t in zip(rows, texts)), key=str)
    assert repeat_report(docs.limit(0)).count() == 0


def test_a_line_repeated_within_a_document_is_sent_once(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdeé ", k=70)) + "\n"
    noise = ["".join(rng.choices("abcde ", k=600)) for _ in range(3)]
    rows = [(1, line * 300), (2, noise[0] + line * 40 + noise[1] + line * 40), (3, noise[2] + line * 3), (4, "z" * 5000), (5, line * 9), (6, "ab" * 199)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 4]), pa.array([0, 0], pa.int32()), pa.array([rows[0][1], rows[3][1]])], ["doc_id", "text_hash", "text"])
    sent = sum(b.num_rows for b in _name_runs(400, 64)([batch]))
    assert sent <= 6  # 300 periods of a line and 4,600 of a letter
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows, 400)
    assert sorted(tuple(r) for r in repeat_report(docs).collect()) == sorted(want)
    alone = rows[3:4]  # repeated by itself only
    got = repeat_report(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == brute(alone, 400)[0]


def test_joins_on_ranges_can_be_split(spark, monkeypatch):
    """No join on names of ranges has an aggregate in its stage, which would keep a range of many contexts in one task."""
    rng = random.Random(4)
    line, plans = bytes(rng.choices(range(97, 123), k=500)), []
    rows = [(1, k, 0, 300, 0, True, bytes(rng.choices(range(97, 123), k=200)) + line) for k in range(40)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written = suffix_dedup.checkpointed
    monkeypatch.setattr(suffix_dedup, "checkpointed", lambda df: (plans.append(plan(df)), written(df))[1])
    found = _narrowed(spark.createDataFrame(rows, CONTEXTS), 400, 337)
    plans.append(plan(found))
    assert any("Join" in p for p in plans)
    assert not [p for p in plans if "Join" in p and "Aggregate" in p]
    reach = {}
    for r in found.collect():
        a, b = reach.get(r.doc_id, (r.start, r.end))
        reach[r.doc_id] = min(a, r.start), max(b, r.end)
    assert sorted(reach) == list(range(40))
    assert all((a, b) == (200, 700) or a < 200 and b == 700 for a, b in reach.values())
