"""The pipeline against a plain version of its five stages, and the registered queries."""

import hashlib
import math
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from seqloom.llm.quality import quality_report  # noqa: E402
from seqloom.llm.queries import QUERIES, SQL, tokenizer_path  # noqa: E402
from seqloom.llm.simhash_dedup import fingerprint  # noqa: E402

from .test_near import components  # noqa: E402
from .test_quality_secrets_mixing import quality_rows  # noqa: E402


def corpus():
    rows = [(d, t, "en", f"s{d % 3}", len(t)) for d, t, _ in quality_rows()]
    big = [(5000 + k, rows[k % 40][1] + f" tail{k}", "en", "s0", 1) for k in range(60)]
    return rows + big + [(9000, rows[3][1] + "\n", "en", "s1", 1), (9001, None, None, None, None), (9002, "", "en", "s1", 0), (9003, rows[5][1], None, "s2", 0)]


def exact(rows):
    first = {}
    for d, t, *_ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[key] = min(first.get(key, d), d)
    return [r for r in rows if first[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")] == r[0]]


def near(rows):
    prints = [fingerprint((r[1] or "").encode(), 5, 2) for r in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 20])
    least = {}
    for r, c in zip(rows, root):
        least[c] = min(least.get(c, r[0]), r[0])
    return [r for r, c in zip(rows, root) if least[c] == r[0]]


def mixed(rows, entropy=0.95, repeats=2.0):
    """Plain temperature mixing: each row as often as it is read."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    digits = lambda *p: int(hashlib.sha256("|".join(["mix-1", *map(str, p)]).encode()).hexdigest()[:8], 16)
    by = {}
    for r in rows:
        by.setdefault(r[3] or "", []).append((f"{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}", words(r[1]), r))
    tokens = {s: sum(n for _, n, _ in x) for s, x in by.items()}
    total = sum(tokens.values())
    p = [n / total for n in tokens.values() if n]
    z = lambda a: sum(x**a for x in p)
    even = lambda a: len(p) < 2 or (math.log(z(a)) - a * sum(x**a * math.log(x) for x in p) / z(a)) / math.log(len(p)) >= entropy
    over = lambda a: max(x**a / x for x in p) / z(a) > repeats

    def border(good):
        if good(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    a = round(max(border(even), 0.0 if not over(0.0) else border(over)), 9)
    out = []
    for s, own in by.items():
        if not tokens[s]:
            continue
        budget = math.floor(round((tokens[s] / total) ** a / z(a), 9) * total)
        whole, rest = divmod(budget, tokens[s])
        out += [r for _, _, r in own] * whole
        n = -(-len(own) // 2048)
        order = lambda x: (digits("order", s, whole, digits("block", x[0]) % n), digits("block", x[0]) % n, digits("row", whole, x[0]), x[0])  # noqa: B023, E731
        seen = 0
        for _, k, r in sorted(own, key=order):
            if seen < rest:
                out.append(r)
            seen += k
    return out


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    accepted = {r.doc_id for r in quality_report(docs).collect() if r.accepted}
    assert {d for d, _, kind in quality_rows() if kind == "good"} <= accepted
    want = [[r for r in rows if r[0] in accepted]]
    for stage in (exact, near, mixed):
        want.append(stage(want[-1]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = [tuple(r) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(expected, key=str), name
        docs = spark.createDataFrame(got, schema)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in out:
        tokens[r.doc_id] += r.length
    expected = Counter()
    for r in want[-1]:
        expected[r[0]] += len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert tokens == expected
    assert len({r.sequence_id for r in out}) <= -(-sum(tokens.values()) // 4096) + 1


def test_an_empty_corpus_passes_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)
