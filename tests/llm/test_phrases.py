"""Collocations against a plain version."""

import random
import re
from collections import Counter

import pytest

from seqloom.llm.phrases import collocations, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_n, min_count, top, cover):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    frequent = {p: c for p, c in f.items() if c >= min_count}
    candidates = {p: c for p, c in frequent.items() if len(p) > 2}
    longer = Counter()
    for (lang, *w), c in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[(lang, *w[i : i + k])] = max(longer[(lang, *w[i : i + k])], c)
    found = {}
    for (lang, *w), a in candidates.items():
        if (lang, *w) in longer and 100 * longer[(lang, *w)] >= cover * a:
            continue
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in found.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])
    }, {(lang, len(p), " ".join(p), c) for (lang, *p), c in frequent.items()} | {(lang, 0, "", c) for lang, c in n.items() if c}


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "A", "ab", "a\x01", "a\x00b", "é", "Éa", "the", "ζ", "🙂", "b-c", "%20", "日本"]
    gaps = [" "] * 12 + ["  ", "\t", " \t ", ".", ", ", "\n", "\r\n", " ; ", "\x0b", "?!"]
    out = []
    for k in range(120):
        weights = [len(words) - i for i in range(len(words))]
        out.append("".join(w + rng.choice(gaps) for w in rng.choices(words, weights, k=rng.randint(0, 60))))
    return out + ["", " ", ".", "the", " . the the", None] + ["hot hot hot cold"] * 90 + ["long " * 4000 + "word"]


@pytest.mark.parametrize("n", [1, 4, 23])
def test_collocations_equal_a_plain_version(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["en", "en", "en", "d e", "d", "%", "", None, "und"]), t) for t in texts(n)]
    docs = spark.createDataFrame([(k, t, lang, "x", "y", "z") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n string, words string, KEY string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    for max_n, low, top, cover in ((4, 5, 2000, 80), (3, 3, 7, 50)):
        report, frequent = plain(rows, max_n, low, top, cover)
        got = collocations(docs, max_n, low, top, cover)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(report)
        have = [tuple(r) for r in frequent_phrases(docs, max_n, low).collect()]
        assert sorted(have) == sorted(frequent) and len(report) > 10
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_word_and_no_words(spark):
    docs = spark.createDataFrame([(k, "the " * 3 + f"w{k % 50} x{k % 7}", "en") for k in range(3000)], "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    report, _ = plain([(r.lang, r.text) for r in docs.collect()], 4, 30, 2000, 80)
    assert {tuple(r) for r in collocations(docs).collect()} == report
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(spark.createDataFrame([(None, None, None), (1, " .\n", "en")], docs.schema)).count() == 0
