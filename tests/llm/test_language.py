"""Language ID: held-out accuracy, a plain version without a filter, odd rows."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm.language_id import MIN_SHARE, PROBES, RATIO, SLOTS, Filter, language_report


def plain_grams(text):
    low = " " + "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()) + " "
    low = " " + " ".join(low.split(" ")).strip() + " "
    low = " ".join(x for x in low.split(" ") if x)
    low = f" {low} " if low else " "
    return [low[i : i + n] for n in (3, 4) for i in range(len(low) - n + 1)]


def plain(rows):
    """lang_pred and score with sets in place of the filter."""
    counts = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and text is not None and not (d is not None and zlib.crc32(str(d).encode()) % 5 == 0):
            counts[lang].update(plain_grams(text))
    counts = {lang: c for lang, c in counts.items() if c}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {g: n / total[lang] for g, n in c.items() if n / total[lang] >= MIN_SHARE} for lang, c in counts.items()}
    most = Counter()
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    holds = {lang: {g for g, x in s.items() if x >= most[g] * RATIO} for lang, s in share.items()}
    order = sorted(total, key=lambda lang: (-total[lang], lang))
    out = []
    for d, text, _ in rows:
        g = plain_grams(text)
        if not order or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0))
            continue
        found = [sum(x in holds[lang] for x in g) for lang in order]
        out.append((order[found.index(max(found))], max(found) / len(g)))
    return out


SYLLABLES = {"aa": ["ba", "ko", "tri", "um"], "bb": ["ço", "été", "un", "ba"], "cc": ["жи", "ша", "да"], "dd e": ["日本", "語", "の"], "ee": ["um", "tri", "zz", "x"]}


def make(n, seed=3):
    rng = random.Random(seed)

    def word(lang):
        return "".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3)))

    out = []
    for k in range(n):
        lang = rng.choice(["aa"] * 6 + ["bb", "cc", "dd e", "ee"])
        out.append((k, " ".join(rng.choice([word, lambda x: word(x).upper()])(lang) for _ in range(rng.randint(1, 40))) + rng.choice(["", ".", "!\n12", "\t"]), lang))
    odd = ["", " ", "123 _-", "é", "x", "ΣΑΣ İ ẞ", "🙂", None, "a\x00b", "ǅ ª", "ba " * 9000, "ⅧⅧ", "́"]
    return out + [(n + k, t, rng.choice(["aa", None])) for k, t in enumerate(odd)] + out[:4] + [(None, "ba ko um", "aa"), (None, None, None)]


def test_equals_a_plain_version(spark):
    rows = make(300)
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, TEXT2 int").repartition(5)
    got = language_report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = Counter((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0, lang, round(s, 6)) for (d, _, _), (lang, s) in zip(rows, plain(rows)))
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got.collect()) == want
    assert sum(k[2] == "und" for k in want.elements()) == 8


def test_nothing_learnt(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, "some text", None), (2, None, "en"), (3, "", "en")]
    assert {tuple(r) for r in language_report(spark.createDataFrame(rows, schema)).collect()} == {(k, zlib.crc32(str(k).encode()) % 5 == 0, "und", 0.0) for k in (1, 2, 3)}
    assert language_report(spark.createDataFrame([], schema)).count() == 0


def test_false_positives_are_taken_off():
    import numpy as np

    rng = np.random.default_rng(1)
    model = Filter([f"l{k}" for k in range(11)])
    own = [rng.integers(0, 2**63, 400_000, np.uint64) for _ in range(2)]
    for k, hashes in enumerate(own):
        model.add(k + 8, hashes)
    model.close()
    fill = 1 - (1 - 1 / SLOTS) ** (400_000 * PROBES)
    assert abs(model.wrong[8] - fill**PROBES) < 0.01 and model.wrong[0] == 0
    masks = model.holders(own[0])
    assert len(masks) == 2 and (masks[1] & 1).all() and abs(((masks[1] >> 1) & 1).mean() - model.wrong[9]) < 0.01


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    held = language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert right.n > 100 and right.right >= 0.98
