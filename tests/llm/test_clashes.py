"""Stages leave extra columns alone, whatever their names, and rows that repeat each other."""

from collections import Counter

import pytest

from seqloom.llm.exact_dedup import drop_exact_copies
from seqloom.llm.line_dedup import drop_common_lines
from seqloom.llm.mixing import mix, mix_report
from seqloom.llm.quality import keep_good
from seqloom.llm.simhash_dedup import drop_near_copies
from seqloom.llm.suffix_dedup import remove_repeats

EXTRA = ["_text", "_key", "_norm", "_own", "_kept", "_hash", "_keep", "row", "id", "ident", "keep", "sha", "h128", "norm", "each", "over", "salt", "n", "Row", "text_hash"]


def rows():
    out = [(k, f"line {k} of prose that is the same for nobody\nshared by all", "en", f"s{k % 3}") for k in range(40)]
    return out + [(7, "thirty equal rows", "en", "hot")] * 30 + [(100, out[3][1], "en", "s0"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    schema = f"doc_id long, text string, lang string, source string, {extra}"
    yield spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in EXTRA)) for r in rows()], schema)
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.parametrize("stage", [keep_good, drop_exact_copies, drop_near_copies, mix, drop_common_lines, remove_repeats])
def test_extra_columns_and_repeats(spark, docs, stage):
    settings = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    got = stage(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    found = got.collect()
    for r in found:
        assert [r[c] for c in EXTRA] == [f"{c}-{r['doc_id']}" for c in EXTRA]
    assert settings == {k: spark.conf.get(k) for k in settings}
    ids = Counter(r["doc_id"] for r in found)
    if stage is drop_exact_copies:
        assert ids == Counter({k: 1 for k in [*range(40), None]}) + Counter([7])
    elif stage is mix:
        assert ids == Counter(r["doc_id"] for r in mix_report(docs).collect()) and ids[7] > 30
    elif stage in (drop_common_lines, remove_repeats, keep_good):
        assert ids == Counter(r[0] for r in rows())
