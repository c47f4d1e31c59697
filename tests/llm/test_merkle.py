"""Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest

from seqloom.llm.merkle import fold, height, manifest, manifest_report, path_length, traverse


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and each leaf's path: (place in its run, the run's others) a level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, path in enumerate(paths):
            run, place = runs[at[k] // 3], at[k] % 3
            path.append((place, run[:place] + run[place + 1 :]))
            at[k] //= 3
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    def leaf(row):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for row in rows:  # doc_id, source, lang, n_chars, text
        trees.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    subs, found = [], []
    for k, key in enumerate(sorted(trees)):
        own = sorted(trees[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = plain_tree([leaf(r) for r in own])
        subs.append(sub)
        found += [(k, r, sub, path) for r, path in zip(own, paths)]
    root, tops = plain_tree(subs) if subs else (None, [])
    out = []
    for k, row, sub, path in found:
        path = path + tops[k]
        node = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
            node = (*row[:4], row[4].replace("\n", ""))
        node = leaf(node)
        for place, others in path:
            node = H(*others[:place], node, *others[place:])
        out.append((row[0], leaf(row), sub, root, H(*(s for _, others in path for s in others)), node, node == root))
    return out


def make(n, seed):
    rng = random.Random(seed)
    sources = ["hot"] * 8 + ["a", "b", "", None, "é", "zz", "Z", "1", "0"]
    rows = [(k, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, k, -k]), rng.choice([None, "", "x", "one\ntwo\n", "é\n日", f"t{k}", "l " * 5000])) for k in range(n)]
    return rows + rows[:5] + [(None, "hot", None, None, "a\nb"), (None, "hot", None, None, "a\nb"), (None, None, None, None, None), (3, "hot", "x", 1, "other\n"), (10**15, "alone", None, 0, "\n")]


@pytest.mark.parametrize("levels, n, parts", [(7, 60, 4), (2, 400, 7), (1, 130, 1), (1, 90, 23)])
def test_manifest_equals_a_plain_version(spark, levels, n, parts):
    rows = make(n, levels)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, DIGEST string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = [tuple(r) for r in manifest_report(docs, levels).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_traversal_of_blocks_is_the_whole_tree():
    for n in range(1, 100):
        leaves = [H(str(k)) for k in range(n)]
        root, paths = plain_tree(leaves)
        top, own = traverse(leaves, height(n))
        assert top == root and own == [[s for _, others in p for s in others] for p in paths]
        assert {fold(leaf, k, n, own[k]) for k, leaf in enumerate(leaves)} == {root}
    assert traverse(["x"], 2)[0] == H(H("x"))


def test_manifest_columns_and_empty_table(spark):
    docs = spark.createDataFrame(make(20, 3), "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest(docs).collect()
    assert {r.source for r in got} == {r[1] for r in make(20, 3)} and len({r.root for r in got}) == 1
    for r in got:
        assert len(r.siblings) == path_length(r.place, r.size) + path_length(r.source_place, r.n_sources)
    assert manifest_report(docs.limit(0)).count() == 0
