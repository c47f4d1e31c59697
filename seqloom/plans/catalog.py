"""Every query by name: a Spark function of (session, folder) and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import tokenizers as K
from ..functions.splitmix import splitmix_draw
from ..operators import baselines as B
from ..operators import bpe, clusters, coding, corpus, homology, letters, metrics, nearest, runs, segments, splits
from ..sources.readers import union_releases
from ..streaming import ingest
from ..views import SEQS, seqs, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Shares of documents in the roles of training and held-out sequences, by stable hash.
PARTS = [("train", 0.8), ("holdout", 0.2)]
RATIOS = [0.1, 0.25, 0.5]


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def part(ident: str = "accession") -> Column:
    return S.stable_bucket(F.col(ident), PARTS)


def unique(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sequences with their first document's values."""
    return corpus.keep_first(seqs(spark, d), ["canonical_sequence_hash"], ["ord"])


FRACTION = "('0x' || substr(sha256('20260808:' || {}), 1, 8))::BIGINT / 4294967295.0"
PART_SQL = f"CASE WHEN {FRACTION.format('accession')} < 0.8 THEN 'train' ELSE 'holdout' END"
UNIQUE = f"""{SEQS},
uniq AS (SELECT * FROM seqs QUALIFY row_number() OVER (PARTITION BY canonical_sequence_hash ORDER BY ord) = 1),
parted AS (SELECT *, {PART_SQL} AS part FROM uniq)"""


def parted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = unique(spark, d).withColumn("part", part())
    return rows.where("part = 'train'"), rows.where("part = 'holdout'")


# ---- canonical records -------------------------------------------------------------------------------------------


@query(f"WITH {SEQS} SELECT accession, rna_type, raw_sequence_hash, canonical_sequence_hash, length, length_bin FROM seqs")
def canonicalize_docs(spark, d):
    return seqs(spark, d).select("accession", "rna_type", "raw_sequence_hash", "canonical_sequence_hash", "length", "length_bin")


@query(r"""
WITH w AS (SELECT coalesce(text, '') AS seq FROM documents)
SELECT CASE WHEN regexp_full_match(translate(seq, 'acgtuT', 'ACGUUU'), '[ACGU]*') THEN 'primary' ELSE 'ambiguous' END AS alphabet_status, count(*) AS n,
       sum(length(seq))::BIGINT AS letters FROM w GROUP BY 1""")
def qc_alphabet_split(spark, d):
    """Alphabet status of each document's whole text."""
    rows = table(spark, d, "documents").select(F.coalesce(F.col("text"), F.lit("")).alias("seq"))
    status = S.alphabet_status(F.translate("seq", "acgtuT", "ACGUUU"))
    return rows.groupBy(status.alias("alphabet_status")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("long").alias("letters"))


@query(f"""WITH {SEQS}
SELECT canonical_sequence_hash, arg_min(rna_type, ord) AS rna_type, min(length) AS length, count(*) AS num_accessions,
       string_agg(accession, chr(9) ORDER BY ord) AS accessions FROM seqs GROUP BY 1""")
def exact_dedup(spark, d):
    return corpus.exact_dedup(seqs(spark, d)).select("canonical_sequence_hash", "rna_type", "length", "num_accessions", "accessions")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def dedup_keep_first_order(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return corpus.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH {SEQS} SELECT source_database || '|' || rna_type || '|' || length_bin AS label, count(*) AS n FROM seqs GROUP BY 1")
def composition_cells(spark, d):
    return corpus.composition(seqs(spark, d), ["source_database", "rna_type", "length_bin"])


@query("SELECT l_returnflag || '|' || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1")
def composition_lineitem(spark, d):
    return corpus.composition(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(f"""WITH {SEQS}, p AS (SELECT unnest([{{'c': 'rna_type', 'v': rna_type}}, {{'c': 'source_database', 'v': source_database}}, {{'c': 'length_bin', 'v': length_bin}}]) AS x FROM seqs)
SELECT x.c AS "column", x.v AS value, count(*) AS n FROM p GROUP BY 1, 2""")
def composition_unpivot(spark, d):
    return corpus.strata(seqs(spark, d), ["rna_type", "source_database", "length_bin"])


@query(f"""WITH {SEQS} SELECT coalesce(source_database, '*') AS source, coalesce(rna_type, '*') AS kind, count(*) AS n, sum(length)::BIGINT AS letters
FROM seqs GROUP BY CUBE (source_database, rna_type)""")
def composition_cube(spark, d):
    rows = seqs(spark, d).cube("source_database", "rna_type").agg(F.count("*").alias("n"), F.sum("length").alias("letters"))
    star = lambda c: F.coalesce(c, F.lit("*"))
    return rows.select(star("source_database").alias("source"), star("rna_type").alias("kind"), "n", "letters")


# ---- homology ----------------------------------------------------------------------------------------------------

PAIRS = f"""{UNIQUE},
km AS (SELECT DISTINCT ord, substr(canonical_sequence, i, 16) AS k FROM uniq, unnest(range(1, length - 14)) AS t(i) WHERE length >= 16),
sz AS (SELECT ord, count(*) AS n FROM km GROUP BY ord),
sh AS (SELECT x.ord AS a, y.ord AS b, count(*) AS shared FROM km x JOIN km y ON x.k = y.k AND x.ord < y.ord GROUP BY 1, 2),
pairs AS (SELECT a, b, shared, shared / least(p.n, q.n) AS containment FROM sh JOIN sz p ON p.ord = a JOIN sz q ON q.ord = b WHERE shared / least(p.n, q.n) >= 0.8)"""


def similar(spark, d):
    return homology.containment_pairs(unique(spark, d))


@query(f"WITH {PAIRS} SELECT a, b, shared, round(containment, 9) AS containment FROM pairs")
def kmer_containment_pairs(spark, d):
    return similar(spark, d).withColumn("containment", F.round("containment", 9))


CLUSTERS = f"""{PAIRS},
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT ord, ord FROM uniq UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS ident, min(b) AS cluster_id FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {CLUSTERS} SELECT ident, cluster_id FROM comp")
def homology_components(spark, d):
    return homology.containment_components(unique(spark, d))


def kmers_sql(name: str, rows: str) -> str:
    """Distinct 14-mers of rows, base-4, with where each is first and its hash."""
    code = " + ".join(f"(ascii(substr(x, i + {j}, 1)) - 48) * {4 ** (13 - j)}::BIGINT" for j in range(14))
    return f"""{name} AS (SELECT *, (code * {clusters.FACTOR} + 11) % {clusters.PRIME} AS h FROM (
  SELECT ord, length, code, min(pos) AS pos FROM (
    SELECT ord, length, i - 1 AS pos, {code} AS code FROM (SELECT ord, length, translate(canonical_sequence, 'ACGU', '0123') AS x FROM {rows}), unnest(range(1, length - 12)) AS t(i) WHERE length >= 14)
  GROUP BY ord, length, code))"""


def aligned_sql(name: str, members: str, centres: str, sent: str, top: str) -> str:
    """Aligned pairs of the members' k-mers with the longest sequence of each k-mer."""
    return f"""{name}_top AS (SELECT * FROM {top} QUALIFY row_number() OVER (PARTITION BY code ORDER BY length DESC, ord) = 1),
{name}_met AS (SELECT s.ord AS member, t.ord AS centre, t.pos - s.pos AS diagonal, count(*) AS votes FROM {sent} s JOIN {name}_top t USING (code) GROUP BY 1, 2, 3),
{name}_best AS (SELECT * FROM {name}_met WHERE votes >= {clusters.VOTES} QUALIFY row_number() OVER (PARTITION BY member, centre ORDER BY votes DESC, diagonal) = 1),
{name}_over AS (SELECT member, centre, diagonal, m.canonical_sequence AS a, c.canonical_sequence AS b, m.length AS ml, c.length AS cl, greatest(0, -diagonal) AS bg,
    least(m.length, c.length - diagonal) - greatest(0, -diagonal) AS ov
  FROM {name}_best JOIN {members} m ON m.ord = member JOIN {centres} c ON c.ord = centre),
{name} AS (SELECT member, centre, ml, cl, 1 - d / ov AS identity, ov / ml AS coverage FROM (
    SELECT *, levenshtein(substr(a, bg + 1, ov), substr(b, bg + diagonal + 1, ov)) AS d FROM {name}_over WHERE ov * 100 >= ml * 80)
  WHERE d <= ov * 20 // 100)"""


def linear_sql(name: str, rows: str) -> str:
    """name(ident, cluster_id): greedy set cover of the aligned pairs of rows; {name}_links are the pairs."""
    sent = f"{name}_sent AS (SELECT * FROM {name}_km QUALIFY row_number() OVER (PARTITION BY ord ORDER BY h, code) <= {clusters.SENT})"
    return f"""{kmers_sql(name + "_km", rows)}, {sent}, {aligned_sql(name + "_pairs", rows, rows, name + "_sent", name + "_sent")},
{name}_links AS (SELECT * FROM {name}_pairs WHERE member <> centre),
{name}_place AS (SELECT ord, row_number() OVER (ORDER BY coalesce(n, 0) DESC, length DESC, ord) AS place FROM {rows} LEFT JOIN (SELECT centre, count(*) AS n FROM {name}_links GROUP BY 1) ON centre = ord),
{name}_ahead AS (SELECT member, centre, c.place FROM {name}_links JOIN {name}_place m ON m.ord = member JOIN {name}_place c ON c.ord = centre WHERE c.place < m.place),
{name}_st(step, ord, rep) AS (
  SELECT 0, ord, NULL::BIGINT FROM {rows} UNION ALL
  SELECT s.step + 1, s.ord, CASE WHEN any_value(s.rep) IS NOT NULL THEN any_value(s.rep)
           WHEN count(l.centre) = count(c.rep) THEN coalesce(arg_min(c.ord, l.place) FILTER (WHERE c.rep = c.ord), s.ord) END
  FROM {name}_st s LEFT JOIN {name}_ahead l ON l.member = s.ord LEFT JOIN {name}_st c ON c.ord = l.centre
  WHERE EXISTS (SELECT 1 FROM {name}_st WHERE rep IS NULL) GROUP BY s.step, s.ord),
{name} AS (SELECT ord AS ident, rep AS cluster_id FROM {name}_st WHERE step = (SELECT max(step) FROM {name}_st))"""


LINEAR = f"{UNIQUE}, {linear_sql('lin', 'uniq')}"


def linear(rows: DataFrame) -> DataFrame:
    return clusters.linear_clusters(rows.select(F.col("ord").alias("id"), F.col("canonical_sequence").alias("seq")))


@query(f"""WITH RECURSIVE {LINEAR} SELECT ident, cluster_id, round(coalesce(identity, 1), 9) AS identity, round(coalesce(coverage, 1), 9) AS coverage
FROM lin LEFT JOIN lin_links ON member = ident AND centre = cluster_id""")
def linear_clusters(spark, d):
    """Representatives and members at an identity and a coverage of the member of 0.8."""
    found = linear(unique(spark, d))
    return found.select(F.col("id").alias("ident"), F.col("representative").alias("cluster_id"), F.round("identity", 9).alias("identity"), F.round("coverage", 9).alias("coverage"))


def clustered(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """rows with cluster_id, the representative of their canonical sequence."""
    uniq = homology.checkpointed(unique(spark, d).select("ord", "canonical_sequence_hash", "canonical_sequence"))
    found = linear(uniq).select(F.col("id").alias("ord"), F.col("representative").alias("cluster_id"))
    found = homology.checkpointed(uniq.select("ord", "canonical_sequence_hash").join(found, "ord").select("canonical_sequence_hash", "cluster_id"))
    return rows.join(found, "canonical_sequence_hash")


#: The same for the rows of seqs.
CLUSTERED = f"""{LINEAR}, member AS (SELECT canonical_sequence_hash, cluster_id FROM uniq JOIN lin ON ident = ord)"""


@query(f"""WITH RECURSIVE {CLUSTERED} SELECT cluster_id, canonical_sequence_hash, length FROM uniq JOIN member USING (canonical_sequence_hash)
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY length DESC, canonical_sequence_hash) = 1""")
def longest_per_cluster(spark, d):
    best = splits.longest_per_cluster(clustered(spark, d, unique(spark, d)).select("ord", "canonical_sequence_hash", "length", "cluster_id"))
    return best.select("cluster_id", "canonical_sequence_hash", "length")


SEARCH = f"""{UNIQUE}, trn AS (SELECT * FROM parted WHERE part = 'train'), cand AS (SELECT * FROM parted WHERE part = 'holdout'),
{linear_sql("tl", "trn")}, reps AS (SELECT trn.* FROM trn JOIN tl ON ident = ord AND cluster_id = ord), sizes AS (SELECT cluster_id, count(*) AS n FROM tl GROUP BY 1),
{kmers_sql("q_km", "cand")}, q_sent AS (SELECT * FROM q_km QUALIFY row_number() OVER (PARTITION BY ord ORDER BY h, code) <= {clusters.SENT}),
{kmers_sql("t_km", "reps")}, {aligned_sql("hit", "cand", "reps", "q_sent", "t_km")},
hits AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY member ORDER BY identity DESC, coverage DESC, centre) = 1)"""


def searched(spark, d):
    """(candidates, the training clusters, hits of candidates on their representatives)."""
    train, candidates = (homology.checkpointed(x.select("ord", "canonical_sequence", "length", "rna_type")) for x in parted(spark, d))
    found = homology.checkpointed(linear(train))
    named = lambda x: x.select(F.col("ord").alias("id"), F.col("canonical_sequence").alias("seq"))
    reps = named(train).join(found.where("id = representative").select("id"), "id")
    return candidates, found, homology.checkpointed(clusters.search(named(candidates), reps))


@query(f"""WITH RECURSIVE {SEARCH} SELECT member AS query, centre AS target, round(identity, 9) AS identity, round(coverage, 9) AS coverage, n AS n_members
FROM hits JOIN sizes ON cluster_id = centre""")
def representative_search(spark, d):
    """Held-out sequences against the representatives of the training clusters; a hit stands for all members of the cluster."""
    _, found, hits = searched(spark, d)
    sizes = found.groupBy(F.col("representative").alias("target")).agg(F.count("*").alias("n_members"))
    return hits.join(sizes, "target").select("query", "target", F.round("identity", 9).alias("identity"), F.round("coverage", 9).alias("coverage"), "n_members")


@query(f"""WITH RECURSIVE {SEARCH}, w AS (SELECT DISTINCT query, ident FROM (SELECT member AS query, centre FROM hits) JOIN tl ON cluster_id = centre)
SELECT c.rna_type, count(*) AS candidates, count(h.member) AS removed, count(*) - count(h.member) AS kept, coalesce(sum(m.n), 0)::BIGINT AS similar_members
FROM cand c LEFT JOIN hits h ON h.member = c.ord LEFT JOIN (SELECT query, count(*) AS n FROM w GROUP BY 1) m ON m.query = c.ord GROUP BY 1""")
def search_removal(spark, d):
    """Candidates by whether a hit removes them, and the training sequences that the hits stand for."""
    candidates, found, hits = searched(spark, d)
    members = hits.select("query", F.col("target").alias("representative")).join(found.select("id", "representative"), "representative").groupBy("query").agg(F.count("*").alias("n"))
    rows = candidates.join(members, candidates["ord"] == members["query"], "left")
    return rows.groupBy("rna_type").agg(
        F.count("*").alias("candidates"), F.count("query").alias("removed"), F.count_if(F.col("query").isNull()).alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("similar_members")
    )


# ---- composition and samples --------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {CLUSTERED}, r AS (SELECT * FROM uniq JOIN member USING (canonical_sequence_hash)),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY canonical_sequence_hash) <= 2)
SELECT cluster_id, canonical_sequence_hash, length FROM k ORDER BY cluster_id, canonical_sequence_hash LIMIT 100""")
def stratified_subsample(spark, d):
    """A sampling operator: two of each cluster, 100 in all."""
    rows = clustered(spark, d, unique(spark, d))
    return corpus.stratified_subsample(rows, "cluster_id", "canonical_sequence_hash", 2, 100).select("cluster_id", "canonical_sequence_hash", "length")


@query(f"""WITH {SEQS}, s AS (SELECT canonical_sequence_hash FROM seqs ORDER BY sha256('42:' || ord), ord LIMIT 100)
SELECT count(*) AS n, sha256(string_agg(canonical_sequence_hash, '' ORDER BY canonical_sequence_hash)) AS selection_hash FROM s""")
def selection_hash(spark, d):
    """One hash for the sample of 100 rows: a hash over a sorted list is for selections of bounded size."""
    return corpus.selection_hash(hash_sample(spark, d), "canonical_sequence_hash")


@query(f"""WITH {SEQS}, s AS (SELECT ord, length, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen FROM seqs)
SELECT ord, length, seen FROM s WHERE seen < 100000""")
def running_budget(spark, d):
    """Sequences read until 100,000 letters are seen; the last one runs over."""
    return corpus.within_budget(seqs(spark, d), "length", "ord", 100_000).select("ord", "length", "seen")


CUTS = f"""{UNIQUE}, c AS (
  SELECT canonical_sequence_hash, canonical_sequence, ord, length, ratio, (6 * floor(length * ratio / 6))::BIGINT AS prefix_len
  FROM uniq, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5]) AS ratio)),
cut AS (SELECT * FROM c WHERE prefix_len > 0 AND prefix_len < length)"""


@query(f"WITH {CUTS} SELECT ord, ratio, prefix_len, round(prefix_len / length, 9) AS actual_ratio FROM cut")
def continuation_cuts(spark, d):
    return corpus.cuts(unique(spark, d), RATIOS).select("ord", "ratio", "prefix_len", F.round("actual_ratio", 9).alias("actual_ratio"))


MANIFEST_SQL = f"""{CUTS}, m AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY ratio ORDER BY sha256('1201:' || canonical_sequence_hash), canonical_sequence_hash) <= 50)"""


@query(f"WITH {MANIFEST_SQL} SELECT ratio, canonical_sequence_hash, length, prefix_len, substr(canonical_sequence, 1, prefix_len) AS prefix FROM m")
def continuation_manifest(spark, d):
    """A sampling operator: 50 entries of each ratio."""
    rows = corpus.continuation_manifest(unique(spark, d), RATIOS, 1201, 50)
    return rows.select("ratio", "canonical_sequence_hash", "length", "prefix_len", F.expr("substr(canonical_sequence, 1, int(prefix_len))").alias("prefix"))


@query(f"""WITH {MANIFEST_SQL} SELECT count(*) AS n,
  sha256(string_agg(canonical_sequence_hash || '|' || length || '|' || prefix_len, chr(10) ORDER BY ratio, canonical_sequence_hash)) AS manifest_hash FROM m""")
def continuation_manifest_hash(spark, d):
    return corpus.manifest_hash(corpus.continuation_manifest(unique(spark, d), RATIOS, 1201, 50))


@query(f"""WITH {SEQS} SELECT count(*) AS checked, count(*) FILTER (WHERE i.md5 = md5(s.canonical_sequence)) AS matched,
  count(*) FILTER (WHERE i.md5 <> md5(s.canonical_sequence)) AS mismatched, count(*) FILTER (WHERE i.md5 IS NULL) AS no_lookup
FROM seqs s LEFT JOIN (SELECT lower(accession) AS a, CASE WHEN rna_type = 'de' THEN md5('x') ELSE md5(canonical_sequence) END AS md5
                       FROM seqs WHERE rna_type <> 'es') i ON i.a = lower(s.accession)""")
def md5_integrity(spark, d):
    """Against an index that lacks one language and is wrong on another."""
    rows = seqs(spark, d)
    index = rows.where("rna_type <> 'es'").select("accession", F.when(F.col("rna_type") == "de", F.md5(F.lit("x"))).otherwise(F.md5("canonical_sequence")).alias("md5"))
    return corpus.integrity(rows.withColumnRenamed("canonical_sequence", "seq"), index)


@query(f"WITH {SEQS} SELECT ord, canonical_sequence_hash FROM seqs ORDER BY sha256('42:' || ord), ord LIMIT 100")
def hash_sample(spark, d):
    """A sampling operator: 100 rows in seeded-hash order."""
    return corpus.hash_sample(seqs(spark, d), "ord", 100).select("ord", "canonical_sequence_hash")


# ---- splits, leakage, releases -----------------------------------------------------------------------------------

FAMILY_SQL = f"""{CLUSTERED},
fam AS (SELECT doc_id, 'F' || (doc_id * 7 % 23) AS model, quality + toxic AS score FROM labels),
best AS (SELECT doc_id, arg_max(model, score) AS family FROM fam GROUP BY doc_id),
clustered AS (SELECT u.*, b.family, m.cluster_id FROM uniq u JOIN member m USING (canonical_sequence_hash) LEFT JOIN best b ON b.doc_id = u.ord),
elig AS (SELECT family FROM clustered WHERE family IS NOT NULL GROUP BY family HAVING count(*) >= 10 AND count(DISTINCT cluster_id) >= 3),
fate AS (SELECT family, CASE WHEN {FRACTION.format("'fam:' || family")} < 0.1 THEN 'family_test' WHEN {FRACTION.format("'fam:' || family")} < 0.2 THEN 'family_validation' ELSE 'train' END AS f FROM elig),
cl AS (SELECT cluster_id, bool_or(coalesce(f = 'family_test', false)) AS t, bool_or(coalesce(f = 'family_validation', false)) AS v
       FROM clustered LEFT JOIN fate USING (family) GROUP BY 1),
assigned AS (
  SELECT c.canonical_sequence_hash, c.canonical_sequence, c.ord, c.length, c.cluster_id, c.family, c.rna_type, e.family IS NOT NULL AS eligible_family,
    CASE WHEN t THEN 'family_test' WHEN v THEN 'family_validation' WHEN {FRACTION.format("'cl:' || c.cluster_id")} < 0.98 THEN 'train'
         WHEN {FRACTION.format("'cl:' || c.cluster_id")} < 0.99 THEN 'validation' ELSE 'test' END AS split_membership
  FROM clustered c JOIN cl USING (cluster_id) LEFT JOIN elig e ON e.family = c.family)"""


def assigned(spark, d):
    """Sequences with their clusters, families from labels, and their split (thresholds scaled to the tables)."""
    labels = table(spark, d, "labels").select("doc_id", F.concat(F.lit("F"), F.col("doc_id") * 7 % 23).alias("model"), (F.col("quality") + F.col("toxic")).alias("score"))
    family = splits.best_hit(labels.withColumn("n", F.lit(0)), "doc_id", "model", "score", "n").select(F.col("doc_id").alias("ord"), F.col("model").alias("family_annotation"))
    rows = clustered(spark, d, unique(spark, d)).join(family, "ord", "left")
    return splits.assign_splits(rows, 10, 3)


@query(f"WITH RECURSIVE {FAMILY_SQL} SELECT canonical_sequence_hash, cluster_id, family AS family_annotation, eligible_family, split_membership FROM assigned")
def split_assign(spark, d):
    return assigned(spark, d).select("canonical_sequence_hash", "cluster_id", "family_annotation", "eligible_family", "split_membership")


@query(f"WITH RECURSIVE {FAMILY_SQL} SELECT split_membership, count(*) AS n, sum(length)::BIGINT AS letters FROM assigned GROUP BY 1")
def split_counts(spark, d):
    return assigned(spark, d).groupBy("split_membership").agg(F.count("*").alias("n"), F.sum("length").alias("letters"))


# Leakage is looked for in a split that leaks: clusters of rows as they come, by the hash of the accession.
LEAKY = f"""{CLUSTERED}, names AS (SELECT unnest(['family_test', 'family_validation', 'test', 'train', 'validation']) AS s),
leaky AS (SELECT *,
  CASE WHEN {FRACTION.format('accession')} < 0.6 THEN 'train' WHEN {FRACTION.format('accession')} < 0.7 THEN 'validation' ELSE 'test' END AS split_membership FROM seqs JOIN member USING (canonical_sequence_hash))"""


def leaky(spark, d):
    split = S.stable_bucket(F.col("accession"), [("train", 0.6), ("validation", 0.1), ("test", 0.3)])
    return seqs(spark, d).withColumn("split_membership", split)


@query(f"""WITH RECURSIVE {LEAKY}, h AS (SELECT DISTINCT canonical_sequence_hash AS h, split_membership AS s FROM leaky),
j AS (SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM h a JOIN h b ON a.h = b.h AND a.s < b.s GROUP BY 1, 2)
SELECT x.s AS split_a, y.s AS split_b, coalesce(n, 0) AS n FROM names x JOIN names y ON x.s < y.s LEFT JOIN j ON j.split_a = x.s AND j.split_b = y.s""")
def leakage_pairwise_overlap(spark, d):
    return splits.pairwise_overlap(leaky(spark, d))


@query(f"WITH RECURSIVE {LEAKY} SELECT count(*) AS n FROM (SELECT cluster_id FROM leaky GROUP BY 1 HAVING count(DISTINCT split_membership) > 1)")
def leakage_cluster_crossing(spark, d):
    return splits.crossing_clusters(clustered(spark, d, leaky(spark, d)))


@query(f"""WITH RECURSIVE {FAMILY_SQL},
x AS (SELECT count(*) AS n FROM (SELECT canonical_sequence_hash FROM assigned GROUP BY 1 HAVING count(DISTINCT split_membership) > 1)),
c AS (SELECT count(*) AS n FROM (SELECT cluster_id FROM assigned GROUP BY 1 HAVING count(DISTINCT split_membership) > 1)),
t AS (SELECT count(*) AS n FROM assigned WHERE split_membership <> 'train' AND canonical_sequence_hash IN (SELECT canonical_sequence_hash FROM assigned WHERE split_membership = 'train'))
SELECT x.n = 0 AS exact_ok, c.n = 0 AS cluster_ok, t.n = 0 AS temporal_ok, x.n = 0 AND c.n = 0 AND t.n = 0 AS all_ok FROM x, c, t""")
def leakage_gates(spark, d):
    rows = assigned(spark, d)
    return splits.leakage_gates(rows, rows.where("split_membership <> 'train'"))


RELEASE = f"""rel AS (SELECT *, CASE WHEN {FRACTION.format("'rel:' || accession")} < 0.5 THEN 22 ELSE 23 END AS rel FROM seqs),
known AS (SELECT accession FROM rel WHERE rel = 22), train AS (SELECT DISTINCT canonical_sequence_hash FROM rel WHERE rel = 22)"""


def releases(spark, d):
    rows = seqs(spark, d).withColumn("rel", F.when(S.stable_fraction(F.concat(F.lit("rel:"), F.col("accession"))) < 0.5, 22).otherwise(23))
    return rows, rows.where("rel = 22")


@query(f"""WITH {SEQS}, {RELEASE} SELECT r.accession, CASE WHEN k.accession IS NOT NULL THEN 'in_release22' WHEN t.canonical_sequence_hash IS NOT NULL THEN 'exact_overlap_train' ELSE 'new' END AS reason,
  k.accession IS NULL AND t.canonical_sequence_hash IS NULL AS keep
FROM rel r LEFT JOIN known k USING (accession) LEFT JOIN train t USING (canonical_sequence_hash)""")
def release_classify(spark, d):
    rows, old = releases(spark, d)
    return splits.classify_release(rows, old, old).select("accession", "reason", "keep")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def release_anti_accession(spark, d):
    """The anti-join at volume: customers without orders."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query(f"WITH {SEQS}, {RELEASE} SELECT accession, canonical_sequence_hash FROM rel WHERE rel = 23 AND canonical_sequence_hash NOT IN (SELECT canonical_sequence_hash FROM train)")
def release_anti_hash(spark, d):
    rows, old = releases(spark, d)
    return rows.where("rel = 23").join(old, "canonical_sequence_hash", "left_anti").select("accession", "canonical_sequence_hash")


@query(f"""WITH {SEQS}, {RELEASE} SELECT rna_type, count(*) AS candidates, count(*) FILTER (WHERE canonical_sequence_hash IN (SELECT canonical_sequence_hash FROM train)) AS removed,
  count(*) FILTER (WHERE canonical_sequence_hash NOT IN (SELECT canonical_sequence_hash FROM train)) AS kept FROM rel WHERE rel = 23 GROUP BY 1""")
def release_removal_counts(spark, d):
    """How many rows of the new release the frozen hashes remove."""
    rows, old = releases(spark, d)
    known = old.select("canonical_sequence_hash").distinct().withColumn("known", F.lit(True))
    return splits.removal_counts(rows.where("rel = 23").join(known, "canonical_sequence_hash", "left"), "known", ["rna_type"])


@query(f"WITH {SEQS}, {RELEASE} SELECT count(DISTINCT canonical_sequence_hash) AS n FROM rel WHERE rel = 23 AND canonical_sequence_hash IN (SELECT canonical_sequence_hash FROM train)")
def overlap_semi_count(spark, d):
    rows, old = releases(spark, d)
    return splits.exact_overlap(rows.where("rel = 23"), old)


@query(f"""WITH RECURSIVE {CLUSTERED}, {RELEASE},
m AS (SELECT cluster_id AS rep, ord, rel FROM rel JOIN member USING (canonical_sequence_hash) WHERE length >= 16),
tainted AS (SELECT DISTINCT rep FROM m WHERE rel = 22)
SELECT r.accession FROM rel r LEFT JOIN m USING (ord) WHERE r.rel = 23 AND coalesce(m.rep, r.ord) NOT IN (SELECT rep FROM tainted)""")
def cluster_anti(spark, d):
    """New sequences outside the clusters that hold old ones; sequences too short for a k-mer are in no cluster."""
    rows, _ = releases(spark, d)
    members = clustered(spark, d, rows.where("length >= 16")).select(F.col("cluster_id").alias("rep"), F.col("ord").alias("member"))
    labels = rows.select(F.col("ord").alias("ident"), (F.col("rel") == 22).alias("is_train"))
    return splits.cluster_anti(rows.where("rel = 23"), members, labels, "ord").select("accession")


@query(f"WITH {SEQS}, {RELEASE} SELECT rel, count(*) AS n, sum(length)::BIGINT AS letters FROM rel GROUP BY rel")
def union_releases_counts(spark, d):
    rows, old = releases(spark, d)
    both = union_releases([old, rows.where("rel = 23").drop("release")])
    return both.groupBy("rel").agg(F.count("*").alias("n"), F.sum("length").alias("letters"))


@query("""SELECT doc_id, coalesce(arg_max(model, score), 'none') AS model, max(score) AS score
FROM (SELECT doc_id, 'F' || (doc_id * 7 % 23) AS model, quality + toxic AS score FROM labels) GROUP BY doc_id""")
def best_hit(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.concat(F.lit("F"), F.col("doc_id") * 7 % 23).alias("model"), (F.col("quality") + F.col("toxic")).alias("score"))
    return splits.best_hit(rows.withColumn("n", F.lit(0)), "doc_id", "model", "score", "n")


@query(f"""WITH {SEQS}, m AS (SELECT rna_type, arg_min(source_database, ord) AS db FROM seqs GROUP BY 1)
SELECT s.source_database, coalesce(m.db, 'UNKNOWN_MAPPING') AS mapped, count(*) AS n FROM seqs s LEFT JOIN m ON m.rna_type = s.rna_type AND s.length > 100 GROUP BY 1, 2""")
def db_map_first_wins(spark, d):
    """The first source seen for each language, looked up for sequences of more than 100 letters."""
    rows = seqs(spark, d)
    first = splits.first_mapping(rows, "rna_type", "source_database", ["ord"]).withColumnRenamed("source_database", "db")
    joined = rows.withColumn("k", F.when(F.col("length") > 100, F.col("rna_type"))).join(first.withColumnRenamed("rna_type", "k"), "k", "left")
    return joined.groupBy("source_database", F.coalesce("db", F.lit("UNKNOWN_MAPPING")).alias("mapped")).agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, p AS (SELECT ord, {PART_SQL} AS part FROM uniq),
h AS (SELECT x.ord AS q, y.ord AS t, count(*) AS shared FROM km x JOIN km y ON x.k = y.k JOIN p a ON a.ord = x.ord AND a.part = 'holdout' JOIN p b ON b.ord = y.ord AND b.part = 'train' GROUP BY 1, 2)
SELECT DISTINCT q FROM h JOIN sz ON sz.ord = q WHERE shared >= 0.8 * n""")
def homology_cross_search(spark, d):
    train, holdout = parted(spark, d)
    return homology.cross_hits(holdout, train)


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, d):
    return metrics.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


# ---- functions and tokenizers ------------------------------------------------------------------------------------


@query(f"WITH {SEQS} SELECT ord, reverse(translate(canonical_sequence, 'ACGU', 'UGCA')) AS rc FROM seqs")
def reverse_complement(spark, d):
    return seqs(spark, d).select("ord", S.reverse_complement(F.col("canonical_sequence")).alias("rc"))


@query()
def sequence_ids(spark, d):
    """CRC-32 ids and a SplitMix64 draw for each sequence."""
    rows = seqs(spark, d).select("ord", S.sequence_id(F.col("canonical_sequence")).alias("seq_id"))
    return rows.withColumn("draw", splitmix_draw(20260815)(F.col("seq_id"), F.lit(7).cast("long")))


@query(f"""WITH {SEQS}, t AS (SELECT ord, unnest(string_split(canonical_sequence, '')) AS c FROM seqs WHERE length > 0)
SELECT c AS token, (instr('ACGU', c) - 1)::INT AS id, count(*) AS n FROM t GROUP BY 1""")
def nuc_tokens(spark, d):
    each = seqs(spark, d).select(F.explode(K.nuc_tokens(F.col("canonical_sequence"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).withColumn("id", K.base4(F.col("token")))


BASE4 = "list_sum([(instr('ACGU', substr({0}, i, 1)) - 1) * 4 ** (length({0}) - i) for i in range(1, length({0}) + 1)])"


@query(f"""WITH {SEQS}, p AS (SELECT CASE WHEN length > 0 THEN rpad(canonical_sequence, greatest(length, 3)::INT, 'A') ELSE '' END AS s FROM seqs),
t AS (SELECT substr(s, i, 3) AS token FROM p, unnest(range(1, length(s) - 1)) AS u(i) WHERE length(s) >= 3)
SELECT token, {BASE4.format('token')}::INT AS id, count(*) AS n FROM t GROUP BY 1""")
def overlap_kmer(spark, d):
    each = seqs(spark, d).select(F.explode(K.overlap_tokens(F.col("canonical_sequence"), 3)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).withColumn("id", K.base4(F.col("token")))


@query(f"""WITH {SEQS}, t AS (SELECT unnest(regexp_extract_all(canonical_sequence, '[ACGU]{{1,3}}')) AS token FROM seqs)
SELECT token, (CASE length(token) WHEN 3 THEN 0 WHEN 2 THEN 68 ELSE 64 END + {BASE4.format('token')})::INT AS id, count(*) AS n FROM t GROUP BY 1""")
def nonoverlap_kmer(spark, d):
    each = seqs(spark, d).select(F.explode(K.block_tokens(F.col("canonical_sequence"), 3)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).withColumn("id", K.block_id(F.col("token"), 3))


VOCAB = f"""{UNIQUE}, g AS (
  SELECT substr(canonical_sequence, i, k) AS token FROM parted, unnest(range(2, 7)) AS u(k), unnest(range(1, length - k + 2)) AS v(i) WHERE part = 'train' AND length >= k),
vocab AS (SELECT token, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, token LIMIT 1020)"""


@query(f"WITH {VOCAB} SELECT token, n FROM vocab")
def unigram_vocab(spark, d):
    """The vocabulary of 1,024 tokens is the feature: four letters and the 1,020 most frequent k-mers of the training sequences."""
    return K.unigram_vocabulary(parted(spark, d)[0], 1024)


@query(f"""WITH {VOCAB}, p AS (SELECT '(' || string_agg(token, '|' ORDER BY length(token) DESC, token) || '|A|C|G|U)' AS re FROM vocab),
t AS (SELECT ord, regexp_extract_all(canonical_sequence, re) AS x FROM seqs, p)
SELECT ord, len(x) AS n_tokens, md5(array_to_string(x, ' ')) AS tokens_md5 FROM t""")
def unigram_encode(spark, d):
    vocabulary = [r.token for r in unigram_vocab(spark, d).collect()]  # 1,020 tokens
    rows = seqs(spark, d).withColumn("x", K.greedy_tokens(F.col("canonical_sequence"), vocabulary))
    return rows.select("ord", F.size("x").cast("long").alias("n_tokens"), F.md5(F.array_join("x", " ")).alias("tokens_md5"))


def bpe_merges(spark, d, merges=1020, letters=128):
    """Merges fitted on all segments of `letters` letters (a parameter of the fit) of the distinct training sequences."""
    return bpe.fit_bpe_rows(parted(spark, d)[0], merges, letters)


@query()
def bpe_fit_encode(spark, d):
    tokens = K.bpe_tokens(bpe_merges(spark, d))(F.col("canonical_sequence"))
    rows = seqs(spark, d).select("ord", "canonical_sequence", tokens.alias("x"))
    return rows.select("ord", F.size("x").alias("n_tokens"), F.md5(F.array_join("x", " ")).alias("tokens_md5"), K.round_trip(F.col("x"), F.col("canonical_sequence")).alias("lossless"))


@query(f"WITH {SEQS} SELECT tokenizer, count(*) AS n, 0::BIGINT AS bad FROM seqs, unnest(['nuc', 'block3', 'block6', 'unigram']) AS t(tokenizer) GROUP BY 1")
def roundtrip_check(spark, d):
    vocabulary = [r.token for r in unigram_vocab(spark, d).collect()]  # 1,020 tokens
    c = F.col("canonical_sequence")
    kinds = {"nuc": K.nuc_tokens(c), "block3": K.block_tokens(c, 3), "block6": K.block_tokens(c, 6), "unigram": K.greedy_tokens(c, vocabulary)}
    checks = F.array(*[F.struct(F.lit(k).alias("tokenizer"), K.round_trip(t, c).alias("ok")) for k, t in kinds.items()])
    return seqs(spark, d).select(F.explode(checks).alias("x")).groupBy("x.tokenizer").agg(F.count("*").alias("n"), F.count_if(~F.col("x.ok")).alias("bad"))


@query(f"""WITH {SEQS} SELECT ord, greatest(length, CASE WHEN length > 0 THEN 3 ELSE 0 END)::BIGINT AS overlap_nt, length AS block_nt FROM seqs""")
def token_attribution(spark, d):
    """Letters that the tokens of each sequence account for; an overlapping k-mer input shorter than k counts as filled up."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x).cast("long")
    c = F.col("canonical_sequence")
    return seqs(spark, d).select("ord", total(K.token_lengths(K.overlap_tokens(c, 3), 3)).alias("overlap_nt"), total(K.token_lengths(K.block_tokens(c, 3))).alias("block_nt"))


@query(f"""WITH {SEQS} SELECT rna_type, sum(greatest(0, least(length - 1, 512)))::BIGINT AS valid_nt, count(*) AS sequences FROM seqs GROUP BY 1""")
def token_exposure(spark, d):
    """Letters that next-token targets expose, for single-letter tokens and a context of 512."""
    c = F.col("canonical_sequence")
    ids = F.transform(K.nuc_tokens(c), K.base4)
    rows = seqs(spark, d).select("rna_type", K.next_token_window(ids, K.token_lengths(K.nuc_tokens(c)), 512).alias("w")).select("rna_type", "w.*")
    return runs.exposure(rows, ["rna_type"])


# ---- baselines and scores ----------------------------------------------------------------------------------------

MARKOV = """{unique},
pt AS (SELECT part, ord, i AS pos, substr(canonical_sequence, i - {k} + 1, {k}) AS ctx, substr(canonical_sequence, i + 1, 1) AS sym
       FROM parted, unnest(range({k}, length)) AS u(i) WHERE length > {k}),
cnt AS (SELECT ctx, sym, count(*) AS c FROM pt WHERE part = 'train' GROUP BY 1, 2), tot AS (SELECT ctx, sum(c) AS n FROM cnt GROUP BY 1),
bits AS (SELECT p.ord, p.pos, -log2((coalesce(c, 0) + 1) / (coalesce(n, 0) + 4)) AS bits FROM pt p LEFT JOIN cnt USING (ctx, sym) LEFT JOIN tot USING (ctx) WHERE part = 'holdout')"""


def markov(order: int) -> Query:
    def run(spark, d):
        train, holdout = parted(spark, d)
        out = B.bits_per_letter(B.markov_bits(holdout, B.markov_fit(train, order), ["ord"], order))
        return out.select(F.round("bpn", 8).alias("bpn"), "n")

    run.__name__ = f"markov_bpn_k{order}"
    return run


for _k in range(4):
    query(f"WITH {MARKOV.format(unique=UNIQUE, k=_k)} SELECT round(sum(bits) / count(*), 8) AS bpn, count(*) AS n FROM bits")(markov(_k))

_D = 5
PPM = f"""{UNIQUE},
att AS (SELECT part, ord, i AS pos, substr(canonical_sequence, greatest(0, i - {_D}) + 1, i - greatest(0, i - {_D})) AS ctx, substr(canonical_sequence, i + 1, 1) AS sym
       FROM parted, unnest(range(0, length)) AS u(i)),
ex AS (SELECT right(ctx, e) AS ctx, sym FROM att, unnest(range(0, length(ctx) + 1)) AS u(e) WHERE part = 'train'),
cnt AS (SELECT ctx, sym, count(*) AS c FROM ex GROUP BY 1, 2), tot AS (SELECT ctx, sum(c) AS n, count(*) AS t FROM cnt GROUP BY 1),
hold AS (SELECT ord, pos, sym, right(ctx, e) AS ctx, e FROM att, unnest(range(0, {_D + 1})) AS u(e) WHERE part = 'holdout'),
tried AS (SELECT h.ord, h.pos, h.e, cnt.c, tot.n, tot.t FROM hold h LEFT JOIN tot USING (ctx) LEFT JOIN cnt USING (ctx, sym)),
firsthit AS (SELECT ord, pos, max(e) FILTER (WHERE c IS NOT NULL) AS hit FROM tried GROUP BY 1, 2),
bits AS (SELECT ord, pos, CASE WHEN any_value(hit) IS NULL THEN 2.0 ELSE -sum(CASE WHEN e = hit THEN log2(c / (n + t)) WHEN e > hit AND n IS NOT NULL THEN log2(t / (n + t)) ELSE 0 END) END AS bits
         FROM tried JOIN firsthit USING (ord, pos) GROUP BY 1, 2)"""


@query(f"WITH {PPM} SELECT round(sum(bits) / count(*), 8) AS bpn, count(*) AS n FROM bits")
def ppm_bpn(spark, d):
    train, holdout = parted(spark, d)
    out = letters.ppm_bits(holdout, "ord", letters.nested_counts(train, _D), _D).agg(F.sum("nll_bits").alias("bits"), F.sum("nt").alias("n"))
    return out.select(F.round(F.col("bits") / F.col("n"), 8).alias("bpn"), "n")


@query(f"WITH {UNIQUE} SELECT round(sum(2.0 * length) / sum(length), 8) AS bpn, sum(length)::BIGINT AS n FROM parted WHERE part = 'holdout'")
def uniform_bpn(spark, d):
    """Held-out sequences under a model that has counted nothing: the same bits for each letter."""
    holdout = parted(spark, d)[1]
    bits = letters.letter_bits(holdout.select("ord", "length", "canonical_sequence"), "ord", np.zeros((1, 4)), 0)
    total = holdout.select("ord", "length").join(bits, "ord").agg(F.sum("nll_bits").alias("bits"), F.sum("length").alias("n"))
    return total.select(F.round(F.col("bits") / F.col("n"), 8).alias("bpn"), "n")


@query(f"""WITH {MARKOV.format(unique=UNIQUE, k=2)},
per AS (SELECT ord, sum(bits) AS b, count(*) AS n FROM bits WHERE pos < 4096 GROUP BY 1),
s AS (SELECT rna_type, coalesce(b, 0) AS b, coalesce(n, 0) AS n, length > 4096 AS long FROM parted LEFT JOIN per USING (ord) WHERE part = 'holdout')
SELECT rna_type, round(sum(b), 5) AS nll_bits, sum(n)::BIGINT AS valid_nt, count(*) AS sequence_count, 0::BIGINT AS invalid_count, count(*) FILTER (WHERE long) AS truncation_count,
       CASE WHEN sum(n) > 0 THEN round(sum(b) / sum(n), 8) END AS bpn FROM s GROUP BY 1""")
def score_sums(spark, d):
    train, holdout = parted(spark, d)
    sums = B.score_sums(holdout, B.markov_bits(holdout, B.markov_fit(train, 2), ["ord"], 2), "ord").join(holdout.select("ord", "rna_type"), "ord")
    out = B.aggregate_sums(sums, ["rna_type"])
    return out.withColumn("nll_bits", F.round("nll_bits", 5)).withColumn("bpn", F.round("bpn", 8))


@query(f"""WITH {MARKOV.format(unique=UNIQUE, k=2)},
c AS (SELECT ord, length, ratio, (6 * floor(length * ratio / 6))::BIGINT AS p FROM parted, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5]) AS ratio) WHERE part = 'holdout'),
s AS (SELECT c.ord, c.ratio, any_value(c.length - c.p) AS suffix_nt, sum(bits) AS b FROM c JOIN bits ON bits.ord = c.ord AND bits.pos >= c.p WHERE c.p > 0 AND c.p < c.length GROUP BY 1, 2)
SELECT ratio, count(*) AS n, sum(suffix_nt)::BIGINT AS suffix_nt, round(avg(b / suffix_nt), 8) AS mean_bpn FROM s GROUP BY 1""")
def suffix_code_length(spark, d):
    train, holdout = parted(spark, d)
    per = B.suffix_bits(corpus.cuts(holdout, RATIOS), B.markov_fit(train, 2), ["ord", "ratio"], 2)
    return per.groupBy("ratio").agg(F.count("*").alias("n"), F.sum("suffix_nt").alias("suffix_nt"), F.round(F.avg("bpn"), 8).alias("mean_bpn"))


def markov_probs(spark, d, order=2):
    return B.probabilities(B.markov_fit(parted(spark, d)[0], order))


@query()
def quantized_cdf(spark, d):
    rows = coding.quantised(markov_probs(spark, d))
    text = F.array_join(F.transform("cdf", lambda x: x.cast("string")), ",").alias("cdf")
    return rows.select("ctx", text, F.round(S.symbol_bits(F.col("cdf"), F.lit(0)), 9).alias("bits_of_a"), S.find_symbol(F.col("cdf"), F.lit(1 << 23)).alias("middle"))


@query()
def range_codec_roundtrip(spark, d):
    """One stream for each source and block of 65,536 ids of the held-out part, so that no stream grows with the table."""
    model = {r.ctx: list(r.probs) for r in markov_probs(spark, d).collect()}  # 16 contexts
    stream = F.concat_ws("/", "source_database", F.floor(F.col("ord") / 65_536).cast("string"))
    streams = parted(spark, d)[1].select(stream.alias("stream_id"), "ord", "canonical_sequence")
    return coding.code_streams(streams, model, 2)


@query()
def codec_totals(spark, d):
    return coding.codec_totals(range_codec_roundtrip(spark, d))


# ---- segments ----------------------------------------------------------------------------------------------------


@query(f"WITH {SEQS} SELECT ord, ((length + 5) // 6)::BIGINT AS patches FROM seqs")
def fixed_patch(spark, d):
    b = segments.fixed_boundaries(F.col("length"), 6)
    return seqs(spark, d).select("ord", F.aggregate(b, F.lit(0), lambda s, x: s + x).cast("long").alias("patches"))


@query(f"""WITH {SEQS}, s AS (SELECT unnest([6 for i in range(0, length // 6)] || CASE WHEN length % 6 > 0 THEN [(length % 6)::INT] ELSE []::INT[] END) AS length FROM seqs),
c AS (SELECT length, count(*) AS n FROM s GROUP BY 1) SELECT length::INT AS length, n, round(n / sum(n) OVER (), 9) AS share FROM c""")
def patch_lengths(spark, d):
    rows = seqs(spark, d).select("ord", segments.fixed_boundaries(F.col("length"), 6).alias("boundary"))
    return segments.segment_lengths(rows, "ord").withColumn("share", F.round("share", 9))


@query()
def random_patch(spark, d):
    bounds = segments.random_boundaries([0.1, 0.2, 0.3, 0.2, 0.1, 0.1], 17)
    rows = seqs(spark, d).select("ord", bounds(F.col("length"), S.sequence_id(F.col("canonical_sequence"))).alias("boundary"))
    return segments.segment_lengths(rows.where(F.size("boundary") > 0), "ord")


ENTROPY_SQL = f"""{MARKOV.format(unique=UNIQUE, k=2)},
sy AS (SELECT t.ctx, s.s AS sym, (coalesce(c, 0) + 1) / (n + 4) AS p FROM tot t CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'U']) AS s) s LEFT JOIN cnt ON cnt.ctx = t.ctx AND cnt.sym = s.s),
en AS (SELECT ctx, -sum(p * ln(p)) AS h FROM sy GROUP BY 1),
ent AS (SELECT ord, i AS pos, coalesce(CASE WHEN i >= 2 THEN h END, ln(4.0)) AS entropy
        FROM parted CROSS JOIN unnest(range(0, length)) AS u(i) LEFT JOIN en ON i >= 2 AND en.ctx = substr(canonical_sequence, i - 1, 2))"""


def entropies(spark, d):
    return letters.entropy_steps(unique(spark, d), "ord", letters.letter_counts(parted(spark, d)[0], 2), 2)


@query(f"WITH {ENTROPY_SQL} SELECT round(6 * avg(entropy), 8) AS gate, count(*) AS n FROM ent")
def entropy_gate(spark, d):
    return entropies(spark, d).agg(F.round(F.avg("entropy") * 6, 8).alias("gate"), F.count("*").alias("n"))


def gated(spark, d):
    """ord, pos, entropy, boundary of the gate at six times the mean entropy."""
    rows, counts = unique(spark, d), letters.letter_counts(parted(spark, d)[0], 2)
    return letters.entropy_steps(rows, "ord", counts, 2, 6 * letters.mean_entropy(rows, counts, 2))


@query()
def entropy_patch(spark, d):
    return gated(spark, d).groupBy("ord").agg(F.sum("boundary").alias("patches"), F.count("*").alias("letters"))


@query(f"""WITH {SEQS}, x AS (SELECT ord, i AS pos, i // 6 AS seg, (instr('ACGU', substr(canonical_sequence, i + 1, 1)) - 1)::DOUBLE AS v FROM seqs, unnest(range(0, length)) AS u(i)),
m AS (SELECT ord, pos, avg(v) OVER (PARTITION BY ord, seg ORDER BY pos ROWS UNBOUNDED PRECEDING) AS mean FROM x)
SELECT ord, count(*) AS letters, round(sum(mean), 6) AS total FROM m GROUP BY 1""")
def open_patch_mean(spark, d):
    """Running means of base codes inside open patches of six, summed per sequence."""
    c = F.col("canonical_sequence")
    each = F.posexplode(F.arrays_zip(segments.fixed_boundaries(F.col("length"), 6).alias("b"), F.transform(K.nuc_tokens(c), lambda t: K.base4(t).cast("double")).alias("v")))
    rows = seqs(spark, d).select("ord", each.alias("pos", "x")).select("ord", "pos", F.col("x.b").alias("boundary"), F.col("x.v").alias("value"))
    return segments.running_means(rows, "ord").groupBy("ord").agg(F.count("*").alias("letters"), F.round(F.sum("mean"), 6).alias("total"))


Q_PREFIX = [0, 10, 100, 1000, 4096]


@query(f"""WITH {ENTROPY_SQL}, e AS (SELECT quantile_cont(entropy, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS q FROM ent),
ed AS (SELECT list_concat(q[1:8], [q[9] + 1e-9]) AS edges FROM e),
b AS (SELECT greatest(0, least(len(list_filter([0, 10, 100, 1000, 4096], lambda x: x <= pos)) - 1, 3)) AS prefix_bin,
             greatest(0, least(len(list_filter(edges, lambda x: x <= entropy)) - 1, 7)) AS entropy_bin, (pos % 6 = 0)::INT AS boundary FROM ent, ed)
SELECT prefix_bin::INT AS prefix_bin, entropy_bin::INT AS entropy_bin, count(*) AS n, sum(boundary)::BIGINT AS boundaries, round(sum(boundary) / count(*), 9) AS q FROM b GROUP BY 1, 2""")
def q_table_fit(spark, d):
    """Rates of a fixed boundary every six letters, by prefix and entropy bin."""
    ent = homology.checkpointed(entropies(spark, d))
    at = ent.withColumn("boundary", (F.col("pos") % 6 == 0).cast("int"))
    out = segments.rate_table(at, Q_PREFIX, segments.entropy_edges(ent))
    return out.select("prefix_bin", "entropy_bin", "n", "boundaries", F.round("q", 9).alias("q"))


@query()
def balance_audit(spark, d):
    """Conditional random boundaries against the gated ones that they were fitted to."""
    at = homology.checkpointed(gated(spark, d))
    edges = segments.entropy_edges(at)
    fitted = homology.checkpointed(segments.rate_table(at, Q_PREFIX, edges))
    about = unique(spark, d).select("ord", "length", S.sequence_id(F.col("canonical_sequence")).alias("seq_id"))
    drawn = segments.conditional_boundaries(at.join(about, "ord"), fitted, Q_PREFIX, edges, 20260815)
    return segments.balance_audit(drawn, fitted)


# ---- metrics -----------------------------------------------------------------------------------------------------

TURNS = r"""
t AS (SELECT conv_id, turn, role, translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS s FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.s AS pred, b.s AS ref FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def turn_pairs(spark, d):
    """Each turn's letters as a prediction of the next turn's."""
    t = table(spark, d, "conversations").select("conv_id", "turn", S.canonical(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[^ACGTUacgtu]", "")).alias("s"))
    later = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("ref"))
    return t.join(later, ["conv_id", "turn"]).withColumnRenamed("s", "pred")


@query(rf"""WITH {TURNS},
m AS (SELECT levenshtein(pred, ref) AS e,
        CASE WHEN length(ref) > 0 THEN coalesce(list_sum([(substr(pred, i, 1) = substr(ref, i, 1))::INT for i in range(1, least(length(pred), length(ref)) + 1)]), 0) / length(ref) ELSE 0 END AS a,
        list_distinct([substr(pred, i, 5) for i in range(1, length(pred) - 3)]) AS kp, list_distinct([substr(ref, i, 5) for i in range(1, length(ref) - 3)]) AS kr FROM p)
SELECT count(*) AS n, round(avg(e), 8) AS mean_edit_distance, round(avg(a), 8) AS mean_accuracy,
       round(avg(CASE WHEN len(kr) > 0 THEN len(list_intersect(kr, kp)) / len(kr) ELSE 0 END), 8) AS mean_kmer_recovery FROM m""")
def continuation_metrics(spark, d):
    out = metrics.continuation_metrics(turn_pairs(spark, d), [])
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("mean_edit_distance", "mean_accuracy", "mean_kmer_recovery")])


@query(rf"""WITH {UNIQUE}, g AS (SELECT item_id AS ord, translate(upper(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS s FROM benchmark),
best AS (SELECT g.ord, max(CASE WHEN least(length(s), length) > 0 THEN
    list_sum([(substr(s, i, 1) = substr(canonical_sequence, i, 1))::INT for i in range(1, least(length(s), length) + 1)]) / least(length(s), length) ELSE 0 END) AS best FROM g, uniq GROUP BY 1),
x AS (SELECT g.*, best, s IN (SELECT canonical_sequence FROM uniq) AS copied FROM g JOIN best USING (ord))
SELECT count(*) AS total, count(*) FILTER (WHERE s <> '') AS valid, count(*) FILTER (WHERE s = '') AS invalid, count(DISTINCT s) FILTER (WHERE s <> '') AS unique_valid,
  count(*) FILTER (WHERE s <> '' AND copied) AS train_copies, count(*) FILTER (WHERE s <> '' AND best >= 1) AS id_100, count(*) FILTER (WHERE s <> '' AND best >= 0.9) AS id_90,
  count(*) FILTER (WHERE s <> '' AND best >= 0.8) AS id_80, round(count(*) FILTER (WHERE s <> '') / count(*), 9) AS validity_rate,
  round(count(DISTINCT s) FILTER (WHERE s <> '') / count(*) FILTER (WHERE s <> ''), 9) AS uniqueness FROM x""")
def generation_stats(spark, d):
    """Benchmark items as generated sequences, a stated set of queries against all documents' sequences."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), S.canonical(F.regexp_replace("text", "[^ACGTUacgtu]", "")).alias("canonical_sequence"))
    train = unique(spark, d)
    out = metrics.generation_stats(items.withColumnRenamed("canonical_sequence", "sequence"), train, metrics.nearest_identity_all(items, train))
    return out.withColumn("validity_rate", F.round("validity_rate", 9)).withColumn("uniqueness", F.round("uniqueness", 9))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS y FROM embeddings),
p AS (SELECT vec_id, neighbour, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 9) AS cosine FROM q JOIN v ON vec_id <> neighbour)
SELECT vec_id, neighbour, cosine FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) = 1""")
def nearest_neighbor(spark, d):
    """Queries are the vectors whose id is divisible by 20, against all."""
    v = table(spark, d, "embeddings")
    return nearest.nearest_vectors(v.where("vec_id % 20 = 0"), v).drop("compared")


# ---- run records -------------------------------------------------------------------------------------------------

RUN_SQL = """
run AS (SELECT event_id, ts, 'F' || (user_id % 7 + 1) AS arm, (user_id % 3 * 13 + 17)::INT AS seed,
          CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'RUNNING' ELSE 'FAILED' END AS status, value AS val_loss FROM events)"""


def run_rows(spark, d):
    """Events as records of runs: users are cells, types are states, values are losses."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "click", "RUNNING").otherwise("FAILED")
    return e.select("event_id", "ts", F.concat(F.lit("F"), F.col("user_id") % 7 + 1).alias("arm"), (F.col("user_id") % 3 * 13 + 17).cast("int").alias("seed"), status.alias("status"), F.col("value").alias("val_loss"))


@query(f"""WITH {RUN_SQL} SELECT arm, seed, event_id, status, val_loss FROM run
QUALIFY row_number() OVER (PARTITION BY arm, seed ORDER BY (status <> 'DONE')::INT, event_id) = 1""")
def run_registry(spark, d):
    return runs.ledger(run_rows(spark, d).drop("ts"), ["arm", "seed"], "event_id")


SPINE = "spine AS (SELECT 'F' || a AS arm, s AS seed FROM unnest(range(1, 10)) AS x(a), unnest([17, 30, 43, 56]) AS y(s))"


def spine(spark):
    seeds = F.explode(F.array(*map(F.lit, (17, 30, 43, 56))))
    return spark.range(1, 10).select(F.concat(F.lit("F"), F.col("id")).alias("arm"), seeds.alias("seed"))


@query(f"""WITH {RUN_SQL}, {SPINE}, best AS (SELECT arm, seed, status FROM run QUALIFY row_number() OVER (PARTITION BY arm, seed ORDER BY (status <> 'DONE')::INT, event_id) = 1)
SELECT s.arm, s.seed, coalesce(status, 'NOT_STARTED') AS status FROM spine s LEFT JOIN best b ON b.arm = s.arm AND b.seed = s.seed""")
def run_closure(spark, d):
    return runs.closure(spine(spark), run_registry(spark, d).select("arm", "seed", "status"), ["arm", "seed"])


@query(f"WITH {RUN_SQL} SELECT arm, seed, event_id, val_loss FROM run WHERE val_loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm, seed ORDER BY val_loss, event_id) = 1")
def best_checkpoint(spark, d):
    return runs.best_checkpoint(run_rows(spark, d), ["arm", "seed"], "val_loss", "event_id")


@query(f"WITH {RUN_SQL} SELECT arm, seed, event_id, status FROM run QUALIFY row_number() OVER (PARTITION BY arm, seed ORDER BY ts DESC, event_id DESC) = 1")
def furthest_run(spark, d):
    return runs.furthest(run_rows(spark, d).select("arm", "seed", "event_id", "status", "ts"), ["arm", "seed"], "ts", "event_id").drop("ts")


@query(f"""WITH {RUN_SQL}, {SPINE},
r AS (SELECT arm, seed, min(val_loss) AS best_val_loss, count(*) AS params, count(*) FILTER (WHERE status = 'DONE') > 0 AS done, avg(val_loss) AS thr FROM run GROUP BY 1, 2)
SELECT s.arm, round(avg(best_val_loss), 8) AS mean_best_val_loss, round(avg(params), 8) AS mean_params, round(avg(thr), 8) AS mean_throughput_nt_s,
  count(*) AS seeds, count(*) FILTER (WHERE r.arm IS NULL) AS missing, count(*) FILTER (WHERE r.arm IS NOT NULL AND NOT done) AS no_checkpoint
FROM spine s LEFT JOIN r ON r.arm = s.arm AND r.seed = s.seed GROUP BY 1""")
def main_table(spark, d):
    done = F.count_if(F.col("status") == "DONE") > 0
    rows = run_rows(spark, d).groupBy("arm", "seed").agg(
        F.min("val_loss").alias("best_val_loss"), F.count("*").alias("params"), F.when(done, "best.pt").alias("best_checkpoint"),
        F.lit("DONE").alias("status"), F.avg("val_loss").alias("throughput_nt_s"),
    )
    likelihood = rows.select("arm", "seed", F.col("best_val_loss").alias("bpn"))
    generation = rows.select("arm", "seed", F.lit(None).cast("double").alias("uniqueness"))
    out = runs.main_table(spine(spark), rows, likelihood, generation)
    means = ("mean_best_val_loss", "mean_params", "mean_throughput_nt_s")
    return out.select("arm", *[F.round(c, 8).alias(c) for c in means], "seeds", "missing", "no_checkpoint")


@query(f"WITH {RUN_SQL}, {SPINE} SELECT arm, seed FROM spine EXCEPT SELECT arm, seed FROM run WHERE status = 'DONE'")
def missing_cells(spark, d):
    return runs.missing_cells(spine(spark), run_rows(spark, d).where("status = 'DONE'"), ["arm", "seed"])


@query(f"""WITH {RUN_SQL}, r AS (SELECT arm, seed / 17.0 AS factor, min(val_loss) AS loss FROM run GROUP BY 1, 2)
SELECT arm, round(arg_min(factor, {{'l': loss, 'f': factor}}), 9) AS factor, min(loss) AS loss, count(*) AS reports FROM r GROUP BY 1""")
def factor_choice(spark, d):
    rows = run_rows(spark, d).groupBy("arm", (F.col("seed") / 17.0).alias("factor")).agg(F.min("val_loss").alias("loss"))
    return runs.factor_choice(rows).withColumn("factor", F.round("factor", 9))


@query(f"WITH {RUN_SQL} SELECT status, count(*) AS n FROM run GROUP BY 1")
def status_counts(spark, d):
    return run_rows(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {RUN_SQL}, r AS (SELECT arm, count(*) AS params, count(DISTINCT seed) AS nonemb FROM run GROUP BY 1)
SELECT count(DISTINCT nonemb) = 1 AS same_params, abs(min(params) - max(params)) / min(params) <= 0.02 AS in_tolerance, true AS no_fallback,
       count(DISTINCT nonemb) = 1 AND abs(min(params) - max(params)) / min(params) <= 0.02 AS all_ok FROM r""")
def fairness_report(spark, d):
    rows = run_rows(spark, d).groupBy("arm").agg(F.count("*").alias("params"), F.countDistinct("seed").alias("non_embedding_params"))
    return runs.fairness(rows.withColumn("cpu_fallback_count", F.lit(0)))


# ---- streams -----------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{homology.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark, stream: DataFrame, mode: str, poll: str | None = None) -> DataFrame:
    return ingest.run_to_table(stream, scratch(spark, "stream"), mode, poll)


@query("""WITH w AS (SELECT lang, length(coalesce(text, '')) AS n FROM documents)
SELECT lang AS rna_type, CASE WHEN n < 16 THEN '<16' WHEN n <= 4096 THEN '16-4096' WHEN n <= 16384 THEN '4097-16384' ELSE '>16384' END AS length_bin, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_ingest(spark, d):
    """Documents as a stream of records, canonical and counted."""
    docs = ingest.stream_table(spark, f"{d}/documents.parque[t]")
    records = docs.select(F.col("doc_id").cast("string").alias("accession"), F.coalesce(F.col("text"), F.lit("")).alias("seq"), F.col("lang").alias("rna_type"))
    counts = corpus.canonicalise(records).groupBy("rna_type", "length_bin").agg(F.count("*").alias("n"))
    return streamed(spark, counts, "complete")


@query("SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def stream_dedup(spark, d):
    events = ingest.stream_table(spark, f"{d}/events.parque[t]").select("event_id", "ts", "user_id", "event_type")
    return streamed(spark, ingest.dedup_events(events, ["event_id"], delay="3 days"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    out = streamed(spark, ingest.windowed_counts(ingest.stream_table(spark, f"{d}/events.parque[t]")), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""SELECT user_id, event_type, arg_min(event_id, {'v': value, 'e': event_id}) AS event_id, min(value) AS value FROM events GROUP BY 1, 2""")
def stream_best_events(spark, d):
    events = ingest.stream_table(spark, f"{d}/events.parque[t]").select("event_id", "user_id", "event_type", "value")
    return ingest.latest(streamed(spark, ingest.best_so_far(events, ["user_id", "event_type"]), "update"), ["user_id", "event_type"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def stream_new_against(spark, d):
    """The release filter as a stream: customers that a frozen table does not hold."""
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return streamed(spark, ingest.new_against(ingest.stream_table(spark, f"{d}/customer.parque[t]").select("c_custkey"), known, "c_custkey"), "append")
