"""Queries of readers, writers and file streams: tables are written in the format at hand to the shared folder and read back.

Writers keep an order over several files by range partitions, whose file names sort like their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S
from ..operators import corpus, runs
from ..sources import readers, writers
from ..streaming import ingest
from ..views import SEQS, seqs, table
from .catalog import QUERIES, RUN_SQL, SQL, query, run_rows, scratch, streamed


def put(rows: DataFrame, folder: str, columns: list, order: list[str]) -> str:
    """Tab-separated lines of the columns in the given order, over as many files as it takes."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in columns])
    rows.orderBy(*order).select(line.alias("value")).write.text(folder)
    return folder


# ---- sequences ---------------------------------------------------------------------------------------------------


@query(f"WITH {SEQS} SELECT accession, rna_type, length, md5(canonical_sequence) AS seq_md5 FROM seqs WHERE length > 0")
def fasta_scan(spark, d):
    """Sequences written as FASTA and scanned again, headers parsed."""
    folder = scratch(spark, "fasta")
    rows = seqs(spark, d).where("length > 0").withColumn("header", F.concat_ws(" ", "accession", "rna_type"))
    writers.write_fasta(rows, folder, "header")
    back = readers.read_fasta(spark, folder)
    return back.select(*readers.header_fields(F.col("header")), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("seq_md5"))


@query(f"WITH {SEQS} SELECT accession, length FROM seqs")
def strict_canonical(spark, d):
    """The strict canonical form, which would fail on a letter outside the alphabet."""
    rows = seqs(spark, d).select("accession", S.strict_canonical(F.translate("canonical_sequence", "U", "t")).alias("s"))
    return rows.select("accession", F.length("s").cast("long").alias("length"))


# ---- annotation tables -------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT 'URS' || l_suppkey AS urs, 'RF' || (l_partkey % 97) AS model, l_quantity::DOUBLE AS score, l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT urs, model, score FROM h QUALIFY row_number() OVER (PARTITION BY urs ORDER BY score DESC, l_orderkey, l_linenumber, model) = 1),
c AS (SELECT 'RF' || (p_partkey % 97) AS family, 'CL' || (p_size % 11) AS clan FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_partkey DESC) = 1)
SELECT urs, model, score, clan FROM b LEFT JOIN c ON family = model""")
def family_tables(spark, d):
    """The best family of each accession (of equal scores the first line) and its clan (the last line)."""
    folder = scratch(spark, "families")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("URS"), "l_suppkey").alias("urs"), F.concat(F.lit("RF"), F.col("l_partkey") % 97).alias("model"), F.col("l_quantity").cast("double").alias("score"), "l_orderkey", "l_linenumber")
    hits = readers.read_family_hits(spark, put(rows, f"{folder}/hits", ["urs", "model", "score"], ["l_orderkey", "l_linenumber", "model"]))
    part = table(spark, d, "part").select(F.concat(F.lit("RF"), F.col("p_partkey") % 97).alias("family"), F.concat(F.lit("CL"), F.col("p_size") % 11).alias("clan"), "p_partkey")
    clans = readers.read_family_clans(spark, put(part, f"{folder}/clans", ["family", "clan"], ["p_partkey"]))
    best = hits.groupBy("urs").agg(F.min_by(F.struct("model", "score"), F.struct(-F.col("score"), "file", "line")).alias("b"))
    return best.select("urs", "b.model", "b.score").join(clans.withColumnRenamed("family", "model"), "model", "left").select("urs", "model", "score", "clan")


@query(f"""WITH {SEQS} SELECT 'URS' || (ord % 300) AS accession, arg_min(source_database, (release % 2) * 1000000000 + ord) AS database FROM seqs GROUP BY 1""")
def mapping_files(spark, d):
    """The first database of each accession over two files of mappings, in the order of files and lines."""
    folder = scratch(spark, "mapping")
    rows = seqs(spark, d).withColumn("accession", F.concat(F.lit("URS"), F.col("ord") % 300))
    columns = ["accession", "source_database", F.lit("x"), F.lit("y"), "rna_type", F.lit("z")]
    for k in (0, 1):
        put(rows.where(F.col("release") % 2 == k), f"{folder}/database_{k}", columns, ["ord"])
    return readers.first_db_mapping(readers.read_db_mapping(spark, f"{folder}/database_*"))


@query(f"""WITH {SEQS} SELECT count(*) AS checked, count(*) FILTER (WHERE ord % 10 <> 0 AND ord % 13 <> 0) AS matched, count(*) FILTER (WHERE ord % 10 <> 0 AND ord % 13 = 0) AS mismatched,
count(*) FILTER (WHERE ord % 10 = 0) AS no_lookup FROM seqs""")
def md5_index(spark, d):
    """Sequences against an index that lacks each tenth and has a wrong last line for each thirteenth."""
    rows = seqs(spark, d).select("ord", "accession", F.col("canonical_sequence").alias("seq"))
    good = rows.where("ord % 10 <> 0").select("ord", "accession", F.md5("seq").alias("md5"), F.lit(0).alias("k"))
    bad = good.where("ord % 13 = 0").select("ord", "accession", F.md5(F.concat("md5", F.lit("x"))), F.lit(1))
    index = readers.read_md5_index(spark, put(good.union(bad), scratch(spark, "md5"), ["accession", "md5"], ["ord", "k"]))
    return corpus.integrity(rows, index)


# ---- clusters, searches, removals --------------------------------------------------------------------------------


@query(f"""WITH {SEQS} SELECT CASE WHEN ord % 3 <> 0 THEN (ord - ord % 4)::VARCHAR ELSE ord::VARCHAR END AS cluster_id, count(*) AS n, sum(length)::BIGINT AS letters FROM seqs GROUP BY 1""")
def cluster_files(spark, d):
    """Clusters from a list of (representative, member) row numbers; a row that no cluster lists is its own."""
    rows = seqs(spark, d).select("ord", "length")
    listed = rows.where("ord % 3 <> 0").select((F.col("ord") - F.col("ord") % 4).alias("rep"), "ord")
    clusters = readers.read_clusters(spark, put(listed, scratch(spark, "clusters"), ["rep", "ord"], ["rep", "ord"]))
    return readers.with_clusters(rows, clusters, "ord").groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("length").alias("letters"))


@query(f"WITH {SEQS} SELECT rna_type, count(*) AS kept FROM seqs WHERE ord % 5 <> 2 GROUP BY 1")
def search_hits(spark, d):
    """Rows whose accession is not among the queries of a tabular search result with repeated lines."""
    rows = seqs(spark, d).select("ord", "accession", "rna_type")
    hits = rows.where("ord % 5 = 2").withColumn("target", F.explode(F.array(F.lit("t1"), F.lit("t2"))))
    found = readers.read_search_hits(spark, put(hits, scratch(spark, "hits"), ["accession", "target", F.lit("0.9")], ["accession", "target"]))
    return rows.join(found, rows["accession"] == found["query"], "left_anti").groupBy("rna_type").agg(F.count("*").alias("kept"))


@query(f"""WITH {SEQS}, g AS (SELECT * FROM seqs WHERE NOT (ord % 7 IN (0, 1, 2, 4) AND ord % 2 = 0)),
k AS (SELECT rna_type, canonical_sequence_hash FROM g QUALIFY row_number() OVER (PARTITION BY canonical_sequence_hash ORDER BY ord) = 1)
SELECT rna_type, count(*) AS kept, 3::BIGINT AS missing FROM k GROUP BY 1""")
def removed_lists(spark, d):
    """Rows left after the removals of four of five chunks, then one row for each sequence; the missing chunk is named."""
    rows, folder = seqs(spark, d), scratch(spark, "removed")
    for k in (0, 1, 2, 4):
        put(rows.where(f"ord % 7 = {k} AND ord % 2 = 0"), f"{folder}/removed_{k}.txt", ["ord"], ["ord"])
    removed = readers.read_removed(spark, f"{folder}/removed_*.txt")
    kept = corpus.keep_first(readers.without_removed(rows, removed, "ord"), ["canonical_sequence_hash"], ["ord"])
    missing = readers.missing_chunks(removed, 5).agg(F.sum("chunk").alias("missing"))  # one row
    return kept.groupBy("rna_type").agg(F.count("*").alias("kept")).crossJoin(missing)


# ---- Parquet, reports, hashes ------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT translate(upper(coalesce(lang, '') || regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS c, doc_id FROM documents),
s AS (SELECT CASE WHEN regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN substr(c, 3) ELSE c END, '[ACGU]*') THEN 'primary' ELSE 'ambiguous' END AS alphabet_status, doc_id FROM w)
SELECT alphabet_status, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM s GROUP BY 1""")
def alphabet_sinks(spark, d):
    """Records in two sinks by their alphabet, read back each on its own."""
    docs = table(spark, d, "documents")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTUacgtu]", "")
    seq = F.when(F.col("doc_id") % 2 == 0, letters).otherwise(F.concat(F.coalesce("lang", F.lit("")), letters))
    records = docs.select(F.col("doc_id").cast("string").alias("accession"), seq.alias("seq"), F.col("lang").alias("rna_type"))
    folder = scratch(spark, "alphabet")
    writers.write_by_alphabet(corpus.canonicalise(records), folder)
    parts = [spark.read.parquet(folder).where(F.col("alphabet_status") == k) for k in ("primary", "ambiguous")]
    both = parts[0].union(parts[1])
    return both.groupBy("alphabet_status").agg(F.count("*").alias("n"), F.sum(F.col("accession").cast("long")).alias("ids"))


@query(SQL["alphabet_sinks"])
def stream_two_sinks(spark, d):
    """The same as a stream into two tables."""
    docs = ingest.stream_table(spark, f"{d}/documents.parque[t]")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTUacgtu]", "")
    seq = F.when(F.col("doc_id") % 2 == 0, letters).otherwise(F.concat(F.coalesce("lang", F.lit("")), letters))
    folder = scratch(spark, "sinks")
    records = docs.select(F.col("doc_id").cast("string").alias("accession"), seq.alias("seq"), F.col("lang").alias("rna_type"))
    ingest.two_sinks(records, f"{folder}/primary", f"{folder}/ambiguous", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/primary").union(spark.read.parquet(f"{folder}/ambiguous"))
    return rows.groupBy("alphabet_status").agg(F.count("*").alias("n"), F.sum(F.col("accession").cast("long")).alias("ids"))


@query("SELECT count(*) AS n, sum(value) AS total, NULL::VARCHAR AS note FROM (SELECT round(value * 100)::BIGINT AS value FROM events)")
def table_and_report(spark, d):
    """A table written with a wider schema than its rows, and a report of it as JSON; the report is read back."""
    rows = table(spark, d, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.LongType()), T.StructField("note", T.StringType())])
    folder = scratch(spark, "table")
    writers.write_table(rows, schema, f"{folder}/rows")
    report = spark.read.parquet(f"{folder}/rows").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("note").alias("note"))
    writers.write_report(report, f"{folder}/report")
    return spark.read.schema("n long, total long, note string").json(f"{folder}/report")


@query(f"WITH {SEQS} SELECT release, count(*) AS n, count(CASE WHEN release = 2 THEN 1 END) AS extra FROM seqs WHERE release < 3 GROUP BY 1")
def matching_tables(spark, d):
    """Tables of three releases, one with a column more, read through a pattern."""
    rows, folder = seqs(spark, d).select("ord", "release"), scratch(spark, "releases")
    for k in range(4):
        one = rows.where(F.col("release") == k)
        (one.withColumn("extra", F.lit(1)) if k == 2 else one).write.parquet(f"{folder}/{'release' if k < 3 else 'other'}_{k}")
    return readers.read_matching(spark, f"{folder}/release_*").groupBy("release").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


@query("SELECT 1::BIGINT AS files, sum(length(r_name) + 1)::BIGINT AS bytes, sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS sha256 FROM region")
def file_sha256(spark, d):
    """Size and SHA-256 of a whole file (the names of the regions, a line each)."""
    folder = scratch(spark, "hash")
    put(table(spark, d, "region").coalesce(1), folder, ["r_name"], ["r_name"])
    return readers.file_hashes(spark, f"{folder}/part-*").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("sha256").alias("sha256"))


# ---- run folders -------------------------------------------------------------------------------------------------

_STAMPS = ("20260801T000000", "20260802T000000")


@query(f"""WITH {RUN_SQL}, c AS (SELECT arm, seed, count(*) AS n, min(val_loss) AS loss FROM run GROUP BY 1, 2)
SELECT arm, seed, 'phase4_' || arm || '_s' || seed || '_20260802T000000_restart' AS run_dir, true AS restarted, loss AS best_val_loss,
  list_aggregate(list_filter([CASE WHEN n * 1000 < 50000 THEN 'under_budget' END, CASE WHEN seed = 30 THEN 'no_checkpoint' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS faults FROM c""")
def manifest_scan(spark, d):
    """Manifests in run folders: names parsed, the last run of each cell by name, its faults."""
    cells = run_rows(spark, d).groupBy("arm", "seed").agg(F.count("*").alias("n"), F.min("val_loss").alias("loss"))
    folder = scratch(spark, "runs")
    for c in cells.collect():  # seven arms by three seeds
        for stamp, tail in zip(_STAMPS, ("", "_restart")):
            one = [(c.arm, c.seed, "DONE", c.n * 1000, c.loss if tail else None, None if c.seed == 30 else "best.pt", c.n, 0, (50_000, 64))]
            schema = "arm string, seed int, status string, final_nt long, best_val_loss double, best_checkpoint string, params long, cpu_fallback_count int, config struct<budget_nt: long, batch_nt: long>"
            spark.createDataFrame(one, schema).coalesce(1).write.json(f"{folder}/phase4_{c.arm}_s{c.seed}_{stamp}{tail}")
    spark.createDataFrame([("x",)], "arm string").coalesce(1).write.json(f"{folder}/notes_of_a_run")
    rows = readers.read_manifests(spark, f"{folder}/*/*.json").withColumn("budget_nt", F.col("config.budget_nt"))
    named = rows.withColumnsRenamed({"arm": "own_arm", "seed": "own_seed"}).select("*", *runs.parse_run_name(F.col("run_dir"))).where("arm is not null")
    last = runs.latest_run(named, ["arm", "seed"])
    faulty = last.withColumnsRenamed({"arm": "a", "seed": "s"}).withColumnsRenamed({"own_arm": "arm", "own_seed": "seed"})
    faulty = faulty.withColumn("faults", F.array_join(runs.issues(F.col("a"), F.col("s")), ","))
    return faulty.select(F.col("a").alias("arm"), F.col("s").alias("seed"), "run_dir", "restarted", "best_val_loss", F.nullif("faults", F.lit("")).alias("faults"))


@query(f"""WITH {RUN_SQL}, c AS (SELECT arm, seed, min(val_loss) FILTER (WHERE status = 'DONE' AND seed <> 30) AS v FROM run GROUP BY 1, 2) SELECT arm, round(avg(v), 8) AS mean, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1""")
def finished_means(spark, d):
    """Mean per arm over the cells that have a finished value."""
    done = F.when((F.col("status") == "DONE") & (F.col("seed") != 30), F.col("val_loss"))
    cells = run_rows(spark, d).groupBy("arm", "seed").agg(F.min(done).alias("v"))
    return runs.finished_means(cells, "v").withColumn("mean", F.round("mean", 8))


# ---- streams -----------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_polling(spark, d):
    """Counts by a stream that polls at an interval, as a daemon would, until all that is there has been taken."""
    events = ingest.stream_table(spark, f"{d}/events.parque[t]").groupBy("event_type").agg(F.count("*").alias("n"))
    return streamed(spark, events, "complete", poll="1 second")


__all__ = ["QUERIES", "SQL"]
