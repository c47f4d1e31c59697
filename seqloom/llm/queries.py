"""The corpus queries op1 to op13, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .language_id import language_report
from .line_dedup import line_report
from .merkle import manifest_report
from .mixing import mix_report
from .packing import pack_documents
from .phrases import collocations
from .quality import quality_report
from .secret_scan import secret_report
from .simhash_dedup import near_copies
from .suffix_dedup import repeat_report
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are sources by language, owners are sources."""
    docs = table(spark, sf_dir, "documents")
    return secret_report(docs, F.concat_ws("/", docs["source"], docs["lang"]), docs["source"])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_source_mixing,
        op3_suffix_array_dedup,
        op4_best_fit_packing,
        op5_simhash_near_dedup,
        op6_exact_dedup,
        op7_secret_scan,
        op8_quality_classifier,
        op9_token_counts,
        op10_line_dedup,
        op11_language_id,
        op12_phrase_collocations,
        op13_merkle_manifest,
    )
}

_Z = "list_sum([x ** {a} for x in p])"
_ENTROPY = f"((ln({_Z}) - {{a}} * list_sum([x ** {{a}} * ln(x) for x in p]) / {_Z}) / ln(len(p)))"
_REPEATS = f"(list_max([x ** {{a}} / x for x in p]) / {_Z})"


def _bisect(name: str, good: str) -> str:
    """A recursive table that bisects [0, 1] fifty times for a condition on {a}."""
    return f"""{name}(step, lo, hi) AS (
          SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
          SELECT step + 1, CASE WHEN g THEN mid ELSE lo END, CASE WHEN g THEN hi ELSE mid END
          FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, {good.format(a='((lo + hi) / 2)')} AS g FROM {name}, one WHERE step < 50))"""


def _digits(parts: str) -> str:
    return f"('0x' || substr(sha256('mix-1|' || {parts}), 1, 8))::BIGINT"


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(list_reduce([4294967295::UBIGINT] || [ord(c)::UBIGINT for c in string_split({text}, '')],
             lambda s, b: list_reduce([xor(s, b)] || [0::UBIGINT for z in range(8)],
             lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


SQL = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        l AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op2_source_mixing": rf"""
        WITH RECURSIVE r AS (
          SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                 coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS ident FROM documents),
        s AS (SELECT source, count(*) AS n_rows, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY source),
        one AS (SELECT list(tokens / total ORDER BY source) AS p, any_value(total)::BIGINT AS total
                FROM (SELECT source, tokens, sum(tokens) OVER () AS total FROM s WHERE tokens > 0)),
        {_bisect("even", _ENTROPY + " >= 0.95")},
        {_bisect("spare", _REPEATS + " > 2.0")},
        ex AS (SELECT total, p, round(greatest(
                 CASE WHEN len(p) < 2 OR {_ENTROPY.format(a='1.0')} >= 0.95 THEN 1.0 ELSE (SELECT lo FROM even WHERE step = 50) END,
                 CASE WHEN {_REPEATS.format(a='0.0')} <= 2.0 THEN 0.0 WHEN {_REPEATS.format(a='1.0')} > 2.0 THEN 1.0 ELSE (SELECT lo FROM spare WHERE step = 50) END), 9) AS a FROM one),
        w AS (SELECT source, n_rows, tokens, CASE WHEN tokens > 0 THEN round((tokens / total) ** a / list_sum([x ** a for x in p]), 9) ELSE 0 END AS weight, total FROM s, ex),
        plan AS (SELECT source, weight, tokens, ceil(n_rows / 2048.0)::BIGINT AS n_blocks,
                        CASE WHEN tokens > 0 THEN floor(weight * total)::BIGINT // tokens ELSE 0 END AS whole, floor(weight * total)::BIGINT AS budget FROM w),
        dealt AS (SELECT r.*, weight, whole, budget - whole * tokens AS rest, {_digits("'block|' || ident")} % n_blocks AS block FROM r JOIN plan USING (source)),
        sums AS (SELECT source, block, any_value(whole) AS whole, any_value(rest) AS rest, sum(n_tokens)::BIGINT AS inside FROM dealt GROUP BY source, block),
        ahead AS (SELECT *, coalesce(sum(inside) OVER (PARTITION BY source ORDER BY {_digits("'order|' || source || '|' || whole || '|' || block")}, block
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums),
        last AS (SELECT d.*, a.before + coalesce(sum(d.n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY {_digits("'row|' || d.whole || '|' || ident")}, ident
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, a.before + inside <= a.rest AS fits
                 FROM dealt d JOIN ahead a ON a.source = d.source AND a.block = d.block WHERE a.before < a.rest)
        SELECT doc_id, source, e::INT AS epoch, block, n_tokens, weight FROM dealt, unnest(range(0, whole)) AS u(e)
        UNION ALL SELECT doc_id, source, whole::INT, block, n_tokens, weight FROM last WHERE fits OR seen < rest""",
    "op6_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op10_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
          SELECT doc_id, pos, line,
                 translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (
          SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id""",
    "op12_phrase_collocations": r"""
        WITH pieces AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        f AS (
          SELECT lang, p, count(*) AS n FROM (
            SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS p FROM pieces, range(1, 5) AS u(k) WHERE len(w) >= k)
          GROUP BY lang, p HAVING count(*) >= 30),
        c AS (SELECT lang, p, n AS a FROM f WHERE len(p) > 1),
        cuts AS (
          SELECT c.lang, c.p, c.a, k, l.n AS l, r.n AS r, ((2000000::HUGEINT * c.a) // (l.n + r.n))::BIGINT AS score
          FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c
          JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k)
          JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, len(c.p))),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        held AS (
          SELECT lang, part, max(a) AS longer FROM (
            SELECT lang, a, unnest(list_transform(range(1, len(p) - k + 2), lambda i: list_slice(p, i, i + k - 1))) AS part FROM c, range(2, 4) AS u(k) WHERE len(p) > k)
          GROUP BY lang, part),
        ranked AS (
          SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score
          FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.part = w.p WHERE h.longer IS NULL OR 100 * h.longer::HUGEINT < 80 * a::HUGEINT)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
          SELECT row_number() OVER () AS id, doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
                 CASE WHEN doc_id IS NOT NULL AND {_CRC.format(text="doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
        nodes(tree, level, i, n, d) AS (
          SELECT tree, 0, i, n, leaf FROM placed UNION ALL
          SELECT tree, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3),
        subroots AS (SELECT tree, d, level AS high, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        above(level, i, n, d) AS (
          SELECT 0, i, n, d FROM subroots UNION ALL
          SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 3),
        siblings AS (
          SELECT id, 0 AS part, level, s.i, s.d FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.i // 3 = p.i // (3 ** (level + 1))::BIGINT AND s.i <> p.i // (3 ** level)::BIGINT
          UNION ALL
          SELECT id, 1, level, s.i, s.d FROM placed p JOIN subroots r USING (tree) JOIN above s ON s.n > 1 AND s.i // 3 = r.i // (3 ** (level + 1))::BIGINT AND s.i <> r.i // (3 ** level)::BIGINT),
        proofs AS (SELECT id, string_agg(d, '' ORDER BY part, level, i) AS proof FROM siblings GROUP BY id),
        low(id, tree, level, i, n, d) AS (
          SELECT id, tree, 0, i, n, coalesce(changed, leaf) FROM placed UNION ALL
          SELECT l.id, any_value(l.tree), l.level + 1, any_value(l.i) // 3, (any_value(l.n) + 2) // 3, sha256(string_agg(CASE WHEN s.i = l.i THEN l.d ELSE s.d END, '' ORDER BY s.i))
          FROM low l JOIN nodes s ON s.tree = l.tree AND s.level = l.level AND s.i // 3 = l.i // 3 WHERE l.n > 1 GROUP BY l.id, l.level),
        high(id, level, i, n, d) AS (
          SELECT l.id, 0, r.i, r.n, l.d FROM low l JOIN subroots r USING (tree) WHERE l.n = 1 UNION ALL
          SELECT l.id, l.level + 1, any_value(l.i) // 3, (any_value(l.n) + 2) // 3, sha256(string_agg(CASE WHEN s.i = l.i THEN l.d ELSE s.d END, '' ORDER BY s.i))
          FROM high l JOIN above s ON s.level = l.level AND s.i // 3 = l.i // 3 WHERE l.n > 1 GROUP BY l.id, l.level)
        SELECT p.doc_id, p.leaf, r.d AS subroot, a.d AS root, sha256(coalesce(proof, '')) AS proof_sha256, h.d AS folded_root, h.d = a.d AS verified
        FROM placed p JOIN subroots r USING (tree) JOIN (SELECT d FROM above WHERE n = 1) a ON true LEFT JOIN proofs USING (id) JOIN (SELECT id, d FROM high WHERE n = 1) h USING (id)""",
}
