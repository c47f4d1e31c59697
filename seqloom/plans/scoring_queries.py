"""Queries of token-level scores, codec diagnostics, boundaries and small functions; the SQL folds and draws say the same step by step."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..functions import tokenizers as K
from ..operators import arms, coding, corpus, letters, scans, scoring, segments
from ..operators.homology import checkpointed
from ..views import SEQS, seqs, table
from .catalog import BASE4, CLUSTERED, ENTROPY_SQL, MARKOV, Q_PREFIX, QUERIES, RATIOS, SQL, UNIQUE, VOCAB, bpe_merges, clustered, markov_probs, parted, query

# ---- scores of arms ----------------------------------------------------------------------------------------------

MARKED = f"""{UNIQUE},
mk AS (SELECT ord, source_database, part, CASE WHEN ord % 50 = 0 THEN 'N' || canonical_sequence ELSE canonical_sequence END AS s0 FROM parted),
tr AS (SELECT ord, source_database, part, s0 LIKE 'N%' AS invalid, s0 NOT LIKE 'N%' AND length(s0) > 4096 AS cut, CASE WHEN s0 LIKE 'N%' THEN '' ELSE substr(s0, 1, 4096) END AS s FROM mk)"""


def marked(spark, d):
    """Training and held-out sequences cut to 4,096 letters; each fiftieth document starts with a letter outside the alphabet."""
    seq = F.when(F.col("ord") % 50 == 0, F.concat(F.lit("N"), "canonical_sequence")).otherwise(F.col("canonical_sequence"))
    return [scoring.truncated(x.withColumn("canonical_sequence", seq)) for x in parted(spark, d)]


def _letters_sql(name: str, k: int) -> str:
    return f"""
{name}_at AS (SELECT ord, part, substr(s, greatest(0, i - {k - 1}) + 1, i - greatest(0, i - {k - 1})) AS ctx, substr(s, i + 1, 1) AS sym FROM tr, unnest(range(0, length(s))) AS u(i)),
{name}_c AS (SELECT ctx, sym, count(*) AS c FROM {name}_at WHERE part = 'train' GROUP BY 1, 2), {name}_n AS (SELECT ctx, sum(c) AS n FROM {name}_c GROUP BY 1),
{name} AS (SELECT ord, sum(-log2((coalesce(c, 0) + 1) / (coalesce(n, 0) + 4))) AS b FROM {name}_at LEFT JOIN {name}_c USING (ctx, sym) LEFT JOIN {name}_n USING (ctx) WHERE part = 'holdout' GROUP BY 1)"""


def _patches_sql(name: str, size: int) -> str:
    """Letters given those before them in a patch of so many."""
    return f"""
{name}_at AS (SELECT ord, part, substr(s, i - i % {size} + 1, i % {size}) AS ctx, substr(s, i + 1, 1) AS sym FROM tr, unnest(range(0, length(s))) AS u(i)),
{name}_c AS (SELECT ctx, sym, count(*) AS c FROM {name}_at WHERE part = 'train' GROUP BY 1, 2), {name}_n AS (SELECT ctx, sum(c) AS n FROM {name}_c GROUP BY 1),
{name} AS (SELECT ord, sum(-log2((coalesce(c, 0) + 1) / (coalesce(n, 0) + 4))) AS b FROM {name}_at LEFT JOIN {name}_c USING (ctx, sym) LEFT JOIN {name}_n USING (ctx) WHERE part = 'holdout' GROUP BY 1)"""


def _tokens_sql(name: str, tokens: str, vocabulary: int) -> str:
    return f"""
{name}_l AS (SELECT ord, part, {tokens} AS l FROM tr),
{name}_t AS (SELECT ord, part, l[i] AS token, CASE WHEN i = 1 THEN '' ELSE l[i - 1] END AS ctx FROM {name}_l, unnest(range(1, len(l) + 1)) AS u(i)),
{name}_c AS (SELECT ctx, token, count(*) AS c FROM {name}_t WHERE part = 'train' GROUP BY 1, 2), {name}_n AS (SELECT ctx, sum(c) AS n FROM {name}_c GROUP BY 1),
{name} AS (SELECT ord, sum(-log2((coalesce(c, 0) + 1) / (coalesce(n, 0) + {vocabulary}))) AS b FROM {name}_t LEFT JOIN {name}_c USING (ctx, token) LEFT JOIN {name}_n USING (ctx) WHERE part = 'holdout' GROUP BY 1)"""


ROUNDED = {"nll_bits_sum": 5, "nll_nats_sum": 5, "bpn": 8}


@query(f"""WITH {MARKED}{VOCAB[len(UNIQUE):]}, alts AS (SELECT '(' || string_agg(token, '|' ORDER BY length(token) DESC, token) || '|A|C|G|U)' AS re FROM vocab),
{_letters_sql('f1', 2)}, {_tokens_sql('f3', 'regexp_extract_all(s, (SELECT re FROM alts))', 1024)}, {_letters_sql('f4', 3)}, {_letters_sql('f5', 6)},
{_tokens_sql('f6', "regexp_extract_all(s, '[ACGU]{1,3}')", 84)}, {_tokens_sql('f7', "regexp_extract_all(s, '[ACGU]{1,6}')", 5460)}, {_patches_sql('p1', 6)},
am AS (SELECT unnest(['F1', 'F3', 'F4', 'F5', 'F6', 'F7', 'P1']) AS arm,
              unnest(['next_base_BPN', 'canonical_path_BPN', 'overlap_path_BPN', 'overlap_path_BPN', 'canonical_path_BPN', 'canonical_path_BPN', 'next_base_BPN']) AS metric),
sc AS ({' UNION ALL '.join(f"SELECT '{x.upper()}' AS arm, ord, b FROM {x}" for x in ('f1', 'f3', 'f4', 'f5', 'f6', 'f7', 'p1'))})
SELECT a.arm, 'holdout' AS split, a.metric, count(*) AS n_sequences, count(*) FILTER (WHERE invalid) AS n_invalid, count(*) FILTER (WHERE cut) AS n_truncated,
  round(sum(coalesce(b, 0)), 5) AS nll_bits_sum, round(sum(coalesce(b, 0)) * ln(2), 5) AS nll_nats_sum, sum(length(s))::BIGINT AS valid_nt_count,
  round(sum(coalesce(b, 0)) / greatest(1, sum(length(s))), 8) AS bpn
FROM tr CROSS JOIN am a LEFT JOIN sc ON sc.arm = a.arm AND sc.ord = tr.ord WHERE part = 'holdout' GROUP BY 1, 2, 3""")
def score_arms(spark, d):
    """Letters, overlapping and disjoint k-mers, unigram tokens and fixed patches, each by its own metric over the same sequences."""
    train, rows = marked(spark, d)
    vocabulary = [r.token for r in QUERIES["unigram_vocab"](spark, d).collect()]  # 1,020 tokens
    out = scoring.score_arms(train, rows, "ord", ["F1", "F3", "F4", "F5", "F6", "F7", "P1"], "holdout", vocabulary=vocabulary)
    return out.withColumns({c: F.round(c, n) for c, n in ROUNDED.items()})


@query()
def score_fitted_arms(spark, d):
    """The same for merged pairs, and patches drawn at random and by entropy; tests hold the sums against a plain version."""
    # each arm reads both tables several times
    train, rows = (checkpointed(x.select("ord", "canonical_sequence", "invalid", "truncated")) for x in marked(spark, d))
    out = scoring.score_arms(train, rows, "ord", ["F2", "P2", "P3"], "holdout", merges=bpe_merges(spark, d))
    return out.withColumns({c: F.round(c, n) for c, n in ROUNDED.items()})


@query(f"""WITH {UNIQUE},
tl AS (SELECT ord, regexp_extract_all(canonical_sequence, '[ACGU]{{1,3}}') AS l FROM parted WHERE part = 'train'),
tk AS (SELECT l[i] AS token, CASE WHEN i = 1 THEN '' ELSE l[i - 1] END AS ctx FROM tl, unnest(range(1, len(l) + 1)) AS u(i)),
tc AS (SELECT ctx, token, count(*) AS c FROM tk GROUP BY 1, 2), tn AS (SELECT ctx, sum(c) AS n FROM tc GROUP BY 1),
e AS (SELECT ord, ratio, length, canonical_sequence AS s, (6 * floor(length * ratio / 6))::BIGINT AS p FROM parted, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5]) AS ratio) WHERE part = 'holdout'),
ok AS (SELECT * FROM e WHERE p > 0 AND p < length UNION ALL SELECT ord, 0.0, length, canonical_sequence, 0 FROM parted WHERE part = 'holdout'),
sp AS (SELECT ord, ratio, length - p AS nt, regexp_extract_all(substr(s, 1, p::INT), '[ACGU]{{1,3}}') AS a, regexp_extract_all(substr(s, p::INT + 1), '[ACGU]{{1,3}}') AS z FROM ok WHERE p > 0 AND p < length),
st AS (SELECT ord, ratio, nt, z[i] AS token, CASE WHEN i = 1 THEN a[-1] ELSE z[i - 1] END AS ctx FROM sp, unnest(range(1, len(z) + 1)) AS u(i)),
bt AS (SELECT ord, ratio, count(*) FILTER (WHERE c IS NULL) > 0 AS inf, sum(-log2(c / n)) / any_value(nt) AS bpn FROM st LEFT JOIN tc USING (ctx, token) LEFT JOIN tn USING (ctx) GROUP BY 1, 2)
SELECT ok.ratio, count(*) AS n, count(*) FILTER (WHERE p = 0) AS n_nan, count(*) FILTER (WHERE inf) AS n_inf, round(avg(bpn) FILTER (WHERE NOT inf), 8) AS mean_bpn
FROM ok LEFT JOIN bt ON bt.ord = ok.ord AND bt.ratio = ok.ratio GROUP BY 1""")
def suffix_token_length(spark, d):
    """Code length of true suffixes through disjoint 3-mers, unsmoothed; cuts at 0 are no cuts and give NaN."""
    train, holdout = parted(spark, d)
    blocks = lambda c: K.block_tokens(c, 3)
    model = scoring.token_model(scoring.token_steps(train, ["ord"], blocks(F.col("canonical_sequence"))))
    columns = ["ord", "ratio", "canonical_sequence", "prefix_len"]
    none = holdout.select("ord", F.lit(0.0).alias("ratio"), "canonical_sequence", F.lit(0).cast("long").alias("prefix_len"))
    per = scoring.suffix_code_length(corpus.cuts(holdout, RATIOS).select(*columns).union(none), ["ord", "ratio"], blocks, model, 84)
    infinite = F.col("bpn") == float("inf")
    return per.groupBy("ratio").agg(
        F.count("*").alias("n"), F.count_if(F.isnan("bpn")).alias("n_nan"), F.count_if(infinite).alias("n_inf"),
        F.round(F.avg(F.when(~infinite & ~F.isnan("bpn"), F.col("bpn"))), 8).alias("mean_bpn"),
    )


# ---- codec -------------------------------------------------------------------------------------------------------

# four symbols: floors of the shares of 2^24 - 4, the rest to the largest remainders, one more for each symbol
CDF_PARTS = """sy AS (SELECT t.ctx, s.s AS sym, instr('ACGU', s.s) - 1 AS id, (coalesce(c, 0) + 1) / (n + 4) AS p FROM {n} t CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'U']) AS s) s LEFT JOIN {c} cn ON cn.ctx = t.ctx AND cn.sym = s.s),
sh AS (SELECT *, p / sum(p) OVER (PARTITION BY ctx) * 16777212 AS share FROM sy),
fl AS (SELECT *, floor(share)::BIGINT AS f, row_number() OVER (PARTITION BY ctx ORDER BY floor(share) - share, id) AS rk, 16777212 - sum(floor(share)::BIGINT) OVER (PARTITION BY ctx) AS short FROM sh),
fr AS (SELECT ctx, sym, id, p, f + (rk <= short)::INT + 1 AS freq FROM fl)"""
CDF_SQL = f"{MARKOV.format(unique=UNIQUE, k=2)}, {CDF_PARTS.format(c='cnt', n='tot')}"

SQL["quantized_cdf"] = f"""WITH {CDF_SQL},
cu AS (SELECT *, sum(freq) OVER (PARTITION BY ctx ORDER BY id) AS top FROM fr)
SELECT ctx, '0,' || string_agg(top::BIGINT::VARCHAR, ',' ORDER BY id) AS cdf, round(-log2(max(freq) FILTER (WHERE id = 0) / 16777216.0), 9) AS bits_of_a,
  count(*) FILTER (WHERE top <= 8388608)::INT AS middle FROM cu GROUP BY 1"""


DIAGNOSED = """su AS (SELECT source_database, sum(coalesce(b, 0)) AS b, sum(coalesce(q, 0)) AS q, sum(length(s))::BIGINT AS nt, count(*) AS n, count(*) FILTER (WHERE invalid) AS bad, count(*) FILTER (WHERE cut) AS cut
       FROM tr LEFT JOIN bt USING (ord) WHERE part = 'holdout' GROUP BY 1)
SELECT source_database, 0 AS coded_bits, round(q, 5) AS quantized_nll_bits, round(b, 5) AS canonical_nll_bits, round(b, 5) AS next_base_nll_bits, nt AS valid_nt, 0 AS eos_nll, n AS sequence_count,
  n AS attempted_count, 0 AS decoded_count, n - bad AS valid_count, bad AS invalid_count, 0 AS early_eos_count, cut AS truncation_count, 0 AS overshoot_count, 0 AS illegal_transition_mass,
  (CASE WHEN nt > 0 THEN 0.0 ELSE -1 END)::DOUBLE AS canonical_code_length_bpn, CASE WHEN nt > 0 THEN round(b / nt, 8) ELSE -1 END AS canonical_code_nll_bpn,
  CASE WHEN nt > 0 THEN round(q / nt, 8) ELSE -1 END AS quantized_cdf_nll_bpn, CASE WHEN nt > 0 THEN round(b / nt, 8) ELSE -1 END AS next_base_bpn FROM su"""


@query(f"""WITH {CDF_SQL}, {MARKED[len(UNIQUE) + 1 :]},
ps AS (SELECT ord, substr(s, i - 1, 2) AS ctx, i, substr(s, i + 1, 1) AS sym FROM tr, unnest(range(0, length(s))) AS u(i) WHERE part = 'holdout'),
bt AS (SELECT ord, sum(CASE WHEN i >= 2 THEN coalesce(-log2(p), 2) ELSE 2 END) AS b, sum(CASE WHEN i >= 2 THEN coalesce(-log2(freq / 16777216.0), 2) ELSE 2 END) AS q
       FROM ps LEFT JOIN fr ON i >= 2 AND fr.ctx = ps.ctx AND fr.sym = ps.sym GROUP BY 1),
{DIAGNOSED}""")
def codec_diagnostics(spark, d):
    """Fifteen counters and four ratios of each source without coding a stream (a ratio without letters is -1 here)."""
    tables = coding.quantised(markov_probs(spark, d))
    return _diagnosed(scoring.diagnostic_sums(marked(spark, d)[1], tables, "ord", 2))


def _diagnosed(rows):
    out = scoring.codec_sums(rows, ["source_database"])
    sums = {c: F.round(c, 5) for c in ("quantized_nll_bits", "canonical_nll_bits", "next_base_nll_bits")}
    ratios = {c: F.round(F.when(F.isnan(c), -1.0).otherwise(F.col(c)), 8) for c in ("canonical_code_length_bpn", "canonical_code_nll_bpn", "quantized_cdf_nll_bpn", "next_base_bpn")}
    return out.withColumns(sums | ratios)


@query(f"""WITH {MARKED}, {_patches_sql('p1', 6)}, {CDF_PARTS.format(c='p1_c', n='p1_n')},
bt AS (SELECT ord, sum(coalesce(-log2(p), 2)) AS b, sum(coalesce(-log2(freq / 16777216.0), 2)) AS q FROM p1_at LEFT JOIN fr USING (ctx, sym) WHERE part = 'holdout' GROUP BY 1), {DIAGNOSED}""")
def patch_diagnostics(spark, d):
    """The same counters for fixed patches of six, each letter given those before it in its patch."""
    train, rows = marked(spark, d)
    return _diagnosed(scoring.patch_diagnostics(train, rows, "ord", segments.fixed_boundaries(F.length("canonical_sequence"), 6)))


# ---- ids and draws -----------------------------------------------------------------------------------------------

CRC = """tab AS (SELECT [list_reduce([c::UBIGINT] || [0::UBIGINT for i in range(8)], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) for c in range(256)] AS t),
crc AS (SELECT ord, canonical_sequence, length, CASE WHEN length = 0 THEN 0 ELSE xor(list_reduce([4294967295::UBIGINT] || [ord(c)::UBIGINT for c in string_split(canonical_sequence, '')],
        lambda x, y: xor(x >> 8, t[((xor(x, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) END AS seq_id FROM {rows}, tab)"""
#: dr: the columns of {rows} and the SplitMix64 draw of (seq_id, pos).
DRAW = """sm0 AS (SELECT *, xor(xor(seq_id::UBIGINT * 4294967296, 20260815::UBIGINT), pos::UBIGINT) AS x FROM {rows}),
sm1 AS (SELECT * REPLACE (((x::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM sm0),
sm2 AS (SELECT * REPLACE (((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM sm1),
sm3 AS (SELECT * REPLACE (((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x) FROM sm2),
dr AS (SELECT * EXCLUDE (x), (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS draw FROM sm3)"""

SQL["sequence_ids"] = f"WITH {SEQS}, {CRC.format(rows='seqs')}, ps AS (SELECT ord, seq_id, 7 AS pos FROM crc), {DRAW.format(rows='ps')} SELECT ord, seq_id::BIGINT AS seq_id, draw FROM dr"

# ---- boundaries --------------------------------------------------------------------------------------------------

# a fold over each sequence's entropies: the sum since the last boundary, and the boundaries so far as a string
GATED = f"""{ENTROPY_SQL}, gt AS (SELECT 6 * avg(entropy) AS gate FROM ent), ls AS (SELECT ord, list(entropy ORDER BY pos) AS e FROM ent GROUP BY 1),
fo AS (SELECT ord, e, list_reduce([{{'s': 'inf'::DOUBLE, 'b': '', 'e': 0::DOUBLE}}] || [{{'s': 0::DOUBLE, 'b': '', 'e': x}} for x in e],
       lambda a, b: {{'s': (CASE WHEN a.s >= gate THEN 0 ELSE a.s END) + b.e, 'b': a.b || (CASE WHEN a.s >= gate THEN '1' ELSE '0' END), 'e': 0::DOUBLE}}).b AS b FROM ls, gt)"""

SQL["entropy_patch"] = f"WITH {GATED} SELECT ord, (length(b) - length(replace(b, '1', '')))::BIGINT AS patches, length(b)::BIGINT AS letters FROM fo"

AUDIT = f"""{GATED}, ga AS (SELECT ord, i AS pos, e[i + 1] AS entropy, substr(b, i + 1, 1)::INT AS boundary FROM fo, unnest(range(0, len(e))) AS u(i)),
qe AS (SELECT quantile_cont(entropy, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS q FROM ga), ed AS (SELECT list_concat(q[1:8], [q[9] + 1e-9]) AS edges FROM qe),
bn AS (SELECT ga.*, greatest(0, least(len(list_filter({Q_PREFIX}, lambda x: x <= pos)) - 1, 3)) AS pb, greatest(0, least(len(list_filter(edges, lambda x: x <= entropy)) - 1, 7)) AS eb FROM ga, ed),
qt AS (SELECT pb, eb, count(*) AS n, sum(boundary) AS bs, sum(boundary) / count(*) AS q, sum(boundary) / count(*) BETWEEN 0.05 AND 0.95 AS ok FROM bn GROUP BY 1, 2),
{CRC.format(rows='uniq')}, jo AS (SELECT bn.*, q, ok, seq_id, length FROM bn JOIN qt USING (pb, eb) JOIN crc USING (ord)), {DRAW.format(rows='jo')},
pr AS (SELECT *, CASE WHEN pos = 0 THEN 1 WHEN ok THEN (draw < q)::INT ELSE boundary END AS drawn FROM dr)"""

SQL["balance_audit"] = f"""WITH {AUDIT}, t AS (SELECT sum(drawn)::BIGINT AS drawn, sum(boundary)::BIGINT AS given FROM pr),
g AS (SELECT drawn, given, abs(drawn - given) / greatest(1, given) * 100 AS e FROM t),
s AS (SELECT max(abs(coalesce(d, 0) - coalesce(b, 0)) / greatest(1, coalesce(b, 0)) * 100) <= 2 AS ok FROM unnest(range(0, 5)) AS u(k) LEFT JOIN (
  SELECT CASE WHEN length BETWEEN 16 AND 127 THEN 0 WHEN length BETWEEN 128 AND 511 THEN 1 WHEN length BETWEEN 512 AND 2047 THEN 2 WHEN length BETWEEN 2048 AND 4096 THEN 3 WHEN length BETWEEN 4097 AND 16384 THEN 4 END AS k,
         sum(drawn) AS d, sum(boundary) AS b FROM pr GROUP BY 1) x USING (k)),
r AS (SELECT coalesce(max(pp), 0) <= 2 AS ok FROM (SELECT abs(sum(drawn) - sum(boundary)) / count(*) * 100 AS pp FROM pr GROUP BY pb, eb)),
f AS (SELECT count(*) FILTER (WHERE pos > 0 AND NOT ok AND drawn <> boundary) AS n FROM pr),
c AS (SELECT sum(CASE WHEN ok THEN n ELSE 0 END) / greatest(1, sum(n)) >= 0.8 AND sum(CASE WHEN ok THEN bs ELSE 0 END) / greatest(1, sum(bs)) >= 0.8 AS ok FROM qt)
SELECT drawn, given, e <= 0.5 AS gate_total, e <= 5 AS gate_flops, s.ok AS gate_strata, r.ok AS gate_rates, f.n AS replay_failures, f.n = 0 AS gate_replay, c.ok AS gate_coverage,
  e <= 0.5 AND e <= 5 AND s.ok AND r.ok AND f.n = 0 AND c.ok AS all_pass FROM g, s, r, f, c"""


# ---- batches -----------------------------------------------------------------------------------------------------


@query(f"""WITH {SEQS}, l AS (SELECT list(length ORDER BY ord) AS x FROM seqs),
f AS (SELECT x, list_reduce([{{'n': 0::BIGINT, 'm': 0::BIGINT, 'k': 0::BIGINT, 'o': []::BIGINT[]}}] || [{{'n': 0::BIGINT, 'm': v, 'k': 0::BIGINT, 'o': []::BIGINT[]}} for v in x],
  lambda a, b: CASE WHEN a.n > 0 AND (a.n + 1) * greatest(a.m, b.m) > 16384 THEN {{'n': 1::BIGINT, 'm': b.m, 'k': a.k + 1, 'o': list_append(a.o, a.k + 1)}}
                    ELSE {{'n': a.n + 1, 'm': greatest(a.m, b.m), 'k': a.k, 'o': list_append(a.o, a.k)}} END).o AS o FROM l),
r AS (SELECT unnest(x) AS length, unnest(o) AS batch FROM f)
SELECT batch, count(*) AS n, max(length) AS longest FROM r GROUP BY 1""")
def budget_batches(spark, d):
    """Batches of at most 16,384 letters (rows times the longest) over all sequences in order."""
    rows = seqs(spark, d).select("ord", "length")
    out, _ = scans.resetting_scan(rows, ["ord"], lambda batch: [[x] for x in batch.column(1).to_pylist()], scans.budget_rule(16_384))
    return out.groupBy(F.col("number").alias("batch")).agg(F.count("*").alias("n"), F.max("length").alias("longest"))


@query()
def calibrated_patches(spark, d):
    """The gate for patches of six letters on average, and the lengths of the patches that it cuts from all training sequences as one stream."""
    train = parted(spark, d)[0]
    counts = letters.letter_counts(train, 2)
    gate = 6 * letters.mean_entropy(train, counts, 2)
    sizes = letters.stream_patches(train.select("ord", "canonical_sequence"), ["ord"], counts, 2, gate)
    total = sizes.agg(F.sum("n").alias("patches"), F.sum(F.col("n") * F.col("length")).alias("nt"))
    out = sizes.crossJoin(total)  # one row
    return out.select("length", "n", F.round(F.col("n") / F.col("patches"), 9).alias("share"), F.round(F.col("nt") / F.col("patches"), 9).alias("mean_length"), F.round(F.lit(gate), 8).alias("gate"))


# ---- tokens ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SEQS}, o AS (SELECT CASE WHEN length > 0 THEN rpad(canonical_sequence, greatest(length, 3)::INT, 'A') ELSE '' END AS s FROM seqs),
ot AS (SELECT substr(s, i, 3) AS token FROM o, unnest(range(1, length(s) - 1)) AS u(i) WHERE length(s) >= 3),
bt AS (SELECT unnest(regexp_extract_all(canonical_sequence, '[ACGU]{{1,3}}')) AS token FROM seqs),
x AS (SELECT 'nonoverlap_mer' AS tokenizer, sum((CASE length(token) WHEN 3 THEN 0 WHEN 2 THEN 68 ELSE 64 END + {BASE4.format('token')})::BIGINT)::BIGINT AS ids FROM bt
      UNION ALL SELECT 'overlap_mer', sum({BASE4.format('token')}::BIGINT)::BIGINT FROM ot UNION ALL SELECT 'NUC', sum(instr('ACGU', c) - 1)::BIGINT FROM (SELECT unnest(string_split(canonical_sequence, '')) AS c FROM seqs WHERE length > 0))
SELECT tokenizer, ids, (SELECT count(*) FROM seqs) AS n, 0::BIGINT AS bad FROM x""")
def token_decode(spark, d):
    """Ids of each tokenizer's tokens, decoded again; an overlapping input shorter than k comes back filled up."""
    c = F.col("canonical_sequence")
    rows = seqs(spark, d).select("ord", c, K.overlap_tokens(c, 3).alias("o"), K.block_tokens(c, 3).alias("b"), K.nuc_tokens(c).alias("l"))
    rows = rows.select(c, *[F.transform(x, f).alias(x) for x, f in (("o", K.base4), ("b", lambda t: K.block_id(t, 3)), ("l", K.base4))])
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, i: s + i)
    filled = F.when(F.length(c) > 0, F.rpad(c, F.greatest(F.length(c), F.lit(3)), "A")).otherwise("")
    kinds = [
        ("overlap_mer", "o", K.overlap_decode(F.col("o"), 3) == filled),
        ("nonoverlap_mer", "b", K.block_decode(F.col("b"), 3) == c),
        ("NUC", "l", K.listed_decode(F.col("l"), list(S.ALPHABET)) == c),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), total(F.col(x)).alias("ids"), ok.alias("ok")) for n, x, ok in kinds])
    return rows.select(F.explode(each).alias("x")).groupBy("x.tokenizer").agg(F.sum("x.ids").alias("ids"), F.count("*").alias("n"), F.count_if(~F.col("x.ok")).alias("bad"))


@query(f"""WITH {SEQS}, t AS (SELECT ord, regexp_extract_all(canonical_sequence, '[ACGU]{{1,3}}') AS l FROM seqs), o AS (SELECT ord, l[i] AS token, 3 * (i - 1) AS begins FROM t, unnest(range(1, len(l) + 1)) AS u(i))
SELECT token, count(*) AS n, sum(begins)::BIGINT AS offsets, max(begins)::BIGINT AS last FROM o GROUP BY 1""")
def token_offsets(spark, d):
    """Where tokens start: the letters that the tokens before them account for, as a running sum."""
    tokens = K.block_tokens(F.col("canonical_sequence"), 3)
    rows = seqs(spark, d).select("ord", F.posexplode(tokens).alias("pos", "token"))
    before = Window.partitionBy("ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("at").alias("offsets"), F.max("at").alias("last"))


# ---- arms and small functions ------------------------------------------------------------------------------------


@query(f"""WITH {SEQS}, a AS (SELECT * FROM (VALUES ('F1', 'NUC', 4, 'next_base_BPN', NULL, NULL, 1), ('F2', 'BPE', 1024, 'canonical_path_BPN', NULL, NULL, 2), ('F3', 'Unigram', 1024, 'canonical_path_BPN', NULL, NULL, 3),
('F4', 'overlap_mer', 64, 'overlap_path_BPN', NULL, NULL, 4), ('F5', 'overlap_mer', 4096, 'overlap_path_BPN', NULL, NULL, 5), ('F6', 'nonoverlap_mer', 84, 'canonical_path_BPN', NULL, NULL, 6),
('F7', 'nonoverlap_mer', 5460, 'canonical_path_BPN', NULL, NULL, 7), ('P1', 'fixed_patch', 4, 'next_base_BPN', 'fixed', 6, 8), ('P2', 'random_patch', 4, 'next_base_BPN', 'random', NULL, 9),
('P3', 'entropy_patch', 4, 'next_base_BPN', 'entropy', NULL, 10), ('B1', 'fixed_patch', 4, 'next_base_BPN', 'fixed', 1, 11)) AS t(arm, tokenizer, vocab_size, metric, kind, segment_length, place)),
r AS (SELECT list_sort(list(arm)) AS l FROM a)
SELECT arm, tokenizer, vocab_size, metric, kind, segment_length, place, count(*) AS n, sum(length)::BIGINT AS letters, round(sum((6.0 * length * length * 512)::DOUBLE), 1) AS attention
FROM (SELECT length, l[ord % 11 + 1] AS arm FROM seqs, r) JOIN a USING (arm) GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def arm_table(spark, d):
    """Sequences dealt to arms: each arm's tokenizer, metric and boundaries, its place in reports, and operations of attention over its sequences."""
    names = sorted(arms.ARMS)
    arm = F.get(F.array(*map(F.lit, names)), (F.col("ord") % len(names)).cast("int"))
    rows = seqs(spark, d).select(arm.alias("arm"), "length").groupBy("arm").agg(
        F.count("*").alias("n"), F.sum("length").alias("letters"), F.round(F.sum(arms.attention_flops(F.lit(1.0), F.col("length").cast("double"), F.lit(512.0))), 1).alias("attention")
    )
    rows = rows.select(
        "arm", arms.by_arm(F.col("arm"), {a: x[1] for a, x in arms.ARMS.items()}).alias("tokenizer"), arms.by_arm(F.col("arm"), {a: x[2] for a, x in arms.ARMS.items()}).alias("vocab_size"),
        arms.metric(F.col("arm")).alias("metric"), *arms.boundary_policy(F.col("arm")), "n", "letters", "attention", arms.arm_rank(F.col("arm")).alias("rank"),
    )
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rank", "arm"))).drop("rank")  # eleven rows


@query("""SELECT o_orderkey, round(o_totalprice * log2(exp(1)), 4) AS bits, 'F' || (o_custkey % 7 + 1) || '_s' || (o_orderkey % 50) || '_small_b' || 4096 AS run,
  CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE (o_orderkey % 100)::VARCHAR || '.' || lpad((o_orderkey % 10 * 1000)::VARCHAR, 4, '0') END AS text,
  round(CASE WHEN o_orderkey % 1200 < 100 THEN 0.0003 * (o_orderkey % 1200 + 1) / 100 ELSE 0.0003 * 0.5 * (1 + cos(pi() * least(1.0, (o_orderkey % 1200 - 100) / 900.0))) END, 12) AS rate FROM orders""")
def number_functions(spark, d):
    """Bits of nats, run ids, formatted numbers and the learning-rate schedule."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    number = F.when(key % 11 != 0, key % 100 + key % 10 / F.lit(10.0))
    arm = F.concat(F.lit("F"), (F.col("o_custkey") % 7 + 1).cast("string"))
    return o.select(
        "o_orderkey", F.round(S.bits_of_nats(F.col("o_totalprice").cast("double")), 4).alias("bits"), S.run_id(arm, key % 50, F.lit("small"), F.lit(4096)).alias("run"),
        S.formatted(number).alias("text"), F.round(S.learning_rate(key % 1200, 100, 1000, 0.0003), 12).alias("rate"),
    )


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_max(embedding::DOUBLE[]) AS top FROM embeddings WHERE len(embedding) > 0), e AS (SELECT vec_id, [exp(v - top) for v in x] AS e FROM m),
p AS (SELECT vec_id, [v / list_sum(e) for v in e] AS p FROM e) SELECT vec_id, round(-list_sum([v * ln(v) for v in p]), 8) AS entropy, round(list_max(p), 8) AS top FROM p""")
def softmax_entropy(spark, d):
    rows = table(spark, d, "embeddings").where(F.size("embedding") > 0)
    p = rows.select("vec_id", S.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return p.select("vec_id", F.round(S.entropy_nats(F.col("p")), 8).alias("entropy"), F.round(F.array_max("p"), 8).alias("top"))


@query(f"""WITH {SEQS}, e AS (SELECT list_sort(list_distinct([0] || [x for x in [floor(10 ** (log10(4096) * k / 8))::BIGINT for k in range(0, 9)] if x > 0])) AS a),
ed AS (SELECT CASE WHEN a[-1] >= 4096 THEN a ELSE a || [4096] END AS edges FROM e),
b AS (SELECT CASE WHEN length BETWEEN 16 AND 127 THEN 'L1' WHEN length BETWEEN 128 AND 511 THEN 'L2' WHEN length BETWEEN 512 AND 4096 THEN 'L3' WHEN length BETWEEN 4097 AND 16384 THEN 'L4' END AS report_bin,
  CASE WHEN length BETWEEN 16 AND 127 THEN 0 WHEN length BETWEEN 128 AND 511 THEN 1 WHEN length BETWEEN 512 AND 2047 THEN 2 WHEN length BETWEEN 2048 AND 4096 THEN 3 WHEN length BETWEEN 4097 AND 16384 THEN 4 END AS stratum,
  greatest(0, least(len(list_filter(edges, lambda x: x <= length)) - 1, len(edges) - 2))::INT AS prefix_bin FROM seqs, ed)
SELECT report_bin, stratum, prefix_bin, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def length_bins(spark, d):
    """Reporting bins, audit strata and log-spaced prefix bins of the lengths."""
    n, edges = F.col("length"), F.array(*[F.lit(x) for x in S.prefix_edges(4096)])
    rows = seqs(spark, d).select(S.report_bin(n).alias("report_bin"), S.audit_stratum(n).alias("stratum"), S.bin_of(edges, n).alias("prefix_bin"))
    return rows.groupBy("report_bin", "stratum", "prefix_bin").agg(F.count("*").alias("n"))


# ---- rows and selections -----------------------------------------------------------------------------------------


@query(f"""WITH {SEQS}, c AS (SELECT ord, length, ord // ((SELECT count(*) + 6 FROM seqs) // 7) AS chunk FROM seqs) SELECT chunk, count(*) AS n, min(ord) AS first, max(ord) AS last, sum(length)::BIGINT AS letters FROM c GROUP BY 1""")
def chunks(spark, d):
    """Seven chunks of rows by their explicit row number."""
    rows = seqs(spark, d)
    out = rows.withColumn("chunk", corpus.chunk_of(F.col("ord"), rows.count(), 7))
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum("length").alias("letters"))


@query(f"""WITH {SEQS} SELECT canonical_sequence_hash, count(*) AS num_accessions, arg_min(accession, ord) AS representative FROM seqs GROUP BY 1""")
def representatives(spark, d):
    """The accession that stands for a sequence: the first of its tab-joined list."""
    rows = corpus.exact_dedup(seqs(spark, d))
    return rows.select("canonical_sequence_hash", "num_accessions", F.split("accessions", "\t")[0].alias("representative"))


@query(f"""WITH RECURSIVE {CLUSTERED}, c AS (SELECT * FROM seqs JOIN member USING (canonical_sequence_hash))
SELECT 'rna_type' AS "column", rna_type AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'length_bin', length_bin, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'cluster_id', NULL, count(DISTINCT cluster_id) FROM c""")
def strata_summary(spark, d):
    """Rows of each value of each column, and how many distinct clusters there are."""
    rows = clustered(spark, d, seqs(spark, d))
    return corpus.strata_summary(rows, ["rna_type", "length_bin"], "cluster_id")


@query(f"WITH {SEQS} SELECT canonical_sequence_hash, ord, length FROM seqs WHERE length BETWEEN 16 AND 4096 ORDER BY canonical_sequence_hash, ord LIMIT 100")
def first_by_hash(spark, d):
    """The first hundred rows that pass a filter, in order of their hashes (a stopping scan, with its order stated)."""
    return seqs(spark, d).where("length BETWEEN 16 AND 4096").orderBy("canonical_sequence_hash", "ord").limit(100).select("canonical_sequence_hash", "ord", "length")


__all__ = ["QUERIES", "SQL"]
