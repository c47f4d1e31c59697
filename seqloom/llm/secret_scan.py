"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds the base spans (kinds assign, access, hex) and
candidate credentials: the base spans' secret parts and other long tokens with
mixed characters and high entropy. Each candidate is hashed; the hashes are
counted over the whole corpus by distinct repositories and owners, in two
aggregations with map-side combine, so a string that a third of all documents
hold is a few rows when it is shuffled. A candidate known to at least
WIDE_OWNERS owners, or found in at least WIDE_REPOSITORIES repositories, is an
example that was copied about; one known to fewer that looks random is
owner-specific and live-looking and adds a span of kind `live` (on its token,
unless a base span covers just that).

Null text counts as empty, a null repository or owner as a value of its own.
Rows that repeat an id, or an id and a text, are each scanned and returned.
Texts of any length are scanned whole. An empty table gives no rows. Other
columns of docs may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced, text_of

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # shorter maximal runs would fail anyway
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_BITS = 3.5
#: Owners, and repositories of however few owners, from which a string counts as copied about.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 4


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, secret part) by start, then kind in the order listed; ends exclusive, in code points."""
    found = [(m.start(), "assign", m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def bits(token: str) -> float:
    """Entropy of the token's characters."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def looks_random(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and bits(token) >= MIN_BITS


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches):
    one = pa.struct([("hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("random", pa.bool_()), ("base", pa.bool_())])
    for batch in sliced(batches, 1):
        rows = []
        for text in batch.column(1):
            text = text.as_py()
            base = base_spans(text)
            counts = Counter(kind for _, kind, _, _ in base)
            candidates = {(end - len(secret), end): (secret, True) for _, _, end, secret in base}
            for m in TOKEN.finditer(text):
                if looks_random(m[0]):
                    candidates.setdefault(m.span(), (m[0], False))
            whole = {(start, end) for start, _, end, _ in base}
            listed = [
                {
                    "hash": int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True),
                    "start": span[0],
                    "end": span[1],
                    "random": looks_random(token),
                    "base": span in whole,
                }
                for span, (token, _) in sorted(candidates.items())
            ]
            spans = joined(s[:3] for s in base)
            rows.append((counts["assign"], counts["access"], counts["hex"], hashlib.sha256(spans.encode()).hexdigest(), spans, listed))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(one)]
        names = ["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, columns, kinds)], names)


SCANNED = (
    "doc_id bigint, repository string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "base string, candidates array<struct<hash: bigint, start: bigint, end: bigint, random: boolean, base: boolean>>"
)


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Base spans and candidates of each row of docs, numbered by `row`."""
    rows = docs.select("doc_id", text_of(docs).alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    return checkpointed(rows.mapInArrow(_scan, SCANNED).withColumn("row", F.monotonically_increasing_id()))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners of each candidate of the corpus."""
    each = scanned.select("repository", "owner", F.explode("candidates.hash").alias("hash"))
    # null is a value of its own
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    pairs = each.groupBy("hash", part("repository").alias("repository"), part("owner").alias("owner")).agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    by_repository = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    return by_repository.join(by_owner, "hash")


def secret_report(docs: DataFrame, repository: Column, owner: Column, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repositories for each row of docs.

    n_live and n_example count the row's candidates that are live-looking and owner-specific, and widely
    copied; the last two are the largest counts among its candidates (0: it has none).
    """
    scanned = scan(docs, repository, owner)
    each = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = each.join(ownership(scanned), "hash")
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repositories") >= wide_repositories)
    live = ~wide & F.col("random")
    added = F.when(live & ~F.col("base"), F.struct("start", "end"))
    per_row = judged.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(wide).alias("n_example"), F.array_distinct(F.collect_list(added)).alias("added"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    # base spans are listed in order already; added ones go behind all base spans of the same start
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("kind"), s.alias("text")),
    )
    more = F.transform(
        "added",
        lambda s: F.struct(s["start"].alias("at"), F.lit(len(KINDS)).alias("kind"), F.concat_ws(":", F.lit("live"), s["start"], s["end"]).alias("text")),
    )
    spans = F.array_join(F.array_sort(F.concat(base, F.coalesce(more, F.array().cast("array<struct<at: bigint, kind: int, text: string>>"))))["text"], ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    return scanned.drop("candidates").join(per_row, "row", "left").select(*columns, spans.alias("spans"), *map(zero, ("n_live", "n_example", "most_owners", "most_repositories")))
