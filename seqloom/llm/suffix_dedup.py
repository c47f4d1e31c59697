"""Removal of byte strings of a given length that start more than once in a corpus.

Strings of LENGTH bytes that are equal are found by names of a sample of positions,
settled through the sampled position and compared with their neighbours. This is
not the difference-cover suffix sort as published: no ranks, no merge of suffixes.

Sample. The cover is not one of a fixed period but content-defined: each window of
LENGTH bytes samples the position of its smallest 64-byte gram (by a mixed rolling
hash, leftmost of equals). Like a difference cover it has a sampled position at the
same offset in any two equal windows, but it holds only about 2 of 337 positions,
where the sparsest fixed cover that leaves 64 bytes behind each position holds 22.
The README has what that cover's first round was measured to cost; its later rounds
were not built. Consecutive windows with one sampled position form a run.

Names. A run is named twice: by the gram, and by a 128-bit fingerprint of all
bytes its windows cover. Fingerprints are names that need no global ranking.
Runs of one full name that overlap within a document, as in periodic text, are
sent as one. Runs whose full name recurs repeat as a whole. A gram that recurs
under a single full name is settled by that. Only for grams with several full
names the remaining windows matter, and one run per full name stands for all of
them. Up to FEW names, their bytes are brought together by gram and compared to
the left and right of the sampled position. Beyond that the recursion is on names
of ranges of windows: those that share their bytes are settled together, those
that share nothing are dropped, and what is left is cut in eight until single
windows remain. Marked intervals are merged per document and cut out.

Texts are compressed before they are shuffled to the runs or intervals that are
wanted of them.

Every row is a document of its own: rows that repeat id and text repeat each
other's strings. Null text counts as empty; texts shorter than LENGTH lose
nothing, texts of any length are searched whole; matches never cross documents.
A null id is carried through. An empty table gives no rows. Other columns of docs
may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import changes, checkpointed, partitions, sliced, text_of, whole_groups, whole_row

LENGTH = 400
GRAM = 64
CHUNK = 1 << 18
#: Full names of one gram that are compared in one task, of LENGTH bytes and a half each, about.
FEW = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
KEY = ["doc_id", "text_hash"]


class _Sampler:
    """Runs (sampled position, first and last window) of a byte string."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        n = CHUNK + length
        base = 0x5851F42D4C957F2D
        self.power = np.ones(n + 1, np.uint64)
        self.power[1:] = np.uint64(base)
        np.multiply.accumulate(self.power, out=self.power)
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def _grams(self, x: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.power[: len(x)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: len(x) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= _ODD
        h ^= h >> np.uint64(29)
        h *= _ODD
        return h ^ (h >> np.uint64(32))

    def runs(self, x: np.ndarray):
        """Yields arrays (gram hash, sampled position, first window, last window); texts are cut every CHUNK windows."""
        for begin in range(0, len(x) - self.length + 1, CHUNK):
            part = x[begin : begin + CHUNK + self.length - 1]
            h, wide = self._grams(part), self.length - self.gram + 1
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            # the smallest of each wide keys, from running minima of blocks in both directions
            n = len(key)
            blocks = -(-n // wide)
            full = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
            full[:n] = key
            full = full.reshape(blocks, wide)
            ahead = np.minimum.accumulate(full, axis=1).ravel()
            back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n]) & np.uint64(0xFFFFFFFF)
            first = np.flatnonzero(changes(least))
            last = np.append(first[1:], len(least)) - 1
            at = least[first].astype(np.int64)
            yield h[at].view(np.int64), begin + at, begin + first, begin + last


RUNS = "g bigint, h1 bigint, h2 bigint, doc_id bigint, text_hash int, p bigint, lo bigint, hi bigint, end bigint"


def _name_runs(length: int, gram: int):
    """Documents -> their named runs; runs of one name that overlap within a document are one row, the first of them, up to the end of the last."""
    names_ = [c.split(" ")[0] for c in RUNS.split(", ")]

    def run(batches):
        import xxhash

        digest, sampler = xxhash.xxh3_128_digest, _Sampler(length, gram)
        for batch in sliced(batches, 2):
            names, counts, found = [], [], [[], [], [], []]
            for text in batch.column(2):
                data, n = text.as_py().encode(), 0
                if len(data) >= length:
                    for part in sampler.runs(np.frombuffer(data, np.uint8)):
                        names += [digest(data[a : b + length]) for a, b in zip(part[2].tolist(), part[3].tolist())]
                        n += len(part[0])
                        for kept, x in zip(found, part):
                            kept.append(x)
                counts.append(n)
            rows = np.repeat(np.arange(len(counts)), counts)
            g, p, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
            h1, h2 = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2).T
            order = np.lexsort((lo, h2, h1, rows))
            new = changes(rows[order], h1[order], h2[order])
            new[1:] |= lo[order][1:] > hi[order][:-1] + length
            first = np.flatnonzero(new)
            end = pa.array(hi[order][np.append(first, len(order))[1:] - 1] + length)
            one = order[first]
            g, h1, h2, p, lo, hi = (pa.array(x[one]) for x in (g, h1, h2, p, lo, hi))
            take = pa.array(rows[one])
            yield pa.RecordBatch.from_arrays([g, h1, h2, batch.column(0).take(take), batch.column(1).take(take), p, lo, hi, end], names_)

    return run


def _squeeze(batches):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in sliced(batches, 2):
        data = pa.array([squeeze(t.as_py().encode()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], [*KEY, "data"])


def _unsqueezed(column):
    import zstandard

    back = zstandard.ZstdDecompressor().decompress
    return (back(x.as_py()) for x in column)


CONTEXTS = "g bigint, doc_id bigint, text_hash int, p bigint, lo bigint, solo boolean, context binary"


def _contexts(length: int):
    """Documents with the runs wanted of them -> the bytes that each run's windows cover."""

    def run(batches):
        for batch in sliced(batches, 2, 1 << 20):  # compressed
            rows, columns = [], [[], [], [], [], []]
            for k, (data, runs) in enumerate(zip(_unsqueezed(batch.column(2)), batch.column(3))):
                for r in runs.as_py():
                    rows.append(k)
                    for kept, x in zip(columns, (r["g"], r["p"], r["lo"], r["solo"], data[r["lo"] : r["hi"] + length])):
                        kept.append(x)
            take = pa.array(rows, pa.int64())
            g, p, lo, solo, context = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())))
            own = [batch.column(0).take(take), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays([g, *own, p, lo, solo, context], ["g", *KEY, "p", "lo", "solo", "context"])

    return run


def _agreement(contexts: list[bytes], before: list[int], wanted: list[int], length: int):
    """For each wanted context the bytes that it shares to the left and right of its sampled position with others, at the most."""
    n = len(contexts)
    left, right = max(before), max(len(c) - b for c, b in zip(contexts, before))
    # what lies outside a context agrees with nothing: numbers below zero, one for each row
    a = np.repeat(-1 - np.arange(n, dtype=np.int16)[:, None], left + 1, axis=1)
    z = np.repeat(-1 - np.arange(n, dtype=np.int16)[:, None], right + 1, axis=1)
    for k, (c, b) in enumerate(zip(contexts, before)):
        x = np.frombuffer(c, np.uint8)
        a[k, :b] = x[:b][::-1]
        z[k, : len(x) - b] = x[b:]
    for k in wanted:
        others = np.arange(n) != k
        to_left = (a != a[k]).argmax(axis=1)
        to_right = (z != z[k]).argmax(axis=1)
        good = others & (to_left + to_right >= length)
        if good.any():
            yield k, int(to_left[good].max()), int(to_right[good].max())


def _compare(length: int):
    """Contexts sorted by gram -> the intervals of solo runs that another run repeats."""

    def run(batches):
        for table in whole_groups(batches, ["g"]):
            bounds = np.flatnonzero(changes(table["g"].to_numpy()))
            p, lo = table["p"].to_numpy(), table["lo"].to_numpy()
            solo = table["solo"].to_numpy()
            contexts, rows, starts, ends = table["context"].to_pylist(), [], [], []
            for i, j in zip(bounds.tolist(), np.append(bounds[1:], len(table)).tolist()):
                wanted = np.flatnonzero(solo[i:j]).tolist()
                for k, to_left, to_right in _agreement(contexts[i:j], (p[i:j] - lo[i:j]).tolist(), wanted, length):
                    rows.append(i + k)
                    starts.append(int(p[i + k]) - to_left)
                    ends.append(int(p[i + k]) + to_right)
            at = table.select(KEY).take(pa.array(rows, pa.int64()))
            for name, values in (("start", starts), ("end", ends)):
                at = at.append_column(name, pa.array(values, pa.int64()))
            yield from at.to_batches()

    return run


KEYED = "rid bigint, a int, wanted boolean, c1 bigint, c2 bigint, f1 bigint, f2 bigint, doc_id bigint, text_hash int, p bigint"


def _range_names(length: int, width: int):
    """Contexts with a range of windows (from offset a on, width many) -> names of what all these windows share and of all they cover.

    Offsets count from the sampled position. A range outside the context is left out; one that is only
    partly inside has no second name.
    """

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        names_ = [c.split(" ")[0] for c in KEYED.split(", ")]
        for batch in sliced(batches, "context"):
            rows, shared, whole = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "p", "lo", "context")]
            for k, (a, p, lo, context) in enumerate(zip(*columns)):
                b = a + width - 1
                first, last = lo - p, lo - p + len(context) - length  # offsets of the context's windows
                if b < first or a > last:
                    continue
                rows.append(k)
                shared.append(digest(context[b - first : max(b - first, a - first + length)]))
                whole.append(digest(context[a - first : b - first + length]) if first <= a and b <= last else None)
            take = pa.array(rows, pa.int64())
            c = np.frombuffer(b"".join(shared), "<i8").reshape(-1, 2)
            f = np.frombuffer(b"".join(x or bytes(16) for x in whole), "<i8").reshape(-1, 2)
            none = np.array([x is None for x in whole], bool)
            own = lambda name: batch.column(name).take(take)  # noqa: B023, E731
            columns = [own("rid"), own("a"), own("wanted")]
            columns += [pa.array(np.ascontiguousarray(c[:, i])) for i in (0, 1)]
            columns += [pa.array(np.ascontiguousarray(f[:, i]), mask=none) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, own("doc_id"), own("text_hash"), own("p")], names_)

    return run


def _merge(batches):
    """Intervals sorted by document and start -> one row per document with disjoint intervals."""
    held = None

    def emit(table: pa.Table):
        if not len(table):
            return
        doc = table["doc_id"]
        null, value = doc.is_null().to_numpy(), pc.fill_null(doc, 0).to_numpy()
        start, end = table["start"].to_numpy(), table["end"].to_numpy()
        new_doc = changes(value, null, table["text_hash"].to_numpy())
        bounds = np.flatnonzero(new_doc)
        starts, ends = [], []
        for a, b in zip(bounds, np.append(bounds[1:], len(table))):
            reach = np.maximum.accumulate(end[a:b])
            cut = np.flatnonzero(np.append(True, start[a + 1 : b] > reach[:-1]))
            starts.append(start[a:b][cut])
            ends.append(reach[np.append(cut[1:], b - a) - 1])
        at = table.take(pa.array(bounds))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        yield from pa.Table.from_arrays([at["doc_id"], at["text_hash"], *lists], names=[*KEY, "starts", "ends"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        doc = table["doc_id"]
        last = int(np.flatnonzero(changes(pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(), table["text_hash"].to_numpy()))[-1])
        yield from emit(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from emit(held)


def _same_row(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.select("doc_id", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("text_hash"), "text")


def _narrowed(contexts: DataFrame, length: int, span: int) -> DataFrame:
    """Intervals of solo contexts that others repeat, by recursion on ranges of windows.

    A context starts with all its ranges of 8^3 windows. In each round a range is named by the bytes that
    all its windows share and by the bytes that they cover. Without another range of the first name it
    is dropped; with another of the second name it is repeated as a whole, and one of these goes on for
    the others' sake; what is left is cut in eight. A context has at most two ranges that are partly
    repeated, so a round has rows in proportion to the number of contexts, whatever shares one gram.
    """
    contexts = checkpointed(contexts.withColumn("rid", F.monotonically_increasing_id()))
    width = 8**3
    starts = [1 - width * (k + 1) for k in range(-(-span // width))]
    active = contexts.select("rid", F.explode(F.array(*map(F.lit, starts))).alias("a"), F.col("solo").alias("wanted"))
    found = None
    while True:
        keyed = active.join(contexts, "rid").select("rid", "a", "wanted", "doc_id", "text_hash", "p", "lo", "context")
        keyed = checkpointed(keyed.mapInArrow(_range_names(length, width), KEYED))
        whole = keyed.where("f1 is not null").groupBy("a", "f1", "f2").agg(F.count("*").alias("same"), F.min("rid").alias("first"))
        # both written, so that the joins with them have shuffles of their own and a range that many contexts share can be split
        whole = checkpointed(whole.where("same > 1"))
        marked = keyed.where("wanted").join(whole, ["a", "f1", "f2"], "left_semi")
        end = F.col("p") + F.col("a") + (width - 1 + length)
        marked = marked.select(*KEY, (F.col("p") + F.col("a")).alias("start"), end.alias("end"))
        found = marked if found is None else found.union(marked)
        if width == 1:
            return found
        shared = keyed.groupBy("a", "c1", "c2").agg(
            F.count("*").alias("n"), F.count("f1").alias("nf"), F.bool_or("wanted").alias("any"),
            ((F.min("f1") == F.max("f1")) & (F.min("f2") == F.max("f2"))).alias("alike"),
        )
        shared = checkpointed(shared.where("n > 1 and any and not (nf = n and alike)").select("a", "c1", "c2"))
        # ranges without a second name are dealt by rid, so that they don't all meet in one task
        dealt = [F.coalesce(F.col(f), F.col("rid")).alias(d) for f, d in (("f1", "d1"), ("f2", "d2"))]
        rest = keyed.join(shared, ["a", "c1", "c2"], "left_semi").select("rid", "a", "wanted", "f1", *dealt)
        rest = rest.join(whole.withColumnsRenamed({"f1": "d1", "f2": "d2"}), ["a", "d1", "d2"], "left")
        rest = rest.withColumn("same", F.expr("if(f1 is null, null, same)")).where("same is null or rid = first")
        parts = F.explode(F.array(*[F.col("a") + k * (width // 8) for k in range(8)]))
        active = rest.select("rid", parts.alias("a"), (F.col("wanted") & F.col("same").isNull()).alias("wanted"))
        width //= 8


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, few: int = FEW) -> DataFrame:
    """doc_id, text_hash, starts, ends: the maximal byte intervals covered by repeated strings, for documents that have any."""
    spark = docs.sparkSession
    long = _texts(docs).where(F.octet_length("text") >= length)
    runs = long.mapInArrow(_name_runs(length, gram), RUNS)
    times = F.sum(F.when(F.col("end") > F.col("hi") + length, 2).otherwise(1))  # a row of several runs counts as two
    # written, so that both sides of the join have a shuffle of their own and a gram that many runs share can be split
    again = checkpointed(runs.groupBy("g").agg(times.alias("n")).where("n > 1").select("g"))
    runs = checkpointed(runs.join(again, "g", "left_semi"))
    named = runs.groupBy("g", "h1", "h2").agg(times.alias("n"), F.min(F.struct(*KEY, "p", "lo", "hi")).alias("one"))
    named = checkpointed(named.select("g", "h1", "h2", "one", (F.col("n") == 1).alias("solo")))
    several = checkpointed(named.groupBy("g").agg(F.count("*").alias("names")).where("names > 1"))

    def wanted(names: str) -> DataFrame:
        some = named.join(several.where(names), "g", "left_semi").select("g", "one.*", "solo")
        per_row = some.groupBy(*KEY).agg(F.collect_list(F.struct("g", "p", "lo", "hi", "solo")).alias("runs"))
        packed = long.mapInArrow(_squeeze, "doc_id bigint, text_hash int, data binary")
        joined = packed.alias("t").join(per_row.alias("r").hint("shuffle_hash"), _same_row("t", "r"))
        return joined.select("t.doc_id", "t.text_hash", "data", "runs")

    whole = runs.join(named.where("not solo"), ["g", "h1", "h2"], "left_semi")
    found = whole.select(*KEY, F.col("lo").alias("start"), "end")
    contexts = wanted(f"names <= {few}").mapInArrow(_contexts(length), CONTEXTS)
    contexts = contexts.repartition(partitions(spark), "g").sortWithinPartitions("g")
    found = found.union(contexts.mapInArrow(_compare(length), "doc_id bigint, text_hash int, start bigint, end bigint"))
    if not several.where(f"names > {few}").isEmpty():
        found = found.union(_narrowed(wanted(f"names > {few}").mapInArrow(_contexts(length), CONTEXTS), length, length - gram + 1))
    found = found.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "start")
    return found.mapInArrow(_merge, "doc_id bigint, text_hash int, starts array<bigint>, ends array<bigint>")


def _kept(data: bytes, starts, ends) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))


def _report(batches):
    for batch in sliced(batches, 1, 1 << 20):  # compressed
        out = []
        for data, starts, ends in zip(_unsqueezed(batch.column(1)), batch.column(2), batch.column(3)):
            starts, ends = starts.as_py() or [], ends.as_py() or []
            out.append((len(data), sum(ends) - sum(starts), len(starts), hashlib.sha256(_kept(data, starts, ends)).hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    spans = repeated_intervals(docs, length, gram, few).alias("s").hint("shuffle_hash")
    packed = _texts(docs).mapInArrow(_squeeze, "doc_id bigint, text_hash int, data binary").alias("t")
    rows = packed.join(spans, _same_row("t", "s"), "left").select("t.doc_id", "data", "starts", "ends")
    return rows.mapInArrow(_report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the bytes that stay as text, other columns untouched; a character that loses bytes becomes U+FFFD."""
    columns = docs.columns

    def run(batches):
        for batch in sliced(batches, 0):
            out = []
            for text, starts, ends in zip(*(batch.column(k) for k in range(3))):
                data = text.as_py().encode()
                out.append(_kept(data, starts.as_py() or [], ends.as_py() or []).decode(errors="replace"))
            own = dict(zip(columns, batch.column(3).flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else own[c] for c in columns], columns)

    spans = repeated_intervals(docs, length, gram).alias("s").hint("shuffle_hash")
    rows = docs.select("doc_id", text_of(docs).alias("text"), whole_row(docs).alias("row"))
    rows = rows.withColumn("text_hash", F.shiftright(F.xxhash64("text"), 32).cast("int")).alias("t")
    return rows.join(spans, _same_row("t", "s"), "left").select("text", "starts", "ends", "row").mapInArrow(run, docs.schema)
