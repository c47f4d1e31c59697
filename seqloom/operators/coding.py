"""Range-coded streams: the operators that walk a group in order."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import TOTAL, Contexts, Decoder, Encoder, consistency, quantise
from ..functions.sequence import ALPHABET

CODED = (
    "stream_id string, sequence_count long, valid_nt long, stream_bits long, quantised_bits double, nll_bits double, overhead_bits double, "
    "within_64_bits boolean, nll_drift double, decoded boolean, status string"
)
PARTS = f"{CODED}, part long, bits binary"
#: Bytes of a part of a stream.
PART_BYTES = 1 << 16


class Stream:
    """One stream as it is coded and decoded again, a sequence at a time; what waits for its bytes is a few symbols."""

    def __init__(self, name: str, contexts: Contexts):
        self.name, self.contexts, self.coder, self.decoder = name, contexts, Encoder(), Decoder()
        self.sums = {"sequence_count": 0, "token_count": 0, "nll_bits": 0.0, "quantised_bits": 0.0, "stream_bits": 0}
        self.waiting: deque = deque()
        self.decoded, self.ready, self.number = True, bytearray(), 0

    def _check(self, least: int = 0) -> None:
        while self.waiting and (least or self.decoder.can_take()):
            cdf, symbol = self.waiting.popleft()
            self.decoded &= self.decoder.take(cdf) == symbol

    def _take(self, data: bytes) -> None:
        self.sums["stream_bits"] += 8 * len(data)
        self.ready += data
        self.decoder.feed(data)

    def add(self, seq: list[int]) -> Iterator[dict]:
        for i, s in enumerate(seq):
            p, cdf = self.contexts.at(seq, i)
            self.coder.put(cdf, s)
            self.sums["nll_bits"] -= math.log2(max(p[s], 1e-300))
            self.sums["quantised_bits"] -= math.log2((cdf[s + 1] - cdf[s]) / cdf[-1])
            self.waiting.append((cdf, s))
        self.sums["token_count"] += len(seq)
        self.sums["sequence_count"] += 1
        self._take(self.coder.ready())
        self._check()
        while len(self.ready) >= PART_BYTES:
            yield self._part(bytes(self.ready[:PART_BYTES]))
            del self.ready[:PART_BYTES]

    def _part(self, data: bytes | None) -> dict:
        self.number += 1
        return {"stream_id": self.name, "part": self.number - 1, "bits": data}

    def close(self) -> Iterator[dict]:
        self._take(self.coder.finish())
        self._check(1)
        yield self._part(bytes(self.ready))
        gates = consistency(self.sums, self.sums["token_count"], self.decoded)
        own = {c: self.sums[c] for c in ("sequence_count", "stream_bits", "quantised_bits", "nll_bits")}
        yield {"stream_id": self.name, "part": None, "bits": None, "valid_nt": self.sums["token_count"], **own, **gates}


def stream_parts(streams: DataFrame, model: dict[str, list[float]], order: int) -> DataFrame:
    """PARTS of each stream_id: columns stream_id, ord, canonical_sequence. A stream's bytes are its parts in order; the
    row without a part has its sums.

    model: distribution of each context of `order` letters (at most 4^order, so it travels with the function); an
    unknown context is uniform. Streams are contiguous ranges of sorted partitions. A task holds a batch of
    sequences, a part and the coder's state, whatever a stream's length; a stream takes one task as long as it takes
    to code, so a table is cut into streams of a bounded number of ids.
    """
    uniform = [0.25] * 4
    names = [x.strip().split(" ")[0] for x in PARTS.split(",")]

    def run(batches):
        contexts = Contexts(lambda context: model.get("".join(ALPHABET[x] for x in context), uniform), order)
        stream, out, size = None, [], 0

        def rows():
            nonlocal out, size
            found, out, size = out, [], 0
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in found], schema=kinds)

        kinds = pa.schema([(n, k) for n, k in zip(names, [pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 3, pa.bool_(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()])])
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stream is None or name != stream.name:
                    out += [] if stream is None else list(stream.close())
                    stream = Stream(name, contexts)
                for part in stream.add([ALPHABET.index(c) for c in seq]):
                    out.append(part)
                    size += PART_BYTES
                if size >= 1 << 20 or len(out) >= 256:
                    yield rows()
        if stream is not None:
            out += list(stream.close())
        yield rows()

    by = ["stream_id", "ord"]
    dealt = streams.repartition("stream_id").sortWithinPartitions(*by).select("stream_id", "canonical_sequence")
    return dealt.mapInArrow(run, PARTS)


def code_streams(streams: DataFrame, model: dict[str, list[float]], order: int) -> DataFrame:
    """CODED for each stream_id, without the bytes."""
    return stream_parts(streams, model, order).where("part is null").drop("part", "bits")


def quantised(probs: DataFrame, total: int = TOTAL) -> DataFrame:
    """Adds cdf (cumulative integer frequencies) to rows with probs."""

    @F.pandas_udf("array<int>")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: quantise(list(x), total))

    return probs.withColumn("cdf", run("probs"))


def codec_totals(coded: DataFrame) -> DataFrame:
    """Summed over streams: counts, and the bits per letter of the code, its quantised form and the model."""
    out = coded.agg(*[F.sum(c).alias(c) for c in ("sequence_count", "valid_nt", "stream_bits", "quantised_bits", "nll_bits")], F.bool_and("decoded").alias("decoded"))
    for name, c in (("code_length_bpn", "stream_bits"), ("quantised_bpn", "quantised_bits"), ("nll_bpn", "nll_bits")):
        out = out.withColumn(name, F.when(F.col("valid_nt") > 0, F.col(c) / F.col("valid_nt")))
    return out
