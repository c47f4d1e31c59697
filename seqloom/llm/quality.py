"""Quality classifier: a weak-label model and a hashed linear scorer.

Labellers. Overlapping heuristics vote good, bad or nothing on each document. A
document's votes are one number, its pattern; patterns are counted over the
whole corpus, a table of at most 3^9 = 19,683 rows whatever the corpus holds.
Expectation-maximisation on these counts estimates each labeller's accuracy on
good and on bad documents and the share of good ones, and gives every pattern a
posterior.

Scorer. A logistic model on hashed byte trigrams (shares of 2^BITS buckets, as
square roots) is fitted to posteriors, in one task, on at most FIT_ROWS distinct
texts: of either side the FIT_ROWS / 2 with the smallest hash, or all there are.
Copies of a text count once there, so that no text fills the sample, however
many rows hold it; patterns are counted over all rows. The fit sees its rows in
the order of their hashes, so two runs agree. All documents are then scored in
one pass; those with a probability below THRESHOLD are rejected.

Null text counts as empty. Short texts hold too little to judge: most labellers
abstain on them, and their features are damped, which leaves them near the
model's bias. Texts of any length are judged whole. Rows that repeat an id, or
an id and a text, are each scored, alike if the text is. An empty table, and one
on which all posteriors agree, gives a model that rejects nothing. Other columns
of docs may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced, text_of, whole_row

BITS = 12
FIT_ROWS = 8_000
THRESHOLD = 0.5
MIN_LETTERS = 20
#: Trigrams at which a text's features count half.
DAMP = 60
#: Features of a document.
SIZE = (1 << BITS) + 1
GOOD, BAD, NONE = 1, 2, 0
LABELLERS = ("symbols", "capitals", "doubled", "lines", "word_length", "top_word", "stutter", "function_words", "plain_words")
#: Function words of the languages at hand.
COMMON = frozenset(
    "the of and to in a is that for it with as was on by be this are from or an at not but have "
    "de la le les et des en un une que qui dans pour par sur est pas du au "
    "el los las y que una por con para se del al es su "
    "der die das und zu den von mit ist im auf ein eine nicht dem des sich".split()
)
_WORD = re.compile(rb"[^\x00-\x60\x7B-\x7F]+(?:['-][^\x00-\x60\x7B-\x7F]+)*[.,;:!?]?")
_DOUBLED = re.compile(rb"([!?#$%&*@^~|=+<>])\1")


def stutter(words: list) -> float:
    """Share of words that repeat the one before."""
    return sum(map(eq, words, words[1:])) / max(1, len(words) - 1)


def votes(text: str) -> list[int]:
    """One vote of each labeller. Seven only know bad signs; the last two, on words, vote either way."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = upper + lower + int(counts[0xC0:].sum())  # first bytes of other letters, about
    digits = int(counts[48:58].sum())
    space = int(counts[9:14].sum() + counts[32])
    plain = int(counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    words = data.lower().split()
    n = max(1, len(words))
    bad = lambda sign: BAD if sign else NONE
    out = [
        bad(len(text) - letters - digits - space - plain > 0.06 * len(text)),
        bad(upper > 0.5 * (upper + lower) and letters >= MIN_LETTERS),
        bad(len(_DOUBLED.findall(data)) > 0.1 * n),
    ]
    lines = [x for x in data.split(b"\n") if x.strip()]
    out.append(bad(len(lines) >= 4 and len(set(lines)) < 0.6 * len(lines)))
    out.append(bad(letters >= MIN_LETTERS and not 2 <= letters / n <= 14))
    out.append(bad(n >= 10 and max(Counter(words).values()) > 0.3 * n))
    out.append(bad(n >= 10 and stutter(words) > 0.2))
    if n < 10:
        return out + [NONE, NONE]
    words = [w for w, v in zip(words, [b"", *words]) if w != v]  # a word that repeats the one before is no sign of prose
    common = sum(w.strip(b".,") in _COMMON_BYTES for w in words) / n
    out.append(BAD if common < 0.02 else GOOD if common > 0.12 else NONE)
    # letters, and at most one mark of punctuation behind them
    clean = sum(map(bool, map(_WORD.fullmatch, words))) / n
    out.append(BAD if clean < 0.5 else GOOD if clean > 0.9 else NONE)
    return out


_COMMON_BYTES = frozenset(w.encode() for w in COMMON)


def pattern(text: str) -> int:
    number = 0
    for v in votes(text):
        number = 3 * number + v
    return number


def posteriors(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Probability of good for each pattern, by expectation-maximisation on pattern counts."""
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    m = len(LABELLERS)
    vote = np.array([[k // 3 ** (m - 1 - j) % 3 for j in range(m)] for k in keys])
    # chance of each vote (nothing, good, bad) of each labeller on good and on bad documents; a labeller starts as right
    start = np.array([[[0.93, 0.02, 0.05], [0.58, 0.02, 0.4]]] * (m - 2) + [[[0.35, 0.6, 0.05], [0.35, 0.15, 0.5]]] * 2)
    chance = start
    prior = 0.8
    one_hot = np.eye(3)[vote]  # pattern x labeller x vote
    one_hot[:, -2:, NONE] = 0  # of the two that vote either way, an abstention says nothing
    for _ in range(rounds):
        log = np.einsum("pjv,jcv->pc", one_hot, np.log(chance)) + np.log([prior, 1 - prior])
        good = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
        share = np.stack([good, 1 - good], axis=1) * n[:, None]
        prior = float(np.clip(share[:, 0].sum() / n.sum(), 1e-3, 1 - 1e-3))
        # two documents' worth of the start keeps a labeller from turning round or vanishing
        seen = np.einsum("pjv,pc->jcv", one_hot, share) + 2 * start
        chance = seen / seen.sum(axis=2, keepdims=True)
    return dict(zip(keys, good.tolist()))


def buckets(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, drawn to zero for short texts; then the share of stuttered words."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(SIZE)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    counts = np.bincount(h, minlength=1 << BITS).astype(float)
    shares = np.sqrt(counts / counts.sum())
    return np.append(shares, stutter(data.lower().split())) * (len(h) / (len(h) + DAMP))


def fit(rows: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights and bias by full-batch gradient steps with momentum; classes count alike."""
    if not len(rows) or good.min() > 0.5 or good.max() < 0.5:
        return np.append(np.zeros(SIZE), 1.0)
    x = np.hstack([rows, np.ones((len(rows), 1))]).astype(np.float32)
    balance = np.where(good > 0.5, 0.5 / (good > 0.5).mean(), 0.5 / (good <= 0.5).mean())
    w = speed = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        error = balance * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - good)
        speed = 0.9 * speed - rate * ((error.astype(np.float32) @ x) / len(x) + decay * w)
        w = w + speed
    return w.astype(float)


def _draw(data: bytes) -> int:
    """The seeded hash of a text by which texts are drawn, as a signed long."""
    import xxhash

    return xxhash.xxh3_64_intdigest(data, 77) - (1 << 63)


def _patterns(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, 0):
            texts = batch.column(0).to_pylist()
            draws = pa.array([_draw(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([draws, pa.array(map(pattern, texts), pa.int32())], ["draw", "pattern"])

    return docs.select(text_of(docs).alias("text")).mapInArrow(run, "draw bigint, pattern int")


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each pattern, and the scorer's weights."""
    seen = checkpointed(_patterns(docs))  # 12 bytes a document
    counts = {r.pattern: r["count"] for r in seen.groupBy("pattern").count().collect()}  # 19,683 rows at most
    good = posteriors(counts)
    chosen = {}
    for side in (False, True):
        own = [k for k, p in good.items() if (p > 0.5) == side]
        if own:
            listed = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in own], "pattern int"))
            texts = seen.join(listed, "pattern").groupBy("draw").agg(F.min("pattern").alias("pattern"))
            chosen |= {r.draw: good[r.pattern] for r in texts.orderBy("draw").limit(fit_rows // 2).collect()}

    def sample(batches):
        sent = set()
        for batch in sliced(batches, 0):
            draws, used, values = [], [], []
            for t in batch.column(0):
                data = t.as_py().encode()
                draw = _draw(data)
                if draw in chosen and draw not in sent:
                    sent.add(draw)
                    found = buckets(data)
                    # sparse: places and values of the buckets in use
                    draws.append(draw)
                    used.append(np.flatnonzero(found).astype(np.int32))
                    values.append(found[used[-1]].astype(np.float32))
            columns = [pa.array(draws, pa.int64()), pa.array(used, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["draw", "used", "vals"])

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw")
        rows = np.zeros((len(group), SIZE), np.float32)
        for row, used, values in zip(rows, group["used"], group["vals"]):
            row[used] = values
        return pd.DataFrame({"w": [fit(rows, group["draw"].map(chosen).to_numpy(float))]})

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(sample, "draw bigint, used array<int>, vals array<float>")
    # a task sends a text once, the aggregate keeps one of all tasks: fit_rows rows reach the fit at the most
    rows = rows.groupBy("draw").agg(F.first("used").alias("used"), F.first("vals").alias("vals"))
    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit_group, "w array<double>").collect()  # one row
    return good, np.array(found[0].w) if found else np.append(np.zeros(SIZE), 1.0)


def _scores(texts: list[str], w: np.ndarray) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-np.clip(buckets(t.encode()) @ w[:-1] + w[-1], -30, 30))) for t in texts], float)


def quality_report(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, weak_label (posterior), score (probability of good), accepted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, fit_rows))  # 19,683 numbers and 2^BITS + 2

    def run(batches):
        good, w = shared.value
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            weak = pa.array([good.get(pattern(t), 1.0) for t in texts], pa.float64())
            scores = _scores(texts, w)
            yield pa.RecordBatch.from_arrays([batch.column(0), weak, pa.array(scores), pa.array(scores >= threshold)], ["doc_id", "weak_label", "score", "accepted"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, weak_label double, score double, accepted boolean")


def keep_good(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the scorer accepts, all columns untouched."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(train(docs, fit_rows)[1]), docs.columns

    def run(batches):
        for batch in sliced(batches, 0):
            accepted = _scores(batch.column(0).to_pylist(), shared.value) >= threshold
            yield pa.RecordBatch.from_arrays(batch.column(1).flatten(), columns).filter(pa.array(accepted))

    return docs.select(text_of(docs).alias("text"), whole_row(docs).alias("row")).mapInArrow(run, docs.schema)
