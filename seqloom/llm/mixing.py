"""Temperature mixing of sources, realised as budgeted block permutations.

All of it is DataFrame and SQL: no Python runs on the executors.

Weights. A source with the share p of all tokens gets the weight p^a / sum p^a.
The exponent a (1: as it comes, 0: all sources alike) is bisected in one SQL
expression over the array of shares, one row whose size is the number of
sources: it becomes the largest a in [0, 1] with at least `entropy` (as a part
of the largest possible, log n), then is raised as far as is needed for no
source to be repeated more than `max_repeats` times at the given budget. The
budget can be met by a = 1 whenever it is at most max_repeats times the corpus.

Order. Each source is dealt into blocks by a hash of its rows, about BLOCK_ROWS
rows each, and each epoch permutes the blocks and the rows in a block by seeded
SHA-256 keys. A source's budget takes whole epochs, then blocks in the order of
the permutation, then rows of one last block; the row that reaches the budget
is the last one taken. Running sums are over blocks (their totals are small
rows) and inside the one block that is cut, so no window holds more than one
block of rows, however large a source is.

Tokens are counted as white-space words. A null source is the source ''; null
text counts as empty; rows without words weigh nothing and follow the epochs.
Rows that repeat an id and a text tie: they share a block and follow each other
in it, each is read and counted on its own. Texts of any length are counted
whole. An empty table gives no rows. Other columns of docs may have any names.

Up to BROADCAST_SOURCES sources their table is broadcast, beyond that it is
joined by (source, salt); the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, text_of, whole_row

SEED = "mix-1"
ENTROPY = 0.95
MAX_REPEATS = 2.0
BLOCK_ROWS = 2048
STEPS = 50
#: Sources up to which their table (a row each) is broadcast, and the parts of a source beyond that.
BROADCAST_SOURCES, SALTS = 10_000, 256


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))




def weights(sources: DataFrame, budget: Column, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, n_rows, tokens, exponent, weight, budget (tokens, whole) from source, n_rows, tokens."""
    all_ = sources.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("total"))
    one = all_.select("total", budget.alias("goal"), F.transform("s", lambda x: x["tokens"] / F.col("total")).alias("p"))
    powers = lambda a: F.transform("p", lambda x: F.pow(x, a))
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def part_of_largest(a: Column) -> Column:
        # entropy of q = p^a / z is log z - a * sum p^a log p / z
        z = sum_of(powers(a))
        mean = sum_of(F.transform("p", lambda x: F.pow(x, a) * F.log(x))) / z
        return F.when(F.size("p") < 2, F.lit(1.0)).otherwise((F.log(z) - a * mean) / F.log(F.size("p").cast("double")))

    def repeats(a: Column) -> Column:
        # of the source that is repeated most: goal * weight / tokens
        return F.array_max(F.transform("p", lambda x: F.pow(x, a) / x)) / sum_of(powers(a)) * F.col("goal") / F.col("total")

    def bisect(good) -> Column:
        """The border of good in [0, 1], for a condition that holds from 0 upwards."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s, _):
            mid = (s["lo"] + s["hi"]) / 2
            return F.when(good(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["lo"]
        return F.when(good(F.lit(1.0)), F.lit(1.0)).otherwise(found)

    one = one.withColumn("mixed", bisect(lambda a: part_of_largest(a) >= entropy))
    # repetition falls with a: the smallest a that keeps to the limit
    one = one.withColumn("least", F.when(repeats(F.lit(0.0)) <= max_repeats, F.lit(0.0)).otherwise(bisect(lambda a: repeats(a) > max_repeats)))
    one = one.withColumn("exponent", F.round(F.greatest("mixed", "least"), 9)).withColumn("z", sum_of(powers(F.col("exponent"))))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    out = sources.crossJoin(F.broadcast(one.select("total", "goal", "exponent", "z")))  # one row
    out = out.withColumn("weight", F.round(weight, 9))
    return out.select("source", "n_rows", "tokens", "exponent", "weight", F.floor(F.col("weight") * F.col("goal")).alias("budget"))


def mixed_rows(docs: DataFrame, keys: list[str], budget_part: float = 1.0, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows to read: keys, source, epoch (from 0), block, n_tokens, weight.

    docs: columns keys (kept), `source`, `n_tokens`, `ident` (a string that tells rows apart), written
    before, as they are read several times.
    The budget is budget_part times all tokens.
    """
    sources = checkpointed(docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens")))
    plan = weights(sources, F.floor(F.col("total") * budget_part), entropy, max_repeats)
    plan = plan.withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    digits = lambda *parts: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256), 1, 8), 16, 10).cast("long")
    if sources.count() <= BROADCAST_SOURCES:
        dealt = docs.join(F.broadcast(plan), "source")
    else:  # a large source is spread over SALTS tasks
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")
    dealt = dealt.withColumn("block", F.pmod(digits(F.lit("block"), "ident"), F.col("n_blocks")))
    # whole epochs
    columns = [*keys, "source", "epoch", "block", "n_tokens", "weight"]
    whole = dealt.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    # the last epoch: running sums over blocks in permuted order
    sums = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("full").alias("epoch"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(digits(F.lit("order"), "source", "epoch", "block"), "block")
    sums = sums.withColumn("before", F.coalesce(F.sum("in_block").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = sums.where("before < rest").select("source", "block", "epoch", "before", "in_block")
    last = dealt.join(taken, ["source", "block"])
    inside = last.where("before + in_block <= rest")
    rank = Window.partitionBy("source", "block").orderBy(digits(F.lit("row"), "epoch", "ident"), "ident", *keys)
    cut = last.where("before + in_block > rest")
    cut = cut.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.where("ahead < rest")
    parts = [x.withColumn("epoch", F.col("epoch").cast("int")).select(*columns) for x in (whole, inside, cut)]
    return parts[0].union(parts[1]).union(parts[2])


def _ident(docs: DataFrame) -> Column:
    """The id, and the text, which tells rows apart that share an id."""
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(text_of(docs)))


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(
        "doc_id",
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
        word_count(text).cast("long").alias("n_tokens"),
        _ident(docs).alias("ident"),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch, block, n_tokens, weight: one row for each time a row of docs is read."""
    return mixed_rows(checkpointed(_rows(docs)), ["doc_id"], **options)  # the texts are read once


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs' rows as often as the mix reads them, all columns untouched.

    Rows that tie (equal id and text) are read equally often; what is left over when the last epoch takes
    some of them only is read from one of them, the smallest by its other columns' hash.
    """
    rows = checkpointed(_rows(docs))
    read = mixed_rows(rows, ["ident"], **options).groupBy("ident").agg(F.count("*").alias("n"))
    plan = rows.groupBy("ident").agg(F.count("*").alias("ties")).join(read, "ident")
    plan = plan.select("ident", F.floor(F.col("n") / F.col("ties")).cast("int").alias("each"), (F.col("n") % F.col("ties")).cast("int").alias("over"))
    own = docs.select(_ident(docs).alias("ident"), whole_row(docs).alias("row"))
    held = own.alias("d").join(plan.hint("shuffle_hash").alias("p"), F.col("d.ident") == F.col("p.ident"))
    each = held.where("each > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("each"))))
    # of one ident for each source at the most
    over = held.where("over > 0").groupBy("p.ident").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("over").alias("over"))
    return each.select("row.*").union(over.select("row", F.explode(F.sequence(F.lit(1), F.col("over")))).select("row.*"))
