"""Operator 3: mixing sources to target weights, by nested hash thresholds.

A source whose target exceeds its size is taken whole as often as it fits; the
rest of its budget goes to the documents whose hash lies below a threshold. The
threshold is found without sorting: words are summed by source and by the leading
bits of the hash, the bucket in which the budget runs out is found, and only that
bucket is looked at again with the next bits, until it holds one hash. A larger
budget gives a threshold that includes the smaller one's documents.

Sources, targets and thresholds stay tables. Up to FEW_SOURCES of them go to the rows
by broadcast; more meet the rows by a join in which every source is dealt over SALTS
parts, so that one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, cut, numbered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that one pass looks at: a source has 2 ** BITS buckets at most in a pass.
BITS = 12
#: Sources that are broadcast at most; what follows is the same beyond.
FEW_SOURCES = 100_000
SALTS = 64


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals (source, n) with id, its place by code point, null last, and target, the words to take. Weights repeat over the places; what exceeds `most` times a source's size is shared anew by weight.

    The level, words for a unit of weight, rises until no further source is full; each
    step is one aggregate over the sources.
    """
    placed = numbered(totals, F.asc_nulls_last("source")).withColumnRenamed("nth", "id")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int"))
    placed = cut(placed.withColumn("weight", weight))
    most_of = most * F.col("n")
    whole = placed.agg(F.sum("n").alias("n"), F.sum("weight").alias("w"), F.count("*").alias("k")).first()
    budget = share * (whole["n"] or 0)
    level, full = budget / whole["w"] if whole["k"] else 0.0, 0
    while full < whole["k"]:
        is_full = level * F.col("weight") >= most_of
        now = placed.agg(F.count_if(is_full).alias("k"), F.sum(F.when(is_full, most_of)).alias("held"), F.sum(F.when(~is_full, F.col("weight"))).alias("w")).first()
        if now["k"] == full:
            break
        full = now["k"]
        if full < whole["k"]:
            level = max(budget - now["held"], 0.0) / now["w"]
    return placed.withColumn("target", F.least(level * F.col("weight"), most_of)).drop("weight")


def _met(rows: DataFrame, table: DataFrame, on: Column, few: bool) -> DataFrame:
    """rows with the one row of a table of sources that `on` names. rows have hash."""
    if few:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_own", F.pmod("hash", F.lit(SALTS)).cast("int")).join(salted, on & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")


def thresholds(sized: DataFrame, budgets: DataFrame, few: bool = True) -> DataFrame:
    """For sources (id, budget), the hash below which their rows fit the budget best: (id, below), below exclusive and null for all.

    sized has id, hash (unsigned in 60 bits) and size. A pass leaves one row for each source.
    """
    hint = F.broadcast if few else lambda df: df
    found = budgets.where(F.col("budget") <= 0).select("id", F.lit(0).cast("long").alias("below"))
    state = budgets.where(F.col("budget") > 0).select("id", "budget", F.lit(0).cast("long").alias("prefix"))  # leading bits so far, budget left
    for depth in range(BITS, 61, BITS):
        bucket = F.shiftright("hash", 60 - depth)
        # A source's rows of one bucket are few, however many it has: the join by both has no hot key.
        inside = sized if depth == BITS else sized.withColumn("_at", F.shiftright(bucket, BITS)).join(hint(state.select("id", F.col("prefix").alias("_at"))), ["id", "_at"])
        sums = inside.groupBy("id", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("top"))
        run = Window.partitionBy("id").orderBy("bucket")  # 2 ** BITS rows at most
        over = (
            sums.join(hint(state), "id")
            .withColumn("upto", F.sum("words").over(run))
            .where(F.col("upto") > F.col("budget"))
            .groupBy("id")
            .agg(F.min_by(F.struct("bucket", "words", "upto", "least", "top"), "bucket").alias("b"))
        )
        left = F.col("budget") - (F.col("b.upto") - F.col("b.words"))
        at = cut(state.join(over, "id", "left").select("id", "prefix", "b", left.alias("left")))
        beyond = F.lit(None).cast("long") if depth == BITS else F.shiftleft(F.col("prefix") + 1, 60 - depth + BITS)
        # The documents of one hash: in, if that comes closer.
        one = F.when(F.col("left") * 2 > F.col("b.words"), F.col("b.top") + 1).otherwise(F.col("b.least"))
        single = F.col("b.least") == F.col("b.top")
        found = found.unionByName(at.where(F.col("b").isNull()).select("id", beyond.alias("below"))).unionByName(at.where(single).select("id", one.alias("below")))
        state = at.where(F.col("b").isNotNull() & ~single).select("id", F.col("left").alias("budget"), F.col("b.bucket").alias("prefix"))
        if not state.limit(1).count():
            break
    return found


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The columns `keep` of every row of docs with size, source_size, target and taken, the words of it that the mix takes.

    A null text has no words and is taken 0 words; a null source is a source of its
    own, the last. Rows of one doc_id share a hash and are taken or left together.
    Reruns agree: the hash is that of the doc_id. `copies` says how often the row
    is taken. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long")
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 4)
    columns = [c for c in keep if c != "source"]
    sized = cut(docs.select(*columns, "source", size.alias("size"), hashed.alias("hash")))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most)
    whole = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(int(most)))).otherwise(0).cast("int")
    plan = plan.select("id", F.col("source").alias("of"), F.col("n").alias("source_size"), "target", whole.alias("whole"))
    plan = cut(plan.withColumn("budget", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)))
    few = plan.count() <= FEW_SOURCES
    joined = _met(sized, plan, F.col("source").eqNullSafe(F.col("of")), few)
    if not few:
        joined = cut(joined)
    low = cut(thresholds(joined.select("id", "hash", "size"), plan.select("id", "budget"), few).select(F.col("id").alias("_id"), "below"))
    extra = (F.col("below").isNull() | (F.col("hash") < F.col("below"))).cast("int")
    return (
        _met(joined, low, F.col("id") == F.col("_id"), few)
        .withColumn("copies", F.least(F.col("whole") + extra, F.lit(int(most))))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*keep, "size", "source_size", "target", "taken", "copies")
    )
