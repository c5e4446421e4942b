"""Operator 5 in its distributed form: bulk-synchronous best fit over rows.

A round range-sorts the pieces of a band of lengths together with the gaps that can
take them, largest first. Each task sweeps its range with a stack: a gap is pushed, a
piece takes the gap on top, the smallest that is large enough. What a task cannot
settle is numbered, and a scan over the counts of the tasks says which piece takes
which gap of an earlier task: both meet by number. Gaps shrink, and the next round
follows until no gap takes a piece of the band; the pieces left open new sequences.

packing.pack gives the same or fewer sequences for far less work, as README's figures
show; this form is kept, and tested, beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_SWEPT = "part int, kind int, nth bigint, uid bigint, length bigint, seq bigint, gap bigint"
PAIR, GAP, PIECE = 0, 1, 2


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high] of lengths, longest first: by how many fit a sequence up to 8, then by halves."""
    edges = [capacity // k for k in range(1, 9)]
    while edges[-1] > 0:
        edges.append(edges[-1] // 2)
    return list(zip(edges[1:], edges))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events (size, is_piece, id, gap) in order, as pairs and what is left of both."""
    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    pieces = 0
    for batch in batches:
        out = []
        for size, is_piece, uid, gap in zip(batch["size"], batch["is_piece"], batch["id"], batch["gap"], strict=True):
            if not is_piece:
                stack.append((uid, gap))
            elif stack:
                seq, gap = stack.pop()
                out.append((part, PAIR, 0, uid, size, seq, gap))
            else:
                out.append((part, PIECE, pieces, uid, size, 0, 0))
                pieces += 1
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SWEPT.split(", ")])
    yield pd.DataFrame([(part, GAP, k, 0, 0, seq, gap) for k, (seq, gap) in enumerate(stack)], columns=[c.split()[0] for c in _SWEPT.split(", ")])


def _scan(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part of pieces, first, count, part of gaps, its gap for the first) from (gaps, pieces) that each part has left: pieces take the gaps last left by the parts before."""
    stack: list[list[int]] = []
    out = []
    for part in sorted(left):
        gaps, pieces = left[part]
        first = 0
        while first < pieces and stack:
            before, n = stack[-1]
            take = min(n, pieces - first)
            out.append((part, first, take, before, n - 1))
            first += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def pack(cut_pieces: DataFrame, capacity: int, count: list[int] | None = None) -> DataFrame:
    """cut_pieces, rows with a length of 1 to capacity, with sequence_id and offset. `count` gets the number of rounds."""
    spark = cut_pieces.sparkSession
    rows = cut(cut_pieces.withColumn("uid", F.monotonically_increasing_id()))
    seats = []  # (uid, seq, offset)
    gaps = spark.createDataFrame([], "seq bigint, gap bigint")
    opened = rounds = 0
    for low, high in bands(capacity):
        asked = rows.where((F.col("length") > low) & (F.col("length") <= high)).select("uid", "length")
        n_asked = asked.count()
        while n_asked:
            rounds += 1
            able = gaps.where(F.col("gap") > low)
            # A gap beyond the band takes as many of its pieces as surely fit, each in a slot.
            slots = able.withColumn("_s", F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.col("gap") / high), F.lit(1)).cast("int"))))
            events = asked.select(F.col("length").alias("size"), F.lit(1).alias("is_piece"), F.col("uid").alias("id"), F.lit(0).cast("long").alias("gap")).unionByName(
                slots.select(F.least("gap", F.lit(high).cast("long")).alias("size"), F.lit(0).alias("is_piece"), F.col("seq").alias("id"), "gap")
            )
            order = [F.desc("size"), F.asc("is_piece"), F.asc("id")]
            swept = cut(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_sweep, _SWEPT))
            left = {r["part"]: (r["g"], r["p"]) for r in swept.groupBy("part").agg(F.count_if(F.col("kind") == GAP).alias("g"), F.count_if(F.col("kind") == PIECE).alias("p")).collect()}
            spans = spark.createDataFrame(_scan(left), "part int, first bigint, n bigint, g_part int, g_nth bigint")  # two for each part at most
            away = swept.where(F.col("kind") == PIECE).join(F.broadcast(spans), "part").where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n")))
            away = away.select("uid", "length", "g_part", (F.col("g_nth") - (F.col("nth") - F.col("first"))).alias("g_nth"))
            held = swept.where(F.col("kind") == GAP).select(F.col("part").alias("g_part"), F.col("nth").alias("g_nth"), "seq", "gap")
            pairs = swept.where(F.col("kind") == PAIR).select("uid", "length", "seq", "gap").unionByName(away.join(held, ["g_part", "g_nth"]).select("uid", "length", "seq", "gap"))
            w = Window.partitionBy("seq").orderBy(F.desc("length"), "uid")
            pairs = cut(pairs.withColumn("upto", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))))
            n_pairs = pairs.count()
            if n_pairs:
                seats.append(pairs.select("uid", "seq", (capacity - F.col("gap") + F.col("upto") - F.col("length")).alias("offset")))
                taken = pairs.groupBy("seq").agg(F.sum("length").alias("taken"))
                gaps = cut(gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"))
                asked = cut(asked.join(pairs.select("uid"), "uid", "left_anti"))
                n_asked -= n_pairs
                continue
            # None fits: the pieces left open sequences, as many to each as surely fit.
            each = capacity // high
            starts, total = [], 0
            for part in sorted(left):
                starts.append((part, total))
                total += left[part][1]
            base = spark.createDataFrame(starts, "part int, start bigint")
            nth = swept.where(F.col("kind") == PIECE).join(F.broadcast(base), "part").select("uid", "length", (F.col("start") + F.col("nth")).alias("nth"))
            new = nth.withColumn("seq", (F.floor(F.col("nth") / each) + opened).cast("long"))
            new = cut(new.withColumn("upto", F.sum("length").over(Window.partitionBy("seq").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))))
            seats.append(new.select("uid", "seq", (F.col("upto") - F.col("length")).alias("offset")))
            gaps = cut(gaps.unionByName(new.groupBy("seq").agg((capacity - F.sum("length")).alias("gap")).where("gap > 0")))
            opened += -(-total // each)
            n_asked = 0
    if count is not None:
        count.append(rounds)
    out = spark.createDataFrame([], "uid bigint, seq bigint, offset bigint")
    for s in seats:
        out = out.unionByName(s)
    return rows.join(out, "uid").drop("uid").withColumnRenamed("seq", "sequence_id")
