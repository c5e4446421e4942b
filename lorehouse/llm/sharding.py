"""Operator 12: shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard holds VNODES places on a ring of 32 bits; a key belongs to the shard of
the first place at or after its own. A shard takes what its bound allows; keys that
find it full go on clockwise to the next shard that is not. Who comes first is
settled by a second hash of the key, not by the order of the rows, so that reruns
agree and a further document moves few others.

As all keys meet the shards in one order, a shard that is full stays so: the whole
result is told by one number for each shard, how many keys had come when it filled.
These numbers come from counts by arc and span of that order; only the span in which
a shard fills is looked at again, in ever finer spans. The rows then find their shard
by a lookup in the order of shards of their arc: nothing is moved from task to task
while the ring fills.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

SHARDS, VNODES = 8, 64
#: Spans that one look at the order is cut into. With the places of the ring it bounds what comes to the driver.
SPANS = 512
#: Rows of a block at least; slots are counted by block, then within it.
BLOCK = 1_024


class Ring:
    """Places of n shards on the ring, and for each arc, by the place that ends it, the shards in the order in which they come."""

    def __init__(self, n: int, vnodes: int = VNODES):
        places = sorted((int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[:8], 16), s) for s in range(n) for v in range(vnodes))
        self.n, self.at = n, np.array([p for p, _ in places], dtype=np.int64)
        own = [s for _, s in places]
        self.order: list[list[int]] = [[]] * len(own)
        nxt: list[int] = []
        for k in range(2 * len(own) - 1, -1, -1):  # twice round, so that every arc sees all shards
            s = own[k % len(own)]
            nxt = [s, *[x for x in nxt if x != s]]
            self.order[k % len(own)] = nxt


def _arcs(ring: Ring) -> Callable[[Column], Column]:
    at = ring.at

    @F.pandas_udf("int")
    def arc(places: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, places.to_numpy()) % len(at)).astype(np.int32))

    return arc


def filled(ring: Ring, caps: np.ndarray, rows: int, counts: Callable[[int, int, int], np.ndarray]) -> np.ndarray:
    """For each shard, how many of all rows had come when the first found it full; `rows` for one that none found full.

    counts(first, end, width) tells how many rows of each arc, by arc and span of that
    width, lie between two places of the order. Shards fill at most once each, so that
    what is looked at again are as many spans a level as there are shards.
    """
    full = np.full(ring.n, rows, dtype=np.int64)
    load = np.zeros(ring.n, dtype=np.int64)
    order = np.array(ring.order)

    def to() -> np.ndarray:
        """The shard that takes the keys of each arc: the first in its order that no key has found full."""
        return order[np.arange(len(order)), (full[order] == rows).argmax(axis=1)]

    def walk(first: int, end: int) -> None:
        width = -(-(end - first) // SPANS)
        seen = counts(first, end, width)
        for k in range(seen.shape[1]):
            come = np.zeros(ring.n, dtype=np.int64)
            np.add.at(come, to(), seen[:, k])
            if (load + come <= caps).all():
                load[:] += come
            elif width > 1:
                walk(first + k * width, min(end, first + (k + 1) * width))
            else:  # one row, at the door of a full shard
                arc = int(seen[:, k].argmax())
                while load[s := to()[arc]] >= caps[s]:
                    full[s] = first + k
                load[s] += 1

    if rows:
        walk(0, rows)
    return full


def shard(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",), slack: float = 0.0, vnodes: int = VNODES) -> DataFrame:
    """The columns `keep` of every row of docs with size, text_crc32, law, shard, slot and grown_shard.

    A shard takes at most (1 + slack) times its even share of the rows. With no slack
    the shares are the even ones, those of the first shards one more where rows are left
    over: the law is `rows`, counts at most one apart. slot numbers a shard's rows from 0
    in the order of the second hash. A null text has size 1 and the checksum of an
    empty one; null doc_ids are one key. Rows that repeat a doc_id are keys of one
    place and go on clockwise like any others, so that one doc_id may hold any share
    of the rows; rows alike in all that is kept may change places with each other. An
    empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit("key:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = lambda first, n: F.conv(F.substring(digest, first, n), 16, 10).cast("long")
    ring = Ring(shards, vnodes)
    narrow = docs.select(*keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), number(1, 8).alias("_place"), number(9, 15).alias("_turn"))
    # The rows of a doc_id are dealt by a number of their own, or all would be sorted in one task; written first, they keep it.
    rows = cut(narrow.withColumn("_own", F.monotonically_increasing_id()))
    placed = numbered(rows, "_turn", F.xxhash64("_own"), "_own")
    placed = cut(placed.select(*keep, "size", "text_crc32", _arcs(ring)(F.col("_place")).alias("arc"), "nth"))
    n = placed.count()

    def counts(first: int, end: int, width: int) -> np.ndarray:
        some = placed.where((F.col("nth") >= first) & (F.col("nth") < end)).groupBy("arc", F.floor((F.col("nth") - first) / width).cast("int").alias("span"))
        told = some.agg(F.count("*").alias("n")).toPandas()  # as many rows as the ring has places, times SPANS, at most
        out = np.zeros((len(ring.at), -(-(end - first) // width)), dtype=np.int64)
        out[told["arc"].to_numpy(), told["span"].to_numpy()] = told["n"].to_numpy()
        return out

    share = np.array([(n + shards - 1 - s) // shards for s in range(shards)])
    full = filled(ring, np.floor(share * (1 + slack)).astype(np.int64), n, counts)
    orders = docs.sparkSession.createDataFrame([(k, o) for k, o in enumerate(ring.order)], "arc int, _order array<int>")  # one row for each place of the ring
    open_for = F.array(*[F.lit(int(f)).cast("long") for f in full])
    own = F.element_at(F.filter("_order", lambda s: F.col("nth") < F.element_at(open_for, s + 1)), 1)
    block = max(BLOCK, math.isqrt(n))
    found = placed.join(F.broadcast(orders), "arc").withColumn("shard", own).withColumn("_block", F.floor(F.col("nth") / block))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("shard", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("nth"))
    slot = (F.col("_before") + within - 1).cast("long")
    law = "rows" if not slack else "bounded"
    out = found.join(blocks.drop("_n"), ["shard", "_block"])
    return out.select(*keep, "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
