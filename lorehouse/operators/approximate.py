"""Approximate nearest vectors: tables of random-hyperplane buckets, several probed by each query, exact re-scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .joins import QUERY_BLOCK, _Best, _unit, top_k

#: Hyperplanes of a table, tables, and buckets of each table that a query looks into.
BITS, TABLES, PROBES = 6, 8, 10
SEED = 7
#: Rows that meet a block of queries at a time.
ROWS = 2_000
#: From this share of candidates on, all pairs of a batch are multiplied at once and the others masked, which is faster than pair by pair.
DENSE = 0.2


class Planes:
    """Hyperplanes of all tables for vectors of one length."""

    def __init__(self, dim: int, bits: int = BITS, tables: int = TABLES, seed: int = SEED):
        self.bits, self.tables = bits, tables
        self.normals = np.random.default_rng(seed).normal(size=(dim, tables, bits))
        flips = np.arange(1 << bits)
        self.flips = flips[:, None] >> np.arange(bits) & 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return (np.einsum("nd,dtb->ntb", x, self.normals) > 0) @ (1 << np.arange(self.bits))

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """For each vector, table and bucket whether it is probed: those that are reached over the planes the vector is nearest to."""
        side = np.einsum("nd,dtb->ntb", x, self.normals)
        cost = np.einsum("ntb,fb->ntf", side**2, self.flips)
        first = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        own = (side > 0) @ (1 << np.arange(self.bits))
        out = np.zeros((len(x), self.tables, 1 << self.bits), dtype=bool)
        np.put_along_axis(out, own[:, :, None] ^ first, True, axis=2)
        return out


def build_index(corpus: DataFrame, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """(id, v, codes) of corpus (id, v), written once for any number of searches: unit vectors and their bucket in each table. Null vectors and those without length have no bucket."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, Planes] = {}
        for batch in batches:
            for dim, some in batch.groupby(batch["v"].map(len)):
                x = _unit(some["v"])
                one = planes.setdefault(int(dim), Planes(int(dim), bits, tables, seed))
                yield pd.DataFrame({"id": some["id"].to_numpy(), "v": list(x), "codes": list(one.codes(x).astype(np.int32))})

    rows = corpus.where(F.col("v").isNotNull() & F.exists("v", lambda c: c != 0)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return cut(rows.mapInPandas(coded, "id bigint, v array<double>, codes array<int>"))


def search_index(queries: DataFrame, index: DataFrame, k: int, bits: int = BITS, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, id, sim, rank): for queries (query_id, v) the k rows of highest cosine among those of an index (of the same bits, tables and seed) that share a probed bucket, ties to the smaller id.

    Queries go to the tasks in blocks of QUERY_BLOCK; a task multiplies a query with its
    candidates alone and keeps k rows for each, so that no vector and no pair is
    shuffled. All vectors must be of the queries' length.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.where(F.col("v").isNotNull()).select("query_id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    asked = cut(asked) if blocks > 1 else asked
    out = spark.createDataFrame([], "query_id bigint, id bigint, sim double")
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        x = _unit([r["v"] for r in rows])
        planes = Planes(x.shape[1], bits, tables, seed)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), x, planes.probed(x, probes)))

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, probed = shared.value
            best = _Best(len(ids), k)
            for batch in batches:
                for first in range(0, len(batch), ROWS):
                    some = batch.iloc[first : first + ROWS]
                    v, codes = np.stack(some["v"].to_numpy()), np.stack(some["codes"].to_numpy())
                    met = probed[:, 0, :][:, codes[:, 0]]
                    for t in range(1, codes.shape[1]):
                        met |= probed[:, t, :][:, codes[:, t]]
                    if met.mean() >= DENSE:
                        sim = np.where(met, np.round(q @ v.T, 9), -np.inf)
                    else:
                        n, m = np.nonzero(met)
                        sim = np.full(met.shape, -np.inf)
                        for a in range(0, len(n), 100_000):
                            i, j = n[a : a + 100_000], m[a : a + 100_000]
                            sim[i, j] = np.round(np.einsum("ij,ij->i", q[i], v[j]), 9)
                    best.put(sim, some["id"].to_numpy())
            n, j, _, sim = best.rows()
            yield pd.DataFrame({"query_id": ids[n], "id": j, "sim": sim})

        one = index.mapInPandas(near, "query_id bigint, id bigint, sim double")
        out = out.unionByName(cut(top_k(one, k, ("query_id",), F.desc("sim"), "id").drop("rank")) if blocks > 1 else one)
    return top_k(out, k, ("query_id",), F.desc("sim"), "id").withColumn("sim", F.round("sim", 6))


def approximate_knn(queries: DataFrame, corpus: DataFrame, k: int, **how: int) -> DataFrame:
    """search_index over an index built for it; stands in for vector_knn where not every neighbour is needed."""
    probes = how.pop("probes", PROBES)
    return search_index(queries, build_index(corpus, **how), k, probes=probes, **how)


def candidate_share(queries: DataFrame, index: DataFrame, bits: int = BITS, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> float:
    """Which share of all pairs of some queries (v), few enough for one task, and the index is scored."""
    x = _unit([r["v"] for r in queries.select(F.col("v").cast("array<double>").alias("v")).collect()])
    shared = queries.sparkSession.sparkContext.broadcast(Planes(x.shape[1], bits, tables, seed).probed(x, probes))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = np.stack(batch["codes"].to_numpy())
                hit = np.zeros((len(shared.value), len(batch)), dtype=bool)
                for t in range(codes.shape[1]):
                    hit |= shared.value[:, t, :][:, codes[:, t]]
                yield pd.DataFrame({"hit": [int(hit.sum())], "n": [hit.size]})

    r = index.select("codes").mapInPandas(met, "hit bigint, n bigint").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).first()
    return (r["hit"] or 0) / max(r["n"] or 0, 1)
