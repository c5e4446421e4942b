"""Operator 13: how sources diverge from each other and from their language, term by term.

Each group, a source within a language, and each language as a whole gives every kept
term a smoothed integer share p of a billion. Two shares diverge by
f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Pairs of sources sum f over all kept terms. Terms are dealt by hash into parts of
bounded size; a part holds its terms for all sources as a matrix, and gives one sum
for each pair.

The terms that stand out in a source most are found by dominance: f grows with the
count in the group and falls with that in the language, so that a term with k others
above it in both (and before it in UTF-8) can't be among the first k. Each partition
keeps the terms that fewer than k others dominate, before any total is known; these
skybands are merged the same way, and only what is left is ranked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, trimmed

#: Letters of ASCII in lower case, and bytes of code points from U+0080 on.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, TOP = 10, 10
BILLION = 1_000_000_000
#: Terms times sources that a task holds as a matrix at most, about.
CELLS = 500_000
#: Counts that a task holds before it gives them on, and points of a group it holds before it looks for the skyband again.
ENTRIES, POINTS = 300_000, 4_096


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents, of each term by group; null for '' and, for every group, a row of term null."""
    lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def told() -> pd.DataFrame:
            rows = [(l, s, t.decode("utf-8", "replace"), c, df[t]) for (l, s), (n, df) in held.items() for t, c in n.items()]
            rows += [(l, s, None, 0, 0) for l, s in held]
            return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for l, s, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                n, df = held.setdefault((l, s), (Counter(), Counter()))
                own = Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower())) if text else {}
                size -= len(n)
                n.update(own)
                size += len(n)
                df.update(own.keys())
                if size > ENTRIES:
                    yield told()
                    held, size = {}, 0
        if held:
            yield told()

    rows = docs.select(lang, source, "text").mapInPandas(trimmed(counted), "lang string, source string, term string, n bigint, df bigint")
    # By language and term, so that the counts of a term in all of its sources lie together from here on.
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    scaled = wide(F.lit(BILLION), 10) * wide(n + 2, 18)
    return F.lit(1).cast("long") + F.call_function("div", scaled, wide(total + 2 * terms, 18))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs: a square is below 2^60."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As share(), for total + 2 terms below 2^48: the billion is multiplied in two steps, so that nothing passes 2^63."""
    a, b = 32_000, BILLION // 32_000
    whole, rest = np.divmod(a * (n + 2), total)
    return 1 + whole * b + rest * b // total


def skyband(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The rows (n, total, term) that fewer than k others dominate: by at least their n, at most their total and an earlier term."""
    rows = rows.sort_values(["n", "total", "term"], ascending=[False, True, True], ignore_index=True)  # str order is that of UTF-8
    rows = rows[rows.groupby(["n", "total"]).cumcount() < k].reset_index(drop=True)
    total, term = rows["total"].to_numpy(), rows["term"].rank(method="first").to_numpy()
    kept = np.empty(0, dtype=np.int64)
    for first in range(0, len(rows), 256):  # who dominates comes before; of them, those of the skyband suffice
        some = np.arange(first, min(first + 256, len(rows)))
        before = (total[kept][None, :] <= total[some][:, None]) & (term[kept][None, :] < term[some][:, None])
        own = (total[some][None, :] <= total[some][:, None]) & (term[some][None, :] < term[some][:, None]) & (some[None, :] < some[:, None])
        kept = np.concatenate([kept, some[before.sum(axis=1) + own.sum(axis=1) < k]])
    return rows.iloc[kept]


def skybands(points: DataFrame, k: int) -> DataFrame:
    """Of points (lang, source, term, n, total) the k-skyband of each group within each partition."""

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], list[pd.DataFrame]] = {}
        size: Counter = Counter()
        for batch in batches:
            for key, some in batch.groupby(["lang", "source"], sort=False):
                held.setdefault(key, []).append(some)
                size[key] += len(some)
                if size[key] > POINTS:
                    band = skyband(pd.concat(held[key]), k)
                    held[key], size[key] = [band], 0  # grows by POINTS before it is looked at again
        for key in list(held):
            yield skyband(pd.concat(held.pop(key)), k)

    return points.mapInPandas(banded, points.schema)


def pair_sums(counts: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, source, item, value): f summed over all terms of the language for every two of its sources, of counts (lang, source, term, n) of kept terms and groups (lang, source, total, terms)."""
    size = groups.groupBy("lang").agg(F.count("*").alias("_k"), F.max("terms").alias("_v"))
    parts = size.select("lang", (1 + F.floor(F.col("_k") * F.col("_v") / cells)).cast("int").alias("parts"))
    dealt = counts.join(parts, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "source", "term", "n")
    every = groups.join(parts, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "source", "total", "terms")

    def summed(key: tuple, a: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        sources = g["source"].to_numpy()
        out = np.zeros((len(sources), len(sources)), dtype=np.int64)
        if len(a):
            term, terms = pd.factorize(a["term"])
            n = np.zeros((len(terms), len(sources)), dtype=np.int64)
            n[term, pd.Index(sources).get_indexer(a["source"])] = a["n"]
            p = _shares(n, (g["total"] + 2 * g["terms"]).to_numpy())
            for i in range(len(sources) - 1):
                d = p[:, i + 1 :] - p[:, i : i + 1]
                out[i, i + 1 :] = (d * d // (p[:, i + 1 :] + p[:, i : i + 1])).sum(axis=0)
            out += out.T
        i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
        return pd.DataFrame({"lang": key[0], "source": sources[i], "item": sources[j], "value": out[i, j]})

    found = dealt.groupBy("lang", "part").cogroup(every.groupBy("lang", "part")).applyInPandas(summed, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part `pair` has every other source of the group's language, by how far their terms
    diverge; part `term` the `top` terms that the group has more of than its language.
    Null text, lang and source are ''. Every row is a document, repeated ids and texts
    too. Texts are read whole, into counts by task; a group without kept terms has its
    pairs with what smoothing leaves, and value 0 where its language keeps no term. A
    language of one source has no pairs. Ties go by UTF-8. An empty table gives an
    empty one.
    """
    bound_batches(docs.sparkSession)
    counts = cut(term_counts(docs))
    own = counts.where(F.col("term").isNotNull())
    kept = own.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_docs).select("lang", "term", "total")
    points = cut(own.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    held = points.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = points.select("lang", "term", "total").distinct().groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("terms"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", none(F.col("n")).alias("total"), none(F.col("terms")).alias("terms"), none(F.col("lang_total")).alias("lang_total")))

    pairs = pair_sums(points, groups)
    merged = skybands(skybands(points, top).repartition("lang", "source"), top)
    p, q = share(F.col("n"), F.col("group_total"), F.col("terms")), share(F.col("total"), F.col("lang_total"), F.col("terms"))
    stands = merged.join(groups.withColumnRenamed("total", "group_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    stands = stands.where(F.col("p") > F.col("q")).select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    return part(pairs, "pair").unionByName(part(stands, "term").where(F.col("rank") <= top))
