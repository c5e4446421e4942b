"""Operator 11: importance resampling towards a target distribution, over hashed word runs.

Texts of a batch are joined with a separator that no word holds, one pass of a
regular expression finds the words of all of them, and a search in the documents'
offsets says whose they are: a run of words that starts in one document and ends in
another is masked out before buckets are counted. The CRC-32 of a run is not taken
from its bytes: appending a word to what has a known CRC is linear over bits, so that
each distinct word is hashed once and runs are put together by table lookups.

The corpus is read twice, once for its bucket counts and once for the weights. What
is shared is as large as the number of buckets, whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, numbered, trimmed

#: Words in UTF-8: bytes from 0x80 on are those of code points from U+0080 on.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
BUCKETS, MOST_WORDS = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text that are joined at a time; a longer text goes alone.
JOIN_BYTES = 4 << 20
#: Share of the rows that an approximate percentile may be off by.
SLACK = 0.001


@functools.lru_cache(maxsize=4_096)
def _zeros(n: int) -> np.ndarray:
    """Four tables of 256 entries that take a CRC-32 register over n zero bytes, by byte of the register."""
    if n == 1:
        table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
        shifted = np.arange(256, dtype=np.uint32)
        return np.stack([table, shifted, shifted << 8, shifted << 16])
    half = _zeros(n // 2)
    twice = _over(half, half)
    return _over(_zeros(1), twice) if n % 2 else twice


def _over(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    return tables[0][registers & 255] ^ tables[1][registers >> 8 & 255] ^ tables[2][registers >> 16 & 255] ^ tables[3][registers >> 24]


def _appended(crc: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRCs of what has crc, followed by a piece of CRC `word` and `size` bytes."""
    out = np.empty_like(crc)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            out[some] = _over(_zeros(int(size[some[0]])), crc[some])
    return out ^ word


def runs(texts: list[bytes], most: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, CRC-32) of all runs of one word, of two, up to `most`, of a list of UTF-8 texts; A-Z are lower-cased. The documents of the first are those of all words."""
    joined = SEPARATOR.join(texts).lower()  # of bytes lower() changes A-Z alone
    ends_of = np.cumsum([len(t) + len(SEPARATOR) for t in texts])
    found = [(m[0], m.start()) for m in WORD.finditer(joined)]
    words = np.empty(len(found), dtype=object)
    words[:] = [w for w, _ in found]
    doc = np.searchsorted(ends_of, np.fromiter((at for _, at in found), dtype=np.int64, count=len(found)), side="right")
    del found
    code, distinct = pd.factorize(words)
    alone = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in distinct], dtype=np.uint32)
    size = np.array([len(w) + 1 for w in distinct], dtype=np.int64)
    crc = alone[code] if len(code) else np.empty(0, dtype=np.uint32)
    yield doc, crc
    for n in range(1, most):
        if len(code) <= n:
            return
        last = code[n:]
        crc = _appended(crc[: len(last)], spaced[last], size[last])
        own = doc[: len(last)] == doc[n:]
        yield doc[: len(last)][own], crc[own]


def joins(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, UTF-8 texts) of a batch's texts, so many at a time as JOIN_BYTES allows; null is empty."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > JOIN_BYTES:
            yield first, held
            first, held, size = k, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> np.ndarray:
    """How many runs of all texts fall into each bucket. A task gives one row for each bucket at most."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in joins(batch["text"]):
                for _, crc in runs(texts, most):
                    n += np.bincount(crc % buckets, minlength=buckets)
        hit = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": hit, "n": n[hit]})

    rows = docs.select("text").where(F.col("text").isNotNull()).mapInPandas(trimmed(counted), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)  # of `buckets` rows at most
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source."""
    s, t, k = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), most: int = MOST_WORDS) -> DataFrame:
    """The columns `keep` of every row of docs with n_words, n_features and weight, the sum of the gains of its runs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for batch in batches:
            words, features, weight = (np.zeros(len(batch), dtype=np.int64) for _ in range(3))
            for first, texts in joins(batch["text"]):
                some = slice(first, first + len(texts))
                for k, (doc, crc) in enumerate(runs(texts, most)):
                    n = np.bincount(doc, minlength=len(texts))
                    features[some] += n
                    if not k:
                        words[some] += n
                    g = gain[crc % len(gain)]
                    weight[some] += _sums(doc, g, len(texts))
            yield batch[list(keep)].assign(n_words=words, n_features=features, weight=weight)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    own = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    return own.mapInPandas(trimmed(summed), f"{kept}, n_words bigint, n_features bigint, weight bigint")


def _sums(doc: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Sums of g by doc, exactly: docs are in order."""
    upto = np.concatenate([[0], np.cumsum(g)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return upto[at[1:]] - upto[at[:-1]]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the hash of seed and doc_id: the same row draws the same noise each time."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The columns `keep` (doc_id among them) of every row of docs with n_features, weight, score and rank; rank says in which order it is drawn and is null where it is not.

    target (text) is what the draw should look like. A null or empty text has no
    features, weighs 0 and, having fewer than min_words words, is never drawn. Texts
    are read whole. A null doc_id draws as an empty one and comes first among equals;
    repeated doc_ids share their noise and each row counts and is drawn for itself. An
    empty docs gives an empty table, an empty target a weight by rarity alone.

    The rank needs an order over the drawn rows alone: an approximate percentile,
    whose error is bounded, gives a score that fewer than all must pass; only rows at
    or above it are range-sorted, and should too few pass it, all are.
    """
    bound_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weighed(docs, gain, keep)
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = rows.where(F.col("n_words") >= min_words)
    told = able.agg(F.count("*").alias("n"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - SLACK), int(2 / SLACK)).alias("low")).first()
    n = percent * told["n"] // 100
    out = [*keep, "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not n:
        return rows.select(*out, none)
    high = (F.col("n_words") >= min_words) & (F.col("score") >= told["low"])
    if rows.where(high).count() < n:
        high = F.col("n_words") >= min_words
    drawn = numbered(rows.where(high), F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight")
    rank = F.when(F.col("nth") < n, F.col("nth") + 1).cast("long")
    return rows.where(~high).select(*out, none).unionByName(drawn.select(*out, rank.alias("rank")))
