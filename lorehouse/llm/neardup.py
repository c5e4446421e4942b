"""Operator 7: near-duplicate documents by DartMinHash, banded joining and an exact check.

Equal texts are one node of the graph, found by their digest. A shingle weighs as
often as it occurs in its text. For every text, darts are thrown at the plane of
(shingle, weight): those that land below a shingle's weight count, each has a rank,
and a signature keeps, for each of its coordinates, the dart of least rank that was
dealt to it. Two texts agree in a coordinate with the chance of their weighted
Jaccard similarity: the sum of the lesser counts over that of the greater. Throwing
costs a few darts for each coordinate however many shingles there are.

Texts that agree in a band of coordinates are candidates. Every candidate link is
checked exactly, on the shingles with their counts, but a bucket is never expanded into all
its pairs: first its members meet the bucket's most central text; only members that
are then still in different classes, and that can be alike by what they share with
any other text, meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, trimmed

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 5: a pair at 0.8 meets with a chance of 0.9999.
BANDS, ROWS = 24, 5
#: Size of the filter over the keys of candidates that goes to all tasks: 16 MB. It lets
#: through one text in a hundred at ten million keys, and more beyond, all of which a join drops.
FILTER_BITS = 1 << 27
#: A shingle is hot from this share of all on, so that hot ones number at most its inverse.
HOT_SHARE = 10_000
#: Darts drawn at once.
DARTS = 100_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no visible pattern."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of each text, in order of number and hash. A text of fewer words than `size` is one shingle."""
    words = [WORD.findall(t or "") for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    if not n.sum():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    which, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    h = pd.util.hash_array(distinct, categorize=False)[which]
    begin = np.cumsum(n) - n
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[of]
    x = np.zeros(len(at), dtype=np.uint64)
    end = begin[of] + n[of]
    for k in range(size):
        inside = at + k < end
        x = x * _GOLD + np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(0))
    x = _mix(x)
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (x[1:] != x[:-1])]))
    return of[first], x[first], np.diff(np.append(first, len(x)))


def dart_minhash(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n rows of k dart ids) of n weighted sets given as (set number, element hash, weight), and which of them have elements.

    An element's weights are laid out in regions [2^v - 1, 2^(v+1) - 1), each with
    its own stream of darts of rate 2^v, in order of rank. Darts are drawn up to a
    rank that gives a set about k ln k + 2 k of them; a set left with an empty
    coordinate draws on, up to twice the rank.
    """
    ids = np.zeros((n, k), dtype=np.uint64)
    weight = np.asarray(weight, dtype=float)
    total = np.bincount(of, weight, n)
    has = total > 0
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = has.copy()
    levels = np.floor(np.log2(weight + 1 - 1e-12)).astype(np.int64).clip(0) + 1
    row = np.repeat(np.arange(len(of)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    rate = 2.0**level
    seed = _mix(element[row] + _GOLD * (level.astype(np.uint64) + np.uint64(1)))
    while todo.any():
        live = np.flatnonzero(todo[of[row]])
        rank = np.zeros(len(live))
        found = []
        turn = 0
        while len(live):
            width = max(1, min(64, DARTS // len(live)))  # darts drawn at once for each element
            turns = np.arange(turn + 1, turn + 1 + width, dtype=np.uint64)
            turn += width
            x = _mix(seed[live][:, None] + _GOLD * turns)
            gaps = -np.log1p(-((x >> np.uint64(11)).astype(float) * 2.0**-53)) / rate[live][:, None]
            ranks = rank[:, None] + np.cumsum(gaps, axis=1)
            near = ranks <= limit[of[row[live]]][:, None]
            e, x, r = row[live[np.nonzero(near)[0]]], x[near], ranks[near]
            r2 = rate[live[np.nonzero(near)[0]]]
            hit = (_mix(x ^ _M1) >> np.uint64(11)).astype(float) * 2.0**-53 * r2 + r2 - 1 < weight[e]
            e, x, r = e[hit], x[hit], r[hit]
            found.append((of[e] * k + (_mix(x ^ _M2) % np.uint64(k)).astype(np.int64), r, x))
            stay = near[:, -1]
            live, rank = live[stay], ranks[stay, -1]
        cell, ranks, dart = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ranks, cell))
        cell, dart = cell[order], dart[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, dtype=bool)
        filled = np.bincount(cell[first] // k, minlength=n) == k
        ids.reshape(-1)[cell[first]] = dart[first]
        todo &= ~filled
        limit = np.where(todo, limit * 2, limit)
    return ids, has


def bands(ids: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature."""
    out = np.zeros((len(ids), n_bands), dtype=np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out * _GOLD + ids[:, r::rows][:, :n_bands])
    return out.view(np.int64)


def elements(of: np.ndarray, x: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n texts the sorted 64-bit elements of its shingles: a shingle that occurs c times is c elements, so that sets of elements share what texts share by count."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of, x = np.repeat(of, count), np.repeat(x, count)
    x = np.where(nth > 0, _mix(x + _GOLD * nth.astype(np.uint64)), x).view(np.int64)
    return [np.unique(part) for part in np.split(x, np.searchsorted(of, np.arange(1, n)))]


def _chunks(texts: pd.Series, chars: int = 500_000) -> Iterator[slice]:
    start = total = 0
    for n, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield slice(start, n + 1)
            start, total = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key")


def band_rows(docs: DataFrame) -> DataFrame:
    """Distinct (band, key) of all texts with a word."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch["text"]):
                rows = batch.iloc[part].drop_duplicates("key")
                of, x, count = shingles(list(rows["text"]))
                ids, has = dart_minhash(of, x, count, len(rows))
                yield pd.DataFrame({"key": rows["key"].to_numpy()[has], "bands": list(bands(ids[has]))})

    signatures = docs.select(text_key(F.col("text")), "text").mapInPandas(trimmed(signed), "key binary, bands array<bigint>")
    return signatures.select(F.explode("bands").alias("band"), "key").distinct()


def membership(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter over keys as bytes: bits / 8 of them, however many keys there are. Spark builds it in pieces of 4 kB."""
    at = keys.select(F.explode(_places(bits)).alias("p")).select((F.col("p") + 1).alias("p"))
    pieces = at.groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()
    out = np.zeros((bits // 32_768, 4_096), dtype=np.uint8)
    for r in pieces:
        out[r["n"] - 1] = np.frombuffer(r["b"], dtype=np.uint8)
    return out.reshape(-1)


def _places(bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), F.lit(bits)) for k in range(3)])


def shingle_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, set) of the texts whose key is among keys: the elements of their shingles.

    A filter of fixed size over keys goes to the texts, so that most of them never
    leave their task; the join by key that follows drops what it let through.
    """
    held = docs.sparkSession.sparkContext.broadcast(membership(keys, FILTER_BITS))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for batch in batches:
            if not len(batch):
                continue
            p = np.stack(batch["places"].to_numpy())
            some = batch[((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)].drop_duplicates("key")
            for part in _chunks(some["text"]):
                rows = some.iloc[part]
                yield pd.DataFrame({"key": rows["key"].to_numpy(), "set": elements(*shingles(list(rows["text"])), len(rows))})

    texts = docs.select(text_key(F.col("text")), "text").withColumn("places", _places(FILTER_BITS))
    return texts.mapInPandas(trimmed(sets), "key binary, set array<bigint>").join(keys, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets of elements have at least that Jaccard similarity, which is the weighted one of their shingles."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for p, q in zip(batch["p"], batch["q"], strict=True):
                small, large = sorted((len(p), len(q)))
                shared = len(np.intersect1d(p, q, assume_unique=True)) if small >= similarity * large - 1e-9 else 0
                keep.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9 and shared > 0)
            yield batch.loc[keep, ["a", "b"]]

    one, two = sets.select(F.col("key").alias("b"), F.col("set").alias("q")), sets.select(F.col("key").alias("a"), F.col("set").alias("p"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "p", "q").mapInPandas(trimmed(alike), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, label) of every end of a link (a, b): the least key that links lead to. Labels spread along links and then jump to the label of the label."""
    both = cut(links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other"))).distinct())
    labels = cut(both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), F.col("label").alias("seen")), "other").groupBy("key").agg(F.min("seen").alias("seen"))
        spread = labels.join(near, "key").select("key", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = spread.select(F.col("key").alias("label"), F.col("label").alias("further"))
        after = cut(spread.join(jump, "label", "left").select("key", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        if after.where(F.col("label") != F.col("was")).limit(1).count() == 0:
            return after.drop("was")
        labels = after.drop("was")


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(key, label) of all linked texts, and the links (a, b) between different texts that were checked.

    In a first round the members of a bucket meet its most central text, that which
    shares most buckets with most texts: of a family of copies it is the original or
    one near it, and explains most of the family. What is left in different classes
    meets in a second round (`_unexplained`).
    """
    rows = cut(band_rows(docs))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(rows.join(sizes, "band"))
    degree = cut(members.groupBy("key").agg(F.sum("n").alias("degree")))
    first = members.join(degree, "key").groupBy("band").agg(F.max(F.struct("degree", "key"))["key"].alias("first"))
    met = cut(members.join(first, "band").where(F.col("key") != F.col("first")).select(F.least("first", "key").alias("a"), F.greatest("first", "key").alias("b")).distinct())
    sets = cut(shingle_sets(docs, degree.select("key")))
    found = cut(verified(met, sets, similarity))
    labels = components(found)
    more = cut(_unexplained(members, labels, sets, similarity).join(met, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        found = cut(found.unionByName(verified(more, sets, similarity)))
        labels = components(found)
    return labels, found


def _unexplained(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts in buckets of several classes that lie in different classes and can still be alike.

    An exact join by prefix: two sets that are alike share one of the rarest few of
    their shingles, and early enough for what follows to suffice. A shingle that no
    other open text has is counted but joins nothing, so that an outsider of a
    family, whose own edits come first in its order, is settled without a partner.
    Texts of the class that has most of a shingle's texts meet only others.
    """
    labelled = cut(members.join(labels, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label")))
    several = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("band")
    open_texts = labelled.join(several, "band", "left_semi").select("key", "label").distinct()
    ids = sets.join(open_texts, "key").select("key", F.xxhash64("key").alias("id"), F.xxhash64("label").alias("class"), F.size("set").alias("n"), "set")
    tokens = cut(ids.select("id", F.explode("set").alias("token")))
    often = cut(tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where(F.col("df") > 1))
    # A shingle of very many texts meets them by broadcast, HOT_SHARE rows at most, so that no task gets them all.
    least_hot = tokens.count() / HOT_SHARE
    hot, other = often.where(F.col("df") > least_hot), often.where(F.col("df") <= least_hot)
    counted = tokens.join(F.broadcast(hot), "token").unionByName(tokens.join(F.broadcast(hot.select("token")), "token", "left_anti").join(other, "token"))
    least = F.ceil(similarity * F.col("n") - 1e-9).cast("int")
    ordered = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # of one text
    ordered = ordered.withColumn("c", F.size("t")).join(ids.select("id", "class", "n"), "id").where(F.col("c") >= least)
    prefix = cut(
        ordered.select("id", "class", "n", "c", F.posexplode(F.slice("t", F.lit(1), F.col("c") - least + 1)).alias("k", "t"))
        .select("id", "class", "n", (F.col("c") - F.col("k")).alias("rest"), F.col("t.token").alias("token"))
    )
    main = prefix.groupBy("token", "class").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "class")).alias("top"), F.count("*").alias("parts")).where(F.col("parts") > 1).select("token", F.col("top.class").alias("main"))
    both = prefix.join(main, "token")
    u = both.where(F.col("class") != F.col("main")).select("token", F.col("id").alias("u"), F.col("class").alias("u_class"), F.col("n").alias("un"), F.col("rest").alias("ur"))
    v = both.select(F.col("token").alias("t"), F.col("id").alias("v"), F.col("class").alias("v_class"), (F.col("class") == F.col("main")).alias("inner"), F.col("n").alias("vn"), F.col("rest").alias("vr"))
    enough = F.least("ur", "vr", "un", "vn") >= similarity / (1 + similarity) * (F.col("un") + F.col("vn")) - 1e-9
    pairs = u.join(v, (F.col("token") == F.col("t")) & (F.col("u_class") != F.col("v_class")) & (F.col("inner") | (F.col("u") < F.col("v"))) & enough).select("u", "v").distinct()
    named = ids.select("id", "key")
    pairs = pairs.join(named.select(F.col("id").alias("u"), F.col("key").alias("x")), "u").join(named.select(F.col("id").alias("v"), F.col("key").alias("y")), "v")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links and key for every row of docs.

    class_id is the least doc_id of the class: documents with the same text, or
    joined by a chain of texts with a weighted shingle similarity of at least `similarity`;
    n_links counts the other texts that a document's text was checked to be like. A
    null text counts as empty; texts without a word are alike only if equal. Null
    doc_ids take part; a class of them alone has a null class_id.
    """
    labels, found = links(docs, similarity)
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    rows = docs.select("doc_id", text_key(F.col("text")))
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    texts = cut(texts)
    classes = texts.groupBy("label").agg(F.min("least").alias("class_id"))
    named = texts.select("key", "label").join(classes, "label").join(degree, "key", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(named, "key").select("doc_id", "class_id", "n_links", "key")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near-duplicates: that of the least doc_id, and of rows that share it the least by its columns in order.

    Null doc_ids come after all others; of a class that has no other its least text
    by digest stays.
    """
    labels, _ = links(docs, similarity)
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    texts = cut(keyed.groupBy("_key").agg(F.min("doc_id").alias("_least")).join(labels.withColumnRenamed("key", "_key"), "_key", "left").withColumn("label", F.coalesce("label", "_key")))
    order = F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("_key").alias("text"))
    chosen = texts.groupBy("label").agg(F.min(order).alias("c")).select(F.col("c.id").alias("_id"), F.col("c.text").alias("_key"))
    kept = keyed.join(chosen, "_key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    rest = [c for c in docs.columns if c != "text"]
    return kept.groupBy("_key").agg(F.first("text").alias("text"), F.min(F.struct(*rest)).alias("_row")).select(*["text" if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns])
