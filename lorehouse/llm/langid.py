"""Operator 6: language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-cased letters, everything else
being one space. n-grams are packed into integers, 15 bits a character, and kept in
sorted arrays with their discounted probabilities and back-off weights. A text gets
the language of the lowest cross-entropy per character.

Rejection is calibrated on documents that no model was fitted to: how far their
entropy lies above their language's mean, in units of the spread that texts of their
length have. The limit is the quantile of that excess over all languages, and a text
beyond it keeps its language but loses its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Training documents of a language, and of all languages together, about: those whose hash falls below bound / count. Of more than TRAIN_TOTAL / TRAIN_DOCS languages each has an even part of the total.
TRAIN_DOCS, TRAIN_TOTAL = 2_000, 40_000
#: Languages whose counts are broadcast at most.
FEW_LANGS = 100_000
#: One in so many training documents sets the limits instead of being learned from.
LIMIT_PART = 5
ORDER, BITS = 4, 15
SPACE = 32
#: Texts of a known language that the limit may reject.
REJECTS = 0.001
#: Units of excess beyond the limit over which a score falls to about a third.
FADE = 1.0
#: Nats of cross-entropy by which a language must lead for a score of about 0.73.
WIDTH = 0.1

_NORM = np.full(0x10000, SPACE, dtype=np.uint32)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and chr(_c).isalpha():
        _x = chr(_c).lower()
        _NORM[_c] = ord(_x[0]) if len(_x) == 1 else _c
_NORM = np.where(_NORM < 1 << BITS, _NORM, _NORM * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, bool]:
    """The n-grams of a text, one ending at each of its characters, and whether it has a letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = codes > 0xFFFF
    c = _NORM[np.where(high, 0, codes)]
    if high.any():
        letters = np.array([chr(x).isalpha() for x in codes[high]])
        c[high] = np.where(letters, codes[high].astype(np.int64) & ((1 << BITS) - 1), SPACE)
    letter = c != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of spaces
    c = np.concatenate([np.full(ORDER - 1, SPACE), c[keep], [SPACE] if len(c) and keep[-1] and letter[-1] else []]).astype(np.int64)
    n = len(c) - ORDER + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(ORDER):
        out = out << BITS | c[k : k + len(out)]
    return out, bool(letter.any())


class KneserNey:
    """p(last character | those before) of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys are all n-grams of the top order."""
        self.tables = []  # from order ORDER down to 1: keys, discounted share, contexts, back-off
        for order in range(ORDER, 0, -1):
            at = np.argsort(keys)
            keys, counts = keys[at], counts[at].astype(float)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, of = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(of, counts)
            self.tables.append((keys, (counts - discount).clip(0) / total[of], contexts, discount * np.bincount(of) / total))
            # Below the top, a gram counts by the characters that come before it.
            keys, counts = np.unique(keys & ((1 << BITS * (order - 1)) - 1), return_counts=True)
        self.letters = len(self.tables[-1][0]) + 1

    def log_p(self, g: np.ndarray) -> np.ndarray:
        p = np.full(len(g), 1.0 / self.letters)
        for order, (keys, share, contexts, back) in zip(range(1, ORDER + 1), reversed(self.tables), strict=True):
            part = g & ((1 << BITS * order) - 1)
            p *= _found(contexts, back, part >> BITS, 1.0)
            p += _found(keys, share, part, 0.0)
        return np.log(p)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, otherwise: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], otherwise)


class Identifier:
    """Models by language; means, spread and limit say what entropies their own texts have."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.means = np.full(len(self.langs), np.inf)
        self.spread = (0.0, 1.0)
        self.limit = np.inf

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, the characters, and which texts have a letter."""
        both = [grams(t) for t in texts]
        has = np.array([b for _, b in both], dtype=bool)
        sizes = np.array([len(g) for g, _ in both], dtype=np.int64)
        out = np.full((len(texts), len(self.langs)), np.inf)
        if sizes.sum():
            which, distinct = pd.factorize(np.concatenate([g for g, _ in both]))
            some = sizes > 0
            begin = (np.cumsum(sizes) - sizes)[some]
            for k, model in enumerate(self.models):
                out[some, k] = -np.add.reduceat(model.log_p(distinct)[which], begin) / sizes[some]
        return out, sizes, has

    def excess(self, h: np.ndarray, sizes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far entropies lie above their language's mean, in spreads of texts of their length; 0 before calibration."""
        a, b = self.spread
        with np.errstate(invalid="ignore"):
            out = (h - self.means[lang]) / np.sqrt(a + b / np.maximum(sizes, 1))
        return np.where(np.isfinite(self.means[lang]), out, 0.0)

    def calibrate(self, lang: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> None:
        """Means, spread and limit from texts that no model has seen: their languages, entropies under these, and lengths. A language without any keeps no mean and rejects nothing."""
        if not len(h):
            return
        n = np.bincount(lang, minlength=len(self.langs))
        weight = np.bincount(lang, sizes, len(self.langs))
        with np.errstate(invalid="ignore"):
            self.means = np.where(n > 0, np.bincount(lang, h * sizes, len(self.langs)) / weight, np.inf)
        square, inverse = (h - self.means[lang]) ** 2, 1.0 / sizes
        # square is about a + b inverse, both not below 0
        slope = max(float(np.cov(inverse, square)[0, 1] / max(inverse.var(ddof=1), 1e-18)), 0.0) if len(h) > 2 else 0.0
        self.spread = (max(float(square.mean() - slope * inverse.mean()), 1e-4), slope)
        self.limit = float(np.quantile(self.excess(h, sizes, lang), 1 - REJECTS, method="higher"))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        h, sizes, has = self.entropies(texts)
        best = h.argmin(axis=1)  # ties to the first language
        low = h[np.arange(len(h)), best]
        with np.errstate(invalid="ignore"):
            score = 1 / np.exp(-(h - low[:, None]) / WIDTH).sum(axis=1)
            over = np.where(has, self.excess(low, sizes, best) - self.limit, -1.0)
        score = score * np.exp(-np.maximum(over, 0.0) / FADE)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0), over > 0


def _chunks(texts: pd.Series, chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch of about so many characters: bounds what a worker holds at once."""
    start = total = 0
    for n, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield slice(start, n + 1)
            start, total = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def learn(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Identifier:
    """Models of all languages of rows (doc_id, text, lang), from about `per_lang` whole documents of each, TRAIN_TOTAL of all, chosen by hash; one in LIMIT_PART of these sets the limits. No n-gram of the sample is left out."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")))
    langs = sizes.count()
    if not langs:
        return Identifier({})
    share = sizes.select("of", (min(per_lang, TRAIN_TOTAL / langs) / F.col("n")).alias("share"))
    share = F.broadcast(share) if langs <= FEW_LANGS else share
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    part = (F.pmod(F.xxhash64("doc_id", F.lit(66)), F.lit(LIMIT_PART)) == 0).alias("apart")
    sample = known.join(share, F.col("lang") == F.col("of")).where(drawn < F.col("share")).select("lang", "text", part)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for part in _chunks(texts):
                    g, c = np.unique(np.concatenate([grams(t)[0] for t in texts.iloc[part]]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g, "n": c})

    table = cut(sample.where(~F.col("apart")).drop("apart").mapInPandas(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # The distinct n-grams of TRAIN_TOTAL documents.
    found = Identifier({lang: KneserNey(t["gram"].to_numpy(), t["n"].to_numpy()) for lang, t in table.toArrow().to_pandas().groupby("lang")})

    shared = spark.sparkContext.broadcast(found)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = shared.value
        place = {x: k for k, x in enumerate(one.langs)}
        for batch in batches:
            batch = batch[batch["lang"].isin(place)]
            for part in _chunks(batch["text"]):
                h, sizes, has = one.entropies(list(batch["text"].iloc[part]))
                at = np.array([place[x] for x in batch["lang"].iloc[part]], dtype=np.int64)
                yield pd.DataFrame({"lang": at, "h": h[np.arange(len(h)), at], "size": sizes})[has]

    t = sample.where("apart").select("lang", "text").mapInPandas(own, "lang bigint, h double, size bigint").orderBy("lang", "h", "size").toArrow().to_pandas()  # a few numbers for each document of the sample
    found.calibrate(t["lang"].to_numpy(), t["h"].to_numpy(), t["size"].to_numpy())
    return found


def identify(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row.

    Learns from text and lang of rows whose crc32(doc_id) mod 3 is not 1. A text
    that is null or has no letter is `und` with score 0; so is every text where
    there is nothing to learn from. A null doc_id is not held out and not learned
    from. score is the softmax of the cross-entropies at WIDTH nats, ties between
    languages go to the first by name; rejected marks texts unlike the texts of their
    language, whose score falls with their distance. Texts of any length are read
    whole. Repeated rows get the same prediction.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(fold != 1).select("doc_id", "text", "lang"), per_lang))

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = model.value
        for batch in batches:
            for part in _chunks(batch["text"]):
                rows = batch.iloc[part]
                lang, score, rejected = one.predict(list(rows["text"]))
                yield rows.drop(columns="text").assign(lang_pred=lang, score=score, rejected=rejected)

    rows = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
