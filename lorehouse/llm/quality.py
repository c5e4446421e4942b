"""Operator 2: quality rules, by gradient-boosted trees over document statistics.

The trees are fitted on the driver to a bounded sample of labelled rows
(`TRAIN_ROWS`, documented as a parameter), with monotonic constraints: more
symbols, repeated lines, repeated phrases, capitals or bars never make a document
look better. They are flattened into arrays of nodes, with which a worker scores a
batch by one vectorised descent per tree. Statistics cover every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, trimmed

#: Labelled rows that the trees are fitted to, about, at most: those whose hash, one of DRAWS, lies below a threshold.
TRAIN_ROWS, DRAWS = 20_000, 1 << 30
#: Share of the good labelled rows held out of the fit that the verdict may lose.
FALSE_REJECTS = 0.001

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, with the direction of their effect on the chance of low quality: 1 up, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": 1, "dup_line_share": 1, "repeat_share": 1, "upper_share": 1,
    "letter_share": 0, "digit_share": 0, "bars_per_word": 1, "exclaims_per_word": 1, "distinct_share": 0, "line_words": 0, "stop_share": 0, "long_words": 0,
}

_UPPER, _LETTER, _DIGIT = 1, 2, 4
_CLASS = np.zeros(0x10000, dtype=np.uint8)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000:
        _x = chr(_c)
        _CLASS[_c] = (_UPPER if _x.isupper() else 0) | (_LETTER if _x.isalpha() else 0) | (_DIGIT if _x.isdigit() else 0)


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    often = np.fromiter((found[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= often
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(map(text.count, SYMBOLS))
    base = [n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(codes, 0xFFFF)], minlength=8) if len(codes) else np.zeros(8, dtype=int)
    letters = kinds[_LETTER] + kinds[_LETTER | _UPPER]
    distinct = Counter(words)
    m = max(n, 1)
    return base, [
        np.log1p(n), chars / m, symbols / m, base[3] / max(len(lines), 1), base[4] / m, kinds[_LETTER | _UPPER] / max(letters, 1),
        letters / max(chars, 1), kinds[_DIGIT] / max(chars, 1), text.count("|") / m, text.count("!") / m, len(distinct) / m, n / max(len(lines), 1),
        sum(c for w, c in distinct.items() if len(w) <= 3) / m, sum(c for w, c in distinct.items() if len(w) > 20) / m,
    ]


# --- trees -----------------------------------------------------------------------


class Trees:
    """Boosted trees as node arrays; a leaf points to itself, so that a descent of `depth` steps ends in one."""

    def __init__(self, roots, feature, threshold, left, right, value, depth, start):
        self.roots, self.depth, self.start = np.array(roots), depth, start
        self.feature, self.left, self.right = (np.array(x, dtype=np.int64) for x in (feature, left, right))
        self.threshold, self.value = (np.array(x, dtype=np.float64) for x in (threshold, value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting on binned features. A split whose children would break a feature's sign is refused, and children keep to their side of the parent's middle."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = rate * float(np.clip(-gs / (hs + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    wl, wr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least) | (signs[j] * (wr - wl) < 0)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, wl[k], wr[k]))
            if best[1]:
                j, k, wl, wr = best[1]
                middle = (wl + wr) / 2
                feature[at], threshold[at], left[at], right[at] = j, float(edges[j][k]), node(), node()
                goes = codes[rows, j] <= k
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
                open_nodes += [(left[at], rows[goes], *bounds[0], level + 1), (right[at], rows[~goes], *bounds[1], level + 1)]
            else:
                margin[rows] += value[at]
    return Trees(roots, feature, threshold, left, right, value, depth, start)


# --- on Spark ---------------------------------------------------------------------


def _per_batch(trees: Trees | None, limit: float, labelled: bool, with_text: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [statistics(t) for t in batch["text"]]
            x = np.array([f for _, f in both], dtype=float).reshape(-1, len(FEATURES))
            if labelled:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "low": batch["low"], "x": list(x)})
                continue
            base = np.array([b for b, _ in both], dtype=np.int64).reshape(-1, len(BASE))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            low = trees.chance(x) if trees else np.zeros(len(x))
            yield (batch if with_text else batch.drop(columns="text")).assign(**dict(zip(BASE, base.T, strict=True)), base_failed=failed, kept=~failed & (low < limit), low_quality=low)

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Trees | None, float]:
    """Trees for the chance of label quality 0, and the least chance that rejects.

    Fitted to about `rows` labelled documents at most, those whose hash lies below a
    threshold. Of these, a fifth is held out: the limit is the least one from 0.5 up that loses at most
    FALSE_REJECTS of its good documents. Without two classes there are no trees.
    Of several labels of an id the best counts, of several documents the one of
    least statistics, so that reruns agree.
    """
    seen = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("double").alias("low")).na.drop().groupBy("id").agg(F.min("low").alias("low"))
    seen = seen.where(F.pmod(F.xxhash64("id"), F.lit(DRAWS)) < F.lit(int(DRAWS * min(1.0, rows / max(seen.count(), 1)))))
    seen = F.broadcast(seen)  # rows of 16 bytes, about `rows` at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(seen, F.col("doc_id") == F.col("id")).drop("id")
    one = found.mapInPandas(_per_batch(None, 1, True), f"doc_id {kind}, low double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "low")).alias("b"))
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("b.*").collect()  # about `rows` at most
    if len({r["low"] for r in got}) < 2:
        return None, 1.0
    x, y = np.array([r["x"] for r in got]), np.array([r["low"] for r in got])
    signs = list(FEATURES.values())
    part = np.arange(len(y)) % 5 == 4
    limit = 0.5
    if len({*y[~part]}) == 2 and (good := part & (y == 0)).any():
        limit = max(limit, float(np.quantile(fit(x[~part], y[~part], signs).chance(x[good]), 1 - FALSE_REJECTS)) + 1e-9)
    return fit(x, y, signs), min(limit, 0.95)


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), rows: int = TRAIN_ROWS) -> DataFrame:
    """The columns `keep` of every row of docs, its base counts, base_failed, kept, and low_quality, the chance that it is bad.

    A null text has no words and fails. Null and repeated doc_ids keep their rows, and
    equal texts get equal verdicts; texts of any length are read whole;
    columns of docs beside `keep` and text are dropped, whatever their names. Empty
    or one-sided labels leave the base rules alone to decide.
    """
    trees, limit = train(docs, labels, rows)
    cols = ["text", *[c for c in keep if c != "text"]]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols[1:])
    out = f"{kinds}, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, kept boolean, low_quality double"
    if "text" in keep:
        out = f"text string, {out}"
    return docs.select(*cols).mapInPandas(trimmed(_per_batch(trees, limit, False, "text" in keep)), out)
