"""Operator 9: personal data, by fixed patterns and a semi-Markov conditional random field.

The patterns find the base spans. The field scores whole candidate spans, runs of up
to MAX_WORDS words and MAX_CHARS characters, by features of the span as a whole (its
shape, groups of digits, separators, check digit, the words around it), and a dynamic
program over segments of that bounded length chooses boundaries and types jointly.
Both bounds are part of the model: a longer entity is not one of its segments.

It learns, on a bounded sample, from the base spans as they are and rewritten as people
write them to be read by people: other groupings and separators, trunk and
international prefixes, spelled-out at and dot; and from look-alikes that are none,
such as dates, versions and numbers whose check digit fails. So it finds what the
patterns miss. An entity holds a digit, an @ or a spelled-out at or dot; words without
any of these near are never looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field learns from, about: so many with a base span, and so many others with a cue.
TRAIN_DOCS = 1_000
#: Windows of one document that it learns from, about, and words of such a window at most.
TRAIN_WINDOWS, TRAIN_WORDS = 40, 48
MAX_WORDS, MAX_CHARS = 7, 80
#: By so much, in log odds, an added span must beat the reading without it.
MARGIN = 2.0

#: The base patterns, fixed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: An e-mail's first character is looked for from its @ backwards, as runs of its characters may be long.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: Runs of digits begin where no digit stands before: a later start of the same run cannot do better, and costs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CUE = re.compile(r"[0-9@]|(?i:\bdot\b|[\[({<](?:at|dot)[\])}>])")
#: What texts with a base span hold, and few others.
_LIKE = r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9][ ().0-9-]+[0-9]|(?:[0-9][ -]?){15}[0-9]"
_MARK = re.compile(r"[0-9@]+")
_SPELLED = re.compile(r"(?i)\bdot\b|[\[({<](?:at|dot)[\])}>]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at)):
            k = at
            while k > end and (text[k - 1].isascii() and (text[k - 1].isalnum() or text[k - 1] in "._%+-")):
                k -= 1
            if k < at:
                out.append((k, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    text = text or ""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


# --- the field ------------------------------------------------------------------------


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) that may hold an entity: each word with a cue and MAX_WORDS - 1 words on either side, but one where the cue is a digit or an @; runs that meet are joined."""
    cues = [(m.start(), 1) for m in _MARK.finditer(text)]
    if _SPELLED.search(text):
        cues += [(m.start(), MAX_WORDS - 1) for m in _SPELLED.finditer(text)]
    if not cues:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    near = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.searchsorted(starts, [a for a, _ in cues], side="right") - 1
    for k, around in {*zip(at.tolist(), (n for _, n in cues))}:
        near[max(0, k - around)] += 1
        near[min(len(words), k + around + 1)] -= 1
    inside = np.cumsum(near[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return [words[a:b] for a, b in edges.reshape(-1, 2)]


def shape(span: str) -> str:
    """Digits as d, letters as a, runs of either as one, white space as _."""
    s = re.sub(r"[0-9]+", "d", span)
    s = re.sub(r"[^\W\d_]{2,}|[^\W\d_ad]", "a", s)
    return re.sub(r"\s+", "_", s)[:24]


def _kind_of(c: str) -> str:
    return c if not c.isalnum() else "d" if c.isdigit() else "a"


def features(text: str, a: int, b: int, before: str = "", after: str = "") -> list[str]:
    """Of the whole span text[a:b] between two words."""
    span = text[a:b]
    low = span.lower()
    runs = re.findall("[0-9]+", span)
    digits = "".join(runs)
    n = len(digits)
    marks = "".join(sorted({c for c in span if not c.isalnum() and not c.isspace()}))[:6]
    letters = any(c.isalpha() for c in span)
    spelled = len(_SPELLED.findall(low))
    at = span.count("@") + len(re.findall(r"[\[({<]at[\])}>]|\bat\b", low))
    groups = "-".join(str(len(r)) for r in runs[:8])
    out = [
        "bias", f"shape={shape(span)}", f"marks={marks}", f"n={min(n, 24)}", f"blanks={min(span.count(' '), 6)}", f"lead={_kind_of(span[0])}", f"tail={_kind_of(span[-1])}",
        f"letters={letters}", f"at={min(at, 2)}", f"dots={min(span.count('.'), 5)}", f"groups={groups}", f"groups={groups} marks={marks}", f"spelled={min(spelled, 3)} at={min(at, 2)}",
        f"before={before.strip('.,:;()').lower()[:12]}", f"after={after.strip('.,:;()').lower()[:12]}", f"plus={span[0] == '+'} n={min(n, 24)}", f"zeros={digits[:2] if digits[:1] == '0' else ''}",
    ]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(digits)} n={n}")
    if len(runs) == 4 and not letters or spelled == 3:
        out.append(f"quad={len(runs) == 4 and all(len(r) < 4 and int(r) < 256 for r in runs)} marks={marks}")
    return out


def _bounds(text: str, words: list[tuple[int, int]], i: int, j: int) -> tuple[int, int]:
    """Of the span from word i to word j - 1; marks of punctuation at its ends are no part of it."""
    a, b = words[i][0], words[j - 1][1]
    while b > a and text[b - 1] in ",;:.!?\"'":
        b -= 1
    while a < b and text[a] in "\"'":
        a += 1
    return a, b


class Field:
    """Labels are 0, other, and 1 to 4, KINDS. Other takes one word at a time; a kind takes a run of words."""

    def __init__(self, rows: dict[str, int] | None = None, weights: np.ndarray | None = None):
        self.rows = {} if rows is None else rows
        self.weights = np.zeros((0, len(KINDS))) if weights is None else weights

    def segments(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, list[str], tuple[int, int]]]:
        """(first word, end, features, span) of every candidate with a cue."""
        out = []
        for i in range(len(words)):
            for j in range(i + 1, min(i + MAX_WORDS, len(words)) + 1):
                a, b = _bounds(text, words, i, j)
                if b - a > MAX_CHARS:
                    break
                if b > a and _CUE.search(text, a, b):
                    before = text[slice(*words[i - 1])] if i else ""
                    after = text[slice(*words[j])] if j < len(words) else ""
                    out.append((i, j, features(text, a, b, before[-20:], after[:20]), (a, b)))
        return out

    def scores(self, segments) -> np.ndarray:
        at = [[r for f in feats if (r := self.rows.get(f)) is not None] for _, _, feats, _ in segments]
        return np.array([self.weights[r].sum(axis=0) for r in at]).reshape(-1, len(KINDS))

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans of the best segmentation, with their log odds against being other words."""
        segments = self.segments(text, words)
        if not segments:
            return []
        score = self.scores(segments)
        return [(KINDS[k], *segments[s][3], float(score[s, k])) for s, k in best_path(len(words), segments, score)]


def best_path(n: int, segments, score: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the segmentation of n words that scores most; a word of no kind scores 0."""
    kind = score.argmax(axis=1).tolist()
    top = score.max(axis=1).tolist()
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: dict[int, list[int]] = {}
    for s, (_, j, _, _) in enumerate(segments):
        ending.setdefault(j, []).append(s)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in ending.get(j, ()):
            if (v := best[segments[s][0]] + top[s]) > best[j]:
                best[j], back[j] = v, s
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j], kind[back[j]]))
            j = segments[back[j]][0]
    return out[::-1]


def chances(n: int, edges: list[tuple[int, int]], score: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of each segment (first word, end) and kind over all segmentations of n words, and the log of their sum."""

    def added(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    total = np.logaddexp.reduce(score, axis=1).tolist()
    ending: dict[int, list[tuple[int, float]]] = {}
    starting: dict[int, list[tuple[int, float]]] = {}
    for (i, j), t in zip(edges, total, strict=True):
        ending.setdefault(j, []).append((i, t))
        starting.setdefault(i, []).append((j, t))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = added([ahead[j - 1], *(ahead[i] + t for i, t in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = added([behind[i + 1], *(behind[j] + t for j, t in starting.get(i, ()))])
    around = np.array([ahead[i] + behind[j] - ahead[n] for i, j in edges])
    return np.exp(score + around[:, None]), ahead[n]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 5, rate: float = 0.4, ridge: float = 1e-4) -> Field:
    """Maximises the conditional likelihood of the segmentations of (text, spans), by adaptive steps window by window."""
    field = Field()
    cases = []
    for text, spans in examples:
        gold = {(a, b): KINDS.index(k) for k, a, b in spans}
        for words in windows(text):
            if segments := field.segments(text, words):
                ids = [[field.rows.setdefault(f, len(field.rows)) for f in feats] for _, _, feats, _ in segments]
                width = max(map(len, ids))
                padded = np.array([x + [-1] * (width - len(x)) for x in ids])  # -1 is a row of zeros
                hits = [(s, gold[span]) for s, (*_, span) in enumerate(segments) if span in gold]
                cases.append((len(words), [(i, j) for i, j, *_ in segments], padded, hits))
    weights, squares = np.zeros((len(field.rows) + 1, len(KINDS))), np.full((len(field.rows) + 1, len(KINDS)), 1e-2)
    for _ in range(epochs):
        for n, edges, ids, hits in cases:
            p, _ = chances(n, edges, weights[ids].sum(axis=1))
            step = -p
            for s, k in hits:
                step[s, k] += 1
            if np.abs(step).max() < 1e-3:
                continue
            rows, where = np.unique(ids, return_inverse=True)
            g = np.zeros((len(rows), len(KINDS)))
            np.add.at(g, where.reshape(ids.shape), step[:, None, :])
            g -= ridge * weights[rows]
            squares[rows] += g * g
            weights[rows] += rate * g / np.sqrt(squares[rows])
            weights[-1] = 0.0
    field.weights = weights[:-1]
    return field


# --- what it learns from --------------------------------------------------------------


def _card(rnd: random.Random, n: int = 16, right: bool = True) -> str:
    d = rnd.choice("3456") + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    last = next(c for c in "0123456789" if luhn(d + c))
    return d + (last if right else rnd.choice([c for c in "0123456789" if c != last]))


def _grouped(digits: str, sizes: list[int], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return by.join([*out, digits[at:]] if at < len(digits) else out)


def variant(kind: str, span: str, rnd: random.Random) -> str:
    """The same kind of entity as someone may write it who does not write it as the patterns have it."""
    if kind == "phone":
        d = "".join(rnd.choice("23456789") + "".join(rnd.choice("0123456789") for _ in range(n - 1)) for n in (3, 3, 4))
        a, b, c = d[:3], d[3:6], d[6:]
        country = rnd.choice(["1", "44", "49", "33", "34", "351"])
        return rnd.choice([
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{b}-{c}", f"1-{a}-{b}-{c}", f"00{country} {a[:2]} {b}{c}", f"00{country} {a} {b} {c}", f"00{country}{a}{b}{c}",
            f"0{a}/{b}{c}", f"0{a} {b}{c}", f"0{a[:2]} {b} {c}", f"({country}) {a} {b} {c}", f"+{country}/{a}/{b}{c}",
        ])
    if kind == "card":
        if rnd.random() < 0.2:
            return _grouped(_card(rnd, 15), [4, 6, 5], rnd.choice([" ", "-", ".", ""]))
        return _grouped(_card(rnd), [4, 4, 4, 4], rnd.choice([".", "/", "_", ".", " . ", "  "]))
    if kind == "ip":
        return rnd.choice(["[.]", "(.)", " dot ", "[dot]", ","]).join(str(rnd.randint(0, 255)) for _ in range(4))
    name, _, host = span.partition("@")
    if host.count(".") > 1 and rnd.random() < 0.5:
        host = host.partition(".")[2]
    if len(plain := re.sub("[^A-Za-z]", "", name)) > 1 and rnd.random() < 0.5:
        name = plain
    at = rnd.choice([" [at] ", " (at) ", "[at]", "(at)", " at ", " @ ", " AT "])
    if at in (" at ", " AT "):
        return name + at + host.replace(".", rnd.choice([" dot ", " DOT "]))
    return name + at + (host if rnd.random() < 0.4 else host.replace(".", rnd.choice([" dot ", "[dot]", " [dot] ", "(dot)"])))


def lookalike(rnd: random.Random) -> str:
    """A run of characters that looks like an entity and is none."""
    y, m, d = rnd.randint(1900, 2030), rnd.randint(1, 12), rnd.randint(1, 28)
    r = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    return rnd.choice([
        f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d}-{m}-{y}", f"{y} {y + 1} {y + 2}", f"v{d}.{m}.{r(1)}", f"{m}.{d}.{r(2)}", f"{r(3)}-{r(3)}", f"{d}:{m:02}:{r(2)}", f"{r(3)},{r(3)},{r(3)}", f"$ {r(2)}.{r(2)}",
        f"978-{r(1)}-{r(2)}-{r(6)}-{r(1)}", _grouped(_card(rnd, 16, False), [4, 4, 4, 4], rnd.choice([" ", "-", ".", "/"])), _card(rnd, 16, False), f"{r(3)} {r(3)} {r(3)} {r(3)} {r(3)}", f"{rnd.randint(256, 999)}.{r(2)}.{r(2)}.{r(1)}",
        f"@{rnd.choice(['home', 'news', 'team'])}", f"{r(2)} dot {r(2)}", f"{r(5)}", f"{r(7)}", f"#{r(4)}-{r(4)}", f"{r(2)}%", f"{d}.{m}", f"{r(4)}-{r(4)}", f"No. {r(8)}", f"pages {r(3)}-{r(3)}", f"{y}-{y + 1}",
    ])


def examples(text: str, rnd: random.Random, share: float = 0.7) -> tuple[str, list[tuple[str, int, int]], set[tuple[int, int]]]:
    """A text with `share` of its base spans rewritten and, now and then, a look-alike between its words; all its spans, and those that were rewritten."""
    out, at, spans, new = [], 0, [], set()
    size = 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        put(text[at:a])
        if rnd.random() < 0.3:
            put(f"{lookalike(rnd)} ")
        other = rnd.random() < share
        piece = variant(kind, text[a:b], rnd) if other else text[a:b]
        spans.append((kind, size, size + len(piece)))
        if other:
            new.add(spans[-1][1:])
        put(piece)
        at = b
    put(text[at:])
    if not spans:
        put(f" {lookalike(rnd)} ")
    return "".join(out), spans, new


def sample(docs: DataFrame, rows: int = TRAIN_DOCS) -> list[str]:
    """The surroundings of cues in about `rows` documents with a base span and about as many others with a cue, in order of their hash.

    Documents and their windows are chosen by hash against a share that the counts
    give, and windows are cut out where the documents lie: what moves is bounded by
    the parameters alone.
    """
    marked = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text", F.col("text").rlike(_LIKE).cast("int").alias("like"))
    n = {r["like"]: r["n"] for r in marked.groupBy("like").agg(F.count("*").alias("n")).collect()}
    if not n:
        return []
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("like") == 1, rows / max(n.get(1, 1), 1)).otherwise(rows / max(n.get(0, 1), 1))
    chosen = marked.withColumn("h", drawn).where(F.col("h") < share).select("h", "text")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, text in zip(batch["h"], batch["text"], strict=True):
                rnd = random.Random(int(h * (1 << 30)))
                parts = [w[k : k + TRAIN_WORDS] for w in windows(text) for k in range(0, len(w), TRAIN_WORDS)]
                parts = [p for p in parts if p[-1][1] - p[0][0] <= TRAIN_WORDS * MAX_CHARS]  # longer ones have words that no entity has
                keep = min(1.0, TRAIN_WINDOWS / max(len(parts), 1))
                out += [(h, text[p[0][0] : p[-1][1]]) for p in parts if keep == 1 or rnd.random() < keep]
            yield pd.DataFrame(out, columns=["h", "text"])

    got = chosen.mapInPandas(cut_out, "h double, text string").collect()
    return [r["text"] for r in sorted(got, key=lambda r: (r["h"], r["text"]))]


def learn(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """The field of a sample of docs. Texts without any base span give a field that adds nothing."""
    return learned(sample(docs, rows))


def learned(texts: list[str], seed: int = 1) -> Field:
    rnd = random.Random(seed)
    some = [t for t in texts if base_spans(t)]
    if not some:
        return Field()
    cases = [(t, base_spans(t)) for t in texts]  # as they are
    while some and len(cases) < len(texts) + 2_500:
        for t in some:
            text, spans, _ = examples(t, rnd)
            cases.append((text, spans))
    rnd.shuffle(cases)
    return train(cases)


def measure(field: Field, texts: list[str], seed: int = 2) -> dict[str, float]:
    """How the field does on texts that it has not seen: recall of rewritten base spans, overall and by kind, precision of what it adds, and what it adds to texts without any span, by the thousand texts."""
    rnd = random.Random(seed)
    hit, all_, added, wrong, clean = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0), 0, 0, 0
    for t in texts:
        text, spans, new = examples(t, rnd) if base_spans(t) else (t, [], set())
        base, got = all_spans(text, field)
        extra = {*got} - {*base}
        for k, a, b in spans:
            if (a, b) in new and not any(x < b and a < y for _, x, y in base):
                all_[k] += 1
                hit[k] += (k, a, b) in extra
        clean += len(extra) if not spans else 0
        added += len(extra)
        wrong += sum(s not in spans for s in extra)
    out = {f"recall_{k}": hit[k] / max(all_[k], 1) for k in KINDS}
    return out | {"recall": sum(hit.values()) / max(sum(all_.values()), 1), "precision": 1 - wrong / max(added, 1), "rewritten": sum(all_.values()), "in_clean_per_1000": 1000 * clean / max(len(texts), 1)}


def all_spans(text: str | None, field: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with what the field adds beside them, by kind and start."""
    base = base_spans(text)
    if not text or field is None or not len(field.weights):
        return base, base
    added = []
    taken = sorted((a, b) for _, a, b in base)
    reach = [0, *itertools.accumulate((b for _, b in taken), max)]  # the furthest end of the spans up to each
    for words in windows(text):
        for k, a, b, s in field.decode(text, words):
            if s >= MARGIN:
                if reach[bisect_left(taken, (b, 0))] <= a:  # spans of other kinds may overlap
                    added.append((k, a, b))
    return base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def personal_data(docs: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, the counts of base spans by kind, and both lists of spans as kind:start:end for every row.

    A null or empty text has no spans. Null and repeated doc_ids keep their rows,
    rows that repeat id and text get the same spans. Texts of any length are read
    whole, in time that grows with their length. An empty table gives an empty one;
    without base spans to learn from nothing is added.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.select("doc_id", "text"), rows))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [all_spans(t, model.value) for t in batch["text"]]
            told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            counts = {f"n_{k}": np.array([sum(s[0] == k for s in base) for base, _ in both], dtype="int64") for k in KINDS}
            base = [told(b) for b, _ in both]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **counts, "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [told(s) for _, s in both]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(found, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")
