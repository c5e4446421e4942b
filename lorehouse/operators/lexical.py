"""Lexical search with a query language: phrases, alternatives, exclusions, stems and weighted fields.

Texts are read once, into the stems of each chunk in their order, title first. Queries
go to the tasks in blocks of bounded size, as in the plain lexical join; a task finds
the places of all terms of a block in a batch of chunks at once, holds each phrase
against them, and keeps the best chunks of each query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .joins import FEW_TERMS, _Best, top_k

#: Queries, and terms of these, that go to all tasks at once, about.
BLOCK, TERMS = 512, 16_384
#: Places between the title and the text of a chunk, and between chunks: no phrase reaches over them.
GAP = 64
#: What a place in a title counts, and one in a text.
TITLE, TEXT = 1.0, 0.4
# Fixed values.
#: Words that are never looked for; they keep their place in a phrase.
STOP = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
# End of the fixed values.

_TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
_PLURALS = ((re.compile("^([a-z]{2,})ies$"), r"\1y"), (re.compile("^([a-z]+(?:ss|sh|ch|x|z))es$"), r"\1"), (re.compile("^([a-z]+[^sui])s$"), r"\1"))
_FORMS = re.compile("^([a-z]*[aeiouy][a-z]+)(?:ing|ed)$")


def stem(word: str) -> str:
    """A word without English endings: -ies to -y, -es after a hiss, -s; then -ing and -ed where three letters with a vowel stay, of a doubled consonant one."""
    for pattern, to in _PLURALS:
        if m := pattern.match(word):
            word = m.expand(to)
            break
    if (m := _FORMS.match(word)) and len(m[1]) >= 3:
        word = m[1]
        if word[-1] == word[-2] and word[-1] in "bdfgmnprt":
            word = word[:-1]
    return word


def _hashes(words: list[str]) -> np.ndarray:
    """Of the stems of words, 0 for those that are never looked for."""
    which, distinct = pd.factorize(np.array(words, dtype=object))
    if not len(words):
        return np.empty(0, dtype=np.int64)
    h = pd.util.hash_array(np.array([stem(w) for w in distinct], dtype=object), categorize=False).view(np.int64)
    return np.where(np.array([w in STOP for w in distinct]), 0, h)[which]


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def parse(query: str | None) -> list[list[tuple[bool, list[tuple[int, str]]]]]:
    """Alternatives, each a list of (excluded, phrase), a phrase being (offset, stem) of words.

    `or` between words parts alternatives; within one, all must be there. Words in
    quotes are a phrase, as are the parts of a word with signs in it; what follows a
    minus must not be there. Words that are never looked for leave a gap in a
    phrase, and what consists of nothing else says nothing.
    """
    out: list[list[tuple[bool, list[tuple[int, str]]]]] = [[]]
    for minus, quoted, bare in _PART.findall(query or ""):
        if bare.lower() == "or":
            out.append([])
            continue
        excluded = bool(minus) or bare.startswith("-")
        words = terms(bare or quoted)
        kept = [(k, stem(w)) for k, w in enumerate(words) if w not in STOP]
        if kept:
            out[-1].append((excluded, [(k - kept[0][0], w) for k, w in kept]))
    return [a for a in out if a]


def positions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, page_id, n, places) of chunks (chunk_id, page_id, title, chunk_text): hashes of stems in their order, the n of the title first."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [(terms(a), terms(b)) for a, b in zip(batch["title"], batch["chunk_text"], strict=True)]
            h = _hashes([w for a, b in both for w in (*a, *b)])
            ends = np.cumsum([len(a) + len(b) for a, b in both])[:-1]
            yield batch[["chunk_id", "page_id"]].assign(n=[len(a) for a, _ in both], places=np.split(h, ends) if len(both) else [])

    c, p = (chunks.schema[x].dataType.simpleString() for x in ("chunk_id", "page_id"))
    return chunks.select("chunk_id", "page_id", "title", "chunk_text").mapInPandas(placed, f"chunk_id {c}, page_id {p}, n int, places array<bigint>")


class Block:
    """The parsed queries of a block, by numbers of their terms."""

    def __init__(self, queries: list[tuple[int, str]]):
        self.ids = np.array([q for q, _ in queries], dtype=np.int64)
        parsed = [parse(t) for _, t in queries]
        words = sorted({w for p in parsed for a in p for _, ph in a for _, w in ph})
        h = pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.empty(0, dtype=np.int64)
        self.terms = np.unique(h)
        number = dict(zip(words, np.searchsorted(self.terms, h), strict=True))
        self.phrases: list[tuple[tuple[int, int], ...]] = []
        place: dict[tuple, int] = {}
        self.queries = []
        for p in parsed:
            sides = []
            for a in p:
                side = []
                for excluded, ph in a:
                    key = tuple((k, int(number[w])) for k, w in ph)
                    if key not in place:
                        place[key] = len(self.phrases)
                        self.phrases.append(key)
                    side.append((excluded, place[key]))
                sides.append(side)
            self.queries.append((sides, sorted({int(number[w]) for a in p for excluded, ph in a if not excluded for _, w in ph})))
        self.weights = np.zeros(len(self.terms))

    def matches(self, batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of a batch of positions."""
        n = len(batch)
        size = np.array([len(p) for p in batch["places"]], dtype=np.int64)
        titles = batch["n"].to_numpy().astype(np.int64)
        own = np.concatenate([*batch["places"], np.empty(0, dtype=np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(n), size)
        within = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        # Places of their own for titles and texts, apart by more than a phrase reaches.
        at = np.arange(len(own)) + GAP * (2 * row + (within >= titles[row])) + GAP
        code = np.searchsorted(self.terms, own)
        code = np.where(self.terms[np.minimum(code, len(self.terms) - 1)] == own, code, -1) if len(self.terms) else np.full(len(own), -1)
        hit = np.flatnonzero(code >= 0)
        line = np.full(len(own) + GAP * (2 * n + 2) + GAP, -1, dtype=np.int64)
        line[at[hit]] = code[hit]
        order = hit[np.argsort(code[hit], kind="stable")]
        upto = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        rows_of, weight_of = {}, {}

        def of(term: int) -> np.ndarray:
            return order[upto[term] : upto[term + 1]]

        found: dict[int, np.ndarray] = {}

        def rows(phrase: int) -> np.ndarray:
            if phrase not in found:
                key = self.phrases[phrase]
                k0, t0 = min(key, key=lambda x: upto[x[1] + 1] - upto[x[1]])  # the rarest here
                some = of(t0)
                for k, t in key:
                    if k != k0 and len(some):
                        there = at[some] + (k - k0)
                        some = some[(there >= 0) & (there < len(line)) & (line[np.clip(there, 0, len(line) - 1)] == t) & (abs(k - k0) < GAP)]
                mask = np.zeros(n, dtype=bool)
                mask[row[some]] = True
                found[phrase] = mask
            return found[phrase]

        for q, (sides, words) in enumerate(self.queries):
            any_ = np.zeros(n, dtype=bool)
            for side in sides:
                mask = np.ones(n, dtype=bool)
                for excluded, phrase in side:
                    mask &= ~rows(phrase) if excluded else rows(phrase)
                    if not mask.any():
                        break
                any_ |= mask
            if not any_.any():
                continue
            score = np.zeros(n)
            for t in words:
                if t not in rows_of:
                    i = of(t)
                    tf = np.bincount(row[i], np.where(within[i] < titles[row[i]], TITLE, TEXT), n)
                    rows_of[t] = np.flatnonzero(tf)
                    weight_of[t] = np.log1p(tf[rows_of[t]])
                score[rows_of[t]] += weight_of[t] * self.weights[t]
            which = np.flatnonzero(any_)
            yield q, which, np.round(score[which], 6)


def search(queries: DataFrame, chunks: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, chunk_id, page_id, score, rank): the k best of chunks (chunk_id, page_id, title, chunk_text) that match each query (query_id, text), ties to the smaller chunk.

    A chunk's score is the sum, over the query's terms that are not excluded, of
    ln(1 + places, a title's counting TITLE and a text's TEXT) ln(1 + N / df). Null and
    empty queries, and those of stop words alone, match nothing. chunk_id is a long.
    """
    spark = queries.sparkSession
    page = chunks.schema["page_id"].dataType.simpleString()
    asked = cut(queries.where(F.trim("text") != "").select(F.col("query_id").cast("long").alias("query_id"), "text"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("terms")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-(size["terms"] or 0) // TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"term": Block([(0, t) for t in batch["text"]]).terms})

    held = cut(positions(chunks))
    n = held.count()
    wanted = cut(asked.select("text").mapInPandas(words, "term bigint").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted
    df = cut(held.select(F.explode(F.array_distinct("places")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    schema = f"query_id bigint, chunk_id bigint, page_id {page}, score double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        one = Block([(r["query_id"], r["text"]) for r in asked.where(F.col("block") == b).collect()])  # about BLOCK queries and TERMS terms
        if not len(one.terms):
            continue
        own = spark.createDataFrame([(int(t),) for t in one.terms], "term bigint")
        for r in df.join(F.broadcast(own), "term").collect():
            one.weights[np.searchsorted(one.terms, r["term"])] = np.log(1 + n / r["df"])
        shared = spark.sparkContext.broadcast(one)

        def scored(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            one = shared.value
            best = [_Best(1, k) for _ in one.ids]
            for batch in batches:
                ids, pages = batch["chunk_id"].to_numpy(), batch["page_id"].to_numpy()
                for q, rows, score in one.matches(batch):
                    best[q].put(score[None, :], ids[rows], pages[rows])
            for q, x in enumerate(best):
                _, chunk, also, score = x.rows()
                if len(chunk):
                    yield pd.DataFrame({"query_id": one.ids[q], "chunk_id": chunk, "page_id": also, "score": score})

        found = held.mapInPandas(scored, schema)
        out = out.unionByName(cut(top_k(found, k, ("query_id",), F.desc("score"), "chunk_id").drop("rank")) if blocks > 1 else found)
    return top_k(out, k, ("query_id",), F.desc("score"), "chunk_id")
