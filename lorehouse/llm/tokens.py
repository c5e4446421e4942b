"""Operator 1: token counts of a BPE piece model, with the whole-token shortcut.

A piece model merges neighbouring pieces and never looks past a boundary that no
piece of its vocabulary spans. `PieceCounter` proves from the vocabulary alone
(once per worker, before any text is seen)

* that no piece holds a space mark after another character, so that a text falls
  apart in front of every run of spaces,
* that no piece holds a line feed, so that it falls apart around each of those,
* which pieces come out as one token when they stand alone as such a part.

Parts that are such a piece count 1 by a lookup; only the others are merged by
the library, and their counts are remembered in a bounded table. If a proof fails
for a model, whole texts go to the library instead.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Parts in front of which, and around which, no merge reaches.
PART = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Entries of the table of counts at which it starts afresh before the next text: bounds a worker's memory.
MEMO = 400_000
#: Longer parts are not remembered after their text.
MEMO_CHARS = 64


class PieceCounter(dict):
    """part -> tokens; whole tokens are there from the start."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = [m.id_to_piece(i) for i in ids]
        self.lead = len(m.encode("\n"))
        self.proved = (
            not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)
            and m.encode("\n") + m.encode("\n")[-1:] == m.encode("\n\n")
            and all(m.normalize(c) == MARK + c for c in {c for p in pieces for c in p} - {MARK})
        )
        alone = m.encode(["\n" + p.replace(MARK, " ") for p in pieces], num_threads=1)
        self.whole = {p.replace(MARK, " "): 1 for p, i, got in zip(pieces, ids, alone, strict=True) if got[self.lead :] == [i]}
        self.update(self.whole)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.proved:
            return len(self.model.encode(text))
        if len(self) > MEMO:
            self.clear()
            self.update(self.whole)
        parts = PART.findall(" " + text.replace(MARK, " "))
        if new := [*{p for p in parts if p not in self}]:
            merged = self.model.encode(["\n" + p for p in new], num_threads=1)
            self.update((p, len(ids) - self.lead) for p, ids in zip(new, merged, strict=True))
        n = sum(map(self.__getitem__, parts))
        for p in new:
            if len(p) > MEMO_CHARS:
                del self[p]
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text column; the model is looked up on the worker when no path is given."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = counter(model_path(path))
        for batch in texts:
            yield pd.Series([one.count(t) for t in batch], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, whatever else it holds.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_ids keep
    their rows. One pass, no shuffle; memory is bounded by a batch and `MEMO`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
