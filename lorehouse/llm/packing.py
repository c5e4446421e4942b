"""Operator 5: best-fit packing of token sequences, by rounds over run-length coded sizes.

A document's tokens are cut into pieces of at most `capacity`; pieces go into
sequences of that capacity by best fit, longest first. A round takes all pieces
of one length at a time, over the whole corpus:

* documents and gaps are kept sorted by size. A size takes at most `capacity`
  values, so the sorted lists are held run-length coded, as (size, first rank,
  count): what a round sweeps over is bounded by the capacity, not by the corpus;
* the sweep gives each piece the successor of its length among the gaps, the
  smallest gap that takes it;
* many pieces ask for the same gap: the piece of rank k in its length's run gets
  the sequence of rank k in the gap's run;
* gaps shrink, which moves runs of sequences to smaller sizes, and the next round
  follows.

Spark does the work that grows with the corpus: tokenising, the histogram of
lengths, the rank of every piece among those of its length (salted, so that a
length that a third of all pieces share is dealt over many tasks), and the lookup
of the run that holds the rank. The same rounds over single rows, swept by tasks, are
in `sweeps`; they cost far more and need more sequences (README).
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, trimmed

CAPACITY = 4096
END = 1
#: Words, and runs between white space, that a worker remembers the ids of before it starts afresh.
MEMO = 200_000
#: Rows of one length that one task ranks, about.
RANKED = 1_000_000

# --- ids of a word model ------------------------------------------------------

#: Texts whose lower case has these characters alone are cut into words here, by
#: tables that no Unicode version changes; others go to the library whole. Capitals
#: such as U+018F have a lower case beyond the tables.
_TOP = 0x250
_OWN = "[\\x00-\\u024f\\u2010-\\u2027\\u20ac]"
_LETTERS = "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == "N")
_SPACES = "\\t-\\r \\x85\\xa0"
_PLAIN = re.compile(f"{_OWN}*")
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: White space to Python's split() alone.
_ODD = re.compile("[\x1c-\x1f]")
#: Stands for the end of a word in the byte vocabulary; no UTF-8 text has this byte.
_STOP = b"\xff"


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers, for a BPE model with word ends."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.runs = Runs(self)
        self.library = Tokenizer.from_file(path)
        back = _bytes_of_characters()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = [s for s in special]
        ranks, suffix = {}, "</w>"
        for piece, i in self.library.get_vocab(with_added_tokens=True).items():
            if piece not in special:
                end = piece.endswith(suffix) and len(piece) > len(suffix)
                ranks[bytes(back[c] for c in (piece[: -len(suffix)] if end else piece)) + _STOP * end] = i
        ranks[_STOP] = max(ranks.values()) + 1
        # In a model whose ids follow its merges, the least id among the pairs is the next merge.
        self.fast = tiktoken.Encoding("words", pat_str="[^\\n]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = np.array(self.fast(word.encode() + _STOP), dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if _PLAIN.fullmatch(low) and not _ODD.search(low) and not any(s in text for s in self.special):
            return b"".join(map(self.runs.__getitem__, low.split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Runs(dict):
    """The same for runs between white space, which no word spans."""

    def __init__(self, words: WordIds):
        super().__init__()
        self.words = words

    def __missing__(self, run: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = b"".join(map(self.words.__getitem__, _CUT.findall(run)))
        if len(run) <= 64:
            self[run] = ids
        return ids


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and an end mark, cut where they exceed capacity."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = word_ids(model_path(path))
        last = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(batch["text"]):
                whole = memoryview(ids.encode(text or "") + last)
                for p, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    row.append(n)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[row].array, "piece": np.array(piece, "int32"), "start": np.array(start, "int64"), "length": np.array(length, "int64"), "ids_crc32": np.array(crc, "int64")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(trimmed(cut_up), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- the rounds -----------------------------------------------------------------


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) that place every piece of a histogram of lengths.

    Best fit, longest first: rank k of a run goes to sequence first + k at offset.
    """
    gaps: dict[int, deque] = {}  # gap -> runs of sequences with that gap, as [first, count]
    sizes: list[int] = []  # the gaps that there are, sorted
    opened = 0
    placed = []

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = deque()
                insort(sizes, gap)
            gaps[gap].append([first, count])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)  # the successor among the gaps
            if k == len(sizes):  # none: new sequences, each filled as best fit would
                each = capacity // length
                new, odd = divmod(left, each)
                for count, full in ((new, each), (1, odd)):
                    if count and full:
                        for n in range(full):
                            placed.append((length, rank, count, opened, n * length))
                            rank += count
                        add(capacity - full * length, opened, count)
                        opened += count
                break
            gap = sizes[k]
            run = gaps[gap][0]
            take = min(left, run[1])
            placed.append((length, rank, take, run[0], capacity - gap))
            add(gap - length, run[0], take)
            run[0] += take
            run[1] -= take
            if not run[1]:
                gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
                    del sizes[bisect_left(sizes, gap)]
            rank += take
            left -= take
    return np.array(placed, dtype=np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Any rows with a length of 1 to capacity may be given, repeated ones too: they
    are ranked among their like in any order. An empty table gives an empty one.
    """
    rows = cut(cut_pieces)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    placed = rounds(counts, capacity)
    salts = 1 + max(counts.values(), default=0) // RANKED
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = (
        salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
        .join(shift, ["length", "salt"])
        .withColumn("rank", F.col("nth") + F.col("shift") - 1)
        .drop("salt", "nth", "shift")
    )

    # The runs number at most a few for each length and gap, however large the corpus.
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    runs = rows.sparkSession.sparkContext.broadcast(placed[order])

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, _, sequence, offset = runs.value.T
        base = np.searchsorted(length, np.arange(capacity + 2))  # the runs of a length are base[length] to base[length + 1]
        key = length * (1 << 48) + first
        for batch in batches:
            at = np.searchsorted(key, batch["length"].to_numpy() * (1 << 48) + batch["rank"].to_numpy(), side="right") - 1
            assert len(at) == 0 or (at >= base[batch["length"].to_numpy()]).all()
            yield batch.drop(columns="rank").assign(sequence_id=sequence[at] + batch["rank"].to_numpy() - first[at], offset=offset[at])

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInPandas(trimmed(seat), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of docs and their places. Null texts count as empty; null and repeated doc_ids keep their rows."""
    return pack(pieces(docs, capacity, path), capacity)
