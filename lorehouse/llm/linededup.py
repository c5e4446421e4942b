"""Operator 4: line deduplication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased; lower() does that where a line is ASCII alone, and faster."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


#: A key is hot from this share of all lines on, so that hot keys number at most its inverse.
HOT_SHARE = 10_000


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row of docs with n_lines, n_dropped and kept, the text of the lines that stay.

    Lines of a key of at least min_chars code points that is found in at least
    min_docs documents stay only in the largest doc_id that holds it. A null or
    empty text is one empty line. Rows that repeat a doc_id are one document for the
    counts and each keeps its own text; a null doc_id is one document, below all
    others. A text may have any number of lines: its dropped positions are taken
    from all of its positions as a set.

    Lines are exploded and hashed once, with their position. They are counted by key
    and document before by key, and the few keys that hold more than one in HOT_SHARE
    of all lines meet their lines by broadcast, HOT_SHARE rows at most: no key's lines
    go to one task. The lines of keys over the threshold go back to their texts as
    positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(*keep, *[c for c in ("doc_id", "text") if c not in keep])
    # A variable of a lambda is worked out once, where a column beside an exploded one may be worked out for each of its rows.
    placed = lambda t: F.transform(t["lines"], lambda line, k: F.struct(t["of"].alias("of"), k.alias("at"), line.alias("line")))
    lines = cut(
        docs.select("doc_id", F.explode(F.transform(F.array(F.struct(F.xxhash64(text).alias("of"), F.split(text, "\n", -1).alias("lines"))), placed)[0]).alias("_l"))
        .select("doc_id", F.col("_l.of").alias("_text"), F.col("_l.at").alias("_at"), F.col("_l.line").alias("_line"))
        .where(F.char_length("_line") >= min_chars)
        .select("doc_id", "_text", "_at", F.btrim("_line", F.lit(SPACE)).alias("_bare"), "_line")
        .where(F.char_length("_bare") >= min_chars)
        .select("doc_id", "_text", "_at", F.unhex(F.md5(line_key(F.col("_line")))).alias("_key"))
    )
    common = cut(
        lines.groupBy("_key", "doc_id").agg(F.count("*").alias("_n"))
        .groupBy("_key").agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_last"), F.sum("_n").alias("_lines"))
        .where(F.col("_docs") >= min_docs)
        .select(F.col("_key").alias("_common"), "_last", "_lines")
    )
    least = lines.count() / HOT_SHARE
    hot, other = common.where(F.col("_lines") > least), common.where(F.col("_lines") <= least)
    gone = (F.col("_key") == F.col("_common")) & ~F.col("doc_id").eqNullSafe(F.col("_last"))
    rest = lines.join(F.broadcast(hot.select(F.col("_common").alias("_hot"))), F.col("_key") == F.col("_hot"), "left_anti")
    dropped = (
        lines.join(F.broadcast(hot), gone).unionByName(rest.join(other, gone))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"))
        .agg(F.collect_set("_at").alias("_drop"))  # within one text
    )
    none = F.array().cast("array<int>")
    joined = own.withColumn("_own", F.xxhash64(text)).join(dropped, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_of")), "left")
    split = F.split(text, "\n", -1)
    out = joined.select(*keep, F.struct(split.alias("lines"), F.coalesce("_drop", none).alias("drop")).alias("_both"))

    def stays(both: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(both["lines"]) - 1), both["drop"])
        return F.when(F.size(both["drop"]) == 0, F.array_join(both["lines"], "\n")).otherwise(F.array_join(F.transform(at, lambda k: both["lines"][k]), "\n"))

    return out.select(
        *keep,
        F.size("_both.lines").cast("long").alias("n_lines"),
        F.size("_both.drop").cast("long").alias("n_dropped"),
        F.transform(F.array("_both"), stays)[0].alias("kept"),
    )
