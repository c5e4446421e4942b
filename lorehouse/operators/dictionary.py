"""Names looked up in texts: titles as runs of words, longest first; known entities of queries; the nearest name by edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

WORDS = r"[\p{L}\p{N}_]+"
# Fixed values.
#: Words of a question that say nothing of what it is about.
GUARD_STOPWORDS = "how does did the are was were what for and with into get gets got this that from your our their about".split()
ENTITY_FOLDERS = ("people/", "companies/", "deals/")
# End of the fixed values.


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)


def title_mentions(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, at, n, title_id) of texts (id, text) and titles (title_id, title): where, from word `at` on, the n words of a title stand, from left to right the longest first, none over another. Of equal titles the least id counts.

    Titles are hashes of their words. Only runs of lengths that titles have are looked
    at, and only where the first word and its successor begin some title: texts meet
    titles by hash, whatever the number of either.
    """
    t = titles.select("title_id", words(F.col("title")).alias("w")).where(F.size("w") > 0)
    t = cut(t.groupBy(F.size("w").alias("n"), F.xxhash64(F.array_join("w", " ")).alias("h"), F.array_join("w", " ").alias("title")).agg(F.min("title_id").alias("title_id")))
    lengths = [r["n"] for r in t.select("n").distinct().orderBy("n").collect()]  # as many as there are lengths of titles
    lines = texts.select("id", words(F.col("text")).alias("w"))
    run = lambda w, k, n: F.array_join(F.slice(w, k, n), " ")
    found = None
    for n in lengths:
        of_n = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda k: F.struct(k.alias("at"), F.xxhash64(run(F.col("w"), k, n)).alias("h"), run(F.col("w"), k, n).alias("title")))  # noqa: B023
        runs = lines.where(F.size("w") >= n).select("id", F.explode(of_n).alias("r")).select("id", F.col("r.at").alias("at"), F.lit(n).alias("n"), F.col("r.h").alias("h"), F.col("r.title").alias("title"))
        one = runs.join(t.where(F.col("n") == n).drop("n"), ["h", "title"]).select("id", "at", "n", "title_id")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return texts.select("id", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast(titles.schema["title_id"].dataType).alias("title_id")).limit(0)
    # What a text mentions, in order, longest first; then each that begins behind the last one taken.
    per = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "title_id"))).alias("f"))
    kind = per.schema["f"].dataType.simpleString()
    step = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["m"]).alias("end"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)
    taken = F.aggregate("f", F.struct(F.lit(1).alias("end"), F.array().cast(kind).alias("taken")), step, lambda s: s["taken"])
    return per.select("id", F.explode(taken).alias("x")).select("id", F.col("x.at").alias("at"), (-F.col("x.m")).alias("n"), F.col("x.title_id").alias("title_id"))


def names_known_entity(queries: DataFrame, pages: DataFrame, folders: tuple[str, ...] = ENTITY_FOLDERS) -> DataFrame:
    """(query_id) of queries (query_id, text) one of whose words of three letters or more, other than those that say nothing, is a word of the title of an entity's page (slug, title, deleted)."""
    asked = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: (F.char_length(w) >= 3) & ~w.isin(*GUARD_STOPWORDS)))
    entity = pages.where(~F.col("deleted")).where(F.array_contains(F.array(*[F.startswith("slug", F.lit(f)) for f in folders]), True))
    known = entity.select(F.explode(words(F.col("title"))).alias("w")).distinct()
    return queries.select("query_id", F.explode(asked).alias("w")).join(known, "w", "left_semi").select("query_id").distinct()


def _without(word: str, most: int) -> set[str]:
    """A word with up to `most` of its characters left out."""
    out = last = {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def neighbourhoods(names: DataFrame, most: int = 3) -> DataFrame:
    """(name, key): the 64-bit hashes of all that is left of each name (name) with up to `most` characters taken out: two names within `most` edits share one."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = [], []
        for batch in batches:
            for name in batch["name"]:
                left = sorted(_without(name, most))
                for a in range(0, len(left), KEYS):
                    held += left[a : a + KEYS]
                    of += [name] * (len(held) - len(of))
                    if len(held) >= KEYS:
                        yield told(of, held)
                        held, of = [], []
        if held:
            yield told(of, held)

    told = lambda of, held: pd.DataFrame({"name": of, "key": pd.util.hash_array(pd.array(held, dtype=object).to_numpy(), categorize=False).view("int64")})
    # Dealt out by number: the names of many keys are few bytes, which Spark would put into one task.
    dealt = names.where(F.col("name").isNotNull()).select("name").distinct().repartition(names.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInPandas(keyed, "name string, key bigint").distinct()


#: Keys that a task holds at a time, about.
KEYS = 100_000


def nearest_names(asked: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(word, name, edits): for each of asked (word) the name of names (name) of fewest insertions, deletions and substitutions, `most` at most, ties to the first in order. Case counts.

    Both sides are indexed by deletions; only what shares a key is compared, exactly. First by none, then by one
    more deletion each turn, and only words that have no name yet: few keys find most. Keys grow with the
    power `most` of a word's length: it is meant for names, not for texts.
    """
    open_, known = (cut(df.select(c).where(F.col(c).isNotNull()).distinct()) for df, c in ((asked, "word"), (names, "name")))
    out = None
    for edits in range(most + 1):
        a = neighbourhoods(open_.select(F.col("word").alias("name")), edits).withColumnRenamed("name", "word")
        # Spark takes the keys for as few bytes as the names, and would broadcast them.
        near = a.join(neighbourhoods(known, edits).hint("merge"), "key").withColumn("edits", F.levenshtein("word", "name")).where(F.col("edits") <= edits)
        one = cut(near.groupBy("word").agg(F.min(F.struct("edits", "name")).alias("_b")).select("word", "_b.name", "_b.edits"))
        out = one if out is None else out.unionByName(one)
        open_ = cut(open_.join(one.select("word"), "word", "left_anti"))
        if not open_.limit(1).count():
            break
    return out
