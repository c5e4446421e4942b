"""How complete pages are, by a rubric for each type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
#: By type, what counts and how much: a dimension of dimensions(), or the header fields of which one must say something.
RUBRICS: dict[str, list[tuple[str | tuple[str, ...], float]]] = {
    "person": [(("role", "title", "company"), 0.20), ("urls", 0.20), ("timeline", 0.15), ("citations", 0.15), ("links", 0.10), ("recency", 0.10), ("non_redundancy", 0.10)],
    "company": [("body", 0.20), (("founders", "founder", "ceo"), 0.15), (("funding", "raised", "round", "investors"), 0.15), ("urls", 0.15), ("citations", 0.15), ("links", 0.10), ("recency", 0.10)],
    "project": [("body", 0.25), (("owner", "owners", "lead"), 0.20), ("timeline", 0.15), ("citations", 0.15), (("status", "state", "phase"), 0.15), ("recency", 0.10)],
    "deal": [(("company", "target"), 0.25), (("terms", "amount", "valuation", "round"), 0.25), (("date", "closed", "announced"), 0.15), ("urls", 0.15), ("citations", 0.20)],
    "concept": [("body", 0.35), ("citations", 0.30), ("examples", 0.20), ("links", 0.15)],
    "source": [(("url", "link", "source_url"), 0.35), (("author", "authors", "by"), 0.20), (("date", "published", "year"), 0.20), ("body", 0.25)],
    "media": [(("media_type", "type", "format"), 0.20), (("url", "link"), 0.25), ("title", 0.20), (("date", "published", "recorded"), 0.15), ("body", 0.20)],
    "default": [("title", 0.30), ("body", 0.30), ("urls", 0.20), ("citations", 0.20)],
}
#: Up to so many days old a page has this much of the recency.
RECENCY = ((90, 1.0), (180, 0.7), (365, 0.4))
OLDER = 0.1
# End of the fixed values.


def dimensions(now: Column) -> dict[str, Column]:
    """The dimensions, from 0 to 1, of pages (title, compiled_truth, timeline, frontmatter, updated_on)."""
    t = F.coalesce("compiled_truth", F.lit(""))
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    up_to = lambda c, most: F.least(c / most, F.lit(1.0))
    urls = n(t, r"https?://[^\s)\]]+")
    line = F.trim(F.coalesce("timeline", F.lit("")))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")
    day = F.coalesce(F.try_to_timestamp(F.try_element_at("frontmatter", F.lit("last_verified")), F.lit("yyyy-MM-dd")).cast("date"), F.col("updated_on"))
    age = F.datediff(now, day)
    recency = F.lit(OLDER)
    for days, value in reversed(RECENCY):
        recency = F.when(age <= days, value).otherwise(recency)
    return {
        "urls": F.when(urls >= 2, 1.0).when(urls == 1, 0.6).otherwise(0.0),
        "timeline": F.when(line == "", 0.0).when(n(line, r"(?m)^\s*-\s") > 0, 1.0).otherwise(0.5),
        "citations": up_to(n(t, r"\[Source:[^\]]*\]") + n(t, r"\]\(https?://[^)]+\)"), 3),
        "links": up_to(n(t, r"\[[^\]]+\]\([^)]*\.md\)"), 3),
        "examples": up_to(n(t, r"(?m)^\s*(?:[-*]|\d+\.)\s"), 2),
        "recency": F.when(age.isNull(), 0.0).otherwise(recency),
        "non_redundancy": F.when(F.char_length(t) < 200, 0.5).when(F.size(lines) == 0, 0.0).otherwise(F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))),
        "title": (F.trim(F.coalesce("title", F.lit(""))) != "").cast("double"),
        "body": (F.btrim(t, F.lit(" \t\r\n\x0b\x0c")) != "").cast("double"),
    }


def rubric_score(pages: DataFrame, now: Column) -> DataFrame:
    """(page_id, rubric, score) of pages (page_id, type, title, compiled_truth, timeline, frontmatter MAP, updated_on): the weighted sum of what the type's rubric asks for, to three places; types without a rubric, and none, have the default one."""
    dims = dimensions(now)
    says = lambda keys: reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.try_element_at("frontmatter", F.lit(k)), F.lit(""))) != "" for k in keys]).cast("double")
    rubric = F.when(F.col("type").isin(*[k for k in RUBRICS if k != "default"]), F.col("type")).otherwise("default")
    score = None
    for kind, parts in RUBRICS.items():
        value = reduce(lambda a, b: a + b, [w * (dims[d] if isinstance(d, str) else says(d)) for d, w in parts])
        score = F.when(F.col("rubric") == kind, value) if score is None else score.when(F.col("rubric") == kind, value)
    return pages.withColumn("rubric", rubric).select("page_id", "rubric", F.round(score + 1e-9, 3).alias("score"))  # halves that binary fractions miss go up
