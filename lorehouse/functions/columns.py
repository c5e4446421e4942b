"""Column expressions: all of them stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, half-lives and prefixes of the reference behaviour.
SOURCE_FACTORS = {
    "originals/": 1.5, "docs/": 1.4, "playbooks/": 1.4, "integrations/": 1.4, "runbooks/": 1.4, "decisions/": 1.4, "handoffs/": 1.4, "concepts/": 1.3, "writing/": 1.4,
    "people/": 1.2, "companies/": 1.2, "deals/": 1.2, "meetings/": 1.1, "media/articles/": 1.1, "media/repos/": 1.1, "yc/": 1.0, "civic/": 1.0, "daily/": 0.8, "media/x/": 0.7, "openclaw/chat/": 0.5,
}
HARD_EXCLUDES = ("test/", "archive/", "attachments/", ".raw/")
RECENCY = {
    "concepts/": (0, 0.0), "originals/": (180, 0.5), "writing/": (365, 0.4), "daily/": (14, 1.5), "meetings/": (60, 1.0), "chat/": (7, 1.0), "media/x/": (7, 1.5), "media/articles/": (90, 0.5),
    "people/": (365, 0.3), "companies/": (365, 0.3), "deals/": (180, 0.5),
}
RECENCY_OTHERWISE = (90, 0.5)
HALF_LIVES = {"event": 7, "commitment": 90, "preference": 90, "belief": 365, "fact": 365}
FILENAME_FIRST = ("daily/", "meetings/")
# End of the fixed values.


def visible(deleted: Column, archived: Column | None = None) -> Column:
    """Neither deleted nor of an archived source; null counts as false."""
    gone = F.coalesce(deleted, F.lit(False))
    return ~gone if archived is None else ~(gone | F.coalesce(archived, F.lit(False)))


def in_scope(source: Column, sources: list[str] | None) -> Column:
    return source.isin(sources) if sources else F.lit(True)


def hard_excluded(slug: Column, prefixes: tuple[str, ...] = HARD_EXCLUDES) -> Column:
    return reduce(lambda a, b: a | b, [slug.startswith(p) for p in prefixes])


def longest_prefix(slug: Column, rules: dict, otherwise) -> Column:
    """The value of the longest prefix of slug in rules."""
    out = None
    for p in sorted(rules, key=lambda p: (-len(p), p)):
        out = F.when(slug.startswith(p), F.lit(rules[p])) if out is None else out.when(slug.startswith(p), F.lit(rules[p]))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def source_factor(slug: Column, factors: dict[str, float] = SOURCE_FACTORS, detail: str | None = None) -> Column:
    return F.lit(1.0) if detail == "high" else longest_prefix(slug, factors, 1.0)


def source_tier(slug: Column, factors: dict[str, float] = SOURCE_FACTORS) -> Column:
    f = source_factor(slug, factors)
    return F.when(f > 1.05, "curated").when(f < 0.95, "bulk").otherwise("other")


def recency(slug: Column, day: Column, now: Column, rules: dict[str, tuple[int, float]] = RECENCY, otherwise: tuple[int, float] = RECENCY_OTHERWISE) -> Column:
    """c h / (h + days since day); 0 for what does not age or has no day."""
    half = longest_prefix(slug, {k: float(v[0]) for k, v in rules.items()}, float(otherwise[0]))
    weight = longest_prefix(slug, {k: v[1] for k, v in rules.items()}, otherwise[1])
    days = F.greatest(F.datediff(now, day), F.lit(0)).cast("double")
    return F.when((half == 0) | day.isNull(), F.lit(0.0)).otherwise(weight * half / (half + days))


# Fixed values.
SESSION_FOLDERS = ("chat", "session", "sessions")
# End of the fixed values.


def session_prefix(slug: Column) -> Column:
    """The part of a slug that names its session: up to the segment after the first one that is a session folder, or up to the first that begins with a day, whichever comes first; null for others."""
    folder = "|".join(SESSION_FOLDERS)
    found = F.regexp_extract(slug, rf"^((?:(?!(?:{folder})(?:/|$)|\d{{4}}-\d{{2}}-\d{{2}})[^/]*/)*(?:(?:{folder})(?:/[^/]*|$)|\d{{4}}-\d{{2}}-\d{{2}}[^/]*))", 1)
    return F.when(slug.contains("/") & (found != ""), found)


def stale_score(last: Column, now: Column, days: int = 90) -> Column:
    """2 for what was never retrieved, 1 for what was not for so many days, else 0."""
    return F.when(last.isNull(), 2).when(last < F.date_sub(now, days), 1).otherwise(0)


def effective_confidence(confidence: Column, kind: Column, valid_from: Column, now: Column, expired: Column | None = None, valid_until: Column | None = None) -> Column:
    """confidence exp(-age / e-folding time of its kind), in 0 to 1; undecayed before valid_from."""
    life = F.create_map(*[F.lit(x) for k, v in HALF_LIVES.items() for x in (k, float(v))])[kind]
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))) / 86400e6
    value = F.when(age < 0, confidence).otherwise(confidence * F.exp(-age / life))
    out = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    if valid_until is not None:
        out = F.when(valid_until <= now, 0.0).otherwise(out)
    return out if expired is None else F.when(F.coalesce(expired, F.lit(False)), 0.0).otherwise(out)


def effective_date(slug: Column, filename: Column, fields: dict[str, Column], updated: Column, created: Column, now: Column) -> Column:
    """struct(date, source): the first date in 1990 to a year from now, from fields event_date, date, published in order and the file name, which leads for daily notes and meetings; else the update or creation."""

    def ok(c: Column) -> Column:
        day = F.to_date(F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")))
        return F.when((day >= F.lit("1990-01-01").cast("date")) & (day <= F.date_add(now, 365)), day)

    name = ok(F.nullif(F.regexp_extract(filename, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    dated = [(n, ok(fields[n])) for n in ("event_date", "date", "published") if n in fields]
    first = reduce(lambda a, b: a | b, [slug.startswith(p) for p in FILENAME_FIRST])

    def chain(order: list[tuple[str, Column]]) -> Column:
        label = F.lit("fallback")
        for n, c in reversed(order):
            label = F.when(c.isNotNull(), n).otherwise(label)
        return F.struct(F.coalesce(*[c for _, c in order], updated, created).alias("date"), label.alias("source"))

    return F.when(first, chain([("filename", name), *dated])).otherwise(chain([*dated, ("filename", name)]))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4.0).cast("long")


#: Scripts that are written without blanks between words.
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def word_count(text: Column, share: float = 0.30) -> Column:
    """Characters other than white space where at least `share` of them are CJK, else words."""
    solid = F.char_length(F.regexp_replace(text, r"\s+", ""))
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.when((solid > 0) & (cjk >= share * solid), solid).otherwise(F.regexp_count(text, F.lit(r"\S+"))).cast("long")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


#: Where a word of ASCII begins or ends. Java's own \\b takes other letters for parts of words as well.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """The pattern with \\b as the edge of a word of ASCII."""
    return pattern.replace(r"\b", EDGE)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{ascii_words(p)})" for p in patterns))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text, each word with two blanks before and one after it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high): the 95 % interval of a share, exactly 0 and 1 at the ends; null for none."""
    p = k / n
    d = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n == 0, None).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, None).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
