"""Roll-ups over pages, chunks, links, facts and takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed values.
HEALTH_WEIGHTS = {"embed": 35, "links": 25, "timeline": 15, "orphans": 15, "dead": 10}
HIGH_EMOTION = ("family", "marriage", "wedding", "loss", "death", "grief", "relationship", "love", "mental-health", "health", "illness", "birth", "children", "kids", "parents")
# End of the fixed values.


def corpus_stats(pages: DataFrame, chunks: DataFrame, links: DataFrame, tags: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals."""
    live = pages.where(~F.col("deleted"))
    has = chunks.join(vectors.select("vec_id").distinct(), "vec_id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(live, "pages")
    for df in (one(chunks, "chunks"), one(has, "embedded"), one(links, "links"), tags.agg(F.count_distinct("tag").alias("tags")), chunks.agg(F.count_if(F.col("chunk_source") == "timeline").alias("timeline"))):
        out = out.crossJoin(df)  # one row each
    return out


def pages_by_type(pages: DataFrame) -> DataFrame:
    return pages.where(~F.col("deleted")).groupBy(F.coalesce("type", F.lit("untyped")).alias("type")).agg(F.count("*").alias("n"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Live pages without a link from another live page."""
    live = pages.where(~F.col("deleted"))
    linked = links.join(live.select(F.col("page_id").alias("from_page_id")), "from_page_id", "left_semi").select(F.col("to_page_id").alias("page_id"))
    return live.join(linked, "page_id", "left_anti").select("page_id", "slug")


def dead_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(pages.where(~F.col("deleted")).select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_anti").select("from_page_id", "to_page_id", "link_type")


def corpus_health(pages: DataFrame, chunks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts, coverages and a score of 0 to 100 from five rounded parts."""
    w = HEALTH_WEIGHTS
    live = pages.where(~F.col("deleted"))
    flags = (
        live.select("page_id")
        .join(links.select(F.col("from_page_id").alias("page_id")).union(links.select("to_page_id")).distinct().withColumn("linked", F.lit(1)), "page_id", "left")
        .join(chunks.where(F.col("chunk_source") == "timeline").select("page_id").distinct().withColumn("timed", F.lit(1)), "page_id", "left")
        .join(orphans(pages, links).select("page_id").withColumn("orphan", F.lit(1)), "page_id", "left")
        .agg(F.count("*").alias("pages"), F.count("linked").alias("linked"), F.count("timed").alias("timed"), F.count("orphan").alias("orphans"))
    )
    embedded = chunks.join(vectors.select("vec_id", F.lit(1).alias("e")).distinct(), "vec_id", "left").agg(F.count("*").alias("chunks"), F.count("e").alias("embedded"))
    dead = dead_links(pages, links).agg(F.count("*").alias("dead_links"))
    total = links.agg(F.count("*").alias("links"))
    out = flags.crossJoin(embedded).crossJoin(dead).crossJoin(total)  # one row each
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    parts = {"embed": share("embedded", "chunks"), "links_": share("linked", "pages"), "timeline": share("timed", "pages"), "orphans_": 1 - share("orphans", "pages"), "dead": 1 - share("dead_links", "links")}
    for (name, v), k in zip(parts.items(), w.values(), strict=True):
        out = out.withColumn(f"{name.rstrip('_')}_points", F.round(k * v).cast("long"))
    return out.withColumn("score", F.col("embed_points") + F.col("links_points") + F.col("timeline_points") + F.col("orphans_points") + F.col("dead_points"))


def score_gap(health: DataFrame) -> DataFrame:
    """(component, points, missed, reachable): what each part of the health score lacks, the largest first, and the score once it and those before it are mended."""
    w = HEALTH_WEIGHTS
    rows = health.select("score", F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"{k}_points").alias("points"), F.lit(v).cast("long").alias("most")) for k, v in w.items()])).alias("c"))
    rows = rows.select("score", "c.component", "c.points", (F.col("c.most") - F.col("c.points")).alias("missed"))
    upto = Window.partitionBy("score").orderBy(F.desc("missed"), "component").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("reachable", F.col("score") + F.sum("missed").over(upto)).drop("score")


def source_metrics(pages: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    p = pages.where(~F.col("deleted")).select("page_id", "source_id")
    c = chunks.join(vectors.select("vec_id", F.lit(1).alias("e")).distinct(), "vec_id", "left").groupBy("page_id").agg(F.count("*").alias("c"), F.count("e").alias("e"))
    out = p.join(c, "page_id", "left").groupBy("source_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("embedded"))
    return out.withColumn("coverage", F.round(F.coalesce(F.col("embedded") / F.nullif("chunks", F.lit(0)), F.lit(0.0)), 6))


def type_stats(pages: DataFrame) -> DataFrame:
    """typed, untyped and coverage of each source and, as `*`, of all."""
    out = pages.where(~F.col("deleted")).rollup("source_id").agg(F.count("type").alias("typed"), F.count_if(F.col("type").isNull()).alias("untyped"), F.grouping("source_id").alias("g"))
    return out.select(F.when(F.col("g") == 1, "*").otherwise(F.col("source_id")).alias("source_id"), "typed", "untyped", F.round(F.col("typed") / (F.col("typed") + F.col("untyped")), 4).alias("coverage"))


def detect_types(pages: DataFrame, least: int = 5, top: int = 50) -> DataFrame:
    """First path segments that at least so many pages share, and the types seen there."""
    seg = F.regexp_extract("slug", "^([^/]+)/", 1).alias("prefix")
    out = pages.where(~F.col("deleted")).select(seg, "type").where(F.col("prefix") != "").groupBy("prefix").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return out.where(F.col("n") >= least).orderBy(F.desc("n"), "prefix").limit(top)


def dead_prefixes(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Declared prefixes (prefix) without a page. Rules are few and go to the pages, whose segments are aggregated first."""
    seen = pages.where(~F.col("deleted")).select(F.regexp_extract("slug", "^([^/]+/)", 1).alias("prefix")).distinct()
    return rules.select("prefix").distinct().join(seen, "prefix", "left_anti")


def emotional_weight(pages: DataFrame, tags: DataFrame, takes: DataFrame, owner: str, high: tuple[str, ...] = HIGH_EMOTION) -> DataFrame:
    """(page_id, emotional_weight): half for a moving tag, up to .3 for takes, a tenth each for their mean weight and the owner's share. Both sides are aggregated before they meet."""
    t = tags.where(F.col("tag").isin(*high)).groupBy("page_id").agg(F.lit(0.5).alias("tag_part"))
    k = takes.where("active").groupBy("page_id").agg(F.count("*").alias("n"), F.avg(F.greatest(F.least("weight", F.lit(1.0)), F.lit(0.0))).alias("mean"), F.avg((F.col("holder") == owner).cast("double")).alias("own"))
    value = F.coalesce("tag_part", F.lit(0.0)) + F.coalesce(F.least(0.1 * F.col("n"), F.lit(0.3)) + 0.1 * F.col("mean") + 0.1 * F.col("own"), F.lit(0.0))
    return pages.select("page_id").join(t, "page_id", "left").join(k, "page_id", "left").select("page_id", F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 6).alias("emotional_weight"))


def recent_salience(pages: DataFrame, weights: DataFrame, takes: DataFrame, now: Column, days: int = 14, top: int = 20, rules: dict | None = None) -> DataFrame:
    """5 w + ln(1 + takes) + 1 / (1 + days), or the decay of the slug's prefix where rules are given, of live pages updated, or touched (touched_on, where pages have it), in the window."""
    k = takes.where("active").groupBy("page_id").agg(F.count_distinct("take_id").alias("n"))
    age = F.datediff(now, F.col("updated_on"))
    fresh = 1 / (1 + F.greatest(age, F.lit(0)).cast("double")) if rules is None else C.recency(F.col("slug"), F.col("updated_on"), now, rules)
    score = 5 * F.col("emotional_weight") + F.log1p(F.coalesce("n", F.lit(0)).cast("double")) + fresh
    last = F.greatest("updated_on", "touched_on") if "touched_on" in pages.columns else F.col("updated_on")
    seen = F.datediff(now, last)
    out = pages.where(~F.col("deleted") & (seen <= days) & (seen >= 0)).join(weights, "page_id").join(k, "page_id", "left")
    return out.select("page_id", "slug", F.round(score, 6).alias("salience")).orderBy(F.desc("salience"), "page_id").limit(top)


def anomalies(events: DataFrame, day: str, lookback: int = 30, sigma: float = 3.0, top: int = 20) -> DataFrame:
    """Cohorts of events (cohort, page_id, d) whose distinct pages on `day` exceed the mean of the zero-filled days before it by sigma deviations (by 1 where they never vary)."""
    at = F.lit(day).cast("date")
    counts = events.where((F.col("d") <= at) & (F.col("d") >= F.date_sub(at, lookback))).groupBy("cohort", "d").agg(F.count_distinct("page_id").alias("n"))
    base = F.col("d") < at
    # Days without pages add nothing to the sums and count as zeros.
    s = counts.groupBy("cohort").agg(
        F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.when(base, F.col("n") * F.col("n"))), F.lit(0)).alias("s2"), F.coalesce(F.max(F.when(~base, F.col("n"))), F.lit(0)).alias("n")
    )
    mean = F.col("s1") / float(lookback)
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * mean) / (lookback - 1.0)))
    s = s.withColumn("mean", F.round(mean, 6)).withColumn("sd", F.round(sd, 6))
    s = s.withColumn("sigmas", F.round(F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(F.col("n") - F.col("mean")), 6))
    hit = F.when(F.col("sd") > 0, F.col("n") > F.col("mean") + sigma * F.col("sd")).otherwise(F.col("n") > F.col("mean") + 1)
    return s.where(hit).select("cohort", "n", "mean", "sd", "sigmas").orderBy(F.desc("sigmas"), "cohort").limit(top)


def scorecard(takes: DataFrame, by: tuple[str, ...] = ("holder",)) -> DataFrame:
    """Bets and how they came out; Brier score and accuracy over correct and incorrect ones."""
    q = F.col("resolved_quality")
    right = F.when(q == "correct", 1.0).when(q == "incorrect", 0.0)
    n = lambda v: F.count_if(q == v)
    out = takes.groupBy(*by).agg(
        F.count("*").alias("bets"), F.count_if(q.isin("correct", "incorrect", "partial")).alias("resolved"), n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("partial").alias("partial"), n("unresolvable").alias("unresolvable"),
        F.round(F.avg((F.col("weight") - right) ** 2), 6).alias("brier"), F.round(F.avg(right), 6).alias("accuracy"),
    )
    return out.withColumn("partial_rate", F.round(F.col("partial") / F.nullif("resolved", F.lit(0)), 6))


def calibration_curve(takes: DataFrame, bucket: float = 0.1) -> DataFrame:
    """(bin, n, observed, predicted) of correct and incorrect bets by weight."""
    right = F.when(F.col("resolved_quality") == "correct", 1.0).when(F.col("resolved_quality") == "incorrect", 0.0)
    last = int(1 / bucket + 1e-9) - 1
    return takes.where(right.isNotNull()).groupBy(F.least(F.floor(F.col("weight") / bucket + 1e-9), F.lit(last)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("observed"), F.round(F.avg("weight"), 6).alias("predicted"))


def forecast(takes: DataFrame, domain: Column, least: int = 5) -> DataFrame:
    """Each active take with the Brier score to expect: that of its holder and domain, of its holder where these are fewer than `least`, or null."""
    right = F.when(F.col("resolved_quality") == "correct", 1.0).when(F.col("resolved_quality") == "incorrect", 0.0)
    t = takes.withColumn("domain", domain).withColumn("miss", (F.col("weight") - right) ** 2)
    fine = t.groupBy("holder", "domain").agg(F.count("miss").alias("n1"), F.avg("miss").alias("b1"))
    wide = t.groupBy("holder").agg(F.count("miss").alias("n2"), F.avg("miss").alias("b2"))
    value = F.when(F.col("n1") >= least, F.col("b1")).when(F.col("n2") >= least, F.col("b2"))
    return t.where("active").join(fine, ["holder", "domain"]).join(wide, "holder").select("take_id", "holder", "domain", F.round(value, 6).alias("expected_brier"), F.when(F.col("n1") >= least, "domain").when(F.col("n2") >= least, "holder").alias("basis"))


def facts_health(facts: DataFrame, now: Column) -> DataFrame:
    age = F.datediff(now, F.col("valid_from").cast("date"))
    live = ~F.col("expired")
    return facts.agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("expired"), F.count_if(live & (age <= 1)).alias("today"), F.count_if(live & (age <= 7)).alias("week"), F.count_distinct("entity_slug").alias("entities"))


def top_entities(facts: DataFrame, k: int = 5) -> DataFrame:
    return facts.where(~F.col("expired")).groupBy("entity_slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_slug").limit(k)


def mention_tiers(mentions: DataFrame) -> DataFrame:
    """(entity, n, kinds, tier, escalate) of mentions (entity, source_kind)."""
    s = mentions.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("source_kind").alias("kinds"), F.max(F.col("source_kind").isin("meeting", "voice")).alias("heard"))
    tier = F.when((F.col("n") >= 8) | F.col("heard"), 1).when((F.col("n") >= 3) & (F.col("kinds") >= 2), 2).otherwise(3).cast("long")
    return s.select("entity", "n", "kinds", tier.alias("tier")).withColumn("escalate", F.col("tier") < 3)


def panel(scores: DataFrame) -> DataFrame:
    """Verdict on each item of scores (item, dimension, rater, score)."""
    d = scores.groupBy("item", "dimension").agg(F.round(F.avg("score"), 1).alias("mean"), F.min("score").alias("low"), F.count_distinct("rater").alias("raters"))
    s = d.groupBy("item").agg(F.round(F.avg("mean"), 6).alias("overall"), F.min("raters").alias("raters"), F.max((F.col("mean") < 7) | (F.col("low") < 5)).alias("bad"))
    return s.select("item", "overall", "raters", F.when(F.col("raters") < 2, "inconclusive").when(F.col("bad"), "fail").otherwise("pass").alias("verdict"))


def panel_regress(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dimension, old, new, delta) of two runs (dimension, score)."""
    a, b = (x.groupBy("dimension").agg(F.avg("score").alias(n)) for x, n in ((old, "old_mean"), (new, "new_mean")))
    return a.join(b, "dimension", "full_outer").select("dimension", F.round("old_mean", 6).alias("old_mean"), F.round("new_mean", 6).alias("new_mean"), F.round(F.col("new_mean") - F.col("old_mean"), 6).alias("delta"))


def observed_schema(pages: DataFrame, links: DataFrame, declared: DataFrame) -> DataFrame:
    """(from_type, verb, to_type, n, declared): triples seen in links, and declared ones that none uses with n 0."""
    kind = lambda p: pages.select(F.col("page_id").alias(f"{p}_page_id"), F.coalesce("type", F.lit("untyped")).alias(f"{p}_type"))
    seen = links.join(kind("from"), "from_page_id").join(kind("to"), "to_page_id").groupBy("from_type", F.col("link_type").alias("verb"), "to_type").agg(F.count("*").alias("n"))
    out = seen.join(declared.withColumn("d", F.lit(True)), ["from_type", "verb", "to_type"], "full_outer")
    return out.select("from_type", "verb", "to_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(False)).alias("declared"))


def provenance_checks(extracts: DataFrame, chunks: DataFrame, dated: DataFrame, version: int, now: Column) -> DataFrame:
    """(check, n), a row each: extracts (body, raw) under 30 % of a raw text of more than 1,000 characters that has headings; chunks (chunker_version, chunker_mode) of another version or without a mode; pages (effective_date, effective_source, metadata_day) whose date fell back although their metadata has one, lies more than a year ahead, or before 1990."""
    short = (F.char_length("raw") > 1_000) & F.col("raw").rlike(r"(?m)^#{1,6} ") & (F.char_length(F.coalesce("body", F.lit(""))) < 0.3 * F.char_length("raw"))
    counts = [
        (extracts, {"short_extract": short}),
        (chunks, {"chunker_drift": ~F.coalesce(F.col("chunker_version") == version, F.lit(False)), "chunker_mode_missing": F.col("chunker_mode").isNull()}),
        (dated, {"date_fallback": (F.col("effective_source") == "fallback") & F.col("metadata_day").isNotNull(), "date_far_ahead": F.col("effective_date") > F.date_add(now, 365), "date_before_1990": F.col("effective_date") < F.lit("1990-01-01").cast("date")}),
    ]
    out = None
    for df, checks in counts:
        one = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).select(F.explode(F.create_map(*[x for n in checks for x in (F.lit(n), F.col(n))])).alias("check", "n"))
        out = one if out is None else out.unionByName(one)
    return out


def quality_checks(pages: DataFrame, chunks: DataFrame, takes: DataFrame, weights: DataFrame, now: Column) -> DataFrame:
    """(check, n): one row for each check."""
    grid = takes.agg(F.count_if(F.abs(F.col("weight") * 20 - F.round(F.col("weight") * 20)) > 1e-9).alias("n")).withColumn("check", F.lit("weight_off_grid"))
    lone = chunks.join(pages.where(~F.col("deleted")), "page_id", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("chunk_without_page"))
    zero = takes.where("active").select("page_id").distinct().join(weights.where(F.col("emotional_weight") == 0), "page_id", "left_semi").agg(F.count("*").alias("n")).withColumn("check", F.lit("zero_weight_with_takes"))
    late = pages.agg(F.count_if(F.col("updated_on") > F.date_add(now, 365)).alias("n")).withColumn("check", F.lit("date_in_future"))
    none = pages.agg(F.count_if(F.col("type").isNull()).alias("n")).withColumn("check", F.lit("untyped"))
    out = grid
    for x in (lone, zero, late, none):
        out = out.unionByName(x)
    return out.select("check", "n")
