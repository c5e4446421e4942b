"""Window and sequence analytics over facts and takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shared import cut
from .greedy import leaders


def trajectory(facts: DataFrame, metrics: list[str] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """(entity_slug, claim_metric, n, valid_from, claim_value): typed points in order, n from 1."""
    f = facts.where(~F.col("expired") & F.col("claim_value").isNotNull())
    for cond in (F.col("claim_metric").isin(metrics) if metrics else None, F.col("valid_from") >= since if since is not None else None, F.col("valid_from") < until if until is not None else None):
        f = f if cond is None else f.where(cond)
    w = Window.partitionBy("entity_slug", "claim_metric").orderBy("valid_from", "fact_id")
    return f.select("entity_slug", "claim_metric", F.row_number().over(w).cast("long").alias("n"), "valid_from", "claim_value", "fact_id")


def regressions(points: DataFrame, drop: float = 0.10) -> DataFrame:
    """Points at least `drop` below the one before; a previous value of 0 has no share."""
    before = F.lag("claim_value").over(Window.partitionBy("entity_slug", "claim_metric").orderBy("n"))
    p = points.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != 0))
    change = (F.col("claim_value") - F.col("before")) / F.abs("before")
    return p.withColumn("change", F.round(change, 6)).where(change <= -drop).select("entity_slug", "claim_metric", "n", "before", "claim_value", "change")


def drift_score(points: DataFrame) -> DataFrame:
    """(entity_slug, drift) of points (entity_slug, valid_from, fact_id, v): 1 - mean cosine of neighbours; null under three points."""
    w = Window.partitionBy("entity_slug").orderBy("valid_from", "fact_id")
    s = points.withColumn("sim", C.cosine(F.lag("v").over(w), F.col("v"))).groupBy("entity_slug").agg(F.count("*").alias("n"), F.avg("sim").alias("m"))
    return s.select("entity_slug", F.when(F.col("n") >= 3, F.round(F.least(F.greatest(1 - F.col("m"), F.lit(0.0)), F.lit(1.0)), 6)).alias("drift"))


def founder_scorecard(points: DataFrame, flat: float = 0.01, move: float = 0.05) -> DataFrame:
    """(entity_slug, claim_metric, points, consistency, last_change, direction)."""
    w = Window.partitionBy("entity_slug", "claim_metric").orderBy("n")
    before = F.lag("claim_value").over(w)
    p = points.withColumn("ch", (F.col("claim_value") - before) / F.nullif(F.abs(before), F.lit(0.0)))
    s = p.groupBy("entity_slug", "claim_metric").agg(F.count("*").alias("points"), F.count_if(F.abs("ch") >= move).alias("moves"), F.max_by("ch", "n").alias("last"))
    direction = F.when(F.col("last").isNull(), None).when(F.abs("last") < flat, "flat").when(F.col("last") > 0, "up").otherwise("down")
    return s.select("entity_slug", "claim_metric", "points", F.round(1 - F.col("moves") / F.col("points"), 6).alias("consistency"), F.round("last", 6).alias("last_change"), direction.alias("direction"))


#: Facts of a group that are taken at first, the first of them in order; four times as many each further turn.
CLUSTER_BLOCK = 256


def cluster_facts(facts: DataFrame, least: float = 0.85, by: tuple[str, ...] = ("entity_slug",)) -> DataFrame:
    """(fact_id, leader_id): within each group, newest first, each fact (fact_id, by, valid_from, v) joins the first leader of at least that cosine or leads itself. A fact without a vector leads itself alone."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("valid_from"), F.desc("fact_id")))
    placed = facts.where(F.col("v").isNotNull()).select(F.to_json(F.struct(*by)).alias("key"), F.col("fact_id").alias("id"), newest.alias("o"), "v")
    found = leaders(placed, least, CLUSTER_BLOCK)
    return found.select(F.col("id").alias("fact_id"), F.col("leader").alias("leader_id")).unionByName(facts.where(F.col("v").isNull()).select(F.col("fact_id").cast("long").alias("fact_id"), F.col("fact_id").cast("long").alias("leader_id")))


def consolidate(facts: DataFrame, now: Column, least: float = 0.85, min_facts: int = 3, min_hours: int = 24, by: tuple[str, ...] = ("entity_slug",)) -> DataFrame:
    """(leader_id, n, weight, since, claim_value, sources): one claim for each cluster of at least two of the active facts of a group.

    Only facts older than min_hours take part, and groups that then hold at least
    min_facts. A claim is that of the highest confidence, its weight their mean, it
    holds since the earliest, and names the different sources (source, where facts
    have one) of its facts, in order.
    """
    f = facts.where(~F.col("expired") & (F.col("valid_from") <= now - F.make_dt_interval(hours=F.lit(min_hours))))
    f = f.join(f.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_facts).select(*by), list(by), "left_semi")
    clusters = cluster_facts(f, least, by)
    told = f.withColumn("_source", F.col("source") if "source" in f.columns else F.lit(None).cast("string"))
    per = told.join(clusters, "fact_id").groupBy("leader_id", "_source").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.min("valid_from").alias("since"), F.max(F.struct("confidence", "fact_id", "claim_value")).alias("b"))
    # By source first, so that a cluster's names are as many as it has sources.
    s = per.groupBy("leader_id").agg(F.sum("n").alias("n"), F.round(F.sum("c") / F.sum("n"), 6).alias("weight"), F.min("since").alias("since"), F.max("b")["claim_value"].alias("claim_value"), F.array_join(F.array_sort(F.collect_set("_source")), ",").alias("sources"))
    return s.where(F.col("n") >= 2)


def chain_validity(facts: DataFrame) -> DataFrame:
    """(fact_id, valid_until): each fact ends where the next of its entity and metric begins."""
    w = Window.partitionBy("entity_slug", "claim_metric").orderBy("valid_from", "fact_id")
    return facts.select("fact_id", F.lead("valid_from").over(w).alias("valid_until"))


def chain_heads(pointers: DataFrame) -> DataFrame:
    """(id, head, steps) of pointers (id, next), next null at a head: where following them ends, and after how many. Each turn doubles what a row has followed; on a ring it ends without a head."""
    step = cut(pointers.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    n = step.count()
    reach = 1
    while reach <= n and step.where(F.col("next").isNotNull()).join(step.select(F.col("id").alias("next"), F.col("next").alias("_n")), "next").where(F.col("_n").isNotNull()).limit(1).count():
        after = step.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("steps").alias("_s"))
        step = cut(step.join(after, "next", "left").select("id", F.coalesce("_n", "next").alias("next"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps")))
        reach *= 2
    return step.select("id", F.coalesce("next", "id").alias("head"), "steps")


def supersessions(facts: DataFrame, since: Column | None = None, limit: int = 50) -> DataFrame:
    """The expired facts (fact_id, expired_at, superseded_by) that another has replaced, newest first."""
    f = facts.where(F.col("expired_at").isNotNull() & F.col("superseded_by").isNotNull())
    f = f if since is None else f.where(F.col("expired_at") >= since)
    return f.orderBy(F.desc("expired_at"), F.desc("fact_id")).limit(limit)


def timeline(entries: DataFrame, pages: DataFrame, limit: int, after: Column | None = None, before: Column | None = None) -> DataFrame:
    """entries (page_id, entry_id, at) of a set of pages within a span of time, the newest `limit` of each page, with their rank."""
    e = entries.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    e = e if after is None else e.where(F.col("at") >= after)
    e = e if before is None else e.where(F.col("at") < before)
    newest = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("at"), F.desc("entry_id")))
    return e.withColumn("rank", newest).where(F.col("rank") <= limit)


def supersede_takes(takes: DataFrame, changes: DataFrame) -> DataFrame:
    """takes (page_id, row_num, claim, active) with changes (page_id, old_row, claim) appended as new rows and the old ones closed."""
    top = takes.groupBy("page_id").agg(F.max("row_num").alias("top"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("old_row"))
    new = changes.join(takes.select("page_id", F.col("row_num").alias("old_row")), ["page_id", "old_row"], "left_semi").withColumn("nth", nth).join(top, "page_id")
    added = new.select("page_id", (F.col("top") + F.col("nth")).cast("long").alias("row_num"), "claim", F.lit(True).alias("active"))
    closed = changes.select("page_id", F.col("old_row").alias("row_num"), F.lit(True).alias("_c"))
    kept = takes.join(closed, ["page_id", "row_num"], "left").select("page_id", "row_num", "claim", (F.col("active") & F.col("_c").isNull()).alias("active"))
    return kept.unionByName(added)


def stratified_sample(pages: DataFrame, stratum: Column, rank: list, per: int = 1) -> DataFrame:
    """The first rows of each stratum by the given order."""
    p = pages.withColumn("stratum", stratum)
    return p.withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy(*rank))).where(F.col("_n") <= per).drop("_n")


def corpus_sample(pages: DataFrame, n: int, seed: int, by: str = "page_id") -> DataFrame:
    """n rows drawn by the hash of seed and id: the same ones for the same seed, wherever they lie."""
    return pages.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")))).orderBy("_h", by).limit(n).drop("_h")


#: Close vectors that go to all tasks at once.
CLOSE_BLOCK = 4_096


def _outside(candidates: DataFrame, close: DataFrame) -> DataFrame:
    """The candidates whose stratum is none of the close set's. Strata that fit one block go to all tasks, so that vectors are not dealt by stratum."""
    strata = close.select("stratum").distinct()
    few = strata.limit(CLOSE_BLOCK + 1).count() <= CLOSE_BLOCK
    return candidates.join(F.broadcast(strata) if few else strata, "stratum", "left_anti")


def far_pages(candidates: DataFrame, close: DataFrame, m: int | None = None, seed: int = 0) -> DataFrame:
    """Of candidates (id, stratum, rank) outside the strata of the close set, the one of least rank and id of each stratum; of these m strata drawn by a seed, or all."""
    one = _outside(candidates, close).withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("rank", "id"))).where(F.col("_n") == 1).drop("_n")
    return one if m is None else corpus_sample(one, m, seed, "stratum")


def _nearest(rows: DataFrame, close: DataFrame, sim: Column) -> DataFrame:
    """(id, stratum, s): the greatest `sim` of v, of rows (id, stratum, v), and w, of the close set (id, v), which goes to the tasks in blocks of CLOSE_BLOCK. Each id of a stratum once."""
    blocks = max(1, -(-close.count() // CLOSE_BLOCK))
    rows = rows if blocks == 1 else cut(rows)  # read once a block
    found = None
    for block in range(blocks):
        some = close.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select(F.col("v").alias("w"))  # about CLOSE_BLOCK rows
        part = rows.join(F.broadcast(some)).groupBy("id", "stratum").agg(F.max(sim).alias("s"))
        found = part if found is None else found.unionByName(part)
    return found if blocks == 1 else found.groupBy("id", "stratum").agg(F.max("s").alias("s"))


def _distance(s: Column) -> Column:
    return F.round(F.greatest(F.least((1 - s) / 2, F.lit(1.0)), F.lit(0.0)), 6)


def far_distances(candidates: DataFrame, close: DataFrame) -> DataFrame:
    """(id, stratum, distance) of every one of candidates (id, stratum, v) outside the strata of the close set (id, stratum, v), each once: (1 - cos) / 2 to the nearest close one.

    It is 1 where a vector is missing, or where one of a pair has no length; without
    a close set there are no rows.
    """
    angle = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), F.coalesce(C.cosine(F.col("v"), F.col("w")), F.lit(float("nan"))))  # max takes NaN for the greatest, least for greater than 1
    return _nearest(_outside(candidates, close).select("id", "stratum", "v"), close, angle).select("id", "stratum", _distance(F.col("s")).alias("distance"))


def far_set(candidates: DataFrame, close: DataFrame, m: int | None = None, seed: int = 0) -> DataFrame:
    """(id, stratum, distance) of far_pages(candidates, close, m, seed), candidates with their vectors v: the distance is (1 - cos) / 2 to the nearest of the close set (id, stratum, v), and 0.5 where there is none or a vector is missing."""
    one = cut(far_pages(candidates, close, m, seed).select("id", "stratum", F.col("v").cast("array<double>").alias("v")))
    best = _nearest(one.where(F.col("v").isNotNull()), close.where(F.col("v").isNotNull()), C.cosine(F.col("v"), F.col("w")))
    return one.join(best.groupBy("id").agg(F.max("s").alias("s")), "id", "left").select("id", "stratum", F.when(F.col("s").isNull(), 0.5).otherwise(_distance(F.col("s"))).alias("distance"))


def red_flags(points: DataFrame, takes: DataFrame, drift: DataFrame, least: float = 0.5) -> DataFrame:
    """(entity_slug, kind, text) of entities: each fall of a metric of points (as regressions takes them), a drift (entity_slug, drift) of at least `least`, and each take (entity_slug, claim, resolved_outcome) that came out false."""
    r = regressions(points)
    fell = r.select("entity_slug", F.lit("regression").alias("kind"), F.concat("claim_metric", F.lit(" fell "), F.format_string("%.1f", F.abs(F.col("change") * 100)), F.lit("%")).alias("text"))
    d = drift.where(F.col("drift") >= least).select("entity_slug", F.lit("narrative_drift").alias("kind"), F.format_string("drift %.2f", "drift").alias("text"))
    missed = takes.where(F.col("resolved_outcome") == F.lit(False)).select("entity_slug", F.lit("missed_prediction").alias("kind"), F.col("claim").alias("text"))
    return fell.unionByName(d).unionByName(missed)


def claim_accuracy(takes: DataFrame) -> DataFrame:
    """(entity_slug, predicted, accurate, accuracy) over takes (entity_slug, resolved_outcome) that have an outcome."""
    t = takes.where(F.col("resolved_outcome").isNotNull()).groupBy("entity_slug").agg(F.count("*").alias("predicted"), F.count_if("resolved_outcome").alias("accurate"))
    return t.withColumn("accuracy", F.round(F.col("accurate") / F.col("predicted"), 6))


def cooldown(events: DataFrame, days: int = 14, key: tuple[str, ...] = ("key",), time: str = "ts", tie: str | None = None) -> DataFrame:
    """The events of each key that fire: the first, then each time the first more than `days` after the last that fired. Of one time the least `tie` fires.

    An event fires next after another if it is the first beyond its cooldown. These
    pointers are followed by doubling, so that rounds grow with the logarithm of the
    number of firings. As a span of `days` holds one firing at most, events are dealt by
    key and span: a key may hold any share of the rows.
    """
    span = days * 86_400_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    first = F.min(F.struct(tie)) if tie else F.lit(0)
    e = cut(events.where(F.col(time).isNotNull()).groupBy(F.struct(*key).alias("_k"), at.alias("_t")).agg(first.alias("_f")).withColumn("_s", F.floor(F.col("_t") / span)))
    begins = e.groupBy("_k", "_s").agg(F.min("_t").alias("_first"))
    spans = Window.partitionBy("_k").orderBy("_s")
    # The first event of the spans after the next one.
    later = begins.select("_k", "_s", F.when(F.lead("_s").over(spans) > F.col("_s") + 1, F.lead("_first").over(spans)).otherwise(F.lead("_first", 2).over(spans)).alias("_later"))
    # Where an event's cooldown ends it asks, before the events of that time, for the first that comes after.
    asks = e.select("_k", F.col("_t").alias("_of"), (F.col("_t") + span).alias("_t"), (F.col("_s") + 1).alias("_s"))
    both = asks.withColumn("_ev", F.lit(None).cast("long")).unionByName(e.select("_k", F.lit(None).cast("long").alias("_of"), "_t", "_s", F.col("_t").alias("_ev")))
    back = Window.partitionBy("_k", "_s").orderBy(F.desc("_t"), F.col("_ev").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_n", F.last("_ev", ignorenulls=True).over(back)).where(F.col("_of").isNotNull())
    nxt = found.select("_k", F.col("_of").alias("_t"), (F.col("_s") - 1).alias("_s"), "_n").join(later, ["_k", "_s"], "left").select("_k", "_t", F.coalesce("_n", "_later").alias("_n"))
    jump = cut(nxt.where(F.col("_n").isNotNull()))
    fired = cut(e.groupBy("_k").agg(F.min("_t").alias("_t")))
    while jump.limit(1).count():
        fired = cut(fired.unionByName(fired.join(jump, ["_k", "_t"]).select("_k", F.col("_n").alias("_t"))))
        on = jump.select("_k", F.col("_t").alias("_n"), F.col("_n").alias("_m"))
        jump = cut(jump.join(on, ["_k", "_n"]).select("_k", "_t", F.col("_m").alias("_n")))
    ties = e.join(fired, ["_k", "_t"], "left_semi").drop("_s")
    out = events.withColumn("_k", F.struct(*key)).withColumn("_t", at).join(ties, ["_k", "_t"])
    return (out.where(F.struct(tie) == F.col("_f")) if tie else out).select(*events.columns)


# Fixed values.
CONVICTION = 0.7
#: What a page's folder, or a part of its slug, says about the kind of bet; the first that fits counts.
FOLDER_HINTS = (("companies", "hiring"), ("people", "founder-behavior"), ("deals", "market-timing"))
PART_HINTS = (("macro", "macro"), ("geography", "geography"), ("tactics", "tactics"), ("/ai/", "ai"), ("-ai-", "ai"))
# End of the fixed values.


def domain_hint(slug: Column) -> Column:
    """What kind of bet a take of this page is, '' if nothing tells."""
    s = F.lower(slug)
    hint = F.lit("")
    for part, name in reversed(PART_HINTS):
        hint = F.when(s.contains(part), name).otherwise(hint)
    for folder, name in reversed(FOLDER_HINTS):
        hint = F.when(F.concat(F.lit("/"), s).contains(f"/{folder}/"), name).otherwise(hint)
    return hint


def nudge_rule(takes: DataFrame, profiles: DataFrame, least: float = CONVICTION) -> DataFrame:
    """(take_id, matched, reason, tag) for takes (take_id, holder, weight, page_slug, asked) against profiles (holder, tags), `asked` being the holder whose profile a take is held against.

    A take matches where it is of that holder, weighs more than `least` and its page's
    hint is part of one of the profile's tags; the first such tag is given, or the
    first reason why not.
    """
    p = profiles.groupBy(F.col("holder").alias("asked")).agg(F.first("tags").alias("tags"))
    t = takes.join(p, "asked", "left").withColumn("hint", domain_hint(F.col("page_slug")))
    tag = F.when(F.col("hint") != "", F.get(F.filter("tags", lambda x: F.lower(x).contains(F.col("hint"))), 0))
    reason = (
        F.when(F.col("tags").isNull(), "no_profile").when(F.col("holder") != F.col("asked"), "wrong_holder")
        .when(F.col("weight") <= least, "below_conviction_threshold").when(tag.isNull(), "no_matching_bias_tag")
    )
    return t.select("take_id", reason.isNull().alias("matched"), reason.alias("reason"), F.when(reason.isNull(), tag).alias("tag"))
