"""Takes: how they came out, by whom and when; what is due to be looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OUTCOMES = ("correct", "incorrect", "partial", "unresolvable")
#: A take's outcome counts as resolved in these three; the fourth has a rate of its own.
RESOLVED = OUTCOMES[:3]
# End of the fixed values.


def resolve_takes(takes: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """takes (page_id, row_num, resolved_at, resolved_quality, resolved_outcome, ...) with resolutions (page_id, row_num, resolution_id, at, quality, outcome) taken in, and those that were not: (resolution_id, page_id, row_num, reason).

    A resolution names a quality, an outcome, or both where they agree: correct is
    true, incorrect false, the others have none. What is resolved never changes: of
    several for one take the first that is valid, by time and id, counts. Reasons, the
    first that holds: row_not_found, already_resolved, invalid.
    """
    quality, outcome = F.col("quality"), F.col("outcome")
    stands_for = F.when(quality == "correct", F.lit(True)).when(quality == "incorrect", F.lit(False))
    valid = F.when(quality.isNull(), outcome.isNotNull()).otherwise(quality.isin(*OUTCOMES) & (outcome.isNull() | F.coalesce(stands_for == outcome, F.lit(False))))
    known = takes.select("page_id", "row_num", F.col("resolved_at").isNotNull().alias("_done"), F.lit(True).alias("_there"))
    r = resolutions.withColumn("_valid", F.coalesce(valid, F.lit(False))).join(known, ["page_id", "row_num"], "left")
    able = F.col("_valid") & F.coalesce(~F.col("_done"), F.lit(False))
    r = r.withColumn("_first", F.min(F.when(able, F.struct("at", "resolution_id"))).over(Window.partitionBy("page_id", "row_num"))).withColumn("_me", F.struct("at", "resolution_id"))
    taken = able & (F.col("_me") == F.col("_first"))
    done = F.coalesce(F.col("_done"), F.lit(False)) | F.coalesce(F.col("_me") > F.col("_first"), F.lit(False))
    reason = F.when(F.col("_there").isNull(), "row_not_found").when(done, "already_resolved").otherwise("invalid")
    rejects = r.where(~F.coalesce(taken, F.lit(False))).select("resolution_id", "page_id", "row_num", reason.alias("reason"))
    final = F.coalesce(quality, F.when(outcome, "correct").otherwise("incorrect"))
    accepted = r.where(taken).select("page_id", "row_num", F.col("at").alias("_at"), final.alias("_q"), F.when(final == "correct", F.lit(True)).when(final == "incorrect", F.lit(False)).alias("_o"))
    new = {"resolved_at": "_at", "resolved_quality": "_q", "resolved_outcome": "_o"}
    joined = takes.join(accepted, ["page_id", "row_num"], "left")
    out = joined.select(*[F.when(F.col("_at").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in takes.columns])
    return out, rejects


def scorecards(takes: DataFrame, sets: list[list[str]], allowed: DataFrame | None = None) -> DataFrame:
    """A scorecard for each of several groupings of takes (kind, weight, resolved_quality, and what is grouped by) in one pass: the columns grouped by, null where a row is over all of one, `level`, which of the columns these are, and the figures.

    An empty grouping is the total. `allowed` (holder) bounds whose takes count.
    """
    cols = sorted({c for s in sets for c in s})
    t = takes if allowed is None else takes.join(allowed.select("holder").distinct(), "holder", "left_semi")
    q = F.col("resolved_quality")
    right = F.when(q == "correct", 1.0).when(q == "incorrect", 0.0)
    n = lambda *v: F.count_if(q.isin(*v))
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    out = t.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id(*cols).cast("int").alias("level"), F.count_if(F.col("kind") == "bet").alias("bets"), n(*RESOLVED).alias("resolved"),
        *[n(o).alias(o) for o in OUTCOMES], F.round(F.avg((F.col("weight") - right) ** 2), 6).alias("brier"), F.round(F.avg(right), 6).alias("accuracy"),
    )
    return out.withColumn("partial_rate", rate(F.col("partial"), F.col("resolved"))).withColumn("unresolvable_rate", rate(F.col("unresolvable"), F.col("resolved") + F.col("unresolvable")))


def drift_candidates(takes: DataFrame, evidence: DataFrame, since: Column, low: float = 0.3, high: float = 0.85) -> DataFrame:
    """(take_id, weight, evidence) of active takes (take_id, page_id, weight, active, resolved_quality) without an outcome and of a weight between, with how many entries (page_id, at) their page has had since a day. Those of most evidence, then weight, are the first to look at."""
    n = evidence.where(F.col("at") >= since).groupBy("page_id").agg(F.count("*").alias("n"))
    t = takes.where(F.col("active") & F.col("weight").between(low, high) & F.col("resolved_quality").isNull()).join(n, "page_id", "left")
    return t.select("take_id", "weight", F.coalesce("n", F.lit(0)).alias("evidence"))


def abandoned_claims(takes: DataFrame, now: Column, least: float = 0.7, months: int = 12) -> DataFrame:
    """(holder, n): active takes (holder, weight, active, resolved_quality, superseded_by, since) of at least that weight that have had no outcome and no successor for so many months."""
    old = F.col("since") < F.add_months(now, -months)
    return takes.where(F.col("active") & F.col("resolved_quality").isNull() & F.col("superseded_by").isNull() & (F.col("weight") >= least) & old).groupBy("holder").agg(F.count("*").alias("n"))


def search_stats(calls: DataFrame, by: tuple[str, ...] = ("mode", "intent", "client", "source")) -> DataFrame:
    """Telemetry of calls (by, results, tokens, cache_hits, cache_misses): for every axis and each of its values, and in all, calls, sums, means and the share of hits; `axis` names the column, 'all' for the total."""
    sets = [[F.col(c)] for c in by] + [[]]
    ids = {2 ** len(by) - 1: "all"} | {2 ** len(by) - 1 - (1 << (len(by) - 1 - k)): c for k, c in enumerate(by)}
    g = calls.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.grouping_id(*by).alias("_g"), F.count("*").alias("calls"), F.sum("results").alias("results"), F.sum("tokens").alias("tokens"), F.sum("cache_hits").alias("cache_hits"), F.sum("cache_misses").alias("cache_misses")
    )
    axis = F.create_map(*[F.lit(x) for k, v in ids.items() for x in (k, v)])[F.col("_g").cast("int")]
    value = F.coalesce(*[F.col(c).cast("string") for c in by])
    hits = F.col("cache_hits") / F.nullif(F.col("cache_hits") + F.col("cache_misses"), F.lit(0))
    return g.select(axis.alias("axis"), value.alias("value"), "calls", "results", "tokens", F.round(F.col("results") / F.col("calls"), 6).alias("mean_results"), F.round(F.col("tokens") / F.col("calls"), 6).alias("mean_tokens"), F.round(hits, 6).alias("hit_rate"))
