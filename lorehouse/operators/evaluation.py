"""Retrieval quality over whole sets of queries: results (query_id, doc_id, rank) against qrels (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg) at k; all 0 where nothing is relevant."""
    rel = qrels.where(F.col("grade") > 0).select("query_id", "doc_id", "grade").distinct()
    hits = results.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"])
    gain = lambda r: F.col("grade") / F.log2(r + F.lit(1.0))
    got = hits.groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(gain(F.col("rank"))).alias("dcg"))
    nth = rel.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = nth.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, gain(F.col("r")))).alias("best"))
    out = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", zero(F.col("h") / float(k)).alias("precision"), zero(F.col("h") / F.col("n")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("best")).alias("ndcg"))


def summary(per_query: DataFrame, *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def rollup(per_query: DataFrame, *by: str) -> DataFrame:
    """The same by all of `by`, by their beginnings, and in all; `in_all` marks the total."""
    g = per_query.rollup(*by).agg((F.grouping_id() == 2 ** len(by) - 1).alias("in_all"), F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])
    return g


def replay_diff(captured: DataFrame, current: DataFrame) -> DataFrame:
    """(query_id, jaccard, top1) of two runs (query_id, ids ARRAY)."""
    j = captured.select("query_id", F.col("ids").alias("a")).join(current.select("query_id", F.col("ids").alias("b")), "query_id")
    union = F.size(F.array_union("a", "b"))
    return j.select("query_id", F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union), 6).alias("jaccard"), F.col("a")[0].eqNullSafe(F.col("b")[0]).alias("top1"))


def replay_rows(captured: DataFrame, current: DataFrame) -> DataFrame:
    """(query_id, jaccard, top1, latency_delta, n_captured, n_current, errored) of captured runs (query_id, ids, latency_ms) replayed as (query_id, ids, latency_ms, error); a query that was not replayed has errored."""
    a = captured.select("query_id", F.coalesce("ids", F.array().cast(captured.schema["ids"].dataType)).alias("a"), F.col("latency_ms").alias("la"))
    b = current.select("query_id", F.coalesce("ids", F.array().cast(current.schema["ids"].dataType)).alias("b"), F.col("latency_ms").alias("lb"), F.col("error").isNull().alias("ok"))
    j = a.join(b, "query_id", "left").withColumn("errored", ~F.coalesce("ok", F.lit(False)))
    fine = lambda c: F.when(~F.col("errored"), c)
    union = F.size(F.array_union("a", "b"))
    jaccard = F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union), 6)
    return j.select("query_id", fine(jaccard).alias("jaccard"), fine(F.get("a", 0).eqNullSafe(F.get("b", 0))).alias("top1"), fine(F.col("lb") - F.col("la")).alias("latency_delta"), F.size("a").alias("n_captured"), fine(F.size("b")).alias("n_current"), "errored", fine(F.col("lb") > 2 * F.col("la")).alias("over_2x"))


def replay_summary(rows: DataFrame) -> DataFrame:
    """One row over replay_rows: how many were replayed and how many erred, and over the replayed ones the mean Jaccard, the share of equal first results, the mean latency delta and how many took more than twice as long."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(~F.col("errored")).alias("replayed"), F.count_if("errored").alias("errored"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"),
        F.round(F.avg(F.col("top1").cast("double")), 6).alias("top1_rate"), F.round(F.avg("latency_delta"), 6).alias("mean_latency_delta"), F.count_if("over_2x").alias("over_2x"),
    )


def topk_hit(results: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, hit): whether any of expected (query_id, ids) is among the first k."""
    r = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias("r"))
    return expected.join(r, "query_id", "left").select("query_id", F.coalesce(F.arrays_overlap("ids", "r"), F.lit(False)).alias("hit"))


def compare_modes(scores: DataFrame, modes: list[str]) -> DataFrame:
    """scores (suite, mode, value) as one column a mode."""
    return scores.groupBy("suite").pivot("mode", modes).agg(F.round(F.avg("value"), 6))
