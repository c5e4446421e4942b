"""Reviews and reports: code look-ups, review queues, pair findings, trends, failure logs, context bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .joins import top_k
from .text import redact

# Fixed values.
SYMBOL_ORDER = ("function", "class", "interface", "type", "enum", "method", "variable")
ERROR_CLASSES = (("timeout", r"(?i)time[d]? ?out"), ("auth", r"(?i)\b(401|403|unauthori[sz]ed|forbidden)\b"), ("rate_limit", r"(?i)\b429\b|rate limit"), ("parse", r"(?i)parse|syntax|malformed"), ("missing", r"(?i)\b404\b|not found"))
CONFIDENT = 0.8
# End of the fixed values.


def symbol_defs(chunks: DataFrame, names: list[str], language: str | None = None) -> DataFrame:
    """Definitions (symbol_name, symbol_type, language, chunk_id) of the names, the weightier kinds first."""
    c = chunks.where(F.col("symbol_name").isin(names) & F.col("symbol_type").isin(*SYMBOL_ORDER))
    c = c if language is None else c.where(F.col("language") == language)
    return c.select("symbol_name", "symbol_type", "chunk_id", F.array_position(F.array(*map(F.lit, SYMBOL_ORDER)), F.col("symbol_type")).alias("priority"))


def substring_refs(chunks: DataFrame, terms: list[str], column: str = "chunk_text") -> DataFrame:
    """(chunk_id, term) where a text holds a term, whatever the case. Terms are a short stated list and become one expression."""
    t = F.lower(column)
    hits = F.filter(F.array(*[F.when(F.contains(t, F.lit(x.lower())), F.lit(x)) for x in terms]), lambda x: x.isNotNull())
    return chunks.select("chunk_id", F.explode(hits).alias("term"))


def review_queue(candidates: DataFrame, sources: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of candidates (candidate_id, source_id, created, confidence, rationale), newest first, with source name, total, and a flag for confidence without a reason."""
    total = candidates.agg(F.count("*").alias("total"))
    flag = (F.col("confidence") >= CONFIDENT) & (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    page = candidates.orderBy(F.desc("created"), F.desc("candidate_id")).offset(offset).limit(limit)
    return page.join(sources, "source_id", "left").crossJoin(total).select("candidate_id", "source_name", "total", flag.alias("unexplained"))  # one row


def tier_pairs(pairs: DataFrame, a: Column, b: Column, factors: dict[str, float]) -> DataFrame:
    """(tiers, n) of pairs of slugs, curated before other before bulk."""
    ta, tb = C.source_tier(a, factors), C.source_tier(b, factors)
    rank = lambda t: F.when(t == "curated", 0).when(t == "other", 1).otherwise(2)
    first, second = F.when(rank(ta) <= rank(tb), ta).otherwise(tb), F.when(rank(ta) <= rank(tb), tb).otherwise(ta)
    return pairs.groupBy(F.concat(first, F.lit("x"), second).alias("tiers")).agg(F.count("*").alias("n"))


def hot_pages(findings: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, n, severity) of findings (a, b, severity): in how many a page appears, and the worst."""
    rows = findings.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("page_id"), "severity")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.max("severity").alias("severity")).orderBy(F.desc("n"), F.desc("severity"), "page_id").limit(k)


def share_with_interval(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """(by, n, k, low, high): a share and its 95 % interval."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    w = C.wilson(F.col("k"), F.col("n"))
    return g.select(by, "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def trend(runs: DataFrame, now: Column, days: int) -> DataFrame:
    """(day, runs, mean) of runs (at, value) in the window."""
    return runs.where((F.col("at") > F.date_sub(now, days)) & (F.col("at") <= now)).groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"))


def ab_report(votes: DataFrame, least: int = 20, floor: float = 0.45) -> DataFrame:
    """(arm, wins, losses, ties, win_rate, net_negative) of votes (arm, outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    g = votes.groupBy("arm").agg(n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"))
    decisive = F.col("wins") + F.col("losses")
    g = g.withColumn("win_rate", F.round(F.col("wins") / F.nullif(decisive, F.lit(0)), 6))
    return g.withColumn("net_negative", (decisive >= least) & (F.col("wins") / F.nullif(decisive, F.lit(0)) < floor))


def failure_breakdown(log: DataFrame, message: str = "message") -> DataFrame:
    """(class, n) by the first pattern that a message matches."""
    kind = F.lit("other")
    for name, p in reversed(ERROR_CLASSES):
        kind = F.when(F.col(message).rlike(p), name).otherwise(kind)
    return log.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def extraction_failures(log: DataFrame, since: Column) -> DataFrame:
    """(source_id, reason, n): reasons are what stands before the first colon."""
    reason = F.trim(F.split_part("summary", F.lit(":"), F.lit(1)))
    return log.where(F.col("at") >= since).groupBy("source_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def retrieval_log(hits: DataFrame, queries: DataFrame, now: Column, keep_days: int = 90) -> DataFrame:
    """(query_id, query, page_ids, created) with the query redacted; entries older than the window are left out."""
    ids = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x.page_id).alias("page_ids"))
    return queries.where(F.datediff(now, "created") <= keep_days).join(ids, "query_id").select("query_id", redact(F.col("text")).alias("query"), "page_ids", "created")


def diversified(hits: DataFrame, per_page: int = 3, share: float = 0.6, final: int = 2) -> DataFrame:
    """hits (query_id, page_id, chunk_id, score, type): the best chunks of each page, then a share for each type, then fewer of a page."""
    a = top_k(hits, per_page, ("query_id", "page_id"), F.desc("score"), "chunk_id").withColumnRenamed("rank", "_p")
    a = a.withColumn("_n", F.count("*").over(_by("query_id")))
    b = top_k(a, 1 << 30, ("query_id", "type"), F.desc("score"), "chunk_id").where(F.col("rank") <= F.ceil(F.col("_n") * share - 1e-9))
    return b.where(F.col("_p") <= final).select("query_id", "page_id", "chunk_id", "score", "type")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def context_bundle(pages: DataFrame, takes: DataFrame, neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """(question_id, stream, item, rank): what was gathered for each question, tagged by where it came from."""
    part = lambda df, name, item: df.select("question_id", F.lit(name).alias("stream"), F.col(item).cast("string").alias("item"), F.col("rank").cast("long").alias("rank"))
    return part(pages, "pages", "page_id").unionByName(part(takes, "takes", "take_id")).unionByName(part(neighbours, "graph", "page_id")).unionByName(part(points, "trajectory", "fact_id"))
