"""Ranking: fusion of result lists, re-weighting, diversification. All of it works on whole sets of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .greedy import without_similar
from .joins import top_k, trigram_pairs, vector_knn

# Fixed values.
RRF_K = 60
TRUTH_BOOST = 2.0
BACKLINK = 0.05
SALIENCE = 0.15
HUB, CROSS, SESSION_DEMOTE = 1.05, 1.10, 0.95
TEXT_SHARE, IMAGE_SHARE = 0.6, 0.4
ENTITY_MATCH, EVENT_MATCH = 1.25, 1.10
# End of the fixed values.


def best_chunk_per_page(hits: DataFrame) -> DataFrame:
    """The chunk of highest score of each page and query."""
    return top_k(hits.drop("rank"), 1, ("query_id", "page_id"), F.desc("score"), "chunk_id").drop("rank")


def rrf_fuse(lists: list[tuple[DataFrame, float]], key: str = "chunk_id", k: int = RRF_K, first_rank: int = 0, normalise: bool = True) -> DataFrame:
    """(query_id, key, score): reciprocal-rank fusion of lists (query_id, key, score, ...) with weights, over the best score of the query."""
    parts = None
    for df, weight in lists:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)) - 1 + first_rank
        one = df.select("query_id", key, (1.0 / (k / weight + rank)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    out = parts.groupBy("query_id", key).agg(F.sum("part").alias("score"))
    if normalise:
        out = out.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    return out.withColumn("score", F.round("score", 9))


def truth_boost(hits: DataFrame, detail: str | None = None) -> DataFrame:
    factor = F.lit(1.0) if detail == "high" else F.when(F.col("chunk_source") == "compiled_truth", TRUTH_BOOST).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def cosine_rescore(hits: DataFrame, share: float = 0.7) -> DataFrame:
    """Mixes the score over the query's best with the cosine of qv and v; rows without a vector stay."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    value = share * F.col("score") / top + (1 - share) * C.cosine(F.col("qv"), F.col("v"))
    return hits.withColumn("score", F.when(F.col("v").isNull() | F.col("qv").isNull(), F.col("score")).otherwise(value))


def backlink_boost(hits: DataFrame, links: DataFrame, weight: float = BACKLINK) -> DataFrame:
    n = links.groupBy(F.col("to_page_id").alias("page_id")).agg(F.count_distinct("from_page_id").alias("n"))
    return hits.join(n, "page_id", "left").withColumn("score", F.col("score") * (1 + weight * F.log1p(F.coalesce("n", F.lit(0)).cast("double")))).drop("n")


def salience_boost(hits: DataFrame, salience: DataFrame, weight: float = SALIENCE) -> DataFrame:
    """salience has page_id and salience."""
    return hits.join(salience, "page_id", "left").withColumn("score", F.col("score") * (1 + weight * F.log1p(F.coalesce("salience", F.lit(0.0))))).drop("salience")


def recency_boost(hits: DataFrame, now: Column, rules: dict, weight: float = 1.0) -> DataFrame:
    """hits have slug and updated_on."""
    return hits.withColumn("score", F.col("score") * (1 + weight * C.recency(F.col("slug"), F.col("updated_on"), now, rules)))


def floor_gate(hits: DataFrame, boosted: Column, ratio: float) -> DataFrame:
    """The boosted score only for rows of at least ratio of the query's best; a ratio outside 0 to 1 gates nothing."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    gate = F.lit(True) if not 0 < ratio <= 1 else (top <= 0) | (F.col("score") >= ratio * top)
    return hits.withColumn("score", F.when(gate, boosted).otherwise(F.col("score")))


def graph_signals(hits: DataFrame, adjacency: DataFrame, session: Column, first: int = 20) -> DataFrame:
    """Of each query's `first` results by score, hubs among them and those linked from other sources go up, and of a session all but the best go down; adjacency is that of these results. The others stay as they are."""
    ranked = hits.withColumn("_f", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")))
    rest = ranked.where(F.col("_f") > first).drop("_f")
    hits = ranked.where(F.col("_f") <= first).drop("_f")
    h = hits.join(adjacency, ["query_id", "page_id"], "left")
    h = h.withColumn("score", F.col("score") * F.when(F.col("n_in") >= 2, HUB).otherwise(1.0) * F.when(F.col("n_cross") >= 2, CROSS).otherwise(1.0)).withColumn("_s", session)
    nth = F.row_number().over(Window.partitionBy("query_id", "_s").orderBy(F.desc("score"), "page_id"))
    h = h.withColumn("_n", nth)
    h = h.withColumn("score", F.when(F.col("_s").isNotNull() & (F.col("_n") > 1), F.col("score") * SESSION_DEMOTE).otherwise(F.col("score"))).drop("_s", "_n", "n_in", "n_cross")
    return h.select(*rest.columns).unionByName(rest)


def exact_match_boost(hits: DataFrame, query: Column, intent: Column) -> DataFrame:
    """hits (slug, title, score, ...) whose slug, its last part or whose title is the query, or the query with hyphens for blanks, go up by the factor of the query's intent; others than ENTITY and EVENT have none."""
    q = F.lower(F.trim(query))
    kebab = F.regexp_replace(q, r"\s+", "-")
    slug = F.lower("slug")
    same = (slug == q) | (slug == kebab) | slug.endswith(F.concat(F.lit("/"), kebab)) | (F.lower(F.trim("title")) == q)
    factor = F.when(intent == "entity", ENTITY_MATCH).when(intent == "event", EVENT_MATCH).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * F.when((q != "") & F.coalesce(same, F.lit(False)), factor).otherwise(1.0))


def limit_by_type(hits: DataFrame, share: float = 0.6) -> DataFrame:
    """At most ceil(share n) of a query's n results of one type, the best ones."""
    h = hits.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    h = h.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "page_id")))
    return h.where(F.col("_r") <= F.ceil(F.col("_n") * share - 1e-9)).drop("_n", "_r")


def greedy_similar(hits: DataFrame, least: float = 0.85) -> DataFrame:
    """Drops results (query_id, chunk_id, score, text) whose word set is like that of a better kept one, in rounds over all queries at once."""
    return without_similar(hits, [F.desc("score"), F.asc("chunk_id")], least, "query_id", "chunk_id", "text")


def with_truth(kept: DataFrame, before: DataFrame) -> DataFrame:
    """kept results (query_id, page_id, chunk_id, score, chunk_source) with the worst chunk of each page that has no compiled_truth among them replaced by the page's best such chunk of the results before, where there is one."""
    page = Window.partitionBy("query_id", "page_id")
    h = kept.withColumn("_has", F.max((F.col("chunk_source") == "compiled_truth").cast("int")).over(page))
    h = h.withColumn("_last", F.row_number().over(page.orderBy("score", F.desc("chunk_id"))) == 1)
    best = top_k(before.where(F.col("chunk_source") == "compiled_truth"), 1, ("query_id", "page_id"), F.desc("score"), "chunk_id")
    best = best.select("query_id", "page_id", F.struct("chunk_id", "score", "chunk_source").alias("_b"))
    swap = (F.col("_has") == 0) & F.col("_last") & F.col("_b").isNotNull()
    new = {c: F.when(swap, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in ("chunk_id", "score", "chunk_source")}
    return h.join(best, ["query_id", "page_id"], "left").select("query_id", "page_id", *[v.alias(c) for c, v in new.items()])


def process_reorder(hits: DataFrame, first: int = 10, guarded: DataFrame | None = None) -> DataFrame:
    """hits (query_id, page_id, rank, is_process, is_person): the first process page below a person, within the first ranks, moves to the person's place, but not for the guarded queries (query_id), which name an entity."""
    if guarded is not None:
        moved = process_reorder(hits.join(guarded, "query_id", "left_anti"), first)
        return moved.unionByName(hits.join(guarded, "query_id", "left_semi"))
    w = Window.partitionBy("query_id")
    near = F.col("rank") <= first
    person = F.min(F.when(near & F.col("is_person"), F.col("rank"))).over(w)
    h = hits.withColumn("_p", person)
    h = h.withColumn("_d", F.min(F.when(near & F.col("is_process") & (F.col("rank") > F.col("_p")), F.col("rank"))).over(w))
    place = F.when(F.col("rank") == F.col("_d"), F.col("_p")).when((F.col("rank") >= F.col("_p")) & (F.col("rank") < F.col("_d")), F.col("rank") + 1).otherwise(F.col("rank"))
    return h.withColumn("rank", F.when(F.col("_d").isNull(), F.col("rank")).otherwise(place)).drop("_p", "_d")


def token_budget(hits: DataFrame, budget: int) -> DataFrame:
    """hits (query_id, rank, tokens) up to the first that overflows the budget, with the tokens used up to each."""
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).where(F.col("used") <= budget)


def budget_report(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, used, kept, dropped): what token_budget keeps of each query's hits (query_id, rank, tokens), and what it drops."""
    upto = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("_u") <= budget
    g = hits.withColumn("_u", upto).groupBy("query_id").agg(F.coalesce(F.max(F.when(inside, F.col("_u"))), F.lit(0)).cast("long").alias("used"), F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
    return g.select("query_id", "used", "kept", "dropped")


def modality_merge(text_hits: DataFrame, image_hits: DataFrame, image_query: bool = False, key: str = "id") -> DataFrame:
    """(query_id, key, score): hits by the text vectors and by the image vectors, fused by rank with weights TEXT and IMAGE, which change places where the query is an image."""
    first, second = (IMAGE_SHARE, TEXT_SHARE) if image_query else (TEXT_SHARE, IMAGE_SHARE)
    return rrf_fuse([(text_hits, first), (image_hits, second)], key=key, first_rank=1, normalise=False)


def take_search(queries: DataFrame, takes: DataFrame, limit: int = 30, least: float = 0.3, holders: DataFrame | None = None) -> DataFrame:
    """(query_id, take_id, score, rank) for queries (query_id, text, v) over active takes (take_id, claim, holder, weight, v, active).

    One list by trigram similarity of claim and text above `least`, then by weight;
    one by cosine; both of the holders (holder) alone where such are given. The two
    are fused by rank.
    """
    t = takes.where("active")
    allowed = t if holders is None else t.join(holders.select("holder").distinct(), "holder", "left_semi")
    names = queries.select(F.col("text").alias("name"))
    light = (-F.col("weight")).alias("light")
    close = trigram_pairs(names, allowed.select(F.col("take_id").alias("id"), F.col("claim").alias("title"), light), least, limit, ("light",)).where(F.col("sim") > least)
    worded = queries.select("query_id", F.col("text").alias("name")).join(close, "name").select("query_id", F.col("id").alias("take_id"), F.col("sim").alias("score"), "light")
    near = vector_knn(queries.select("query_id", "v"), allowed.select(F.col("take_id").alias("id"), "v"), limit)
    near = near.select("query_id", F.col("id").alias("take_id"), "rank")
    worded = top_k(worded, limit, ("query_id",), F.desc("score"), F.asc_nulls_last("light"), "take_id").select("query_id", "take_id", "rank")
    part = lambda df: df.select("query_id", "take_id", (1.0 / (RRF_K + F.col("rank") - 1)).alias("part"))
    fused = part(worded).unionByName(part(near)).groupBy("query_id", "take_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(fused, limit, ("query_id",), F.desc("score"), "take_id").select("query_id", "take_id", "score", "rank")


def rerank_merge(hits: DataFrame, scores: DataFrame, first: int = 10) -> DataFrame:
    """hits (query_id, page_id, rank) with the first ranks in the order of given scores; unscored ones follow in theirs, the tail stays; delta is how far a row rose."""
    h = hits.join(scores, ["query_id", "page_id"], "left")
    head = F.col("rank") <= first
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.col("rerank").isNull()), F.desc_nulls_last(F.when(head, F.col("rerank"))), "rank")
    return h.withColumn("new_rank", F.row_number().over(order)).withColumn("delta", F.col("rank") - F.col("new_rank")).select("query_id", "page_id", "rank", "new_rank", "delta")


def two_pass_expand(anchors: DataFrame, links: DataFrame, depth: int = 2, fan: int = 50) -> DataFrame:
    """(query_id, page_id, hop, score): pages within `depth` links of the anchors at score / (1 + hop); the first visit of a page wins, at most `fan` links a page."""
    edges = top_k(links.select("from_page_id", "to_page_id").distinct(), fan, ("from_page_id",), "to_page_id").drop("rank")
    level = anchors.select("query_id", "page_id", F.col("score").alias("base"), F.lit(0).alias("hop"))
    seen = level
    for hop in range(1, depth + 1):
        level = level.withColumnRenamed("page_id", "from_page_id").join(edges, "from_page_id").groupBy("query_id", F.col("to_page_id").alias("page_id")).agg(F.max("base").alias("base")).withColumn("hop", F.lit(hop))
        seen = seen.unionByName(level)
    first = top_k(seen, 1, ("query_id", "page_id"), "hop", F.desc("base")).drop("rank")
    return first.select("query_id", "page_id", "hop", F.round(F.col("base") / (1 + F.col("hop")), 6).alias("score"))


def score_distribution(hits: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of each query's scores."""
    s = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s"))
    at = lambda q: F.element_at("s", F.round((F.size("s") - 1) * q).cast("int") + 1)
    return s.select("query_id", *[at(q).alias(n) for n, q in (("low", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("high", 1.0))])


def expert_rank(hits: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """hits (query_id, page_id, score, updated_on, salience): ln(1 + raw) max(.1, exp(-d / 180)) (.5 + .5 s / (1 + s))."""
    fade = F.when(F.col("updated_on").isNull(), 0.1).otherwise(F.greatest(F.lit(0.1), F.exp(-F.datediff(now, "updated_on") / 180.0)))
    weight = F.when(F.col("salience").isNull(), 0.5).otherwise(0.5 + 0.5 * F.col("salience") / (1 + F.col("salience")))
    scored = hits.withColumn("expert", F.round(F.log1p("score") * fade * weight, 6))
    return top_k(scored, k, ("query_id",), F.desc("expert"), "page_id").select("query_id", "page_id", "expert", "rank")


def hybrid(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, pages: DataFrame, links: DataFrame, k: int = 20) -> DataFrame:
    """The whole pipeline: fuse two lists of chunks, boost, keep the best chunk of each page and the k best pages. `factors` carries the stages' shares."""
    fused = rrf_fuse([(lexical, 1.0), (vector, 1.0)])
    h = truth_boost(fused.join(chunks.select("chunk_id", "page_id", "chunk_source"), "chunk_id").withColumn("base", F.col("score")))
    h = h.join(pages.where(~F.col("deleted")).select("page_id", "slug", "source_id", "type"), "page_id").withColumn("truth", F.col("score") / F.col("base"))
    h = h.withColumn("_b", F.col("score"))
    h = backlink_boost(h, links).withColumn("backlinks", F.col("score") / F.col("_b")).drop("_b")
    best = best_chunk_per_page(h)
    out = top_k(limit_by_type(best.withColumn("score", F.round("score", 6)), 0.9), k, ("query_id",), F.desc("score"), "page_id")
    return out.select("query_id", "page_id", "chunk_id", "score", "rank", F.round("base", 6).alias("base"), F.round("truth", 6).alias("truth"), F.round("backlinks", 6).alias("backlinks"))
