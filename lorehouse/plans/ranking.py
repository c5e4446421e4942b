"""Queries: ranking, sequences, graphs, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation as E
from ..operators import fusion as R
from ..operators import graph as G
from ..operators import joins as J
from ..operators import sequences as W
from .corpus import DECAY
from .joined import _RESULTS, LEXICAL, VECTOR, lexical, results, vector
from .registry import query
from .views import NOW, Views

_LEX = "questions postings"
_VEC_CHUNKS = VECTOR + """, vec as (select query_id, chunk_id, page_id, sim as score from knn join chunks on vec_id = id)"""


def vector_chunks(v: Views):
    return vector(v).join(v.chunk_keys().select(F.col("vec_id").alias("id"), "chunk_id", "page_id"), "id").select("query_id", "chunk_id", "page_id", F.col("sim").alias("score"))


@query(_LEX, f"with {LEXICAL} select query_id, page_id, chunk_id, score from (select *, row_number() over (partition by query_id, page_id order by score desc, chunk_id) as n from lex) where n = 1")
def best_chunk_per_page(v: Views):
    return R.best_chunk_per_page(lexical(v)).select("query_id", "page_id", "chunk_id", "score")


_FUSED = LEXICAL + ", " + _VEC_CHUNKS.replace("sim as score", "round(sim, 6) as score") + """,
f0 as (select query_id, chunk_id, 1.0 / (60 + rank - 1) as part from lex union all select query_id, chunk_id, 1.0 / (60 + row_number() over (partition by query_id order by score desc, chunk_id) - 1) from vec),
f1 as (select query_id, chunk_id, sum(part) as score from f0 group by all), fused as (select query_id, chunk_id, round(score / max(score) over (partition by query_id), 9) as score from f1)"""


@query("questions postings vectors", f"with {_FUSED} select * from fused")
def rrf_fuse(v: Views):
    return R.rrf_fuse([(lexical(v), 1.0), (vector_chunks(v), 1.0)])


@query("questions postings vectors pages links", f"""with {_FUSED}, b as (select to_page_id as page_id, count(distinct from_page_id) as n from links group by 1),
h as (select query_id, chunk_id, page_id, slug, type, score as base, case when chunk_source = 'compiled_truth' then 2.0 else 1.0 end as truth, 1 + 0.05 * ln(1 + coalesce(n, 0)) as backlinks
 from fused join chunks using (chunk_id) join pages using (page_id) left join b using (page_id) where not deleted),
c as (select *, round(base * truth * backlinks, 6) as score, row_number() over (partition by query_id, page_id order by base * truth * backlinks desc, chunk_id) as n from h),
d as (select *, count(*) over (partition by query_id) as total, row_number() over (partition by query_id, type order by score desc, page_id) as r from c where n = 1),
e as (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from d where r <= ceil(total * 0.9 - 1e-9))
select query_id, page_id, chunk_id, score, rank, round(base, 6) as base, round(truth, 6) as truth, round(backlinks, 6) as backlinks from e where rank <= 20""")
def hybrid_retrieval(v: Views):
    return R.hybrid(lexical(v), vector_chunks(v), v.chunk_keys(), v.pages(), v.links())


@query("questions postings vectors", f"""with {LEXICAL}, h as (select lex.query_id, lex.chunk_id, score, q.v as qv, c.v as v from lex join questions qq using (query_id) left join vectors q on q.vec_id = qq.vec_id join chunks ch using (chunk_id) left join vectors c on c.vec_id = ch.vec_id and ch.vec_id % 4 <> 0)
select query_id, chunk_id, round(case when v is null or qv is null then score else 0.7 * score / max(score) over (partition by query_id) + 0.3 * list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) end, 6) as score from h""")
def cosine_rescore(v: Views):
    q = v.questions().join(v.vectors(), "vec_id").select("query_id", F.col("v").alias("qv"))
    c = v.chunks().where(F.col("vec_id") % 4 != 0).join(v.vectors(), "vec_id").select("chunk_id", "v")
    h = R.cosine_rescore(lexical(v).join(q, "query_id", "left").join(c, "chunk_id", "left"))
    return h.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("questions postings pages links", f"""with {_RESULTS}, b as (select to_page_id as page_id, count(distinct from_page_id) as n from links group by 1), s as (select page_id, cast(page_id % 17 as double) / 4 as salience from pages),
g as (select query_id, page_id, r.score * (1 + 0.05 * ln(1 + coalesce(n, 0))) * (1 + 0.15 * ln(1 + salience)) * (1 + case when slug like 'en/src1/%' then 0.0 when slug like 'en/%' then 1.5 * 14 / (14 + datediff('day', updated_on, date '{NOW}'))
  when slug like 'de/%' then 1.0 * 60 / (60 + datediff('day', updated_on, date '{NOW}')) when slug like 'fr/%' then 0.3 * 365 / (365 + datediff('day', updated_on, date '{NOW}')) else 0.5 * 90 / (90 + datediff('day', updated_on, date '{NOW}')) end) as boosted, r.score
 from results r join pages using (page_id) left join b using (page_id) join s using (page_id))
select query_id, page_id, round(case when score >= 0.5 * max(score) over (partition by query_id) then boosted else score end, 6) as score from g""")
def gated_boosts(v: Views):
    p = v.pages().select("page_id", "slug", "updated_on")
    h = results(v).join(p, "page_id").withColumn("plain", F.col("score"))
    s = v.pages().select("page_id", ((F.col("page_id") % 17).cast("double") / 4).alias("salience"))
    h = R.recency_boost(R.salience_boost(R.backlink_boost(h, v.links()), s), F.lit(NOW).cast("date"), DECAY)
    h = h.withColumnRenamed("score", "boosted").withColumnRenamed("plain", "score")
    return R.floor_gate(h, F.col("boosted"), 0.5).select("query_id", "page_id", F.round("score", 6).alias("score"))


@query("questions postings pages links", f"""with {_RESULTS}, n as (select b.query_id, b.page_id, count(distinct a.page_id) as n_in, count(distinct case when a.source_id <> b.source_id then a.page_id end) as n_cross
 from results a join links on from_page_id = a.page_id join results b on b.page_id = to_page_id and b.query_id = a.query_id group by all),
g as (select query_id, page_id, page_id % 2 as folder, page_id % 9 as day, score * case when n_in >= 2 then 1.05 else 1.0 end * case when n_cross >= 2 then 1.10 else 1.0 end as score from results left join n using (query_id, page_id)),
h as (select *, row_number() over (partition by query_id, folder, day order by score desc, page_id) as k from g)
select query_id, page_id, round(case when k > 1 then score * 0.95 else score end, 6) as score from h
union all select query_id, page_id, round(score, 6) from (select query_id, page_id, score, row_number() over (partition by query_id order by score desc, page_id) as r from res) where r > 20 and r <= 40""")
def graph_signals(v: Views):
    r = results(v, 40)  # twenty of which count
    first = J.top_k(r.drop("rank"), 20, ("query_id",), F.desc("score"), "page_id")
    slug = F.concat(F.when(F.col("page_id") % 2 == 0, "team/chat/").otherwise("daily/"), F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 9 + 1).cast("string"), 2, "0")), F.lit("/"), F.col("page_id").cast("string"))
    return R.graph_signals(r, J.adjacency_in_results(first, v.links()), C.session_prefix(slug)).select("query_id", "page_id", F.round("score", 6).alias("score"))


@query("questions postings pages", f"""with {_RESULTS} select query_id, page_id, round(score * case when (query_id + page_id) % 3 = 0 then case query_id % 3 when 0 then 1.25 when 1 then 1.10 else 1.0 end else 1.0 end, 6) as score from results join questions using (query_id)""")
def exact_match_boost(v: Views):
    """Pages whose title is a question, or whose slug ends in it with hyphens, by the question's intent: a third of them is made so, with the whole text of the question."""
    k, q = F.col("query_id") + F.col("page_id"), F.col("text")
    intent = F.when(F.col("query_id") % 3 == 0, "entity").when(F.col("query_id") % 3 == 1, "event").otherwise("general")
    same = F.when(k % 6 == 0, F.concat(F.lit(" "), q))
    slug = F.when(k % 6 == 3, F.concat(F.lit("notes/"), F.regexp_replace(F.lower(F.trim(q)), r"\s+", "-"))).otherwise(F.concat(F.lit("other/"), F.col("page_id").cast("string")))
    h = results(v).join(v.questions().select("query_id", "text"), "query_id").withColumn("title", F.coalesce(same, F.lit("another title"))).withColumn("slug", slug)
    return R.exact_match_boost(h, q, intent).select("query_id", "page_id", F.round("score", 6).alias("score"))


@query("questions postings pages", f"""with {_RESULTS}, t as (select query_id, page_id, coalesce(type, 'none') as type, score, count(*) over (partition by query_id) as n from results join pages using (page_id)),
u as (select *, row_number() over (partition by query_id, type order by score desc, page_id) as k from t) select query_id, page_id, type from u where k <= ceil(n * 0.3 - 1e-9)""")
def limit_by_type(v: Views):
    h = results(v).join(v.pages().select("page_id", F.coalesce("type", F.lit("none")).alias("type")), "page_id")
    return R.limit_by_type(h, 0.3).select("query_id", "page_id", "type")


@query("questions postings", rf"""with recursive {LEXICAL}, t as materialized (select query_id, chunk_id, score, rank, list_distinct(list_filter(regexp_split_to_array(lower(chunk_text), '\s+'), lambda x: x <> '')) as w from lex join chunks using (chunk_id)),
walk as (select query_id, rank, [w] as kept, true as stays from t where rank = 1 union all
 select query_id, rank, case when fresh then list_append(kept, w) else kept end, fresh from (select t.query_id, t.rank, kept, w, not coalesce(list_bool_or(list_transform(kept, lambda k: len(list_intersect(k, w)) > 0.85 * (len(k) + len(w) - len(list_intersect(k, w))))), false) as fresh
  from walk join t on t.query_id = walk.query_id and t.rank = walk.rank + 1))
select query_id, chunk_id, score from walk join t using (query_id, rank) where stays""")
def dedup_similar_results(v: Views):
    h = lexical(v).join(v.chunks().select("chunk_id", F.col("chunk_text").alias("text")), "chunk_id").select("query_id", "chunk_id", "score", "text")
    return R.greedy_similar(h).select("query_id", "chunk_id", "score")


@query("questions postings", f"""with {LEXICAL}, k as (select query_id, page_id, chunk_id, score, chunk_source from lex join chunks using (chunk_id, page_id) where chunk_index % 4 <> 0 qualify row_number() over (partition by query_id, page_id order by score desc, chunk_id) <= 2),
b as (select query_id, page_id, chunk_id as c, score as s from lex join chunks using (chunk_id, page_id) where chunk_source = 'compiled_truth' qualify row_number() over (partition by query_id, page_id order by score desc, chunk_id) = 1),
h as (select *, bool_or(chunk_source = 'compiled_truth') over (partition by query_id, page_id) as has, row_number() over (partition by query_id, page_id order by score, chunk_id desc) = 1 as last from k)
select query_id, page_id, case when last and not has and c is not null then c else chunk_id end as chunk_id, case when last and not has and c is not null then s else score end as score, case when last and not has and c is not null then 'compiled_truth' else chunk_source end as chunk_source from h left join b using (query_id, page_id)""")
def truth_swap(v: Views):
    """Two chunks a page, of which the first lines of texts were lost; where that was a page's compiled truth it comes back."""
    h = lexical(v).drop("rank").join(v.chunks().select("chunk_id", "chunk_index", "chunk_source"), "chunk_id")
    kept = J.top_k(h.where(F.col("chunk_index") % 4 != 0), 2, ("query_id", "page_id"), F.desc("score"), "chunk_id")
    return R.with_truth(kept.select("query_id", "page_id", "chunk_id", "score", "chunk_source"), h)


@query("questions postings pages", f"""with {_RESULTS}, k as (select query_id, page_id, r as rank, page_id % 3 = 1 as is_process, page_id % 4 = 2 as is_person from results),
p as (select *, min(case when rank <= 10 and is_person then rank end) over (partition by query_id) as p from k), d as (select *, min(case when rank <= 10 and is_process and rank > p then rank end) over (partition by query_id) as d from p)
select query_id, page_id, case when d is null then rank when rank = d then p when rank >= p and rank < d then rank + 1 else rank end as rank from d""")
def process_reorder(v: Views):
    h = results(v).select("query_id", "page_id", "rank", (F.col("page_id") % 3 == 1).alias("is_process"), (F.col("page_id") % 4 == 2).alias("is_person"))
    return R.process_reorder(h).select("query_id", "page_id", "rank")


@query("questions postings", f"""with {LEXICAL}, t as (select query_id, chunk_id, rank, sum(cast(ceil(length(chunk_text) / 4.0) as bigint)) over (partition by query_id order by rank) as used from lex join chunks using (chunk_id)) select query_id, chunk_id, cast(used as bigint) as used from t where used <= 2000""")
def token_budget(v: Views):
    h = lexical(v).join(v.chunks().select("chunk_id", C.estimated_tokens(F.col("chunk_text")).alias("tokens")), "chunk_id")
    return R.token_budget(h, 2000).select("query_id", "chunk_id", "used")


@query("questions postings pages", f"""with {_RESULTS}, s as (select query_id, page_id, cast(page_id * 31 % 101 as double) as rerank from results where page_id % 3 <> 0),
n as (select query_id, page_id, r as rank, row_number() over (partition by query_id order by case when r <= 10 then 0 else 1 end, case when r <= 10 then rerank is null end nulls first, case when r <= 10 then rerank end desc nulls last, r) as new_rank from results left join s using (query_id, page_id))
select *, rank - new_rank as delta from n""")
def rerank_merge(v: Views):
    r = results(v)
    s = r.where(F.col("page_id") % 3 != 0).select("query_id", "page_id", (F.col("page_id") * 31 % 101).cast("double").alias("rerank"))
    return R.rerank_merge(r.select("query_id", "page_id", "rank"), s)


@query("questions postings pages links", f"""with {_RESULTS}, e as (select from_page_id as f, to_page_id as t from (select distinct from_page_id, to_page_id from links) qualify row_number() over (partition by from_page_id order by to_page_id) <= 50),
a as (select query_id, page_id, score as base, 0 as hop from results where r <= 5), b as (select query_id, t as page_id, max(base) as base, 1 as hop from a join e on f = page_id group by query_id, t),
c as (select query_id, t as page_id, max(base) as base, 2 as hop from b join e on f = page_id group by query_id, t), u as (select * from a union all select * from b union all select * from c)
select query_id, page_id, hop, round(base / (1 + hop), 6) as score from u qualify row_number() over (partition by query_id, page_id order by hop, base desc) = 1""")
def two_pass_expand(v: Views):
    return R.two_pass_expand(results(v, 5), v.links())


@query(_LEX, f"""with {LEXICAL}, s as (select query_id, list_sort(list(score)) as s from lex group by 1) select query_id, s[1] as low, s[cast(round((len(s) - 1) * 0.25) as int) + 1] as p25, s[cast(round((len(s) - 1) * 0.5) as int) + 1] as p50,
 s[cast(round((len(s) - 1) * 0.75) as int) + 1] as p75, s[cast(round((len(s) - 1) * 0.95) as int) + 1] as p95, s[len(s)] as high from s""")
def score_distribution(v: Views):
    return R.score_distribution(lexical(v))


@query("questions postings pages", f"""with {_RESULTS}, x as (select query_id, page_id, round(ln(1 + score) * greatest(0.1, exp(-datediff('day', updated_on, date '{NOW}') / 180.0)) * case when page_id % 5 = 0 then 0.5 else 0.5 + 0.5 * (page_id % 5) / (1 + page_id % 5) end, 6) as expert
 from results join pages using (page_id)) select *, row_number() over (partition by query_id order by expert desc, page_id) as rank from x qualify rank <= 5""")
def expert_rank(v: Views):
    s = F.when(F.col("page_id") % 5 != 0, (F.col("page_id") % 5).cast("double"))
    h = results(v).join(v.pages().select("page_id", "updated_on", s.alias("salience")), "page_id")
    return R.expert_rank(h, F.lit(NOW).cast("date"))


_ARM = "round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9)"


@query("questions vectors", f"""with x as (select vec_id as id, case when vec_id % 3 <> 0 then v end as t, case when vec_id % 3 <> 1 then list_reverse(v) end as i from vectors), q as (select query_id, v from questions join vectors using (vec_id)),
tl as (select query_id, id, round({_ARM.replace('(a, b)', '(v, t)').replace('(a, a)', '(v, v)').replace('(b, b)', '(t, t)')}, 9) as sim from q, x where t is not null), il as (select query_id, id, round({_ARM.replace('(a, b)', '(v, i)').replace('(a, a)', '(v, v)').replace('(b, b)', '(i, i)')}, 9) as sim from q, x where i is not null),
tr as (select query_id, id, row_number() over (partition by query_id order by sim desc, id) as r from tl qualify r <= 30), ir as (select query_id, id, row_number() over (partition by query_id order by sim desc, id) as r from il qualify r <= 30),
p as (select 'text' as asked, query_id, id, 1.0 / (60 / 0.6 + r) as part from tr union all select 'text', query_id, id, 1.0 / (60 / 0.4 + r) from ir union all select 'image', query_id, id, 1.0 / (60 / 0.4 + r) from tr union all select 'image', query_id, id, 1.0 / (60 / 0.6 + r) from ir)
select asked, query_id, id, round(sum(part), 9) as score from p group by all""")
def modality_merge(v: Views):
    """Two vector columns: a third of the rows has no text vector, another third no image vector, which is the other one read backwards. Questions asked as texts and as images."""
    q = v.questions().join(v.vectors(), "vec_id").select("query_id", "v")
    x = v.vectors().select(F.col("vec_id").alias("id"), "v")
    texts = J.vector_knn(q, x.where(F.col("id") % 3 != 0), 30).withColumnRenamed("sim", "score")
    images = J.vector_knn(q, x.where(F.col("id") % 3 != 1).withColumn("v", F.reverse("v")), 30).withColumnRenamed("sim", "score")
    both = [R.modality_merge(texts, images, asked == "image").withColumn("asked", F.lit(asked)) for asked in ("text", "image")]
    return both[0].unionByName(both[1]).select("asked", "query_id", "id", "score")


@query("questions postings", f"""with {LEXICAL}, t as (select query_id, rank, sum(cast(ceil(length(chunk_text) / 4.0) as bigint)) over (partition by query_id order by rank) as upto from lex join chunks using (chunk_id))
select query_id, cast(coalesce(max(upto) filter (where upto <= 2000), 0) as bigint) as used, count(*) filter (where upto <= 2000) as kept, count(*) filter (where upto > 2000) as dropped from t group by 1""")
def budget_report(v: Views):
    h = lexical(v).join(v.chunks().select("chunk_id", C.estimated_tokens(F.col("chunk_text")).alias("tokens")), "chunk_id")
    return R.budget_report(h, 2000)


# --- sequences -------------------------------------------------------------------

_POINTS = "points as (select entity_slug, claim_metric, row_number() over (partition by entity_slug, claim_metric order by valid_from, fact_id) as n, valid_from, claim_value, fact_id from facts where not expired)"


@query("facts", f"with {_POINTS} select * from points")
def trajectory(v: Views):
    return W.trajectory(v.facts())


@query("facts", f"""with {_POINTS}, p as (select *, lag(claim_value) over (partition by entity_slug, claim_metric order by n) as before from points)
select entity_slug, claim_metric, n, before, claim_value, round((claim_value - before) / abs(before), 6) as change from p where before <> 0 and (claim_value - before) / abs(before) <= -0.1""")
def regressions(v: Views):
    return W.regressions(W.trajectory(v.facts()))


@query("facts vectors", """with s as (select entity_slug, v, lag(v) over (partition by entity_slug order by valid_from, fact_id) as u from facts join vectors using (vec_id)),
a as (select entity_slug, count(*) as n, avg(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)))) as m from s group by 1) select entity_slug, case when n >= 3 then round(least(1, greatest(0, 1 - m)), 6) end as drift from a""")
def drift_score(v: Views):
    return W.drift_score(v.facts().join(v.vectors(), "vec_id"))


@query("facts", f"""with {_POINTS}, c as (select *, (claim_value - lag(claim_value) over w) / nullif(abs(lag(claim_value) over w), 0) as ch from points window w as (partition by entity_slug, claim_metric order by n)),
s as (select entity_slug, claim_metric, count(*) as points, count(*) filter (where abs(ch) >= 0.05) as moves, arg_max_null(ch, n) as last from c group by all)
select entity_slug, claim_metric, points, round(1 - moves / points, 6) as consistency, round(last, 6) as last_change, case when last is null then null when abs(last) < 0.01 then 'flat' when last > 0 then 'up' else 'down' end as direction from s""")
def founder_scorecard(v: Views):
    return W.founder_scorecard(W.trajectory(v.facts()))


@query("facts vectors", f"""with f as (select *, 's' || fact_id % 3 as source, vec_id % 2 as half from facts join vectors using (vec_id) where not expired and valid_from <= timestamp '{NOW}' - interval 24 hours), g as (select * from f where (half, entity_slug) in (select half, entity_slug from f group by all having count(*) >= 3)),
p as (select a.fact_id, b.fact_id as near, b.valid_from as near_from from g a join g b on a.entity_slug = b.entity_slug and a.half = b.half where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.85 - 1e-12),
l as (select fact_id, arg_max(near, (near_from, near)) as leader_id from p group by 1) -- near facts of these tables are near to each other, so that the newest of them leads
select leader_id, count(*) as n, round(avg(confidence), 6) as weight, min(valid_from) as since, arg_max(claim_value, (confidence, fact_id)) as claim_value, string_agg(distinct source, ',' order by source) as sources from l join g using (fact_id) group by 1 having count(*) >= 2""")
def consolidate_facts(v: Views):
    f = v.facts().join(v.vectors(), "vec_id").withColumn("source", F.concat(F.lit("s"), (F.col("fact_id") % 3).cast("string"))).withColumn("half", F.col("vec_id") % 2)
    return W.consolidate(f, F.lit(NOW).cast("timestamp_ntz"), by=("half", "entity_slug"))


_POINTERS = "ptr as (select fact_id as id, case when fact_id % 3 <> 0 then lead(fact_id) over (partition by entity_slug, claim_metric order by valid_from, fact_id) end as next from facts)"


def _pointers(v: Views):
    """Two of three facts are replaced by the next of their entity and metric."""
    w = Window.partitionBy("entity_slug", "claim_metric").orderBy("valid_from", "fact_id")
    return v.facts().select(F.col("fact_id").alias("id"), F.when(F.col("fact_id") % 3 != 0, F.lead("fact_id").over(w)).alias("next"))


@query("facts", f"""with recursive {_POINTERS}, walk as (select id, id as cur, next, 0 as steps from ptr union all select walk.id, ptr.id, ptr.next, steps + 1 from walk join ptr on ptr.id = walk.next)
select id, cur as head, cast(steps as bigint) as steps from walk where next is null""")
def supersession_chain(v: Views):
    return W.chain_heads(_pointers(v))


@query("facts", f"""with {_POINTERS} select fact_id, valid_from as expired_at, next as superseded_by from facts join ptr on id = fact_id where expired and next is not null and valid_from >= timestamp '2024-01-10' order by expired_at desc, fact_id desc limit 50""")
def supersessions(v: Views):
    f = v.facts().join(_pointers(v), F.col("id") == F.col("fact_id")).select("fact_id", F.when(F.col("expired"), F.col("valid_from")).alias("expired_at"), F.col("next").alias("superseded_by"))
    return W.supersessions(f, F.lit("2024-01-10").cast("timestamp_ntz"))


@query("facts", "select fact_id, lead(valid_from) over (partition by entity_slug, claim_metric order by valid_from, fact_id) as valid_until from facts")
def chain_validity(v: Views):
    return W.chain_validity(v.facts())


@query("", """select user_id as page_id, event_id as entry_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' and user_id in (select c_custkey from customer) qualify rank <= 10""")
def timeline(v: Views):
    e = v.raw("events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("entry_id"), F.col("ts").alias("at"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return W.timeline(e, v.raw("customer").select(F.col("c_custkey").alias("page_id")), 10, at("2024-01-05"), at("2024-01-25")).select("page_id", "entry_id", "rank")


@query("", """with t as (select user_id as page_id, event_id as row_num, event_type as claim, true as active from events), c as (select page_id, row_num as old_row, claim || '!' as claim from t where page_id % 7 = 0 and row_num % 10 = 3),
m as (select page_id, max(row_num) as top from t group by 1)
select page_id, row_num, claim, not exists (select 1 from c where c.page_id = t.page_id and c.old_row = t.row_num) as active from t
union all select page_id, top + row_number() over (partition by page_id order by old_row), claim, true from c join m using (page_id)""")
def supersede_takes(v: Views):
    t = v.raw("events").select(F.col("user_id").cast("long").alias("page_id"), F.col("event_id").cast("long").alias("row_num"), F.col("event_type").alias("claim"), F.lit(True).alias("active"))
    c = t.where((F.col("page_id") % 7 == 0) & (F.col("row_num") % 10 == 3)).select("page_id", F.col("row_num").alias("old_row"), F.concat("claim", F.lit("!")).alias("claim"))
    return W.supersede_takes(t, c)


@query("pages links", """with n as (select to_page_id as page_id, count(*) as n from links group by 1) select page_id, regexp_extract(slug, '^([^/]+/[^/]+)/', 1) as stratum from pages left join n using (page_id)
qualify row_number() over (partition by regexp_extract(slug, '^([^/]+/[^/]+)/', 1) order by coalesce(n, 0) desc, page_id) = 1""")
def stratified_sample(v: Views):
    n = v.links().groupBy(F.col("to_page_id").alias("page_id")).agg(F.count("*").alias("n"))
    p = v.pages().select("page_id", "slug").join(n, "page_id", "left")
    return W.stratified_sample(p, F.regexp_extract("slug", "^([^/]+/[^/]+)/", 1), [F.desc(F.coalesce("n", F.lit(0))), F.asc("page_id")]).select("page_id", "stratum")


@query("vectors", """with close as (select vec_id, vec_id % 23 as s, v from vectors where vec_id in (3, 77, 240)), c as (select vec_id as id, vec_id % 23 as stratum, v from vectors where vec_id % 23 not in (select s from close)),
d as (select id, stratum, round(greatest(0, least(1, (1 - max(list_dot_product(c.v, k.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(k.v, k.v))))) / 2)), 6) as distance from c, close k group by all)
select id, stratum, distance, row_number() over (partition by stratum order by id % 5, id) = 1 as chosen from d""")
def far_set(v: Views):
    """Every vector of the strata that none of three pages lies in, and whether it is the one that its stratum sends."""
    c = v.vectors().where(F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 23).alias("stratum"), "v", (F.col("vec_id") % 5).alias("rank"))
    close = c.where(F.col("id").isin(3, 77, 240))
    sent = W.far_pages(c.select("id", "stratum", "rank"), close).select("id", "stratum", F.lit(True).alias("chosen"))
    return W.far_distances(c, close).join(F.broadcast(sent), ["id", "stratum"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query("pages", "select page_id, slug from pages order by md5('42:' || page_id), page_id limit 25")
def corpus_sample(v: Views):
    return W.corpus_sample(v.pages(), 25, 42).select("page_id", "slug")


@query("pages", f"""with p as (select *, case when page_id % 3 <> 0 then cast(updated_on - cast(page_id % 200 as int) as date) end as last from pages)
select page_id, regexp_extract(slug, '^([^/]+/[^/]+)/', 1) as stratum from p qualify row_number() over (partition by regexp_extract(slug, '^([^/]+/[^/]+)/', 1) order by case when last is null then 2 when last < date '{NOW}' - 90 then 1 else 0 end desc, page_id desc) <= 2""")
def stale_sample(v: Views):
    """Two pages of each prefix, those first that nobody has looked at for long."""
    last = F.when(F.col("page_id") % 3 != 0, F.expr("date_sub(updated_on, cast(page_id % 200 as int))"))
    p = v.pages().select("page_id", "slug", "updated_on").withColumn("last", last)
    return W.stratified_sample(p, F.regexp_extract("slug", "^([^/]+/[^/]+)/", 1), [F.desc(C.stale_score(F.col("last"), F.lit(NOW).cast("date"))), F.desc("page_id")], 2).select("page_id", "stratum")


_FLAGS = f"""{_POINTS}, p as (select *, lag(claim_value) over (partition by entity_slug, claim_metric order by n) as before from points), t as (select 'user/' || take_id % 150 as entity_slug, claim, case resolved_quality when 'correct' then true when 'incorrect' then false end as o from takes)"""


@query("facts takes", f"""with {_FLAGS}, s as (select entity_slug, v, lag(v) over (partition by entity_slug order by valid_from, fact_id) as u from facts join (select vec_id, cast(embedding as double[]) as v from embeddings) using (vec_id)),
d as (select entity_slug, case when count(*) >= 3 then round(least(1, greatest(0, 1 - avg(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)))))), 6) end as drift from s group by 1),
f as (select entity_slug, 'regression' as kind, claim_metric as what from p where before <> 0 and (claim_value - before) / abs(before) <= -0.1 union all select entity_slug, 'narrative_drift', '' from d where drift >= 0.5 union all select entity_slug, 'missed_prediction', '' from t where not o)
select entity_slug, kind, count(*) as n from f group by all""")
def red_flags(v: Views):
    """How many of each kind an entity has; takes are dealt to entities by their id."""
    k = F.col("take_id")
    t = v.takes().select(F.concat(F.lit("user/"), (k % 150).cast("string")).alias("entity_slug"), "claim", F.when(F.col("resolved_quality") == "correct", F.lit(True)).when(F.col("resolved_quality") == "incorrect", F.lit(False)).alias("resolved_outcome"))
    f = v.facts()
    return W.red_flags(W.trajectory(f), t, W.drift_score(f.join(v.vectors(), "vec_id"))).groupBy("entity_slug", "kind").agg(F.count("*").alias("n"))


@query("facts takes", f"""with {_FLAGS} select entity_slug, count(o) as predicted, count(*) filter (where o) as accurate, round(count(*) filter (where o) / count(o), 6) as accuracy from t where o is not null group by 1""")
def claim_accuracy(v: Views):
    k = F.col("take_id")
    t = v.takes().select(F.concat(F.lit("user/"), (k % 150).cast("string")).alias("entity_slug"), F.when(F.col("resolved_quality") == "correct", F.lit(True)).when(F.col("resolved_quality") == "incorrect", F.lit(False)).alias("resolved_outcome"))
    return W.claim_accuracy(t)


@query("", """with recursive e as (select user_id, event_type, ts, min(event_id) as event_id from events group by all), walk as (select user_id, event_type, min(ts) as ts from e group by all
 union all select walk.user_id, walk.event_type, (select min(ts) from e where e.user_id = walk.user_id and e.event_type = walk.event_type and e.ts > walk.ts + interval 2 days) as ts from walk where ts is not null)
select event_id from walk join e using (user_id, event_type, ts)""")
def cooldown_filter(v: Views):
    """What fires when each user's kind of event stays quiet for two days after it fired."""
    return W.cooldown(v.raw("events").select("event_id", "user_id", "event_type", "ts"), 2, ("user_id", "event_type"), tie="event_id").select("event_id")


_FOLDER = "case page_id % 9 when 0 then 'companies/' when 1 then 'notes/people/' when 2 then 'deals/' when 3 then 'macro-' when 4 then 'wiki/geography-' when 5 then 'tactics/' when 6 then 'notes/ai/' when 7 then 'an-ai-' else 'concepts/' end"
_TAGS = [["Over-confident hiring", "founder-behavior: too kind"], ["market-timing early", "AI hype"], ["macro gloom", "geography bias", "tactics over strategy"], []]


@query("takes", f"""with t as (select take_id, holder, weight, {_FOLDER} || page_id as slug, 'src' || case when take_id % 5 = 0 then (cast(substring(holder, 4) as int) + 1) % 20 else cast(substring(holder, 4) as int) end as asked from takes),
p as (select 'src' || k as asked, case k % 4 when 0 then {_TAGS[0]} when 1 then {_TAGS[1]} when 2 then {_TAGS[2]} else [] end as tags from range(0, 17) r(k)),
h as (select t.*, tags, case when slug like 'companies/%' then 'hiring' when slug like '%/people/%' then 'founder-behavior' when slug like 'deals/%' then 'market-timing' when slug like '%macro%' then 'macro' when slug like '%geography%' then 'geography' when slug like '%tactics%' then 'tactics' when slug like '%/ai/%' or slug like '%-ai-%' then 'ai' else '' end as hint from t left join p using (asked)),
g as (select *, case when hint <> '' then list_filter(tags, lambda x: contains(lower(x), hint))[1] end as found from h),
r as (select *, case when tags is null then 'no_profile' when holder <> asked then 'wrong_holder' when weight <= 0.7 then 'below_conviction_threshold' when found is null then 'no_matching_bias_tag' end as reason from g)
select take_id, reason is null as matched, reason, case when reason is null then found end as tag from r""")
def nudge_rule(v: Views):
    """All takes against the profile of their holder, a fifth of them against the next one's; some holders have none."""
    slug = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("companies/", "notes/people/", "deals/", "macro-", "wiki/geography-", "tactics/", "notes/ai/", "an-ai-", "concepts/")]), (F.col("page_id") % 9 + 1).cast("int")), F.col("page_id").cast("string"))
    n = F.substring("holder", 4, 9).cast("int")
    asked = F.concat(F.lit("src"), F.when(F.col("take_id") % 5 == 0, (n + 1) % 20).otherwise(n).cast("string"))
    p = v.spark.createDataFrame([(f"src{k}", _TAGS[k % 4]) for k in range(17)], "holder string, tags array<string>")
    return W.nudge_rule(v.takes().select("take_id", "holder", "weight", slug.alias("page_slug"), asked.alias("asked")), p)


# --- graph ------------------------------------------------------------------------

_SEEDS = "seeds as (select 'customer/' || k as node from range(1, 6) t(k))"
_E = "e as (select distinct src, dst, lt from edges)"


def _seeds(v: Views):
    return v.raw("customer").where(F.col("c_custkey").between(1, 5)).select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("node"))


@query("edges", f"""with recursive {_E}, {_SEEDS}, walk as (select node as seed, node, 0 as depth from seeds union select seed, dst, depth + 1 from walk join e on src = node where depth < 3)
select seed, node, min(depth) as depth from walk group by all""")
def traverse(v: Views):
    return G.traverse(v.edges(), _seeds(v), 3)


@query("edges", f"""with {_E}, {_SEEDS}, one as materialized (select distinct src, dst, lt from (select * from e where src in (select node from seeds) union all select dst, src, lt from e where dst in (select node from seeds))),
two as (select distinct src, dst, lt from (select * from e where src in (select dst from one) union all select dst, src, lt from e where dst in (select dst from one)))
select *, 1 as depth from one union all select *, 2 from two""")
def graph_paths(v: Views):
    return G.paths(v.edges(), _seeds(v), 2, direction="both")


_WALKS = f"""{_E}, {_SEEDS}, walk as (select node as seed, node, 0 as depth, [node] as passed from seeds union all select seed, dst, depth + 1, list_append(passed, dst) from walk join e on src = node where depth < 3 and not list_contains(passed, dst)),
w as (select distinct seed, node, depth from walk)"""


@query("edges", f"""with recursive {_WALKS}, l as (select src as node, string_agg(dst || ' ' || lt, ',' order by dst, lt) as links from e where src in (select node from w) group by 1)
select seed, node, depth, coalesce(links, '') as links from w left join l using (node)""")
def traverse_links(v: Views):
    """Every depth at which a path leads to a node, with the node's outgoing links."""
    w = G.with_outgoing(G.walks(v.edges(), _seeds(v), 3), v.edges())
    return w.select("seed", "node", "depth", F.array_join(F.transform("links", lambda x: F.concat(x["to"], F.lit(" "), x["lt"])), ",").alias("links"))


@query("edges", f"with recursive {_WALKS} select seed, node, depth from w")
def traverse_recursive(v: Views):
    """The same walks as one recursive query."""
    return G.walks_recursive(v.edges(), _seeds(v), 3)


_RING = "ring as (select src, dst from e union select dst, src from e where lt = 'part_of')"


def _ring(v: Views):
    """The edges, with those from nations to regions both ways."""
    e = v.edges()
    return e.unionByName(e.where(F.col("lt") == "part_of").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "lt"))


@query("edges", f"""with recursive {_E}, {_RING}, inner_ as (select * from ring where src in (select src from ring where dst like 'region/%' union select dst from ring where dst like 'region/%') and dst in (select dst from ring where src like 'region/%' or dst like 'region/%')),
reach as (select src, dst from inner_ union select reach.src, inner_.dst from reach join inner_ on inner_.src = reach.dst)
select a.src as node, max(a.dst) as component from reach a join reach b on a.src = b.dst and a.dst = b.src group by 1""")
def strong_components(v: Views):
    return G.strong_components(_ring(v))


@query("edges", f"""with recursive {_E}, {_RING}, s as (select node, node as seed from (values ('customer/1'), ('order/1'), ('part/1'), ('supplier/2')) t(node)), walk as (select seed, node, 0 as depth from s union select seed, dst, depth + 1 from walk join ring on src = node where depth < 3)
select seed, bool_or(node like 'nation/%' or node like 'region/%') as cycles from walk group by 1""")
def cycle_flags(v: Views):
    seeds = v.spark.createDataFrame([("customer/1",), ("order/1",), ("part/1",), ("supplier/2",)], "node string")
    return G.cycle_flags(G.traverse(_ring(v), seeds, 3), _ring(v))


@query("edges", f"with {_E} select node, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out, count(*) as n from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1")
def degree(v: Views):
    return G.degrees(v.edges())


@query("edges", """select dst as symbol, src as caller, lt <> 'contains' as resolved from edges where dst in (select 'supplier/' || s_suppkey from supplier) or dst in (select 'part/' || p_partkey from part)""")
def callers(v: Views):
    """Of all suppliers and parts."""
    e = v.edges()
    s = v.raw("supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("symbol"))
    p = v.raw("part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("symbol"))
    return G.callers(e.where(F.col("lt") != "contains"), e.where(F.col("lt") == "contains"), s.unionByName(p))


@query("edges", f"""with recursive {_E}, seed as (select dst as seed from e where dst in ('nation/3', 'supplier/7', 'region/1') group by 1), walk as (select seed, seed as node, 0 as depth from seed union select seed, src, depth + 1 from walk join e on dst = node where depth < 3),
m as materialized (select seed, node, min(depth) as depth from walk group by all), l0 as (select seed, depth, count(*) as n from m where depth <= 2 group by seed, depth), lv as (select *, sum(n) over (partition by seed order by depth) as upto from l0),
r as (select m.*, n, upto, row_number() over (partition by m.seed, m.depth order by node) as k from m join lv using (seed, depth)), cutoff as (select seed, min(depth) as d from lv where upto > 200 group by 1),
kept as (select r.seed, node, depth from r left join cutoff c on c.seed = r.seed where c.d is null or depth < c.d or depth = c.d and k <= 200 - (upto - n))
select seed, node, depth, round(greatest(0.05, 1 / (1 + 0.3 * depth)), 6) as confidence, case when seed in (select seed from cutoff) then 'nodes' when seed in (select seed from m where depth = 3) then 'depth' else 'done' end as stopped from kept""")
def impact_walk(v: Views):
    """Some walks end at 200 nodes, some at two steps."""
    seeds = v.spark.createDataFrame([("nation/3",), ("supplier/7",), ("region/1",)], "node string")
    return G.impact_walk(v.edges(), seeds, 2, 200)


_ALIAS = "a as (select distinct 'n' || c_custkey as alias, 'n' || c_custkey // 4 as target from customer where c_custkey >= 4)"


def _aliases(v: Views):
    k = F.col("c_custkey")
    return v.raw("customer").where(k >= 4).select(F.concat(F.lit("n"), k.cast("string")).alias("alias"), F.concat(F.lit("n"), F.floor(k / 4).cast("string")).alias("target"))


@query("", f"""with recursive {_ALIAS}, c as (select alias, target, 1 as depth from a union all select c.alias, a.target, c.depth + 1 from c join a on a.alias = c.target where c.depth < 4)
select alias, target, min(depth) as depth from c group by all""")
def alias_closure(v: Views):
    return G.alias_closure(_aliases(v))


@query("", f"""with recursive m as (select distinct 'user/' || user_id as alias, 'user/' || user_id // 6 as target from events where user_id >= 3), c as (select alias, target, 1 as depth from m union all select c.alias, m.target, c.depth + 1 from c join m on m.alias = c.target where c.depth < 4),
ends as (select alias, arg_min(target, depth) as canon from c where target not in (select alias from m) group by 1)
select coalesce(canon, 'user/' || user_id) as entity_slug, count(*) as n from events left join ends on alias = 'user/' || user_id group by 1""")
def merge_entities(v: Views):
    """Every user from 3 on is an alias of another."""
    k = F.col("user_id")
    m = v.raw("events").where(k >= 3).select(k).distinct().select(F.concat(F.lit("user/"), k.cast("string")).alias("alias"), F.concat(F.lit("user/"), F.floor(k / 6).cast("string")).alias("target"))
    f, _ = G.merge_entities(v.facts(), v.edges(), m)
    return f.groupBy("entity_slug").agg(F.count("*").alias("n"))


# --- evaluation -------------------------------------------------------------------

_QRELS = "qrels as (select item_id as query_id, doc_id, case when contains(d.text, b.text) then 3 else 1 end as grade from benchmark b join documents d on contains(d.text, substring(b.text, 1, 60)))"


def _qrels(v: Views):
    """Documents that hold a question's text, grade 3, or its beginning, 1."""
    met = J.passage_matches(v.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("passage")), v.raw("documents").select("doc_id", "text"))
    return met.select(F.col("id").alias("query_id"), "doc_id", F.when(F.col("whole"), 3).otherwise(1).alias("grade"))


_METRICS = f"""{_QRELS}, rs as (select query_id, page_id as doc_id, r as rank from results), h as (select query_id, count(*) as h, min(rank) as first, sum(grade / log2(rank + 1)) as dcg from rs join qrels using (query_id, doc_id) where rank <= 5 group by 1),
i as (select query_id, count(*) as n, sum(case when r <= 5 then grade / log2(r + 1) end) as best from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from qrels) group by 1),
m as (select query_id, round(coalesce(h / 5.0, 0), 6) as precision, round(coalesce(h / n, 0), 6) as recall, round(coalesce(1.0 / first, 0), 6) as mrr, round(coalesce(dcg / best, 0), 6) as ndcg from questions left join i using (query_id) left join h using (query_id))"""


def _metrics(v: Views):
    return E.metrics(results(v).select("query_id", F.col("page_id").alias("doc_id"), "rank"), _qrels(v), v.questions())


@query("questions postings pages", f"with {_RESULTS}, {_METRICS} select * from m")
def retrieval_metrics(v: Views):
    return _metrics(v)


@query("questions postings pages", f"with {_RESULTS}, {_METRICS} select cast(query_id % 4 as bigint) as kind, count(*) as queries, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by 1")
def metrics_by_type(v: Views):
    return E.summary(_metrics(v).withColumn("kind", F.col("query_id") % 4), "kind")


_RUNS = "a as (select query_id, list(page_id order by r) as a from results group by 1), b as (select query_id, list(page_id order by k) as b from (select query_id, page_id, row_number() over (partition by query_id order by score desc, page_id) as k from results where page_id % 7 <> 0) group by 1)"


def _runs(v: Views):
    ids = lambda df: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_id")))["page_id"].alias("ids"))
    r = results(v)
    return ids(r), ids(r.where(F.col("page_id") % 7 != 0))


@query("questions postings pages", f"with {_RESULTS}, {_RUNS} select query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard, a[1] = b[1] as top1 from a join b using (query_id)")
def replay_diff(v: Views):
    return E.replay_diff(*_runs(v))


_REPLAY = f"""{_RUNS}, x as (select query_id, a, b, cast(10 + query_id % 7 as double) as la, cast(12 + query_id % 31 as double) as lb, query_id % 10 = 3 as bad from a left join b using (query_id)),
y as (select query_id, case when not bad then round(len(list_intersect(a, coalesce(b, []))) / len(list_distinct(list_concat(a, coalesce(b, [])))), 6) end as jaccard, case when not bad then coalesce(a[1] = b[1], false) end as top1, case when not bad then lb - la end as latency_delta, cast(len(a) as int) as n_captured, case when not bad then cast(len(coalesce(b, [])) as int) end as n_current, bad as errored, case when not bad then lb > 2 * la end as over_2x from x)"""


def _replayed(v: Views):
    """A tenth of the questions fails when asked again."""
    a, b = _runs(v)
    k = F.col("query_id")
    current = a.select("query_id").join(b, "query_id", "left").select("query_id", "ids", (12 + k % 31).cast("double").alias("latency_ms"), F.when(k % 10 == 3, "timeout").alias("error"))
    return E.replay_rows(a.withColumn("latency_ms", (10 + k % 7).cast("double")), current)


@query("questions postings pages", f"with {_RESULTS}, {_REPLAY} select * from y")
def replay_rows(v: Views):
    return _replayed(v)


@query("questions postings pages", f"""with {_RESULTS}, {_REPLAY} select count(*) as total, count(*) filter (where not errored) as replayed, count(*) filter (where errored) as errored, round(avg(jaccard), 6) as mean_jaccard, round(avg(case when top1 then 1.0 when not top1 then 0.0 end), 6) as top1_rate, round(avg(latency_delta), 6) as mean_latency_delta, count(*) filter (where over_2x) as over_2x from y""")
def replay_summary(v: Views):
    return E.replay_summary(_replayed(v))


@query("questions postings pages", f"with {_RESULTS}, {_RUNS} select count(*) as n, round(avg(case when a[1] = b[1] then 1.0 else 0.0 end), 6) as stable from a join b using (query_id)")
def top1_stability(v: Views):
    return E.replay_diff(*_runs(v)).agg(F.count("*").alias("n"), F.round(F.avg(F.col("top1").cast("double")), 6).alias("stable"))


@query("questions postings pages", f"with {_RESULTS}, {_QRELS} select query_id, bool_or(coalesce(doc_id = page_id, false)) as hit from (select query_id, list(doc_id) as docs from qrels group by 1) join (select query_id, unnest(docs) as doc_id from (select query_id, list(doc_id) as docs from qrels group by 1)) using (query_id) left join (select * from results where r <= 3) using (query_id) group by 1")
def topk_hit(v: Views):
    e = _qrels(v).groupBy("query_id").agg(F.collect_set("doc_id").alias("ids"))
    return E.topk_hit(results(v).select("query_id", F.col("page_id").alias("doc_id"), "rank"), e)


@query("", """select cast(user_id % 5 as bigint) as suite, round(avg(value) filter (where event_type = 'click'), 6) as click, round(avg(value) filter (where event_type = 'view'), 6) as view from events group by 1""")
def compare_modes(v: Views):
    e = v.raw("events").select((F.col("user_id") % 5).alias("suite"), F.col("event_type").alias("mode"), "value")
    return E.compare_modes(e, ["click", "view"])
