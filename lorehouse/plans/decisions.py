"""Queries: takes and their outcomes, telemetry, names in texts, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.table_functions import register_chunker
from ..operators import dictionary as N
from ..operators import evaluation as E
from ..operators import fusion as R
from ..operators import takes as K
from ..operators import text as T
from .joined import _RESULTS, results
from .ranking import _METRICS, _metrics
from .registry import query
from .views import NOW, Views

#: Takes with outcomes of all four kinds and none, a day they were made on, a domain, and a successor for some.
_TAKES = """tk as (select take_id, page_id, holder, kind, weight, active, case when take_id % 11 = 0 then 'unresolvable' when take_id % 7 = 0 then null else resolved_quality end as resolved_quality,
 date '2022-01-01' + cast(take_id * 37 % 700 as int) as since, case when take_id % 17 = 0 then take_id + 1 end as superseded_by, 'd' || take_id % 4 as domain from takes)"""


def _takes(v: Views):
    k = F.col("take_id")
    outcome = F.when(k % 11 == 0, "unresolvable").when(k % 7 == 0, None).otherwise(F.col("resolved_quality"))
    t = v.takes().withColumn("resolved_quality", outcome).withColumn("since", F.date_add(F.lit("2022-01-01").cast("date"), (k * 37 % 700).cast("int")))
    return t.withColumn("superseded_by", F.when(k % 17 == 0, k + 1)).withColumn("domain", F.concat(F.lit("d"), (k % 4).cast("string"))).withColumn("quarter", F.date_format(F.date_trunc("quarter", "since"), "yyyy-MM-dd"))


@query("takes", f"""with {_TAKES}, q as (select *, cast(date_trunc('quarter', since) as date)::varchar as quarter, case resolved_quality when 'correct' then 1.0 when 'incorrect' then 0.0 end as r from tk where holder <> 'src3')
select holder, domain, quarter, cast(grouping(domain, holder, quarter) as int) as level, count(*) filter (where kind = 'bet') as bets, count(*) filter (where resolved_quality in ('correct', 'incorrect', 'partial')) as resolved,
 count(*) filter (where resolved_quality = 'correct') as correct, count(*) filter (where resolved_quality = 'incorrect') as incorrect, count(*) filter (where resolved_quality = 'partial') as partial, count(*) filter (where resolved_quality = 'unresolvable') as unresolvable,
 round(avg(power(weight - r, 2)), 6) as brier, round(avg(r), 6) as accuracy, round(count(*) filter (where resolved_quality = 'partial') / nullif(count(*) filter (where resolved_quality in ('correct', 'incorrect', 'partial')), 0), 6) as partial_rate,
 round(count(*) filter (where resolved_quality = 'unresolvable') / nullif(count(*) filter (where resolved_quality in ('correct', 'incorrect', 'partial', 'unresolvable')), 0), 6) as unresolvable_rate
from q group by grouping sets ((holder), (domain), (quarter), (holder, domain), (holder, domain, quarter), ())""")
def scorecards(v: Views):
    """By holder, domain and quarter, by pairs of them, and in all; one holder is not allowed."""
    t = _takes(v)
    return K.scorecards(t, [["holder"], ["domain"], ["quarter"], ["holder", "domain"], ["holder", "domain", "quarter"], []], t.where(F.col("holder") != "src3"))


@query("questions postings pages", f"with {_RESULTS}, {_METRICS} select cast(query_id % 4 as bigint) as kind, grouping(query_id % 4) = 1 as in_all, count(*) as queries, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from m group by rollup (query_id % 4)")
def metrics_rollup(v: Views):
    """By kind of question and in all."""
    return E.rollup(_metrics(v).withColumn("kind", F.col("query_id") % 4), "kind")


_RESOLVED = """tk as (select doc_id % 50 as page_id, doc_id as row_num, case when doc_id % 9 = 0 then timestamp '2023-01-01' end as resolved_at, case when doc_id % 9 = 0 then 'correct' end as resolved_quality, case when doc_id % 9 = 0 then true end as resolved_outcome from documents),
rs as (select event_id as resolution_id, cast(value * 7 as bigint) % 50 as page_id0, event_id % (select 2 + max(doc_id) from documents) as row_num, ts as "at", case event_id % 6 when 0 then 'correct' when 1 then 'incorrect' when 2 then 'partial' when 3 then 'unresolvable' when 4 then 'maybe' end as quality,
 case event_id % 5 when 0 then true when 1 then false end as outcome from events),
r as (select resolution_id, row_num % 50 as page_id, row_num, "at", quality, outcome from rs)"""
_RULES = """j as (select r.*, tk.row_num is not null as there, tk.resolved_at is not null as done, coalesce(case when quality is null then outcome is not null else quality in ('correct', 'incorrect', 'partial', 'unresolvable') and (outcome is null or quality = 'correct' and outcome or quality = 'incorrect' and not outcome) end, false) as valid from r left join tk using (page_id, row_num)),
f as (select page_id, row_num, min(("at", resolution_id)) as first from j where there and not done and valid group by all), g as (select j.*, first from j left join f using (page_id, row_num))"""


def _resolved(v: Views):
    d, k, e = v.raw("documents"), F.col("doc_id"), F.col("event_id")
    done = k % 9 == 0
    takes = d.select((k % 50).alias("page_id"), k.alias("row_num"), F.when(done, F.lit("2023-01-01").cast("timestamp_ntz")).alias("resolved_at"), F.when(done, "correct").alias("resolved_quality"), F.when(done, F.lit(True)).alias("resolved_outcome"))
    top = d.agg((2 + F.max("doc_id")).alias("top"))
    quality = F.when(e % 6 == 0, "correct").when(e % 6 == 1, "incorrect").when(e % 6 == 2, "partial").when(e % 6 == 3, "unresolvable").when(e % 6 == 4, "maybe")
    outcome = F.when(e % 5 == 0, F.lit(True)).when(e % 5 == 1, F.lit(False))
    r = v.raw("events").crossJoin(F.broadcast(top)).select(e.alias("resolution_id"), (e % F.col("top")).alias("row_num"), F.col("ts").cast("timestamp_ntz").alias("at"), quality.alias("quality"), outcome.alias("outcome"))
    return K.resolve_takes(takes, r.withColumn("page_id", F.col("row_num") % 50))


@query("", f"""with {_RESOLVED}, {_RULES}, a as (select page_id, row_num, "at", coalesce(quality, case when outcome then 'correct' else 'incorrect' end) as q from g where there and not done and valid and ("at", resolution_id) = first)
select page_id, row_num, case when a."at" is not null then a."at" else resolved_at end as resolved_at, coalesce(q, resolved_quality) as resolved_quality, case when q is null then resolved_outcome when q = 'correct' then true when q = 'incorrect' then false end as resolved_outcome from tk left join a using (page_id, row_num)""")
def resolved_takes(v: Views):
    """All documents as takes, a ninth of them resolved before, with events as resolutions, some for no take, some against themselves, many for one."""
    return _resolved(v)[0]


@query("", f"""with {_RESOLVED}, {_RULES} select resolution_id, page_id, row_num, case when not there then 'row_not_found' when done or coalesce(("at", resolution_id) > first, false) then 'already_resolved' else 'invalid' end as reason from g where not (there and not done and valid and ("at", resolution_id) = first)""")
def resolution_rejects(v: Views):
    return _resolved(v)[1]


@query("takes", f"""with {_TAKES} select holder, count(*) as n from tk where active and resolved_quality is null and superseded_by is null and weight >= 0.7 and since < date '{NOW}' - interval 12 months group by 1""")
def abandoned_claims(v: Views):
    return K.abandoned_claims(_takes(v), F.lit(NOW).cast("date"))


@query("takes pages chunks", f"""with {_TAKES}, n as (select page_id, count(*) as n from chunks join pages using (page_id) where chunk_source = 'timeline' and updated_on >= date '2024-01-15' group by 1)
select take_id, weight, coalesce(n, 0) as evidence from tk left join n using (page_id) where active and weight between 0.3 and 0.85 and resolved_quality is null""")
def drift_candidates(v: Views):
    """All of them; entries of the last weeks count as evidence."""
    e = v.chunks().where(F.col("chunk_source") == "timeline").join(v.pages().select("page_id", F.col("updated_on").alias("at")), "page_id")
    return K.drift_candidates(_takes(v), e, F.lit("2024-01-15").cast("date"))


_CALLS = "calls as (select event_type as mode, 'i' || user_id % 4 as intent, 'c' || event_id % 3 as client, 's' || user_id % 6 as source, event_id % 20 as results, event_id % 900 as tokens, event_id % 2 as cache_hits, event_id % 5 as cache_misses from events)"


@query("", f"""with {_CALLS}, g as (select mode, intent, client, source, case when grouping(mode) = 0 then 'mode' when grouping(intent) = 0 then 'intent' when grouping(client) = 0 then 'client' when grouping(source) = 0 then 'source' else 'all' end as axis, count(*) as calls, cast(sum(results) as bigint) as results, cast(sum(tokens) as bigint) as tokens,
 round(sum(cache_hits) / nullif(sum(cache_hits) + sum(cache_misses), 0), 6) as hit_rate from calls group by grouping sets ((mode), (intent), (client), (source), ()))
select axis, coalesce(mode, intent, client, source) as value, calls, results, tokens, round(results / calls, 6) as mean_results, round(tokens / calls, 6) as mean_tokens, hit_rate from g""")
def search_stats(v: Views):
    """Events as calls: by mode, intent, client and source, and in all."""
    u, e = F.col("user_id"), F.col("event_id")
    name = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    calls = v.raw("events").select(F.col("event_type").alias("mode"), name("i", u % 4).alias("intent"), name("c", e % 3).alias("client"), name("s", u % 6).alias("source"), (e % 20).alias("results"), (e % 900).alias("tokens"), (e % 2).alias("cache_hits"), (e % 5).alias("cache_misses"))
    return K.search_stats(calls)


_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


@query("questions", rf"""with recursive q as (select query_id, {_W.format('text')} as w from questions), tt as (select query_id * 3 + k as title_id, array_to_string(list_slice(w, 2, 2 + k), ' ') as title, k + 1 as n from q, range(1, 3) r(k) where len(w) >= 2 + k),
t as (select title, n, min(title_id) as title_id from tt group by all), d as (select id, "at", w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from (select doc_id as id, generate_subscripts(w, 1) as "at", unnest(w) as w from (select doc_id, {_W.format('text')} as w from documents)) window o as (partition by id order by "at")),
c as materialized (select id, "at", n, title_id from (select id, "at", w || ' ' || w2 as title from d union all select id, "at", w || ' ' || w2 || ' ' || w3 from d) join t using (title)),
o as materialized (select *, row_number() over (partition by id order by "at", n desc) as k from c),
walk as (select id, "at", n, title_id, "at" + n as after, k from o where k = 1 union all select o.id, o."at", o.n, o.title_id, o."at" + o.n, o.k from walk join o on o.id = walk.id and o.k = (select min(p.k) from o p where p.id = walk.id and p."at" >= walk.after))
select id, cast("at" as int) as "at", cast(n as int) as n, title_id from walk""")
def title_mentions(v: Views):
    """All documents; the names are the second and third word of each question, and these and the next."""
    q = v.questions().select("query_id", N.words(F.col("text")).alias("w"))
    k = F.explode(F.array(*map(F.lit, range(1, 3)))).alias("k")
    t = q.select("query_id", "w", k).where(F.size("w") >= 2 + F.col("k")).select((F.col("query_id") * 3 + F.col("k")).alias("title_id"), F.array_join(F.slice("w", 2, F.col("k") + 1), " ").alias("title"))
    return N.title_mentions(v.raw("documents").select(F.col("doc_id").alias("id"), "text"), t)


_ENTITY = "e as (select page_id, case page_id % 40 when 0 then 'people/' when 1 then 'companies/' when 2 then 'deals/' else 'notes/people/' end || page_id as slug, title, deleted from pages)"


def _entity_pages(v: Views):
    k = F.col("page_id") % 40
    folder = F.when(k == 0, "people/").when(k == 1, "companies/").when(k == 2, "deals/").otherwise("notes/people/")
    return v.pages().select("page_id", F.concat(folder, F.col("page_id").cast("string")).alias("slug"), "title", "deleted")


_NAMED = rf"""{_ENTITY}, kw as (select distinct unnest({_W.format('title')}) as w from e where not deleted and (slug like 'people/%' or slug like 'companies/%' or slug like 'deals/%')),
qw as (select distinct query_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as w from questions), named as (select distinct query_id from qw join kw using (w) where length(w) >= 3 and w not in ({', '.join(f"'{w}'" for w in N.GUARD_STOPWORDS)}))"""


@query("questions postings pages", f"""with {_RESULTS}, {_NAMED}, k as (select query_id, page_id, r as rank, page_id % 3 = 1 as is_process, page_id % 4 = 2 as is_person from results),
p as (select *, min(case when rank <= 10 and is_person then rank end) over (partition by query_id) as p from k), d as (select *, min(case when rank <= 10 and is_process and rank > p then rank end) over (partition by query_id) as d from p)
select query_id, page_id, case when d is null or query_id in (select query_id from named) then rank when rank = d then p when rank >= p and rank < d then rank + 1 else rank end as rank from d""")
def guarded_reorder(v: Views):
    """Process pages go before persons, but not where the question names an entity."""
    h = results(v).select("query_id", "page_id", "rank", (F.col("page_id") % 3 == 1).alias("is_process"), (F.col("page_id") % 4 == 2).alias("is_person"))
    return R.process_reorder(h, guarded=N.names_known_entity(v.questions(), _entity_pages(v))).select("query_id", "page_id", "rank")


@query("", """with w as (select distinct substring(s_name, 1, 1) || substring(s_name, 3) as word from supplier union select distinct replace(s_name, '#', '##') from supplier), n as (select distinct s_name as name from supplier union select distinct 'Supply#' || s_suppkey from supplier),
d as (select word, name, levenshtein(word, name) as edits from w, n where abs(length(word) - length(name)) <= 2) select word, name, cast(edits as int) as edits from d where edits <= 2 qualify row_number() over (partition by word order by edits, name) = 1""")
def nearest_names(v: Views):
    """Names of suppliers with a letter lost or a sign doubled, against all their names in two forms."""
    s = v.raw("supplier")
    asked = s.select(F.concat(F.substring("s_name", 1, 1), F.expr("substring(s_name, 3)")).alias("word")).unionByName(s.select(F.replace("s_name", F.lit("#"), F.lit("##")).alias("word")))
    names = s.select(F.col("s_name").alias("name")).unionByName(s.select(F.concat(F.lit("Supply#"), F.col("s_suppkey").cast("string")).alias("name")))
    return N.nearest_names(asked, names, 2)


@query("", "select doc_id, true as same from documents where trim(text, ' \n') <> ''")
def chunk_table_function(v: Views):
    """The chunks that SQL gets from the table function, held against those of the operator, for every document."""
    register_chunker(v.spark)
    docs = v.raw("documents").select("doc_id", "text")
    by_sql = v.spark.sql("select * from chunk_recursive(table(select doc_id, text from {docs}) partition by doc_id)", docs=docs)
    told = lambda df, key: df.groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_index", "chunk_text")).alias("h"))
    a, b = told(by_sql, "key"), told(T.chunk_recursive(docs, "doc_id", "text"), "doc_id")
    both = a.select("doc_id", F.struct("n", "h").alias("a")).join(b.select("doc_id", F.struct("n", "h").alias("b")), "doc_id", "full")
    return both.select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
