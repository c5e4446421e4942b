"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import dates as D
from ..operators import approximate as A
from ..operators import fusion as R
from ..operators import joins as J
from ..operators import lexical as X
from ..operators.aggregates import dead_links
from .registry import query
from .views import NOW, Views

_Q = "q as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from questions)"
LEXICAL = f"""{_Q}, df as (select term, count(*) as df from postings where term in (select term from q) group by 1),
l0 as (select query_id, chunk_id, page_id, round(sum((1 + ln(tf)) * ln(1 + (select count(*) from chunks) / df)), 6) as score from q join postings using (term) join df using (term) group by all),
lex as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from l0 qualify rank <= 100)"""
VECTOR = """k0 as (select q.query_id, c.vec_id as id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) as sim
  from questions q join vectors a on a.vec_id = q.vec_id cross join vectors b join (select distinct vec_id from chunks) c on c.vec_id = b.vec_id),
knn as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from k0 qualify rank <= 30)"""


def lexical(v: Views):
    return J.lexical_join(v.questions(), v.chunks())


def vector(v: Views, k: int = 30):
    """The k nearest vectors of each question."""
    q = v.questions().join(v.vectors(), "vec_id").select("query_id", "v")
    x = v.vectors().join(v.chunk_keys().select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("id"), "v")
    return J.vector_knn(q, x, k)


@query("questions postings", f"with {LEXICAL} select query_id, chunk_id, page_id, score, rank from lex")
def lexical_join(v: Views):
    return lexical(v)


@query("questions vectors", """select query_id, least(30, (select count(*) from vectors)) as n, true as exact, true as recalled from questions""")
def vector_approximate(v: Views):
    """By hyperplane buckets: `exact` says whether all scores are the true ones, `recalled` whether at least 0.9 of the true 30 nearest of all queries are there."""
    q = v.questions().join(v.vectors(), "vec_id").select("query_id", "v")
    x = v.vectors().select(F.col("vec_id").alias("id"), "v")
    got, true = A.approximate_knn(q, x, 30), J.vector_knn(q, x, 30)
    both = got.select("query_id", "id", F.col("sim").alias("a")).join(true.select("query_id", "id", F.col("sim").alias("b")), ["query_id", "id"], "full")
    per = both.groupBy("query_id").agg(F.count("a").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-6).alias("bad"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("hit"), F.count("b").alias("all"))
    recall = per.agg((F.sum("hit") / F.sum("all") >= 0.9).alias("recalled"))
    return per.crossJoin(F.broadcast(recall)).select("query_id", "n", (F.col("bad") == 0).alias("exact"), "recalled")


@query("questions vectors chunks", f"with {VECTOR} select query_id, id, round(sim, 6) as sim, rank from knn")
def vector_knn_join(v: Views):
    return vector(v)


_LOW = "regexp_extract_all(lower({}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SINGULAR = r"""case when regexp_matches({0}, '^[a-z]{{2,}}ies$') then {0}[:-4] || 'y' when regexp_matches({0}, '^[a-z]+(ss|sh|ch|x|z)es$') then {0}[:-3] when regexp_matches({0}, '^[a-z]+[^sui]s$') then {0}[:-2] else {0} end"""
_STEMS = f"""v0 as (select distinct w from (select unnest({_LOW.format('chunk_text')}) as w from chunks union all select unnest({_LOW.format('title')}) from pages union all select unnest({_LOW.format('text')}) from questions)),
v1 as (select w, {_SINGULAR.format('w')} as s from v0), v2 as (select w, s, regexp_extract(s, '^([a-z]*[aeiouy][a-z]+)(ing|ed)$', 1) as r from v1),
stems as (select w, case when length(r) < 3 then s when right(r, 1) = r[-2:-2] and contains('bdfgmnprt', right(r, 1)) then r[:-2] else r end as term from v2 where w not in ({', '.join(f"'{w}'" for w in sorted(X.STOP))}))"""
#: Five kinds of query over words of the question: (number of words picked, their alternatives as (excluded, places of the words)).
_ASKED = {0: [[(False, (2, 3, 4))]], 1: [[(False, (3,)), (True, (7,))]], 2: [[(False, (2, 3))], [(False, (5,))]], 3: [[(False, (2,)), (False, (4,)), (False, (6,))]], 4: [[(False, (3,))], [(False, (5, 6)), (True, (2,))]]}


def _asked_rows() -> str:
    """(kind, side, phrase, excluded, off, nth) of _ASKED as a table."""
    rows = [(k, s, p, ex, j, w) for k, sides in _ASKED.items() for s, side in enumerate(sides) for p, (ex, ws) in enumerate(side) for j, w in enumerate(ws)]
    return "(values " + ", ".join(f"({k}, {s}, {p}, {str(ex).lower()}, {j}, {w})" for k, s, p, ex, j, w in rows) + ") a(kind, side, phrase, excluded, off, nth)"


@query("questions chunks pages", f"""with {_STEMS}, qw as (select query_id, query_id % 5 as kind, {_LOW.format('text')} as w from questions),
ask0 as (select query_id, side, phrase, excluded, off, term from qw join {_asked_rows()} using (kind) join stems on stems.w = qw.w[nth]),
ask as (select *, off - min(off) over (partition by query_id, side, phrase) as o, count(*) over (partition by query_id, side, phrase) as n from ask0),
toks as (select chunk_id, true as title, generate_subscripts(w, 1) as pos, unnest(w) as w from (select chunk_id, {_LOW.format('title')} as w from chunks join pages using (page_id)) union all
 select chunk_id, false, generate_subscripts(w, 1), unnest(w) from (select chunk_id, {_LOW.format('chunk_text')} as w from chunks)),
tk as materialized (select chunk_id, title, pos, term from toks join stems using (w) where term in (select term from ask)),
ph as (select query_id, side, phrase, any_value(excluded) as excluded, chunk_id from ask join tk using (term) group by query_id, side, phrase, chunk_id, title, pos - o having count(distinct o) = any_value(n)),
pd as (select distinct query_id, side, phrase, excluded, chunk_id from ph), need as (select query_id, side, count(distinct phrase) filter (where not excluded) as n from ask group by all),
ok as (select query_id, side, chunk_id from pd join need using (query_id, side) group by query_id, side, chunk_id, need.n having count(*) filter (where excluded) = 0 and count(*) = need.n
 union all select query_id, side, chunk_id from need, chunks where n = 0 and (query_id, side, chunk_id) not in (select query_id, side, chunk_id from pd)),
df as (select term, count(distinct chunk_id) as df from tk group by 1), wt as (select chunk_id, term, sum(case when title then 1.0::double else 0.4::double end) as tf from tk group by all),
sc as (select query_id, chunk_id, round(coalesce(sum(ln(1 + tf) * ln(1 + (select count(*) from chunks) / df)), 0), 6) as score
 from (select distinct query_id, chunk_id from ok) left join ((select distinct query_id, term from ask where not excluded) join wt using (term) join df using (term)) using (query_id, chunk_id) group by all)
select query_id, chunk_id, page_id, score, rank from (select query_id, chunk_id, page_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc join chunks using (chunk_id)) where rank <= 50""")
def phrase_search(v: Views):
    """Queries with phrases, alternatives and exclusions, made of words of each question, over all chunks and their pages' titles."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), 0)
    told = None
    for kind, sides in _ASKED.items():
        part = lambda ex, ws: F.concat(F.lit('-"' if ex else '"'), F.array_join(F.array(*[F.coalesce(F.get("w", n - 1), F.lit("")) for n in ws]), " "), F.lit('"'))
        one = F.array_join(F.array(*[F.array_join(F.array(*[part(ex, ws) for ex, ws in side]), " ") for side in sides]), " or ")
        told = F.when(F.col("query_id") % 5 == kind, one) if told is None else told.when(F.col("query_id") % 5 == kind, one)
    q = v.questions().select("query_id", w.alias("w")).select("query_id", told.alias("text"))
    return X.search(q, v.chunks().join(v.pages().select("page_id", "title"), "page_id"), 50)


_FACTOR = "case when slug like 'en/src1/%' then 0.8 when slug like 'de/src5/%' then 0.5 when slug like 'en/%' then 1.4 when slug like 'de/%' then 1.2 else 1.0 end"
FACTORS = {"en/": 1.4, "en/src1/": 0.8, "de/": 1.2, "de/src5/": 0.5, "fr/": 1.0}


@query("questions vectors pages", f"""with x as (select page_id as id, v, {_FACTOR} as factor from vectors join pages on page_id = vec_id),
k as (select q.query_id, x.id, factor, round(list_dot_product(a.v, x.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(x.v, x.v))), 9) as sim from questions q join vectors a on a.vec_id = q.vec_id cross join x),
f as (select *, round(round(sim, 6) * factor, 6) as score from (select * from k qualify row_number() over (partition by query_id order by sim desc, id) <= 105))
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank > 5 and rank <= 25""")
def vector_search(v: Views):
    """Pages by vector, more than asked for, then weighted by the factor of their source and sorted anew; the second page of results."""
    x = v.vectors().join(v.pages().select(F.col("page_id").alias("vec_id"), "slug"), "vec_id").select(F.col("vec_id").alias("id"), "v", "slug")
    q = v.questions().join(v.vectors(), "vec_id").select("query_id", "v")
    return J.vector_search(q, x, C.source_factor(F.col("slug"), FACTORS), 20, 5)


@query("chunks pages", "select chunk_id, slug, source_id from chunks join pages using (page_id) where not deleted")
def chunk_page_join(v: Views):
    return v.chunks().join(v.pages().where(~F.col("deleted")), "page_id").select("chunk_id", "slug", "source_id")


_TRI = r"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"
_FUZZY = f"""n as (select distinct text as name from questions union select distinct claim from takes), ng as (select name, {_TRI.format('name')} as g from n), pg as (select page_id, slug, {_TRI.format('title')} as h from pages),
f0 as (select name, page_id, slug, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) as sim from ng, pg where len(g) > 0 and len(h) > 0),
fz as (select name, page_id, slug, sim from f0 where sim >= 0.55 qualify row_number() over (partition by name order by sim desc, slug) = 1)"""


def _names(v: Views):
    """Whole questions, and the claims of takes."""
    return v.questions().select(F.col("text").alias("name")).unionByName(v.takes().select(F.col("claim").alias("name"))).distinct()


@query("questions pages takes", f"with {_FUZZY} select name, page_id, sim from fz")
def fuzzy_title_join(v: Views):
    return J.fuzzy_title_join(_names(v), v.pages())


@query("pages links", """with m as (select case page_id % 4 when 0 then slug when 1 then title when 2 then ' ' || page_id else 'Nobody ' || page_id end as name from pages where not deleted),
d as (select page_id, count(*) as degree from (select from_page_id as page_id from links union all select to_page_id from links) group by 1),
mm as (select distinct name, regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g') as made from m),
""" + f"""ng as (select name, {_TRI.format('name')} as g from mm), pg as (select page_id, slug, {_TRI.format('title')} as h from pages),
f0 as (select name, page_id, slug, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) as sim from ng, pg where len(g) > 0 and len(h) > 0),
fz as (select name, slug as fuzzy from f0 where sim >= 0.55 qualify row_number() over (partition by name order by sim desc, slug) = 1),
tl as (select split_part(slug, '/', 3) as made, slug as tail from pages left join d using (page_id) qualify row_number() over (partition by split_part(slug, '/', 3) order by coalesce(degree, 0) desc, slug) = 1)
select mm.name, coalesce(p.slug, fuzzy, tail, mm.made) as slug, case when p.slug is not null then 'exact' when fuzzy is not null then 'fuzzy' when tail is not null then 'expanded' else 'made' end as how
from mm left join pages p on p.slug = mm.name left join fz on fz.name = mm.name left join tl on tl.made = mm.made""")
def resolve_entities(v: Views):
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.col("slug")).when(k == 1, F.col("title")).when(k == 2, F.concat(F.lit(" "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("Nobody "), F.col("page_id").cast("string")))
    m = v.pages().where(~F.col("deleted")).select(name.alias("name"))
    l = v.links()
    degree = l.select(F.col("from_page_id").alias("page_id")).unionByName(l.select(F.col("to_page_id").alias("page_id"))).groupBy("page_id").agg(F.count("*").alias("degree"))
    return J.resolve_entities(m, v.pages(), degree)


@query("", "select distinct c_custkey as k from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1997-01-01')")
def tombstones(v: Views):
    return J.tombstones(v.raw("customer").select(F.col("c_custkey").alias("k")), v.raw("orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("k")), "k")


@query("pages", "select slug, 'main' as source_id from pages where source_id = 'src3'")
def misrouted(v: Views):
    return J.misrouted(v.pages().select("slug", F.lit("main").alias("source_id")), v.pages(), "src3")


_RESULTS = LEXICAL + """, res as (select query_id, page_id, max(score) as score from lex group by all), top as (select *, row_number() over (partition by query_id order by score desc, page_id) as r from res qualify r <= 20),
results as (select query_id, page_id, source_id, score, r from top join pages using (page_id))"""


def results(v: Views, k: int = 20):
    best = lexical(v).groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return J.top_k(best, k, ("query_id",), F.desc("score"), "page_id").join(v.pages().select("page_id", "source_id"), "page_id")


@query("questions postings pages links", f"""with {_RESULTS}, n as (select b.query_id, b.page_id, count(distinct a.page_id) as n_in, count(distinct case when a.source_id <> b.source_id then a.page_id end) as n_cross
 from results a join links on from_page_id = a.page_id join results b on b.page_id = to_page_id and b.query_id = a.query_id group by all)
select query_id, page_id, coalesce(n_in, 0) as n_in, coalesce(n_cross, 0) as n_cross from results left join n using (query_id, page_id)""")
def adjacency_within_topk(v: Views):
    return J.adjacency_in_results(results(v), v.links())


@query("questions postings pages", f"with {_RESULTS} select a.query_id, a.page_id as a, b.page_id as b, round(a.score + b.score, 6) as score from results a join results b on a.query_id = b.query_id and a.page_id < b.page_id where a.r <= 5 and b.r <= 5")
def result_pairs(v: Views):
    return J.result_pairs(results(v, 5))


@query("questions postings chunks takes", f"with {LEXICAL} select query_id, chunk_id, take_id, round(score + 1, 6) as score from lex join takes using (page_id) where active and rank <= 20")
def chunk_take_pairs(v: Views):
    return J.chunk_take_pairs(lexical(v).where(F.col("rank") <= 20), v.takes())


@query("links", "select distinct from_page_id as a, to_page_id as b from links l where from_page_id <> to_page_id and not exists (select 1 from links m where m.from_page_id = l.to_page_id and m.to_page_id = l.from_page_id)")
def backlink_gaps(v: Views):
    return J.backlink_gaps(v.links().select(F.col("from_page_id").alias("a"), F.col("to_page_id").alias("b")))


@query("vectors", """with d as (select vec_id, v, date '2023-12-15' + cast(vec_id % 60 as int) as created, vec_id % 7 <> 0 as fresh from vectors), a as (select * from d where created < date '2024-01-20' and fresh and datediff('day', created, date '2024-02-01') <= 30),
s as (select q.vec_id as query_id, a.vec_id as id, round(list_dot_product(q.v, a.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(a.v, a.v))), 9) as sim from d q, a where q.created >= date '2024-01-20')
select query_id, id as answered_id, round(sim, 6) as sim from (select * from s qualify row_number() over (partition by query_id order by sim desc, id) = 1) where round(sim, 6) > 0.3""")
def match_repeat_queries(v: Views):
    """Questions since a day against those answered before it; every vector is one or the other."""
    k = F.col("vec_id")
    d = v.vectors().select(k.alias("query_id"), "v", F.date_add(F.lit("2023-12-15").cast("date"), (k % 60).cast("int")).alias("created"), (k % 7 != 0).alias("fresh"))
    day = F.lit("2024-01-20").cast("date")
    return J.repeat_queries(d.where(F.col("created") >= day).select("query_id", "v"), d.where(F.col("created") < day), F.lit(NOW).cast("date"), 0.3)


@query("facts vectors", """with f as (select fact_id, entity_slug, case when fact_id % 4 <> 0 then v end as v, row_number() over (partition by entity_slug order by valid_from, fact_id) as n from facts join vectors using (vec_id) where not expired),
s as (select a.fact_id, b.fact_id as other_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) as sim from f a join f b on a.entity_slug = b.entity_slug and a.fact_id <> b.fact_id where a.v is not null and b.v is not null)
select a.fact_id, b.fact_id as other_id, cast(a.n - b.n as int) as rank from f a join f b on a.entity_slug = b.entity_slug and b.n between a.n - 5 and a.n - 1 where a.v is null
union all select fact_id, other_id, rank from (select *, cast(row_number() over (partition by fact_id order by sim desc, other_id) as int) as rank from s) where rank <= 5""")
def duplicate_fact_candidates(v: Views):
    """Facts with a vector by that, a fourth of them, taken to have none, by recency."""
    f = v.facts().join(v.vectors(), "vec_id").withColumn("v", F.when(F.col("fact_id") % 4 != 0, F.col("v")))
    return J.duplicate_fact_candidates(f)


@query("facts", """select entity_slug, claim_metric, arg_max(claim_value, (valid_from, fact_id)) as claim_value from facts where valid_from <= timestamp '2024-01-15' and not expired group by all""")
def as_of_facts(v: Views):
    return J.as_of_facts(v.facts(), F.lit("2024-01-15").cast("timestamp_ntz"))


@query("facts", """with l as (select fact_id, entity_slug, valid_from as t from facts where claim_metric = 'purchase'), r as (select entity_slug, valid_from as t, max(claim_value) as view_value from facts where claim_metric = 'view' group by all)
select fact_id, l.t, view_value from l asof left join r on l.entity_slug = r.entity_slug and l.t >= r.t""")
def as_of_join(v: Views):
    f = v.facts()
    l = f.where(F.col("claim_metric") == "purchase").select("fact_id", "entity_slug", F.col("valid_from").alias("t"))
    r = f.where(F.col("claim_metric") == "view").groupBy("entity_slug", F.col("valid_from").alias("t")).agg(F.max("claim_value").alias("view_value"))
    return J.as_of_join(l, r, "entity_slug", "t", "t", "view_value").select("fact_id", "t", "view_value")


@query("", """with w as (select doc_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents), g as (select w, len(w) as n, min(id) as rep from w where len(w) > 0 group by w),
t as (select rep, n, unnest(w) as t from g), s as (select a.rep as a, b.rep as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from t a join t b on a.t = b.t and a.rep < b.rep and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 group by 1, 2)
select a, b, round(c / (na + nb - c), 6) as sim from s where round(c / (na + nb - c), 6) >= 0.85 union all select rep, id, 1.0 from w join g using (w) where id <> rep""")
def near_duplicate_docs(v: Views):
    return J.word_jaccard_pairs(v.raw("documents").select(F.col("doc_id").alias("id"), "text"))


@query("", """with n as (select o_orderkey as id, ' C' || o_custkey || ' Trading Company' as company, o_orderdate as day, o_totalprice as amount from orders),
e as (select lower(substring(trim('c' || o_custkey || ' trading company'), 1, 15)) as c, o_orderdate as day, o_totalprice * case o_orderkey % 3 when 0 then 1.005 when 1 then 1.5 else 1.0 end as other from orders where o_orderdate < timestamp '1996-01-01')
select id, case min(case when other is null then 2 when abs(amount - other) <= 0.01 * abs(other) then 0 else 1 end) when 0 then 'duplicate' when 1 then 'different_amount' else 'new' end as status
from n left join e on e.c = lower(substring(trim(company), 1, 15)) and e.day = n.day group by id""")
def tracker_duplicates(v: Views):
    """All orders against those known by a day, whose amounts were written down with small and large errors."""
    o = v.raw("orders").withColumn("day", F.col("o_orderdate")).withColumn("amount", F.col("o_totalprice"))
    name = lambda a, b: F.concat(F.lit(a), F.col("o_custkey").cast("string"), F.lit(b))
    wrong = F.when(F.col("o_orderkey") % 3 == 0, 1.005).when(F.col("o_orderkey") % 3 == 1, 1.5).otherwise(1.0)
    n = o.select(F.col("o_orderkey").alias("id"), name(" C", " Trading Company").alias("company"), "day", "amount")
    e = o.where(F.col("day") < F.lit("1996-01-01").cast("timestamp_ntz")).select(name("c", " trading company").alias("company"), "day", (F.col("amount") * wrong).alias("amount"))
    return J.tracker_duplicates(n, e)


@query("", """with s as (select 'sym' || p_partkey % 1500 as name, count(*) as n, min(p_partkey) as m from part group by 1)
select l_orderkey * 10 + l_linenumber as edge_id, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as outcome, case when n = 1 then m end as to_chunk_id
from lineitem left join s on s.name = 'sym' || l_partkey""")
def resolve_edges(v: Views):
    e = v.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.concat(F.lit("sym"), F.col("l_partkey").cast("string")).alias("name"))
    s = v.raw("part").select(F.concat(F.lit("sym"), (F.col("p_partkey") % 1500).cast("string")).alias("name"), F.col("p_partkey").alias("chunk_id"))
    return J.resolve_edges(e, s)


@query("", "select distinct l_orderkey, l_suppkey from lineitem where (l_orderkey, l_suppkey) not in (select l_orderkey, l_suppkey from lineitem where l_linenumber = 1)")
def repeat_exclusion(v: Views):
    l = v.raw("lineitem")
    return J.repeat_exclusion(l.select("l_orderkey", "l_suppkey"), l.where(F.col("l_linenumber") == 1), ("l_orderkey", "l_suppkey"))


@query("", rf"""with o as (select o_orderkey as k, cast(o_orderdate as date) as d, cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as b from orders),
t as (select k, case k % 8 when 0 then 'On ' || d || ' it was.' when 1 then 'Seen ' || strftime(d, '%Y/%m/%d') || chr(10) || chr(10) || ' and once in 1992' when 2 then 'By ' || strftime(d, '%B %-d, %Y') || '.' when 3 then 'In ' || strftime(d, '%b. %Y') when 4 then 'Since Q' || quarter(d) || ' ' || year(d) when 5 then 'The year ' || year(d) || ', no. 12345' when 6 then d || ' and ' || b else 'undated' end as a_text,
 coalesce('was ' || b || case when k % 11 = 0 then chr(10) || ' ' || chr(10) || 'back to 1990-01-01' when k % 13 = 0 then ' or 1991-02-03' else '' end, 'never') as b_text, k % 5 = 0 as known from o),
m as (select k, 'a' as side, p, unnest(regexp_extract_all(p, '{{any}}')) as m from (select k, unnest(string_split_regex(a_text, '
\s*
')) as p from t) union all select k, 'b', p, unnest(regexp_extract_all(p, '{{any}}')) from (select k, unnest(string_split_regex(b_text, '
\s*
')) as p from t)),
n as (select *, regexp_matches(m, '^\d{{{{4}}}}[-/]\d{{{{2}}}}[-/]\d{{{{2}}}}$') as num, case when regexp_matches(m, '^[A-PR-Z]') then list_position({list(D.MONTHS)}, substring(m, 1, 3)) end as mon from m),
y as (select *, cast(case when num then substring(m, 1, 4) else right(m, 4) end as int) as y, case when num then cast(substring(m, 6, 2) as int) when mon is not null then mon else 1 end as mo, case when num then cast(substring(m, 9, 2) as int) else coalesce(try_cast(regexp_extract(m, '\s(\d{{{{1,2}}}}),?\s', 1) as int), 1) end as dd from n),
day as (select k, side, p, cast(make_date(y, 1, 1) + to_months(cast(mo - 1 as int)) + to_days(dd - 1) as date) as day from y where y between 1900 and 2100),
two as (select distinct k from (select k from day group by k, side, p having count(distinct day) >= 2)),
top as (select k, max(day) filter (where side = 'a') as a, max(day) filter (where side = 'b') as b from day group by k),
r as (select t.k as o_orderkey, case when two.k is not null then 'same_paragraph_dual_date' when known then 'both_have_effective_date' when a is null or b is null then 'one_or_both_missing_dates' when abs(datediff('day', a, b)) > 30 then 'both_explicit_separated' else 'overlapping_or_close' end as reason from t left join two using (k) left join top using (k))
select o_orderkey, reason, reason = 'both_explicit_separated' as skip from r""".replace("{any}", D.ANY).replace("{{", "{").replace("}}", "}"))
def date_mismatch_skip(v: Views):
    """Every order's day against that of the customer's order before, written in all forms, some in two paragraphs or twice in one, a fifth with effective dates."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("date")
    o = v.raw("orders").select(k, d.alias("d"), before.alias("b"))
    told = lambda form: F.date_format("d", form)
    forms = [
        F.concat(F.lit("On "), told("yyyy-MM-dd"), F.lit(" it was.")), F.concat(F.lit("Seen "), told("yyyy/MM/dd"), F.lit("\n\n and once in 1992")), F.concat(F.lit("By "), told("MMMM d, yyyy"), F.lit(".")), F.concat(F.lit("In "), told("MMM'.' yyyy")),
        F.concat(F.lit("Since Q"), F.quarter("d").cast("string"), F.lit(" "), told("yyyy")), F.concat(F.lit("The year "), told("yyyy"), F.lit(", no. 12345")), F.concat(told("yyyy-MM-dd"), F.lit(" and "), F.col("b").cast("string")), F.lit("undated"),
    ]
    rest = F.when(k % 11 == 0, "\n \nback to 1990-01-01").when(k % 13 == 0, " or 1991-02-03").otherwise("")
    known = F.when(k % 5 == 0, F.lit("2020-01-01"))
    p = o.select(k, F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("a_text"), F.coalesce(F.concat(F.lit("was "), F.col("b").cast("string"), rest), F.lit("never")).alias("b_text"), known.alias("a_effective"), known.alias("b_effective"))
    return J.date_mismatch(p).select("o_orderkey", "reason", "skip")


@query("pages links", "select from_page_id, count(*) as n from links where to_page_id not in (select page_id from pages where not deleted) group by 1")
def dead_links_by_page(v: Views):
    return dead_links(v.pages(), v.links()).groupBy("from_page_id").agg(F.count("*").alias("n"))


@query("pages", "select page_id, slug from pages where starts_with(slug, 'en/src1/') and not deleted")
def prefix_scan(v: Views):
    return v.pages().where(C.visible(F.col("deleted")) & F.col("slug").startswith("en/src1/")).select("page_id", "slug")


_COS = "list_dot_product(q.v, t.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(t.v, t.v)))"
#: What take_hits finds, as `taken`; to be filled with the queries and what holders are allowed.
TAKES = """tq as ({queries}), ta as (select take_id, claim, holder, weight, v from takes join vectors using (vec_id) where active and {where}),
""" + f"""tg as (select query_id, {_TRI.format('text')} as g from tq), th as (select take_id, weight, {_TRI.format('claim')} as h from ta),
ts as (select query_id, take_id, weight, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) as score from tg, th where len(g) > 0 and len(h) > 0),
tl as (select query_id, take_id, row_number() over (partition by query_id order by score desc, weight desc, take_id) as r from ts where score > 0.3 qualify r <= 30),
tv as (select query_id, take_id, row_number() over (partition by query_id order by round({_COS}, 9) desc, take_id) as r from tq q, ta t qualify r <= 30),
tf as (select query_id, take_id, round(sum(part), 9) as score from (select query_id, take_id, 1.0 / (60 + r - 1) as part from tl union all select query_id, take_id, 1.0 / (60 + r - 1) from tv) group by all),
taken as (select *, row_number() over (partition by query_id order by score desc, take_id) as rank from tf qualify rank <= 30)""".replace("{", "{{").replace("}", "}}")


def take_hits(v: Views, asked, holders=None):
    return R.take_search(asked, v.takes().join(v.vectors(), "vec_id"), holders=holders)


@query("takes questions vectors", f"""with {TAKES.format(queries="select take_id as query_id, claim as text, v from takes join vectors using (vec_id)", where="holder in ('src1', 'src2', 'src3', 'src5', 'src8')")} select query_id, take_id, score, rank from taken""")
def take_search(v: Views):
    """Takes like each take, active or not, of five holders."""
    asked = v.takes().join(v.vectors(), "vec_id").select(F.col("take_id").alias("query_id"), F.col("claim").alias("text"), "v")
    holders = v.spark.createDataFrame([("src1",), ("src2",), ("src3",), ("src5",), ("src8",)], "holder string")
    return take_hits(v, asked, holders)
