"""Queries: reviews and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from ..operators import reports as R
from ..sources import corpus as SRC
from .corpus import _FACTOR, FACTORS
from .joined import _RESULTS, LEXICAL, TAKES, lexical, results, take_hits
from .registry import query
from .streams import _folder
from .views import Views


@query("", """select 'sym' || p_partkey % 50 as symbol_name, case p_size % 4 when 0 then 'function' when 1 then 'class' when 2 then 'method' end as symbol_type, p_partkey as chunk_id, cast(case p_size % 4 when 0 then 1 when 1 then 2 else 6 end as bigint) as priority
from part where p_partkey % 50 in (3, 7) and p_size % 4 < 3""")
def symbol_defs(v: Views):
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "function").when(k == 1, "class").when(k == 2, "method").otherwise("comment")
    c = v.raw("part").select(F.concat(F.lit("sym"), (F.col("p_partkey") % 50).cast("string")).alias("symbol_name"), kind.alias("symbol_type"), F.col("p_partkey").alias("chunk_id"))
    return R.symbol_defs(c, ["sym3", "sym7"])


@query("chunks", """select chunk_id, 'LICENSE' as term from chunks where contains(lower(chunk_text), 'license') union all select chunk_id, 'token' from chunks where contains(lower(chunk_text), 'token')""")
def substring_refs(v: Views):
    return R.substring_refs(v.chunks(), ["LICENSE", "token"])


@query("", """select o_orderkey as candidate_id, n_name as source_name, (select count(*) from orders) as total, o_totalprice >= 0.8 and o_orderkey % 3 = 0 as unexplained
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = o_custkey % 30 order by o_orderdate desc, o_orderkey desc limit 50 offset 20""")
def review_queue(v: Views):
    o = v.raw("orders")
    c = o.select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_custkey") % 30).alias("source_id"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("confidence"), F.when(F.col("o_orderkey") % 3 != 0, "because").alias("rationale"))
    s = v.raw("nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    return R.review_queue(c, s, 50, 20)


_TIER = f"case when {_FACTOR} > 1.05 then 'curated' when {_FACTOR} < 0.95 then 'bulk' else 'other' end"


@query("pages links", f"""with t as (select page_id, {_TIER} as t from pages), r as (select *, case t when 'curated' then 0 when 'other' then 1 else 2 end as k from t)
select case when a.k <= b.k then a.t || 'x' || b.t else b.t || 'x' || a.t end as tiers, count(*) as n from links join r a on a.page_id = from_page_id join r b on b.page_id = to_page_id group by 1""")
def source_tier_breakdown(v: Views):
    s = v.pages().select("page_id", "slug")
    p = v.links().join(s.select(F.col("page_id").alias("from_page_id"), F.col("slug").alias("a")), "from_page_id").join(s.select(F.col("page_id").alias("to_page_id"), F.col("slug").alias("b")), "to_page_id")
    return R.tier_pairs(p, F.col("a"), F.col("b"), FACTORS)


@query("links", """with f as (select from_page_id as a, to_page_id as b, (from_page_id * 7 + to_page_id) % 5 as severity from links) select page_id, count(*) as n, max(severity) as severity
from (select a as page_id, severity from f union all select b, severity from f where a <> b) group by 1 order by n desc, severity desc, page_id limit 10""")
def hot_pages(v: Views):
    return R.hot_pages(v.links().select(F.col("from_page_id").alias("a"), F.col("to_page_id").alias("b"), ((F.col("from_page_id") * 7 + F.col("to_page_id")) % 5).alias("severity")))


@query("takes", """with g as (select holder, count(*) as n, count(*) filter (where resolved_quality = 'correct') as k from takes group by 1), w as (select *, 1.959963984540054 as z, k / n as p from g)
select holder, n, k, round(case when k = 0 then 0.0 else greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p * (1 - p) / n + z*z / (4*n*n))) end, 6) as low,
 round(case when k = n then 1.0 else least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p * (1 - p) / n + z*z / (4*n*n))) end, 6) as high from w""")
def wilson_interval(v: Views):
    return R.share_with_interval(v.takes(), "holder", F.col("resolved_quality") == "correct")


@query("", "select cast(ts as date) as day, count(*) as runs, round(avg(value), 6) as mean from events where ts > date '2024-01-25' - 14 and ts <= date '2024-01-25' group by 1")
def quality_trend(v: Views):
    return R.trend(v.raw("events").select(F.col("ts").alias("at"), "value"), F.lit("2024-01-25").cast("date"), 14)


@query("", """with v as (select user_id % 9 as arm, case event_type when 'click' then 'win' when 'view' then 'loss' else 'tie' end as o from events), g as (select arm, count(*) filter (where o = 'win') as wins, count(*) filter (where o = 'loss') as losses, count(*) filter (where o = 'tie') as ties from v group by 1)
select *, round(wins / (wins + losses), 6) as win_rate, wins + losses >= 20 and wins / (wins + losses) < 0.45 as net_negative from g""")
def ab_report(v: Views):
    o = F.when(F.col("event_type") == "click", "win").when(F.col("event_type") == "view", "loss").otherwise("tie")
    return R.ab_report(v.raw("events").select((F.col("user_id") % 9).alias("arm"), o.alias("outcome")))


_MSG = "case event_id % 6 when 0 then 'request timed out' when 1 then 'HTTP 403 Forbidden' when 2 then '429: slow down' when 3 then 'malformed row' when 4 then 'page not found' else 'disk full' end"


def _log(v: Views):
    k = F.col("event_id") % 6
    m = F.when(k == 0, "request timed out").when(k == 1, "HTTP 403 Forbidden").when(k == 2, "429: slow down").when(k == 3, "malformed row").when(k == 4, "page not found").otherwise("disk full")
    return v.raw("events").select("event_id", m.alias("message"), (F.col("user_id") % 7).alias("source_id"), F.concat(F.col("event_type"), F.lit(": "), m).alias("summary"), F.col("ts").alias("at"))


@query("", "select case event_id % 6 when 0 then 'timeout' when 1 then 'auth' when 2 then 'rate_limit' when 3 then 'parse' when 4 then 'missing' else 'other' end as class, count(*) as n from events group by 1")
def failure_breakdown(v: Views):
    return R.failure_breakdown(_log(v))


@query("", "select user_id % 7 as source_id, event_type as reason, count(*) as n from events where ts >= timestamp '2024-01-29' group by all")
def extraction_failures(v: Views):
    return R.extraction_failures(_log(v), F.lit("2024-01-29").cast("timestamp_ntz"))


@query("questions postings pages", f"""with {_RESULTS} select query_id, text as query, array_to_string(list(page_id order by r), ',') as ids, date '2024-01-01' - cast(query_id % 150 as int) as created from results join questions using (query_id)
where datediff('day', date '2024-01-01' - cast(query_id % 150 as int), date '2024-01-10') <= 90 group by query_id, text""")
def retrieval_log(v: Views):
    q = v.questions().withColumn("created", F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("query_id") % 150).cast("int")))
    out = R.retrieval_log(results(v), q, F.lit("2024-01-10").cast("date"))
    return out.select("query_id", "query", F.array_join(F.col("page_ids").cast("array<string>"), ",").alias("ids"), "created")


@query("questions postings pages", f"""with {LEXICAL}, t as (select query_id, page_id, chunk_id, score, coalesce(type, 'none') as type from lex join pages using (page_id)),
a as (select *, row_number() over (partition by query_id, page_id order by score desc, chunk_id) as p from t), b as (select *, count(*) over (partition by query_id) as n from a where p <= 3),
c as (select *, row_number() over (partition by query_id, type order by score desc, chunk_id) as k from b) select query_id, page_id, chunk_id, score, type from c where k <= ceil(n * 0.4 - 1e-9) and p <= 2""")
def diversified_results(v: Views):
    h = lexical(v).drop("rank").join(v.pages().select("page_id", F.coalesce("type", F.lit("none")).alias("type")), "page_id")
    return R.diversified(h, share=0.4)


@query("questions postings pages links takes facts vectors", f"""with {_RESULTS}, {TAKES.format(queries="select query_id, text, v from questions join vectors using (vec_id)", where="true")}, p as (select query_id, page_id, r from results where r <= 5),
e as (select from_page_id as a, to_page_id as b from links union select to_page_id, from_page_id from links), g1 as (select distinct query_id, b as page_id from p join e on a = page_id where not exists (select 1 from p q where q.query_id = p.query_id and q.page_id = b)),
g2 as (select distinct query_id, b as page_id from g1 join e on a = page_id where not exists (select 1 from p q where q.query_id = g1.query_id and q.page_id = b) and not exists (select 1 from g1 h where h.query_id = g1.query_id and h.page_id = b))
select query_id as question_id, 'pages' as stream, cast(page_id as varchar) as item, cast(r as bigint) as rank from p
union all select query_id, 'takes', cast(take_id as varchar), rank from taken
union all select query_id, 'graph', cast(page_id as varchar), 1 from g1 union all select query_id, 'graph', cast(page_id as varchar), 2 from g2
union all select query_id, 'trajectory', cast(fact_id as varchar), n from (select query_id, fact_id, row_number() over (partition by query_id order by valid_from, fact_id) as n from questions join facts on entity_slug = 'user/' || query_id where not expired) where n <= 100""")
def context_bundle(v: Views):
    """Pages, takes, links within two steps in either direction (their rank is the step) and the entity's points."""
    r = results(v, 5).select(F.col("query_id").alias("question_id"), "page_id", "rank")
    asked = v.questions().join(v.vectors(), "vec_id").select("query_id", "text", "v")
    t = take_hits(v, asked).withColumnRenamed("query_id", "question_id")
    g = G.neighbourhood(v.links(), r.select(F.col("question_id").alias("key"), "page_id")).select(F.col("key").alias("question_id"), "page_id", F.col("depth").alias("rank"))
    q = v.questions().select(F.col("query_id").alias("question_id"), F.concat(F.lit("user/"), F.col("query_id").cast("string")).alias("entity_slug"))
    f = J.top_k(v.facts().where(~F.col("expired")).join(q, "entity_slug"), 100, ("question_id",), "valid_from", "fact_id")
    return R.context_bundle(r, t, g, f)


@query("pages", r"""select 'source_id=' || source_id || '/page_id=' || page_id as folder, 'note' as type, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') as title, md5(trim('# ' || regexp_replace(title, '\s+', ' ', 'g') || chr(10) || chr(10) || compiled_truth, chr(32) || chr(10) || chr(13) || chr(9))) as body,
 '- **' || updated_on || '** | seen' as timeline from pages""")
def read_corpus(v: Views):
    """Every page as a file of its own, with its whole text and a timeline, read back as whole files."""
    at = _folder(v)
    text = F.concat(F.lit("# "), F.regexp_replace("title", r"\s+", " "), F.lit("\n\n"), "compiled_truth", F.lit("\n\n## Timeline\n\n- **"), F.col("updated_on").cast("string"), F.lit("** | seen"))
    v.pages().select("source_id", "page_id", text.alias("value")).repartition("source_id", "page_id").write.partitionBy("source_id", "page_id").text(at)
    got = SRC.read_corpus(v.spark, at, "*.txt")
    return got.select(F.regexp_extract("slug", "(source_id=[^/]+/page_id=[^/]+)/", 1).alias("folder"), "type", F.trim("title").alias("title"), F.md5("compiled_truth").alias("body"), "timeline")


@query("takes vectors", "select take_id from takes where vec_id not in (select vec_id from vectors where vec_id % 3 <> 0)")
def stale_takes(v: Views):
    have = v.vectors().where(F.col("vec_id") % 3 != 0).select("vec_id")
    return v.takes().join(have, "vec_id", "left_anti").select("take_id")
