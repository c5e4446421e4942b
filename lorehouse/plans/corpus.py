"""Queries: table maintenance, listings, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import storage as S
from .registry import query
from .views import NOW, Views



def _day():
    return F.lit(NOW).cast("date")

#: A corpus of languages and sources stands in for the directories of the default rules.
FACTORS = {"en/": 1.4, "en/src1/": 0.8, "de/": 1.2, "de/src5/": 0.5, "fr/": 1.0}
DECAY = {"en/": (14, 1.5), "en/src1/": (0, 0.0), "de/": (60, 1.0), "fr/": (365, 0.3)}
_FACTOR = "case when slug like 'en/src1/%' then 0.8 when slug like 'de/src5/%' then 0.5 when slug like 'en/%' then 1.4 when slug like 'de/%' then 1.2 else 1.0 end"


def _hashed(v: Views):
    return v.pages().withColumn("content_hash", C.content_hash(F.col("title"), F.col("type"), F.col("compiled_truth")))


def _incoming(v: Views):
    """A later state: every seventh page retitled, every eleventh gone, some new."""
    p = _hashed(v).where(F.col("page_id") % 11 != 0)
    changed = p.withColumn("title", F.when(F.col("page_id") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    new = p.where(F.col("page_id") % 50 == 1).withColumn("slug", F.concat("slug", F.lit("-new"))).withColumn("page_id", F.col("page_id") + 1000000)
    out = changed.unionByName(new)
    return out.withColumn("content_hash", C.content_hash(F.col("title"), F.col("type"), F.col("compiled_truth")))


_HASH = "sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(type, ''), coalesce(compiled_truth, '')))"
_OLD_NEW = f"""with o as (select *, {_HASH} as h from pages),
n0 as (select * exclude (title), case when page_id % 7 = 0 then title || '!' else title end as title from pages where page_id % 11 <> 0
       union all by name select * exclude (slug, page_id), slug || '-new' as slug, page_id + 1000000 as page_id from pages where page_id % 11 <> 0 and page_id % 50 = 1),
n as (select *, {_HASH} as h from n0)
"""


@query("pages", f"select page_id, {_HASH} as content_hash from pages")
def content_hashes(v: Views):
    return _hashed(v).select("page_id", "content_hash")


@query("pages", _OLD_NEW + """select coalesce(n.slug, o.slug) as slug,
  case when n.slug is null then 'keep' when o.slug is null then 'insert' when o.h = n.h then 'skip' else 'update' end as change,
  case when n.slug is null or o.h = n.h then o.title else n.title end as title
from o full join n on o.slug = n.slug and o.source_id = n.source_id""")
def upsert_pages(v: Views):
    return S.upsert_pages(_hashed(v), _incoming(v)).select("slug", "change", "title")


@query("pages", _OLD_NEW + """, b as (select o.slug as ok, o.h as oh, n.slug as nk, n.h as nh from o full join n on o.slug = n.slug),
g as (select ok, oh, row_number() over (partition by oh order by ok) as r from b where nk is null),
c as (select nk, nh, row_number() over (partition by nh order by nk) as r from b where ok is null)
select coalesce(nk, ok) as slug, case when ok is null then 'added' when nk is null then 'deleted' else 'renamed' end as change, case when nk is not null then ok end as old_key
from g full join c on g.oh = c.nh and g.r = c.r
union all select nk, 'modified', null from b where ok is not null and nk is not null and oh <> nh""")
def diff_snapshots(v: Views):
    return S.diff_snapshots(_hashed(v), _incoming(v))


def _dated(v: Views):
    at = F.when(F.col("deleted"), F.to_timestamp_ntz(F.col("updated_on").cast("string")))
    return v.pages().select("page_id", "slug", at.alias("deleted_at"))


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@query("pages", """select page_id, case when page_id % 10 = 3 then null when deleted then cast(updated_on as timestamp) when page_id % 17 = 0 then timestamp '2024-01-20' end as deleted_at
from pages where (page_id % 10 = 3 or not deleted or cast(updated_on as timestamp) > timestamp '2024-01-20' - interval 72 hours)""")
def soft_delete_restore_purge(v: Views):
    p = S.soft_delete(_dated(v), F.col("page_id") % 17 == 0, _now())
    return S.purge(S.restore(p, F.col("page_id") % 10 == 3), 72, _now()).select("page_id", "deleted_at")


@query("pages", """select page_id, title, timestamp '2024-01-02' as snapshot_at from pages where page_id % 7 = 0""")
def snapshot_versions(v: Views):
    before = v.pages()
    after = before.withColumn("title", F.when(F.col("page_id") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return S.snapshot_versions(before, after, "page_id", "title", F.lit("2024-01-02").cast("timestamp_ntz"))


@query("facts", """select entity_slug, claim_value, valid_from from (
  select *, row_number() over (partition by entity_slug order by valid_from desc, fact_id desc) as n from facts) where n = 2""")
def revert_to(v: Views):
    f = v.facts().withColumn("at", F.struct("valid_from", "fact_id"))
    return S.revert_to(f, "entity_slug", 2, "at").select("entity_slug", "claim_value", "valid_from")


@query("chunks", """select page_id, chunk_index, case when chunk_index % 3 <> 0 then vec_id end as embedding from chunks where chunk_index % 5 <> 4""")
def replace_chunks(v: Views):
    old = v.chunks().withColumn("embedding", F.col("vec_id"))
    text = F.when(F.col("chunk_index") % 3 == 0, F.concat("chunk_text", F.lit("!"))).otherwise(F.col("chunk_text"))
    new = old.where(F.col("chunk_index") % 5 != 4).withColumn("chunk_text", text)
    return S.replace_chunks(old, new).select("page_id", "chunk_index", "embedding")


@query("links pages", """select distinct from_page_id, to_page_id, link_type || '2' as link_type from links
where from_page_id in (select page_id from pages) and to_page_id in (select page_id from pages)""")
def append_dedup_links(v: Views):
    slug = v.pages().select("page_id", "slug")
    named = v.links().join(slug.withColumnRenamed("page_id", "from_page_id").withColumnRenamed("slug", "from_slug"), "from_page_id").join(slug.withColumnRenamed("page_id", "to_page_id").withColumnRenamed("slug", "to_slug"), "to_page_id")
    named = named.select("from_slug", "to_slug", F.concat("link_type", F.lit("2")).alias("link_type"))
    return S.append_links(v.links(), named.unionByName(named), slug)


@query("pages tags", """select page_id, slug, updated_on from pages where not deleted and type = 'concept' and updated_on > date '2024-01-10' and slug like 'en/%'
  and page_id in (select page_id from tags where tag = 'src:src4' or tag = 'src:src5') order by updated_on desc, slug limit 25 offset 5""")
def list_pages(v: Views):
    tags = v.tags().where(F.col("tag").isin("src:src4", "src:src5"))
    return S.list_pages(v.pages(), "concept", "2024-01-10", "en/", tags=tags, limit=25, offset=5).select("page_id", "slug", "updated_on")


@query("pages", f"""select page_id, {_FACTOR} as factor, case when {_FACTOR} > 1.05 then 'curated' when {_FACTOR} < 0.95 then 'bulk' else 'other' end as tier,
  case when slug like 'en/src1/%' then 0.0 when slug like 'en/%' then 1.5 * 14 / (14 + datediff('day', updated_on, date '{NOW}'))
       when slug like 'de/%' then 1.0 * 60 / (60 + datediff('day', updated_on, date '{NOW}')) when slug like 'fr/%' then 0.3 * 365 / (365 + datediff('day', updated_on, date '{NOW}'))
       else 0.5 * 90 / (90 + datediff('day', updated_on, date '{NOW}')) end as recency
from pages where not deleted and not (slug like 'es/%')""")
def page_factors(v: Views):
    p = v.pages().where(C.visible(F.col("deleted")) & ~C.hard_excluded(F.col("slug"), ("es/",)))
    return p.select("page_id", C.source_factor(F.col("slug"), FACTORS).alias("factor"), C.source_tier(F.col("slug"), FACTORS).alias("tier"), C.recency(F.col("slug"), F.col("updated_on"), _day(), DECAY).alias("recency"))


@query("facts", f"""select fact_id, round(case when expired then 0.0 else least(1, greatest(0, confidence * exp(-(epoch(timestamp '{NOW}') - epoch(valid_from)) / 86400.0 /
  case kind when 'event' then 7.0 when 'commitment' then 90.0 when 'preference' then 90.0 else 365.0 end))) end, 6) as effective from facts""")
def effective_confidence(v: Views):
    value = C.effective_confidence(F.col("confidence"), F.col("kind"), F.col("valid_from"), F.lit(NOW).cast("timestamp"), F.col("expired"))
    return v.facts().select("fact_id", F.round(value, 6).alias("effective"))


@query("pages", """select page_id, case when page_id % 4 = 0 then date '2023-05-06' when page_id % 4 = 1 then date '2022-02-03' when page_id % 4 = 2 then updated_on else date '2021-01-09' end as date,
  case page_id % 4 when 0 then 'event_date' when 1 then 'published' when 2 then 'fallback' else 'filename' end as source from pages""")
def effective_dates(v: Views):
    k = F.col("page_id") % 4
    fields = {"event_date": F.when(k == 0, "2023-05-06").when(k == 1, "1875-01-01"), "date": F.when(k == 2, "soon"), "published": F.when(k == 1, " 2022-02-03 ")}
    slug = F.when(k == 3, F.concat(F.lit("daily/"), F.col("slug"))).otherwise(F.col("slug"))
    name = F.when(k == 3, "2021-01-09-notes.md").otherwise("notes.md")
    e = C.effective_date(slug, name, fields, F.col("updated_on"), F.col("updated_on"), _day())
    return v.pages().select("page_id", e.alias("e")).select("page_id", "e.date", "e.source")


@query("", """select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens, cast(len(regexp_extract_all(text, '[^\\s]+')) as bigint) as words from documents""")
def estimated_tokens(v: Views):
    return v.raw("documents").select("doc_id", C.estimated_tokens(F.col("text")).alias("tokens"), C.word_count(F.col("text")).alias("words"))


@query("pages chunks links tags vectors", """select (select count(*) from pages where not deleted) as pages, (select count(*) from chunks) as chunks,
 (select count(*) from chunks where vec_id in (select vec_id from vectors)) as embedded, (select count(*) from links) as links, (select count(distinct tag) from tags) as tags,
 (select count(*) from chunks where chunk_source = 'timeline') as timeline""")
def corpus_stats(v: Views):
    return A.corpus_stats(v.pages(), v.chunks(), v.links(), v.tags(), v.vectors())


@query("pages", "select coalesce(type, 'untyped') as type, count(*) as n from pages where not deleted group by 1")
def pages_by_type(v: Views):
    return A.pages_by_type(v.pages())


_ORPHANS = "select page_id, slug from pages where not deleted and page_id not in (select to_page_id from links where from_page_id in (select page_id from pages where not deleted))"
_DEAD = "select from_page_id, to_page_id, link_type from links where to_page_id not in (select page_id from pages where not deleted)"


@query("pages links", _ORPHANS)
def orphans(v: Views):
    return A.orphans(v.pages(), v.links())


@query("pages links", _DEAD)
def dead_links(v: Views):
    return A.dead_links(v.pages(), v.links())


_HEALTH = f"""with orphan as ({_ORPHANS}), dead as ({_DEAD}),
a as (select (select count(*) from pages where not deleted) as pages,
  (select count(*) from pages where not deleted and page_id in (select from_page_id from links union select to_page_id from links)) as linked,
  (select count(*) from pages where not deleted and page_id in (select page_id from chunks where chunk_source = 'timeline')) as timed,
  (select count(*) from orphan) as orphans, (select count(*) from chunks) as chunks, (select count(*) from chunks where vec_id in (select vec_id from vectors)) as embedded,
  (select count(*) from dead) as dead_links, (select count(*) from links) as links),
b as (select *, cast(round(35.0 * embedded / chunks) as bigint) as embed_points, cast(round(25.0 * linked / pages) as bigint) as links_points, cast(round(15.0 * timed / pages) as bigint) as timeline_points,
  cast(round(15.0 * (1 - 1.0 * orphans / pages)) as bigint) as orphans_points, cast(round(10.0 * (1 - 1.0 * dead_links / links)) as bigint) as dead_points from a),
health as (select *, embed_points + links_points + timeline_points + orphans_points + dead_points as score from b)
"""


@query("pages links chunks vectors", _HEALTH + "select * from health")
def corpus_health(v: Views):
    return A.corpus_health(v.pages(), v.chunks(), v.links(), v.vectors())


@query("pages links chunks vectors", _HEALTH + """, r as (select score, 'embed' as component, embed_points as points, 35 - embed_points as missed from health union all select score, 'links', links_points, 25 - links_points from health
 union all select score, 'timeline', timeline_points, 15 - timeline_points from health union all select score, 'orphans', orphans_points, 15 - orphans_points from health union all select score, 'dead', dead_points, 10 - dead_points from health)
select component, points, missed, cast(score + sum(missed) over (order by missed desc, component rows unbounded preceding) as bigint) as reachable from r""")
def score_gap(v: Views):
    return A.score_gap(A.corpus_health(v.pages(), v.chunks(), v.links(), v.vectors()))


@query("pages chunks vectors", """select source_id, count(distinct p.page_id) as pages, count(c.chunk_id) as chunks, count(v.vec_id) as embedded, round(coalesce(count(v.vec_id) / nullif(count(c.chunk_id), 0), 0.0), 6) as coverage
from pages p left join chunks c on c.page_id = p.page_id left join vectors v on v.vec_id = c.vec_id where not deleted group by 1""")
def source_metrics(v: Views):
    return A.source_metrics(v.pages(), v.chunks(), v.vectors())


@query("pages", """select case when grouping(source_id) = 1 then '*' else source_id end as source_id, count(type) as typed, count(*) - count(type) as untyped, round(count(type) / count(*), 4) as coverage
from pages where not deleted group by rollup (source_id)""")
def type_stats(v: Views):
    return A.type_stats(v.pages())


@query("pages", """select split_part(slug, '/', 1) as prefix, count(*) as n, array_to_string(list_sort(list_distinct(list(type))), ',') as types from pages where not deleted group by 1 having count(*) >= 5 order by n desc, prefix limit 50""")
def detect_types(v: Views):
    return A.detect_types(v.pages())


@query("pages", """select 'zz/' as prefix""")
def dead_prefixes(v: Views):
    rules = v.spark.createDataFrame([("en/",), ("de/",), ("zz/",)], "prefix string")
    return A.dead_prefixes(rules, v.pages())


@query("pages", """select page_id, slug from pages where type is null and not deleted""")
def review_untyped(v: Views):
    return v.pages().where(F.col("type").isNull() & ~F.col("deleted")).select("page_id", "slug")


@query("pages", """select page_id, case when type is not null then type when slug like 'en/src1/%' then 'memo' when slug like 'en/%' then 'essay' when slug like 'de/%' then 'bericht' end as type from pages""")
def apply_type_rules(v: Views):
    rules = {"en/": "essay", "en/src1/": "memo", "de/": "bericht"}
    return v.pages().select("page_id", F.coalesce("type", C.longest_prefix(F.col("slug"), rules, None)).alias("type"))


_WEIGHT = """with t as (select page_id, 0.5 as tag_part from tags where tag = 'loss' group by page_id),
k as (select page_id, count(*) as n, avg(least(1, greatest(0, weight))) as m, avg(case when holder = 'src3' then 1.0 else 0.0 end) as o from takes where active group by page_id),
w as (select p.page_id, round(least(1, greatest(0, coalesce(tag_part, 0) + coalesce(least(0.1 * n, 0.3) + 0.1 * m + 0.1 * o, 0))), 6) as emotional_weight from pages p left join t using (page_id) left join k using (page_id))
"""


@query("pages tags takes", _WEIGHT + "select * from w")
def emotional_weight(v: Views):
    return A.emotional_weight(v.pages(), v.tags(), v.takes(), "src3")


@query("pages tags takes", _WEIGHT + """select page_id, slug, round(5 * emotional_weight + ln(1 + coalesce(n, 0)) + 1.0 / (1 + datediff('day', updated_on, date '2024-01-20')), 6) as salience
from pages join w using (page_id) left join (select page_id, count(distinct take_id) as n from takes where active group by page_id) using (page_id)
where not deleted and datediff('day', updated_on, date '2024-01-20') between 0 and 14 order by salience desc, page_id limit 20""")
def recent_salience(v: Views):
    return A.recent_salience(v.pages(), A.emotional_weight(v.pages(), v.tags(), v.takes(), "src3"), v.takes(), F.lit("2024-01-20").cast("date"))


@query("pages tags takes", _WEIGHT + """, touched as (select page_id, slug, updated_on, cast(date '2024-01-01' + cast(page_id * 7 % 40 as int) as date) as touched_on from pages where not deleted)
select page_id, slug, round(5 * emotional_weight + ln(1 + coalesce(n, 0)) + case when slug like 'en/src1/%' then 0.0 when slug like 'en/%' then 1.5 * 14 / (14 + greatest(0, datediff('day', updated_on, date '2024-01-30'))) when slug like 'de/%' then 1.0 * 60 / (60 + greatest(0, datediff('day', updated_on, date '2024-01-30')))
  when slug like 'fr/%' then 0.3 * 365 / (365 + greatest(0, datediff('day', updated_on, date '2024-01-30'))) else 0.5 * 90 / (90 + greatest(0, datediff('day', updated_on, date '2024-01-30'))) end, 6) as salience
from touched join w using (page_id) left join (select page_id, count(distinct take_id) as n from takes where active group by page_id) using (page_id)
where datediff('day', greatest(updated_on, touched_on), date '2024-01-30') between 0 and 3 order by salience desc, page_id limit 50""")
def decayed_salience(v: Views):
    """By the decay of each prefix, over pages updated or touched in three days."""
    p = v.pages().withColumn("touched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 40).cast("int")))
    return A.recent_salience(p, A.emotional_weight(v.pages(), v.tags(), v.takes(), "src3"), v.takes(), F.lit("2024-01-30").cast("date"), 3, 50, DECAY)


@query("tags pages", """with e as (select tag as cohort, page_id, cast(updated_on as date) as d from tags join pages using (page_id) where not deleted),
c as (select cohort, d, count(distinct page_id) as n from e where d between date '2024-01-25' - 20 and date '2024-01-25' group by all),
days as (select cohort, unnest(range(1, 21)) as k from (select distinct cohort from c)),
z as (select days.cohort, coalesce(c.n, 0) as n from days left join c on c.cohort = days.cohort and c.d = date '2024-01-25' - cast(k as int)),
s as (select cohort, avg(n) as mean, stddev_samp(n) as sd from z group by 1),
t as (select s.cohort, coalesce(n, 0) as n, round(mean, 6) as mean, round(sd, 6) as sd from s left join (select cohort, n from c where d = date '2024-01-25') using (cohort))
select *, round(case when sd > 0 then (n - mean) / sd else n - mean end, 6) as sigmas from t where case when sd > 0 then n > mean + sd else n > mean + 1 end order by sigmas desc, cohort limit 20""")
def anomalies(v: Views):
    p = v.pages().where(~F.col("deleted")).select("page_id", F.col("updated_on").alias("d"))
    e = v.tags().join(p, "page_id").select(F.col("tag").alias("cohort"), "page_id", "d")
    return A.anomalies(e, "2024-01-25", 20, sigma=1.0)


_CARD = """count(*) as bets, count(*) filter (where resolved_quality in ('correct', 'incorrect', 'partial')) as resolved, count(*) filter (where resolved_quality = 'correct') as correct, count(*) filter (where resolved_quality = 'incorrect') as incorrect,
 count(*) filter (where resolved_quality = 'partial') as partial, count(*) filter (where resolved_quality = 'unresolvable') as unresolvable,
 round(avg(power(weight - r, 2)), 6) as brier, round(avg(r), 6) as accuracy, round(count(*) filter (where resolved_quality = 'partial') / nullif(count(*) filter (where resolved_quality in ('correct', 'incorrect', 'partial')), 0), 6) as partial_rate"""
_R = "(select *, case resolved_quality when 'correct' then 1.0 when 'incorrect' then 0.0 end as r from takes)"


@query("takes", f"select holder, {_CARD} from {_R} group by holder")
def scorecard(v: Views):
    return A.scorecard(v.takes())


@query("takes", f"select least(cast(floor(weight / 0.1 + 1e-9) as bigint), 9) as bin, count(*) as n, round(avg(r), 6) as observed, round(avg(weight), 6) as predicted from {_R} where r is not null group by 1")
def calibration_curve(v: Views):
    return A.calibration_curve(v.takes())


@query("takes", f"""with t as (select *, cast(page_id % 3 as varchar) as domain, power(weight - r, 2) as miss from {_R}),
a as (select holder, domain, count(miss) as n1, avg(miss) as b1 from t group by all), b as (select holder, count(miss) as n2, avg(miss) as b2 from t group by all)
select take_id, holder, domain, round(case when n1 >= 5 then b1 when n2 >= 5 then b2 end, 6) as expected_brier, case when n1 >= 5 then 'domain' when n2 >= 5 then 'holder' end as basis
from t join a using (holder, domain) join b using (holder) where active""")
def forecast(v: Views):
    return A.forecast(v.takes(), (F.col("page_id") % 3).cast("string"))


@query("facts", f"""select count(*) as total, count(*) filter (where not expired) as active, count(*) filter (where expired) as expired,
 count(*) filter (where not expired and date_diff('day', cast(valid_from as date), date '{NOW}') <= 1) as today, count(*) filter (where not expired and date_diff('day', cast(valid_from as date), date '{NOW}') <= 7) as week,
 count(distinct entity_slug) as entities from facts""")
def facts_health(v: Views):
    return A.facts_health(v.facts(), _day())


@query("facts", "select entity_slug, count(*) as n from facts where not expired group by 1 order by n desc, entity_slug limit 5")
def top_entities(v: Views):
    return A.top_entities(v.facts())


@query("facts", "select entity_slug, count(*) as n, count(*) filter (where not expired) as active from facts group by 1")
def recall_rollup(v: Views):
    return v.facts().groupBy("entity_slug").agg(F.count("*").alias("n"), F.count_if(~F.col("expired")).alias("active"))


@query("facts", """with m as (select entity_slug as entity, case when claim_metric = 'error' then 'voice' else claim_metric end as k from facts),
s as (select entity, count(*) as n, count(distinct k) as kinds, bool_or(k in ('meeting', 'voice')) as heard from m group by 1),
t as (select entity, n, kinds, cast(case when n >= 8 or heard then 1 when n >= 3 and kinds >= 2 then 2 else 3 end as bigint) as tier from s) select *, tier < 3 as escalate from t""")
def mention_tiers(v: Views):
    m = v.facts().select(F.col("entity_slug").alias("entity"), F.when(F.col("claim_metric") == "error", "voice").otherwise(F.col("claim_metric")).alias("source_kind"))
    return A.mention_tiers(m)


_SCORES = """s as (select l_orderkey as item, case when l_linenumber % 2 = 0 then 'depth' else 'truth' end as dimension, l_suppkey % 3 as rater, cast(4 + l_quantity * 7 % 7 as double) as score from lineitem)"""


def _scores(v: Views):
    l = v.raw("lineitem")
    return l.select(F.col("l_orderkey").alias("item"), F.when(F.col("l_linenumber") % 2 == 0, "depth").otherwise("truth").alias("dimension"), (F.col("l_suppkey") % 3).alias("rater"), (4 + F.col("l_quantity") * 7 % 7).cast("double").alias("score"))


@query("", f"""with {_SCORES}, d as (select item, dimension, round(avg(score), 1) as mean, min(score) as low, count(distinct rater) as raters from s group by all),
e as (select item, round(avg(mean), 6) as overall, min(raters) as raters, bool_or(mean < 7 or low < 5) as bad from d group by 1)
select item, overall, raters, case when raters < 2 then 'inconclusive' when bad then 'fail' else 'pass' end as verdict from e""")
def panel_aggregate(v: Views):
    return A.panel(_scores(v))


@query("", f"""with {_SCORES}, a as (select dimension, avg(score) as m from s where item % 2 = 0 group by 1), b as (select dimension, avg(score) as m from s where item % 2 = 1 group by 1)
select dimension, round(a.m, 6) as old_mean, round(b.m, 6) as new_mean, round(b.m - a.m, 6) as delta from a full join b using (dimension)""")
def panel_regress(v: Views):
    s = _scores(v)
    return A.panel_regress(s.where(F.col("item") % 2 == 0), s.where(F.col("item") % 2 == 1))


@query("tags", "select 'tag' as what, tag as label, count(*) as n from tags group by all")
def tag_counts(v: Views):
    return v.tags().groupBy(F.lit("tag").alias("what"), F.col("tag").alias("label")).agg(F.count("*").alias("n"))


@query("edges", "select lt, count(*) as n from edges group by 1")
def link_type_counts(v: Views):
    return v.edges().groupBy("lt").agg(F.count("*").alias("n"))


@query("pages links", """with p as (select page_id, coalesce(type, 'untyped') as t from pages), s as (select a.t as from_type, link_type as verb, b.t as to_type, count(*) as n from links join p a on a.page_id = from_page_id join p b on b.page_id = to_page_id group by all),
d as (select * from (values ('concept', 'mentions', 'note'), ('note', 'advises', 'note')) d(from_type, verb, to_type))
select from_type, verb, to_type, coalesce(n, 0) as n, d.k is not null as declared from s full join (select *, true as k from d) d using (from_type, verb, to_type)""")
def schema_graph(v: Views):
    declared = v.spark.createDataFrame([("concept", "mentions", "note"), ("note", "advises", "note")], "from_type string, verb string, to_type string")
    return A.observed_schema(v.pages(), v.links(), declared)


@query("pages tags takes chunks", _WEIGHT + """select 'weight_off_grid' as "check", count(*) filter (where abs(weight * 20 - round(weight * 20)) > 1e-9) as n from takes
union all select 'chunk_without_page', count(*) from chunks where page_id not in (select page_id from pages where not deleted)
union all select 'zero_weight_with_takes', count(*) from w where emotional_weight = 0 and page_id in (select page_id from takes where active)
union all select 'date_in_future', count(*) filter (where updated_on > date '2024-02-01' + 365) from pages union all select 'untyped', count(*) filter (where type is null) from pages""")
def quality_checks(v: Views):
    return A.quality_checks(v.pages(), v.chunks(), v.takes(), A.emotional_weight(v.pages(), v.tags(), v.takes(), "src3"), _day())


@query("pages chunks", r"""with x as (select case when page_id % 2 = 0 then '# t' || chr(10) else '' end || compiled_truth as raw, string_split(compiled_truth, chr(10))[1] as body from pages),
d as (select page_id, case when page_id % 4 = 0 then 'fallback' else 'metadata' end as effective_source, case when page_id % 3 = 0 then updated_on end as metadata_day, cast(updated_on + cast(page_id * 53 % 1200 - 600 as int) - case when page_id % 50 = 0 then 13000 else 0 end as date) as effective_date from pages)
select 'short_extract' as "check", count(*) filter (where length(raw) > 1000 and regexp_matches(raw, '(?m)^#{1,6} ') and length(coalesce(body, '')) < 0.3 * length(raw)) as n from x union all select 'chunker_drift', count(*) filter (where page_id % 6 <> 3) from chunks union all select 'chunker_mode_missing', count(*) filter (where page_id % 5 = 0) from chunks
union all select 'date_fallback', count(*) filter (where effective_source = 'fallback' and metadata_day is not null) from d union all select 'date_far_ahead', count(*) filter (where effective_date > date '2024-02-01' + 365) from d union all select 'date_before_1990', count(*) filter (where effective_date < date '1990-01-01') from d""")
def provenance_checks(v: Views):
    """Extracts are first lines; versions, modes and dates go by the ids of pages."""
    k, p = F.col("page_id"), v.pages()
    x = p.select(F.concat(F.when(k % 2 == 0, "# t\n").otherwise(""), "compiled_truth").alias("raw"), F.split("compiled_truth", "\n")[0].alias("body"))
    c = v.chunks().select((k % 6).alias("chunker_version"), F.when(k % 5 != 0, "recursive").alias("chunker_mode"))
    shift = (k * 53 % 1200 - 600).cast("int") - F.when(k % 50 == 0, 13000).otherwise(0)
    d = p.select(F.when(k % 4 == 0, "fallback").otherwise("metadata").alias("effective_source"), F.when(k % 3 == 0, F.col("updated_on")).alias("metadata_day"), F.date_add("updated_on", shift).alias("effective_date"))
    return A.provenance_checks(x, c, d, 3, _day())


@query("", """select user_id, max(ts) as last_retrieved from events group by 1""")
def last_retrieved(v: Views):
    return v.raw("events").groupBy("user_id").agg(F.max("ts").alias("last_retrieved"))


# --- the generic forms -----------------------------------------------------------------


@query("", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 3")
def top_per_group(v: Views):
    return J.top_k(v.raw("orders"), 3, ("o_custkey",), F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 40")
def page_of_all(v: Views):
    return v.raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(100)


@query("", """with a as (select c_nationkey as k from customer), b as (select s_nationkey as k from supplier) select 'all' as what, k, count(*) as n from (select * from a union all select * from b) group by 2
union all select 'distinct', k, 1 from (select * from a union select * from b) union all select 'shared', k, count(*) from a where k in (select k from b) group by 2 union all select 'alone', k, count(*) from a where k not in (select k from b) group by 2""")
def set_operations(v: Views):
    """Union with and without repeats, and the rows of one table whose key the other has, or has not."""
    a, b = v.raw("customer").select(F.col("c_nationkey").alias("k")), v.raw("supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda df, what: df.groupBy(F.lit(what).alias("what"), "k").agg(F.count("*").alias("n"))
    return n(a.unionByName(b), "all").unionByName(n(a.unionByName(b).distinct(), "distinct")).unionByName(n(a.join(b, "k", "left_semi"), "shared")).unionByName(n(a.join(b, "k", "left_anti"), "alone"))


@query("", "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as kinds, array_to_string(list_sort(list(distinct o_orderkey))[1:5], ',') as first from orders group by 1")
def collected_arrays(v: Views):
    """Distinct values of a group in order, and no more than five of them."""
    first = F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 5).cast("array<string>")
    return v.raw("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("kinds"), F.array_join(first, ",").alias("first"))


@query("pages", "select page_id, row_number() over (partition by source_id order by type asc nulls last, updated_on desc nulls last, page_id) as place from pages")
def nulls_last_sort(v: Views):
    w = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("type"), F.desc_nulls_last("updated_on"), "page_id")
    return v.pages().select("page_id", F.row_number().over(w).alias("place"))
