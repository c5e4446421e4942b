"""Queries: text preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rubrics as B
from ..operators import text as T
from .registry import query
from .views import NOW, Views



def _day():
    return F.lit(NOW).cast("date")



def _lines(v: Views):
    """Lines of documents with references, dates and claims put in by arithmetic on ids."""
    c = v.chunks()
    k, n = F.col("page_id"), F.col("chunk_index")
    ref = F.concat(F.lit("people/p"), (k % 97).cast("string"))
    extra = (
        F.when(n % 7 == 0, F.concat(F.lit(" [["), ref, F.lit("|Name]]")))
        .when(n % 7 == 1, F.concat(F.lit(" [who](../"), ref, F.lit(".md)")))
        .when(n % 7 == 2, F.concat(F.lit(" [[wiki:companies/c"), (k % 13).cast("string"), F.lit("#top]]")))
        .when(n % 7 == 3, F.concat(F.lit(" `[[people/no]]` src/a/f"), (k % 5).cast("string"), F.lit(".py:"), n.cast("string")))
        .when(n % 7 == 4, F.concat(F.lit(" [notes/n"), (k % 31).cast("string"), F.lit("#"), (n % 3).cast("string"), F.lit("]")))
        .otherwise("")
    )
    return c.select("chunk_id", "page_id", "chunk_index", F.concat("chunk_text", extra).alias("text"))


_LINES = """lines as (select chunk_id, page_id, chunk_index, chunk_text || case chunk_index % 7 when 0 then ' [[people/p' || page_id % 97 || '|Name]]' when 1 then ' [who](../people/p' || page_id % 97 || '.md)'
 when 2 then ' [[wiki:companies/c' || page_id % 13 || '#top]]' when 3 then ' `[[people/no]]` src/a/f' || page_id % 5 || '.py:' || chunk_index when 4 then ' [notes/n' || page_id % 31 || '#' || chunk_index % 3 || ']' else '' end as text from chunks)
"""


@query("", r"""select doc_id, cast(generate_subscripts(p, 1) - 1 as int) as n, unnest(p) as sentence from (
 select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10) || '+'), lambda s: trim(s)), lambda s: s <> '') as p from documents)""")
def split_sentences(v: Views):
    return T.split_sentences(v.raw("documents"), "doc_id", "text")


@query("chunks", "select page_id as doc_id, chunk_index, chunk_text from chunks")
def chunk_paragraphs(v: Views):
    return T.chunk_paragraphs(v.raw("documents"), "doc_id", "text").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


@query()
def chunk_recursive(v: Views):
    return T.chunk_recursive(v.raw("documents"), "doc_id", "text")


def _vectored(v: Views):
    return v.chunks().join(v.vectors(), "vec_id").select(F.col("page_id").alias("key"), F.col("chunk_index").alias("n"), "v")


_SIM = """s0 as (select page_id as key, chunk_index as n, v, lag(v) over (partition by page_id order by chunk_index) as u from chunks join vectors using (vec_id)),
s as (select key, n, list_dot_product(u, v) / nullif(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)), 0) as sim from s0),
l as (select key, quantile_cont(sim, 0.2) as lim from s where sim is not null group by key)"""


@query("chunks vectors", f"""with {_SIM}, m as (select s.key, n, coalesce(sim < lim, false) as low from s left join l using (key)),
c as (select *, case when low and not coalesce(lag(low) over (partition by key order by n), false) then 1 else 0 end as cut from m)
select key, n, cast(sum(cut) over (partition by key order by n) as bigint) as chunk from c""")
def chunk_semantic(v: Views):
    return T.chunk_semantic(_vectored(v))


@query("chunks vectors", f"""with {_SIM}, t as (select * from s where sim is not null),
d as (select key, n, sim, (-2 * lag(sim, 2) over w - lag(sim) over w + lead(sim) over w + 2 * lead(sim, 2) over w) / 10 as slope from t window w as (partition by key order by n)),
e as (select *, lag(slope) over (partition by key order by n) as before from d) select key, n from e join l using (key) where before < 0 and slope >= 0 and sim <= lim""")
def savgol_minima(v: Views):
    return T.savgol_minima(_vectored(v))


_QUALIFIED = r"\[\[([a-z0-9](?:[a-z0-9-]*[a-z0-9])?):((?:people|companies)/[^|\]#]+?)(?:#[^|\]]*?)?(?:\|[^\]]+?)?\]\]"
_WIKI = r"\[\[((?:people|companies)/[^|\]#]+?)(?:#[^|\]]*?)?(?:\|[^\]]+?)?\]\]"
_MD = r"\[[^\]]+\]\((?:\.\./)*((?:people|companies)/[^)\s]+?)(?:\.md)?\)"


@query("chunks", f"""with {_LINES}, t as (select chunk_id, regexp_replace(text, '`[^`\\n]*`', ' ', 'g') as x from lines),
u as (select chunk_id, x, regexp_replace(x, '{_QUALIFIED}', ' ', 'g') as m from t)
select chunk_id, 'qualified' as kind, unnest(regexp_extract_all(x, '{_QUALIFIED}', 1)) as source, unnest(regexp_extract_all(x, '{_QUALIFIED}', 2)) as slug from u
union all select chunk_id, 'wiki', null, unnest(regexp_extract_all(m, '{_WIKI}', 1)) from u
union all select chunk_id, 'markdown', null, unnest(regexp_extract_all(m, '{_MD}', 1)) from u""")
def entity_refs(v: Views):
    return T.entity_refs(_lines(v), "chunk_id", "text", "people|companies")


@query("", """select page_id, cast(generate_subscripts(h, 1) - 1 as int) as n, unnest(h) as href from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as h from pages)""")
def html_links(v: Views):
    return T.html_links(v.raw("pages"))


_KIND = "case when page_id % 9 = 0 then 'media' when page_id % 9 = 1 then 'meeting' else 'person' end"
_VERB = "case when page_id % 9 = 2 then 'is the founder of' when page_id % 9 = 3 then 'Early Investor in' when page_id % 9 = 4 then 'is an advisor to' when page_id % 9 = 5 then 'works at' else 'saw' end"


@query("pages", f"""with t as (select page_id, {_KIND} as kind, compiled_truth || ' ' || {_VERB} || ' x' as t from pages)
select page_id, case when kind = 'media' then 'mentions' when kind = 'meeting' then 'attended' when regexp_matches(t, '(?i){T.FOUNDED}') then 'founded' when regexp_matches(t, '(?i){T.INVESTED}') then 'invested_in'
 when regexp_matches(t, '(?i){T.ADVISES}') then 'advises' when regexp_matches(t, '(?i){T.WORKS_AT}') then 'works_at' else 'mentions' end as link_type from t""")
def link_types(v: Views):
    """From whole texts, each with a verb put at its end."""
    k = F.col("page_id") % 9
    kind = F.when(k == 0, "media").when(k == 1, "meeting").otherwise("person")
    verb = F.when(k == 2, "is the founder of").when(k == 3, "Early Investor in").when(k == 4, "is an advisor to").when(k == 5, "works at").otherwise("saw")
    return v.pages().select("page_id", T.link_type(kind, F.concat("compiled_truth", F.lit(" "), verb, F.lit(" x"))).alias("link_type"))


@query("pages", """select case when page_id % 2 = 0 then slug else 'companies/c' || page_id % 7 end as "to", case when page_id % 2 = 0 then 'people/p' || page_id % 11 else slug end as "from", 'works_at' as link_type from pages
union all select slug, 'source/' || source_id, 'discussed_in' from pages""")
def field_links(v: Views):
    k = F.col("page_id")
    value = F.when(k % 2 == 0, F.concat(F.lit("people/p"), (k % 11).cast("string"))).otherwise(F.concat(F.lit("companies/c"), (k % 7).cast("string")))
    fields = F.map_from_arrays(F.array(F.when(k % 2 == 0, "key_people").otherwise("company"), F.lit("sources")), F.array(F.array(value), F.array(F.concat(F.lit("source/"), "source_id"))))
    return T.field_links(v.pages().select("slug", F.when(k % 2 == 0, "company").otherwise("person").alias("type"), fields.alias("fields")))


@query("pages chunks", """select page_id, cast(0 as int) as n, updated_on as date, 'opened ' || page_id as summary, 'more' || chr(10) || 'and more' as detail from pages
union all select page_id, 4, date '2023-03-04', 'closed', '' from pages""")
def extract_timeline(v: Views):
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("- **"), F.col("updated_on").cast("string"), F.lit("** | opened "), k, F.lit("\n  more\n  and more\nplain line\n**2023-03-04** -- closed\nend\n- **2023-19-44** | no\n"), "compiled_truth")
    return T.timeline(v.pages().select("page_id", text.alias("t")), "page_id", "t")


@query("chunks", f"""with {_LINES}, c as (select page_id, regexp_extract_all(string_agg(text, chr(10) order by chunk_index), '\\[([a-z0-9][a-z0-9/_-]*#\\d+)\\]', 1) as cs from lines group by page_id),
u as (select page_id, unnest(cs) as c, generate_subscripts(cs, 1) as pos from c), d as (select page_id, c, min(pos) as pos from u group by all)
select page_id, split_part(c, '#', 1) as slug, cast(split_part(c, '#', 2) as bigint) as row, row_number() over (partition by page_id order by pos) as n from d""")
def extract_citations(v: Views):
    text = _lines(v).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "text")))["text"], "\n").alias("text"))
    return T.citations(text, "page_id", "text").withColumn("n", F.col("n").cast("long"))


@query("pages", """select page_id, 1 as row, 'a ' || page_id as claim, cast(page_id % 140 as double) / 100 as weight, page_id % 140 <= 100 and page_id % 3 <> 0 as valid from pages
union all select page_id, case when page_id % 3 = 0 then 1 else 2 end, 'b', cast(null as double), false from pages""")
def extract_claim_rows(v: Views):
    k = F.col("page_id")
    t = F.concat(F.lit("x\n<!-- claims:begin -->\n| # | claim | w |\n|---|---|---|\n| 1 | a "), k.cast("string"), F.lit(" | "), ((k % 140).cast("double") / 100).cast("string"), F.lit(" |\n| "), F.when(k % 3 == 0, "1").otherwise("2"), F.lit(" | b | high |\n<!-- claims:end -->\n| 9 | no | 1 |\n"), "compiled_truth")
    return T.claim_rows(v.pages().select("page_id", t.alias("t")), "page_id", "t")


@query("pages", """with k as (select page_id, page_id % 7 = 0 as twice, page_id % 3 as m, page_id % 5 as f from pages)
select page_id, 1 as row, 'a | ' || page_id as claim, case when m = 0 then 'fact' when m = 1 then 'event' else 'rumour' end as kind, case when f = 0 then null else cast(f as double) / 4 end as confidence, true as active, cast(null as int) as superseded_by, false as forgotten, case when m = 2 then 'unknown_kind' when f = 0 then 'no_confidence' end as issue from k
union all select page_id, case when twice then 1 else 2 end, 'b', 'belief', 0.5, false, case when f % 2 = 0 then 1 end, f % 2 = 1, case when twice then 'number_again' end from k union all select page_id, 3, 'short', 'fact', 0.9, true, null, false, 'too_few_cells' from k""")
def fact_rows(v: Views):
    """A table of facts before each text; kinds, numbers, strikes and cells vary with the page."""
    k = F.col("page_id")
    cell = lambda c: c.cast("string")
    t = F.concat(
        F.lit("<!--- x:facts:begin -->\n| # | claim | kind | confidence | visibility | notability | valid_from | valid_until | source | context |\n|---|---|---|---|---|---|---|---|---|---|\n| 1 | a \\| "), cell(k), F.lit(" | "),
        F.when(k % 3 == 0, "Fact").when(k % 3 == 1, "event").otherwise("rumour"), F.lit(" | "), F.when(k % 5 == 0, "high").otherwise(cell((k % 5).cast("double") / 4)), F.lit(" | world | high | 2024-01-01 | | s | |\n| "), F.when(k % 7 == 0, "1").otherwise("2"),
        F.lit(" | ~~b~~ | belief | 0.5 | private | low | | | s | "), F.when(k % 5 % 2 == 0, "superseded by #1").otherwise("forgotten: asked to"), F.lit(" |\n| 3 | short | fact | 0.9 | world |\n<!--- x:facts:end -->\n"), "compiled_truth",
    )
    return T.fact_rows(v.pages().select("page_id", t.alias("t")), "page_id", "t").select("page_id", "row", "claim", "kind", "confidence", "active", "superseded_by", "forgotten", "issue")


@query("pages", """select page_id, 'revenue' as field, cast(1000 + page_id as double) as value from pages union all select page_id, 'staff', cast(page_id % 50 as double) from pages where page_id % 2 = 0""")
def metric_fields(v: Views):
    k = F.col("page_id")
    t = F.concat(F.lit("Revenue: $"), F.format_number(k + 1000, 0), F.when(k % 2 == 0, F.concat(F.lit(", headcount of "), (k % 50).cast("string"))).otherwise(", n/a"), F.lit("\n"), "compiled_truth")
    return T.metric_fields(v.pages().select("page_id", t.alias("t")), "page_id", "t", {"revenue": r"Revenue: \$([\d,]+\d)", "staff": r"headcount of (\d+)"})


@query("", """with w as (select 'Q' || quarter(s) || ' ' || year(s) as label, cast(s as date) as start, cast(s + interval 3 months as date) as finish from (select unnest(range(timestamp '1992-01-01', timestamp '1999-01-01', interval 3 months)) as s))
select label, coalesce(round(sum(o_totalprice), 2), 0) as amount, count(o_orderkey) as n from w left join orders on o_orderdate >= start and o_orderdate < finish group by label""")
def window_totals(v: Views):
    """Orders as rows of a tracker, amounts as text, summed by quarter."""
    w = T.date_windows(v.spark, 1992, 1998)
    o = v.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount"))
    both = w.join(o.withColumn("start", F.trunc("d", "quarter")), "start", "left")
    n = both.groupBy("label").agg(F.count("o_orderkey").alias("n"))
    return T.totals(both, ["amount"], ("label",)).join(n, "label").select("label", F.round("amount", 2).alias("amount"), "n")


@query("", r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages""")
def strip_html(v: Views):
    return v.raw("pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def redacted_sql(column: str) -> str:
    """redact() in DuckDB, whose patterns have no lookaround: a number's neighbours are matched and put back, twice, as two numbers may share one."""
    r = T.REDACTED
    q = lambda p: "'" + p.replace("'", "''") + "'"
    put = lambda t, p, by=r: f"regexp_replace({t}, {q(p)}, {q(by)}, 'g')"
    alone = lambda t, p: put(put(t, f"(^|[^0-9]){p}($|[^0-9])", rf"\1{r}\2"), f"(^|[^0-9]){p}($|[^0-9])", rf"\1{r}\2")
    t = put(put(column, T.URL_USERINFO, rf"\1{r}@"), T.ANY_EMAIL)
    t = put(put(alone(alone(t, T.ANY_PHONE), T.ANY_SSN), T.JWT), T.BEARER, f"Bearer {r}")
    digit = "cast(substring(d, n, 1) as int)"
    luhn = f"list_sum(list_transform(range(1, length(d) + 1), lambda n: case when (length(d) - n) % 2 = 1 then 2 * {digit} - case when {digit} > 4 then 9 else 0 end else {digit} end)) % 10 = 0".replace("d,", "replace(replace(c, ' ', ''), '-', ''),").replace("(d)", "(replace(replace(c, ' ', ''), '-', ''))")
    cards = f"list_filter(list_distinct(regexp_extract_all(t, '(?:^|[^0-9])({T.CARD})(?:$|[^0-9])', 1)), lambda c: {luhn})"
    t = f"(select list_reduce(list_prepend(t, {cards}), lambda x, y: replace(x, y, {q(r)})) from (select {t} as t))"
    t = put(put(t, T.AUTHORIZATION, rf"\1{r}"), T.ASSIGNMENT, rf"\1{r}")
    return put(t, "|".join(T.SECRET_TOKENS).replace("{0,8192}?", "*?"))


@query("", f"select doc_id, {redacted_sql('text')} as text from documents")
def redact_corpus(v: Views):
    return v.raw("documents").select("doc_id", T.redact(F.col("text"), apart=True).alias("text"))


@query("", f"""select doc_id, regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.SSN}', '[SSN]', 'g') as text from documents""")
def redact_emails(v: Views):
    return v.raw("documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", T.EMAIL, "[EMAIL]"), T.SSN, "[SSN]").alias("text"))


_N = "cast(len(regexp_extract_all(text, '{}')) as bigint)"


@query("", f"""select doc_id, {_N.format(T.EMAIL)} as emails, {_N.format(T.PHONE)} as phones, {_N.format(T.SSN)} as ssns, {_N.format(T.SECRET)} as secrets from documents""")
def pii_counts(v: Views):
    return T.pii_counts(v.raw("documents"), "doc_id", "text")


@query("", """select event_id as id, case when event_id % 2 = 0 then '{"type":"' || event_type || '"}' else '{"type":"' || event_type || '","user":"' || user_id || '"}' end as meta, 
 case when event_id % 2 = 0 then 'body:dropped,secret:dropped,type:kept' else 'body:dropped,secret:dropped,type:kept,user:kept' end as trail from events""")
def minimize_records(v: Views):
    user = F.when(F.col("event_id") % 2 == 1, F.col("user_id").cast("string"))
    meta = F.map_filter(F.create_map(F.lit("type"), "event_type", F.lit("user"), user, F.lit("secret"), F.lit("x")), lambda _, x: x.isNotNull())
    r = v.raw("events").select(F.col("event_id").alias("id"), F.lit("b").alias("body"), meta.alias("meta"))
    return T.minimize(r, ["type", "user"]).select("id", F.to_json("meta").alias("meta"), F.array_join("trail", ",").alias("trail"))


@query("pages", r"""select page_id, 'no_type' as rule from pages where type is null union all select page_id, 'no_title' from pages where trim(coalesce(title, '')) = ''
union all select page_id, 'shouting' from pages where regexp_matches(compiled_truth, '[A-Z]{3,}!!') union all select page_id, 'preamble' from pages where regexp_matches(compiled_truth, '(?i)^\s*(sure|certainly|here is|here''s)\b')
union all select page_id, 'placeholder_date' from pages where regexp_matches(compiled_truth, '(YYYY-MM-DD|XX-XX|\bTBD\b)') union all select page_id, 'broken_citation' from pages where regexp_matches(compiled_truth, '\[[^\]\n]*\]\(\s*\)')
union all select page_id, 'empty_section' from pages where regexp_matches(compiled_truth, '(?m)^#+ [^\n]*\n\s*(#|\z)') union all select page_id, 'fence_wrap' from pages where regexp_matches(compiled_truth, '(?s)^\s*```.*```\s*$')""")
def lint_corpus(v: Views):
    """Texts are read where they lie; ids and names of rules meet the labels."""
    return T.lint(v.pages(found=T.lint_text(F.substring("text", 1, 40), F.col("text"))), found="found")


@query("pages", r"""with f as (select page_id, case page_id % 4 when 3 then '' else '---' || chr(10) || case when page_id % 5 <> 0 then 'title: t' || chr(10) else '' end || case when page_id % 3 <> 0 then 'type: note' || chr(10) else 'type: ' || chr(10) end || case when page_id % 7 <> 0 then 'created: 2024-01-01' || chr(10) else '' end || case page_id % 4 when 2 then '' else '---' || chr(10) end end || compiled_truth as text from pages),
h as (select page_id, text, starts_with(text, '---' || chr(10)) as begins, regexp_matches(text, '(?s)^---
(.*?
)?---(?:
|\z)') as closed, regexp_extract(text, '(?s)^---
(.*?
)?---(?:
|\z)', 1) as header from f)
select page_id, 'no_frontmatter' as rule from h where not begins union all select page_id, 'unclosed_frontmatter' from h where begins and not closed union all select page_id, 'missing_title' from h where closed and not regexp_matches(header, '(?m)^title:[ 	]*[^\s]')
union all select page_id, 'missing_type' from h where closed and not regexp_matches(header, '(?m)^type:[ 	]*[^\s]') union all select page_id, 'missing_created' from h where closed and not regexp_matches(header, '(?m)^created:[ 	]*[^\s]')""")
def lint_headers(v: Views):
    """All texts as files; a fourth has no header, another one that never ends, and fields are missing from the rest."""
    k, e = F.col("page_id"), F.lit("")
    header = F.concat(F.lit("---\n"), F.when(k % 5 != 0, "title: t\n").otherwise(e), F.when(k % 3 != 0, "type: note\n").otherwise("type: \n"), F.when(k % 7 != 0, "created: 2024-01-01\n").otherwise(e), F.when(k % 4 == 2, e).otherwise("---\n"))
    return T.lint_headers(v.pages().select("page_id", F.concat(F.when(k % 4 == 3, e).otherwise(header), "compiled_truth").alias("text")), "page_id", "text")


@query("chunks", r"""with l as (select chunk_id, text, chunk_index from (select chunk_id, chunk_index, chunk_text || case when chunk_index % 5 = 0 then ' see https://x.example/a' when chunk_index % 5 = 1 then ' he Tweeted' else '' end as text from chunks))
select chunk_id, 0 as n, case when chunk_index % 5 = 0 then 'external_link' else 'uncited_post' end as issue from l where chunk_index % 5 < 2""")
def integrity_scan(v: Views):
    k = F.col("chunk_index") % 5
    t = F.concat("chunk_text", F.when(k == 0, " see https://x.example/a").when(k == 1, " he Tweeted").otherwise(""))
    return T.integrity(v.chunks().select("chunk_id", t.alias("t")), "chunk_id", "t")


RUBRICS = {"concept": {"length": 2.0, "lines": 1.0, "recency": 1.0}, "note": {"length": 1.0, "title": 1.0, "citations": 1.0, "recency": 1.0}}


@query("pages", rf"""with d as (select page_id, type, least(n_chars / 1000.0, 1.0) as len, list_filter(string_split(compiled_truth, chr(10)), lambda x: trim(x) <> '') as l,
 case when datediff('day', updated_on, date '{NOW}') <= 90 then 1.0 when datediff('day', updated_on, date '{NOW}') <= 180 then 0.7 else 0.4 end as rec, case when trim(title) <> '' then 1.0 else 0.0 end as t,
 least(len(regexp_extract_all(compiled_truth, '\[[^\]]+\]')) / 3.0, 1.0) as c from pages where type is not null)
select page_id, round(case type when 'concept' then (2 * len + len(list_distinct(l)) / greatest(len(l), 1) + rec) / 4 else (len + t + c + rec) / 4 end + 1e-9, 3) as score from d""")
def completeness_score(v: Views):
    return T.completeness(v.pages(), RUBRICS, _day())


_KINDS = ["person", "company", "project", "deal", "concept", "source", "media", "other"]


def _rubric_sql() -> str:
    says = lambda keys: "case when " + " or ".join(f"coalesce(trim(fm['{k}']), '') <> ''" for k in keys) + " then 1.0 else 0.0 end"
    sums = {k: " + ".join(f"{w}::double * {d if isinstance(d, str) else says(d)}" for d, w in parts) for k, parts in B.RUBRICS.items()}
    return "case rubric " + " ".join(f"when '{k}' then {s}" for k, s in sums.items()) + " end"


@query("pages", rf"""with p as (select page_id, {_KINDS}[page_id % 8 + 1] as type, case when page_id % 6 = 0 then ' ' else title end as title, case when page_id % 11 = 0 then '' else compiled_truth || case page_id % 5 when 0 then ' [Source: x] see https://x.example/a' when 1 then ' [a](https://x.example/b) [b](https://x.example/c)' when 2 then chr(10) || '- one' || chr(10) || '2. two [c](d.md)' else '' end end as t,
 case page_id % 3 when 0 then '- 2024-01-01 met' when 1 then 'met' end as tl, case page_id % 4 when 0 then map {{'role': 'x', 'url': 'u', 'date': '2024', 'founder': 'f'}} when 1 then map {{'company': 'c', 'amount': '5', 'status': ' ', 'last_verified': '2023-06-01'}} when 2 then map {{'owner': 'o', 'author': 'a', 'type': 'v'}} end as fm, updated_on from pages),
a as (select *, datediff('day', coalesce(cast(fm['last_verified'] as date), updated_on), date '{NOW}') as age, len(regexp_extract_all(t, 'https?://[^\s)\]]+')) as u, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') as ls from p),
d as (select page_id, fm, case when type = 'other' then 'default' else type end as rubric, case when u >= 2 then 1.0 when u = 1 then 0.6 else 0.0 end as urls, case page_id % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end as timeline,
 least((len(regexp_extract_all(t, '\[Source:[^\]]*\]')) + len(regexp_extract_all(t, '\]\(https?://[^)]+\)'))) / 3.0, 1.0) as citations, least(len(regexp_extract_all(t, '\[[^\]]+\]\([^)]*\.md\)')) / 3.0, 1.0) as links, least(len(regexp_extract_all(t, '(?m)^\s*(?:[-*]|\d+\.)\s')) / 2.0, 1.0) as examples,
 case when age <= 90 then 1.0 when age <= 180 then 0.7 when age <= 365 then 0.4 else 0.1 end as recency, case when length(t) < 200 then 0.5 when len(ls) = 0 then 0.0 else len(list_distinct(ls)) / len(ls) end as non_redundancy, case when trim(coalesce(title, '')) <> '' then 1.0 else 0.0 end as title, case when trim(t) <> '' then 1.0 else 0.0 end as body from a)
select page_id, rubric, round({_rubric_sql()} + 1e-9, 3) as score from d""")
def rubric_score(v: Views):
    """All pages, dealt to the types by their id, with links, headers and timelines of several kinds."""
    k, e = F.col("page_id"), F.lit("")
    made = lambda **fields: F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    fm = F.when(k % 4 == 0, made(role="x", url="u", date="2024", founder="f")).when(k % 4 == 1, made(company="c", amount="5", status=" ", last_verified="2023-06-01")).when(k % 4 == 2, made(owner="o", author="a", type="v"))
    more = F.when(k % 5 == 0, " [Source: x] see https://x.example/a").when(k % 5 == 1, " [a](https://x.example/b) [b](https://x.example/c)").when(k % 5 == 2, "\n- one\n2. two [c](d.md)").otherwise(e)
    p = v.pages().select(
        "page_id", F.element_at(F.array(*map(F.lit, _KINDS)), (k % 8 + 1).cast("int")).alias("type"), F.when(k % 6 == 0, " ").otherwise(F.col("title")).alias("title"), F.when(k % 11 == 0, "").otherwise(F.concat("compiled_truth", more)).alias("compiled_truth"),
        F.when(k % 3 == 0, "- 2024-01-01 met").when(k % 3 == 1, "met").alias("timeline"), fm.alias("frontmatter"), "updated_on",
    )
    return B.rubric_score(p, _day())


@query("pages chunks", r"""select chunk_id, md5(coalesce('[' || trim(regexp_replace(title, '[\s<>]+', ' ', 'g')) || '] ' || trim(regexp_replace(regexp_extract(compiled_truth, '^([^.!?\n]*[.!?]?)', 1), '[\s<>]+', ' ', 'g')) || chr(10), '') || chunk_text) as h from chunks left join pages using (page_id)""")
def contextual_prefix(v: Views):
    return T.contextual_prefix(v.chunks(), v.pages()).select("chunk_id", F.md5("embedded_text").alias("h"))


@query("chunks", """select distinct chunk_id, 'src/a/f' || page_id % 5 || '.py' as path, page_id % 5 < 3 as found from chunks where chunk_index % 7 = 3""")
def reconcile_code_links(v: Views):
    refs = T.code_refs(_lines(v), "chunk_id", "text")
    code = v.spark.createDataFrame([(f"src/a/f{k}.py",) for k in range(3)], "path string")
    return T.reconcile_links(refs, code, "chunk_id")


@query("", rf"""with m as (select doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}}\b')) as name from documents)
select distinct doc_id, name, case when regexp_matches(name, '(?i){T.ORGANISATION}') then 'company' else 'person' end as kind from m""")
def name_mentions(v: Views):
    return T.name_mentions(v.raw("documents"), "doc_id", "text")


@query("sessions", """select session_id // 10 as question_id, session_id, string_agg(upper(role) || ': ' || text, chr(10) order by turn) as text from sessions group by all""")
def flatten_sessions(v: Views):
    s = v.sessions().groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t.role.alias("role"), t.text.alias("content"))).alias("s"))
    q = s.groupBy(F.floor(F.col("session_id") / 10).cast("long").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("session_id", "s"))).alias("z"))
    return T.flatten_sessions(q.select("question_id", F.col("z.session_id").alias("session_ids"), F.col("z.s").alias("sessions")))


@query("chunks", """select chunk_id, chunk_source from (select *, row_number() over (partition by chunk_source order by md5(concat_ws('-', cast(chunk_id as varchar), '7')), chunk_id) as n from chunks) where n <= 50""")
def stratified_paragraphs(v: Views):
    return T.stratified_paragraphs(v.chunks(), "chunk_source", 50).select("chunk_id", "chunk_source")


_LEADS = ("When did ", "news on ", "who is ", "how do ", "tell me everything about ", "", "what's new and going on with ", "show me photos of ", "any pics from last week of ", "today, what matters: ", "status on the class ")


def _hits(name: str) -> str:
    return "(" + " or ".join("regexp_matches(t, '(?i){}')".format(p.replace("'", "''")) for p in T.QUERY_PATTERNS[name]) + ")"


@query("questions", f"""with q as (select query_id, {"case query_id % 11 " + " ".join("when {} then '{}'".format(k, x.replace("'", "''")) for k, x in enumerate(_LEADS)) + " end"} || text as t from questions),
h as (select query_id, {", ".join(f"{_hits(n)} as p_{n}" for n in T.QUERY_PATTERNS)} from q),
i as (select *, case when p_full_context or p_temporal then 'temporal' when p_event then 'event' when p_entity then 'entity' else 'general' end as intent, p_canonical and not p_bound as settled from h)
select query_id, intent, case intent when 'entity' then 'low' when 'temporal' then 'high' when 'event' then 'high' end as detail, case when settled then 'off' when p_strong_recency then 'strong' when p_recency then 'on' else 'off' end as recency,
 case when not settled and p_salience then 'on' else 'off' end as salience, case when p_image then 'image' else 'text' end as modality, not p_image and p_visual_noun and p_reference as ambiguous, p_process as process from i""")
def classify_queries(v: Views):
    """Whole questions, each with a beginning that calls for a class."""
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("query_id") % len(_LEADS) + 1).cast("int"))
    return T.classify_queries(v.questions().select("query_id", F.concat(lead, "text").alias("text"))).drop("text")


@query("pages", """select 'people/' || page_id || '-x.md' as path, 'person' as type, cast(null as date) as date, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title from pages where page_id % 2 = 0
union all select 'daily/2024-02-0' || (1 + page_id % 9) || '-log-' || page_id || '.md', 'journal', make_date(2024, 2, 1 + page_id % 9), 'log ' || page_id from pages where page_id % 2 = 1""")
def infer_metadata(v: Views):
    k = F.col("page_id")
    odd = F.concat(F.lit("daily/2024-02-0"), (1 + k % 9).cast("string"), F.lit("-log-"), k.cast("string"), F.lit(".md"))
    p = v.pages().select(F.when(k % 2 == 0, F.concat(F.lit("people/"), k.cast("string"), F.lit("-x.md"))).otherwise(odd).alias("path"), F.when(k % 2 == 0, F.concat(F.lit("# "), F.trim(F.regexp_replace("title", r"\s+", " ")))).otherwise("no heading").alias("text"))
    return T.infer_metadata(p)


@query("chunks", """with c as (select page_id, chunk_index, row_number() over (partition by page_id order by chunk_index) as r from chunks) select page_id, count(*) as chunks, max(r) as last from c group by 1""")
def chunk_numbers(v: Views):
    c = v.chunks().withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("chunk_index")))
    return c.groupBy("page_id").agg(F.count("*").alias("chunks"), F.max("r").cast("long").alias("last"))


@query("chunks vectors", "select chunk_id, page_id from chunks where vec_id not in (select vec_id from vectors where vec_id % 5 <> 0)")
def stale_chunks(v: Views):
    have = v.vectors().where(F.col("vec_id") % 5 != 0).select("vec_id")
    return v.chunks().join(have, "vec_id", "left_anti").select("chunk_id", "page_id")


@query("pages", "select page_id, sha256(title) as h from pages where not deleted and not regexp_matches(slug, '(/_index|/log)$') and not starts_with(slug, 'es/')")
def orphan_filter(v: Views):
    p = v.pages().where(~F.col("deleted") & ~F.col("slug").rlike("(/_index|/log)$") & ~C.hard_excluded(F.col("slug"), ("es/",)))
    return p.select("page_id", F.sha2("title", 256).alias("h"))
