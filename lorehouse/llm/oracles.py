"""SQL for DuckDB that gives the rows of operators 11 to 13."""

from __future__ import annotations

#: The 256 entries of CRC-32's table, from its rule.
_TABLE = """tab as (
  select list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by k) as t
  from range(0, 256) r(k))"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])))"


RESAMPLE = f"""
with {_TABLE},
texts as (
  select true as own, row_number() over () as r, doc_id, text from documents
  union all select false, row_number() over (), null, text from benchmark),
words as (
  select own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
features as (
  select own, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]), list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) as f
  from words),
counted as (select own, r, f, count(*) as n from features group by all),
hashed as (select f, {_crc('f')} % 10000 as bucket from (select distinct f from features), tab),
buckets as (select bucket, cast(coalesce(sum(n) filter (where own), 0) as double) as s, cast(coalesce(sum(n) filter (where not own), 0) as double) as t from counted join hashed using (f) group by bucket),
total as (select cast(sum(s) as double) as s, cast(sum(t) as double) as t from buckets),
gains as (select bucket, cast(floor(1000 * ln((b.t + 1) * (total.s + 10000) / ((b.s + 1) * (total.t + 10000)))) as bigint) as gain from buckets b, total),
weights as (select r, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from counted join hashed using (f) join gains using (bucket) where own group by r),
scored as (
  select r, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substring(sha256('42:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from words left join weights using (r) where own),
ranked as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * n // 100 then rank end as rank from scored left join ranked using (r)
"""

SHARDS = f"""
with recursive {_TABLE},
rows_ as materialized (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, {_crc("coalesce(text, '')")} as text_crc32,
         cast('0x' || substring(md5('key:' || doc_id), 1, 8) as bigint) as place, cast('0x' || substring(md5('key:' || doc_id), 9, 15) as bigint) as turn
  from documents, tab),
places as (
  select row_number() over (order by pos, shard) - 1 as k, pos, shard
  from (select cast('0x' || substring(md5('shard:' || s || ':' || v), 1, 8) as bigint) as pos, cast(s as int) as shard from range(0, 8) a(s), range(0, 64) b(v))),
orders as materialized (
  select arc, list(shard order by nearest) as shards
  from (select a.k as arc, b.shard, min((b.k - a.k + 512) % 512) as nearest from places a, places b group by all) group by arc),
keyed as materialized (
  select row_number() over (order by turn) as nth, doc_id, size, text_crc32, shards
  from (select *, coalesce((select min(k) from places where pos >= place), 0) as arc from rows_) join orders using (arc)),
caps as (select list_transform(range(0, 8), lambda s: (n + 7 - s) // 8) as cap from (select count(*) as n from rows_)),
walk as (
  select 0::bigint as nth, null::int as shard, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as load
  union all
  select nth, shard, list_transform(load, lambda x, i: case when i = shard + 1 then x + 1 else x end)
  from (select k.nth, list_filter(shards, lambda s: load[s + 1] < cap[s + 1])[1] as shard, load from walk join keyed k on k.nth = walk.nth + 1, caps))
select doc_id, size, text_crc32, 'rows' as law, shard, load[shard + 1] - 1 as slot, cast(null as int) as grown_shard
from walk join keyed using (nth)
"""

AUDIT = r"""
with words as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
counts as (select lang, source, term, count(*) as n from words group by all),
kept as (select lang, term, count(*) as total from words group by all having count(distinct doc_id) >= 10),
langs as (select lang, sum(total) as lang_total, count(*) as v from kept group by lang),
grp as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
sums as (select lang, source, sum(n) as total from counts join kept using (lang, term) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v)::hugeint as p,
         1 + (1000000000::hugeint * (k.total + 2)) // (l.lang_total + 2 * l.v)::hugeint as q
  from grp g join langs l using (lang) join kept k using (lang) left join sums s using (lang, source)
       left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, cast(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) as bigint) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
       left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
stands as (select lang, source, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from stands qualify rank <= 10)
select lang, source, part, item, value, cast(rank as int) as rank from ranked
"""
