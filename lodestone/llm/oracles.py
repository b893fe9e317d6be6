"""SQL of those operator queries that DuckDB can express and run on whole small tables."""

from __future__ import annotations

from lodestone.llm.mixing import OP7_SQL

WORD = r"[^\x20\x09-\x0D]+"

OP3 = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
f as (select x, min(page_id) as first_id, count(*) as n from p group by 1)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '') as payload_digest,
       case when n > 1 and first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
       case when n > 1 and page_id is distinct from first_id then first_id end as refers_to
from p join f using (x)
"""

OP5 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as w from (select doc_id, h, unnest(range(0, greatest(n - 99, 0))) as i from d)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from w) where k > 1),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from r)),
s as (select doc_id, min(i) as a, max(i) + 100 as b from g group by doc_id, g),
k as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as lo, a as hi from s union all select doc_id, max(b), 1000000000 from s group by 1),
kept as (select k.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (least(hi, n) - lo)), '' order by lo) as t from k join d using (doc_id) group by 1),
t as (select doc_id, sum(b - a) as gone, count(*) as spans from s group by 1)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept.t, h))) as kept_sha256
from d left join t using (doc_id) left join kept using (doc_id)
"""

OP6 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id as id, doc_id as r from documents union select e.b, reach.r from reach join e on e.a = reach.id),
m as (select id, min(r) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join c using (doc_id) join m on m.id = d.doc_id
"""

OP10 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by 1),
ln as (select doc_id, source, unnest(string_split(t, chr(10))) as x from d),
lw as (select doc_id, source, x, len(regexp_extract_all(x, '{WORD}')) as n,
              trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as y from ln where regexp_matches(x, '{WORD}')),
dup as (select doc_id, count(*) - count(distinct x) as n from lw group by 1),
host as (select source, count(*) as n from documents group by 1),
often as (select source, y from lw join host using (source) group by source, y, host.n having count(distinct doc_id) > 10 and count(distinct doc_id) > host.n * 0.01::double),
gone as (select doc_id, sum(n) as n from lw join often using (source, y) group by 1),
f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as n_removed_words
      from d left join cov using (doc_id) left join dup using (doc_id) left join gone using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (n_removed_words > 0 and (n_words - n_removed_words < 0.5 * n_words or n_words - n_removed_words < 10)) as kept
from f
"""

ORACLES = {"op3_warc_salvage": OP3, "op5_suffix_sort": OP5, "op6_tensored_minhash": OP6, "op7_mix_sources": OP7_SQL, "op10_line_frequency": OP10}
