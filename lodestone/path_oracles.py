"""The queries of ``path_queries`` in SQL: what comes out follows from the numbers by which the files are made."""

from __future__ import annotations

from lodestone import oracles as O

#: Number, extension, language, whether it has functions, what its class holds.
CODE = """
sh as (select * from (values (0, '.js', 'javascript', true, 'methods'), (1, '.ts', 'typescript', true, 'methods'), (2, '.frag', 'glsl', true, 'none'), (3, '.rs', 'rust', true, 'methods'), (4, '.go', 'go', true, 'fields'),
  (5, '.java', 'java', false, 'methods'), (6, '.c', 'c', true, 'fields'), (7, '.cpp', 'cpp', true, 'methods'), (8, '.rb', 'ruby', true, 'methods'), (9, '.swift', 'swift', true, 'methods')) as t(i, ext, language, f, kind)),
d0 as (select doc_id, 'code/' || doc_id || ext as path, doc_id || ext as name, ext, language, kind, case when f then doc_id % 3 + 1 else 0 end as nf, doc_id % 4 + 1 as body, doc_id // 10 % 4 as m from documents join sh on i = doc_id % 10),
d as (select *, 3 + nf * (body + 3) as c0, 2 + m * case when kind = 'methods' then 3 else 1 end as size from d0),
fn as (select path, language, 3 + (k - 1) * (body + 3) as lo, 4 + (k - 1) * (body + 3) + body as hi, 'function' as kind, 'f' || k as sym, false as child from (select *, unnest(range(1, nf + 1)) as k from d)),
cl as (select path, language, c0 as lo, c0 + size - 1 as hi, 'class' as kind, 'C' as sym, false as child from d where d.kind <> 'none'),
me as (select path, language, c0 + 1 + (j - 1) * 3 as lo, c0 + j * 3 as hi, 'method' as kind, 'C.m' || j as sym, true as child, size from (select *, unnest(range(1, m + 1)) as j from d where kind = 'methods'))
"""
PYTHON = """
d0 as (select doc_id, 'py/' || doc_id || '.py' as path, doc_id || '.py' as name, doc_id % 3 + 1 as nf, case when doc_id % 2 = 0 then 1 else 0 end as dec, doc_id % 9 + 1 as b, doc_id // 9 % 3 + 1 as m from documents),
d as (select *, 3 + nf * (dec + b + 2) as c0 from d0),
f0 as (select path, dec, b, 3 + (k - 1) * (dec + b + 2) as lo, 'f' || k as sym from (select *, unnest(range(1, nf + 1)) as k from d)),
parts as (select *, case when dec + 1 + b > 6 then (b + 5) // 6 else 1 end as np from f0),
fn as (
  select path, sym, case when p = 1 then lo else lo + dec + 1 + (p - 1) * 6 end as lo, lo + dec + case when np = 1 then b else least(p * 6, b) end as hi,
         dec + 1 + case when np = 1 then b else least(p * 6, b) - (p - 1) * 6 end as n
  from (select *, unnest(range(1, np + 1)) as p from parts)),
me as (select path, 'C.m' || j as sym, c0 + 1 + (j - 1) * 2 as lo, c0 + j * 2 as hi from (select *, unnest(range(1, m + 1)) as j from d))
"""
LEAN = """
d as (select 'lean/' || doc_id || '.lean' as path, doc_id || '.lean' as name, doc_id as i, doc_id % 4 + 1 as n, case when doc_id % 2 = 0 then 1 else 0 end as dec, doc_id % 3 + 1 as s from documents),
dl as (select path, name, dec, s, 3 + (k - 1) * (dec + 1 + s) as lo, 't' || k as sym, (['theorem', 'lemma', 'def', 'structure', 'abbrev'])[(i + k) % 5 + 1] as word from (select *, unnest(range(1, n + 1)) as k from d))
"""


def chunk(lo: str, hi: str, language: str, kind: str, name: str, child: str, lines: str) -> str:
    return f"path as source_path, cast({lo} as int) as start_line, cast({hi} as int) as end_line, 'code' as chunk_type, {language} as language, {kind} as symbol_type, {name} as symbol_name, {child} as has_parent, cast({lines} as int) as text_lines"


def entry(kind: str, lo: str = "lo", concept: str = "sym") -> str:
    return f"path as file_path, {concept} as concept, {kind} as entry_type, cast({lo} as int) as start_line, cast(hi as int) as end_line"


def preamble(language: str) -> str:
    return "select " + chunk("1", "1", language, "'module_preamble'", "name || ' preamble'", "false", "1") + " from d"


UPSERT = rf"""{O.VERSIONS},
o as (select path, md5(path || ':plaintext:' || start_line || '-' || end_line) as m5, md5(text) as t from win join num using (path) where m < 10),
nw as (select path, md5(path || ':plaintext:' || start_line || '-' || end_line) as m5, md5({O.STRIP.format('text')}) as t from w3 join num using (path) where m >= 5 and regexp_matches(text, '\S'))"""
INGEST = f"{O.MD}, {O.LINES}, {O.SECTIONS}, {O.merged(12, True)}, {O.split('grp', 16)}"

ORACLES = {
    "file_scan": """
with s as (select doc_id, source, text, right(source, 1) as g from documents where source is not null),
r as (select source, case when g in ('0', '2', '4', '6', '8') then 'md' else 'txt' end as kind, doc_id % 3 = 0 and g in ('2', '3', '6') as bad, doc_id, coalesce(text, '') as text from s),
f0 as (select source, kind, bool_or(bad) as b, string_agg(case when bad then chr(65533) else '' end || text || chr(10), '' order by doc_id) as content from r group by source, kind),
f as (select *, b and kind = 'md' as hurt from f0)
select 'kind=' || kind || '/source=' || source || '/notes.' || kind as source_path, '.' || kind as ext, case when not hurt then md5(content) end as content_md5, case when hurt then 'not valid UTF-8' end as error from f""",
    "code_chunks": f"""with {CODE}
{preamble('language')}
union all select {chunk('lo', 'hi', 'language', 'kind', 'sym', 'child', 'hi - lo + 1')} from (select * from fn union all select * from cl union all select * exclude (size) from me where size > 6)""",
    "code_index": f"with {CODE} select {entry('kind')} from (select * from fn union all select * from cl union all select * exclude (size) from me)",
    "python_chunks": f"""with {PYTHON}
{preamble("'python'")}
union all select {chunk('lo', 'hi', "'python'", "'function'", 'sym', 'false', 'n')} from fn
union all select {chunk('c0', 'c0 + 2 * m', "'python'", "'class'", "'C'", 'false', '2 * m + 1')} from d
union all select {chunk('lo', 'hi', "'python'", "'method'", 'sym', 'true', '2')} from me""",
    "python_index": f"""with {PYTHON}
select {entry("'function'", 'lo + dec')} from (select *, lo + dec + b as hi from f0) union all select {entry("'class'", 'c0', "'C'")} from (select *, c0 + 2 * m as hi from d) union all select {entry("'method'")} from me""",
    "broken_python_index": f"""with {PYTHON}
select {entry("'function'")} from (select *, lo + dec + b as hi from f0) union all select {entry("'class'", 'c0', "'C'")} from (select *, c0 + 2 * m as hi from d) union all select {entry("'method'")} from me""",
    "lean_chunks": f"""with {LEAN}
select {chunk('1', '2', "'lean'", "'module_preamble'", "name || ' preamble'", 'false', '1')} from d
union all select {chunk('lo', 'lo + dec + s', "'lean'", "case when word in ('theorem', 'lemma') then word when word = 'structure' then 'class' else 'function' end", 'sym', 'false', 'dec + 1 + s')} from dl""",
    "lean_index": f"""with {LEAN} select {entry("case when word in ('theorem', 'lemma') then word when word = 'structure' then 'class' else 'definition' end", 'lo + dec')} from (select *, lo + dec + s as hi from dl)""",
    "ingest_points": f"""with recursive {INGEST}, m as (select *, md5(path || ':markdown:' || start_line || '-' || end_line) as m5 from cut)
select {O._UUID.format('m5')} as point_id, path as source_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5, 4 as dimension from m""",
    "ingest_counts": f"""with md as (with recursive {INGEST} select count(*) as n from cut), pt as (with recursive {O.FILES}, {O.LINES}, {O.plaintext(16, 12)} select count(*) as n from grp)
select 'markdown_chunks' as name, n from md union all select 'total_chunks', md.n + pt.n from md, pt union all select unnest(['code_chunks', 'errors', 'pruned_points']), 0
union all select 'index_entries', (select count(*) from ({O.ORACLES['section_index']})) + (select count(*) from ({O.ORACLES['formal_objects']}))""",
    "collection_upsert": f"""with {UPSERT}
select {O._UUID.format('m5')} as point_id, path as source_path, 'new' as summary, t as text_md5 from nw union all select {O._UUID.format('m5')}, path, 'old', t from o where m5 not in (select m5 from nw)""",
    "collection_sync": O.ORACLES["deleted_counts"],
    "collection_delete": f"""with {UPSERT}, g as (select distinct path from o order by 1 limit 2)
select {O._UUID.format('m5')} as point_id, path as source_path, 'old' as summary, t as text_md5, (select cast(count(*) as int) from o where path in (select path from g)) as gone from o where path not in (select path from g)""",
    "pointer_index_round_trip": O.ORACLES["section_index"],
    "golden_spans": """
with s as (select item_id as i, unnest([2, 1]) as grade from benchmark)
select 'q' || i as query_id, case when i % 2 = 0 then 'search_code' else 'lookup_index' end as tool, grade, 0 as span_id, 'f' || i % 5 || '.md' as file, cast(case when grade = 2 then i + 1 else i end as int) as start_line, cast(case when grade = 2 then i + 3 else i + 5 end as int) as end_line from s""",
    "enrich_run": f"""with {O.ENRICH},
z as (select *, bool_or(start_line = 9) over (partition by g, z // 10) and count(*) over (partition by g, z // 10) > 1 as lost, z % 10 + 1 as id from el),
a as (select path, start_line, case when lost then 1 else id end as n from z)
select w.path as source_path, cast(w.start_line as int) as start_line, 'Summary of passage ' || n || '.' as summary, 'What is passage ' || n || ' about?' as questions from win w left join a using (path, start_line)""",
    "embed_run": "select doc_id, cast(length(coalesce(text, '')) as double) as chars, cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) as double) as es from documents",
    "chat_backoff": """
select conv_id, turn, case when k in (0, 1, 2) then 'answer ' || k end as answer, (case k when 0 then 1 when 1 then 2 else 3 end)::int as calls, (case k when 0 then 0 when 1 then 1 else 3 end)::double as waited
from (select conv_id, turn, (conv_id + turn) % 5 as k from conversations)""",
    "tool_answers": f"""with {O.POINTS}, {O.PART},
b as (select e.vec_id, round(list_cosine_similarity(e.embedding::double[], v), 6) as score, coalesce(d.source, 'none') || '.py' as file, coalesce(d.n_chars, 0) as hi, d.lang as l, coalesce(d.text, '') as t from q, embeddings e left join documents d on e.vec_id = d.doc_id),
c2 as (select *, case when length(t) > 2000 then left(t, 2000) || chr(10) || chr(10) || '... [truncated, ' || length(t) || ' chars total]' else t end as x from b),
h as (select *, 'search_documents' as tool from c2 union all select *, 'search_code' from c2 where l = 'en'),
k as (select *, row_number() over (partition by tool order by score desc, cast(vec_id as varchar)) as rank from h),
o as (select tool, string_agg('### Result ' || rank || ' (score: ' || printf('%.4f', score) || ')' || chr(10) || '**File:** `' || file || '` — Lines 1–' || hi || case when l is not null then ' (' || l || ')' else '' end || chr(10) || chr(10)
  || case when l is not null then '```' || l || chr(10) || x || chr(10) || '```' else x end || chr(10), chr(10) || '---' || chr(10) order by rank) as text from k where rank <= case when tool = 'search_code' then 2 else 3 end group by 1),
r as (select *, row_number() over (order by exact desc, priority, file_path, start_line, concept) as rank, count(*) over () as total from hit),
lk as (select 'Found ' || any_value(total) || ' entries for ''' || any_value((select upper(p_name) from part where p_partkey = 1)) || '''' || case when any_value(total) > 10 then ' (showing top 10)' else '' end || chr(10) || chr(10)
  || string_agg('- **' || concept || '** (' || entry_type || ')' || chr(10) || '  File: `' || substr(file_path, 3) || '` — Lines ' || start_line || '–' || (start_line + 3) || chr(10) || '  Path: `' || file_path || '`', chr(10) order by rank) as text from r where rank <= 10)
select case when tool = 'search_documents' then 0 else 1 end as n, tool, md5(text) as text_md5 from o union all select 2, 'lookup_index', md5('No entries found for concept: ''no such concept''') union all select 3, 'lookup_index', md5(text) from lk""",
    "tool_list": "select * from (values ('search_documents', 'query', 3), ('search_code', 'query', 3), ('lookup_index', 'concept', 1)) as t(tool, required, arguments)",
    "chunk_ids": f"with {CODE} select path as source_path, sym as method, 'C' as class from me where size > 6",
    "corpus_setup": f"with {CODE} select ext, count(*) as files, cast(sum(c0 - 1 + case when kind = 'none' then 0 else size end) as bigint) as lines from d group by 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
