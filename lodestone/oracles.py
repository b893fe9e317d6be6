"""The queries of ``queries`` in SQL, written as relations over lines rather than as folds over arrays."""

from __future__ import annotations

# Shared definitions. RE2 has no lookaround: the inline rule is stated by what stands before and after.
FILES = r"""
f as (select source || '/' || doc_id || '.txt' as path, doc_id || '.txt' as name, doc_id, source, text as content from documents)
"""
MD = r"""
raw as (select source || '/' || doc_id || '.md' as path, doc_id || '.md' as name, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
md0 as (
  select path, name, i, case when i % 9 = 0 then '## Part ' || i when i % 7 = 0 then '$$' when i % 5 = 0 then '$' || x || '$' when i % 11 = 0 then '**Theorem ' || i || '.1** ' || x else x end
         || case when i % 4 = 0 then chr(10) else '' end as x from raw),
f as (select path, name, string_agg(x, chr(10) order by i) as content from md0 group by all)
"""
LINES = r"""
u as (select path, name, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as a from f where content is not null and content <> ''),
v as (select path, name, case when a[-1] = '' then a[:-2] else a end as a from u),
l as (select path, name, unnest(a) as x, generate_subscripts(a, 1) as i from v),
n as (select path, name, max(i) as n from l group by all)
"""
HEADER = r"regexp_matches(x, '^\s*#{1,6}\s+\S')"
TITLE = r"regexp_extract(trim(x, chr(32) || chr(9) || chr(10)), '^#{1,6}\s+(.*)', 1)"
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
MARKERS = r"\\\\|\\frac|\\sum|\\prod|\\int|\\mathbb|\\mathcal|\\operatorname|\\oplus|\\odot|\\oslash|\\otimes|\\in|\\to|\\mapsto|\\coloneqq|\\leq|\\geq|\\neq|\\subseteq|\^\{|_\{"


def density(texts: str) -> str:
    """Relation dens(key, density) of a relation with key and text."""
    return rf"""
dl as (select key, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {texts}),
dd as (select key, x, regexp_matches(x, '^\s*\$\$') as d, coalesce(sum(case when regexp_matches(x, '^\s*\$\$') then 1 else 0 end) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from dl),
dens as (select key, sum(case when d or inside or regexp_matches({STRIP.format('x')}, '(^|[^$])\$[^$].*?\$([^$]|$)') or regexp_matches(x, '{MARKERS}') then 1 else 0 end) / count(*) as density from dd group by 1)
"""


SECTIONS = rf"""
h as (select *, sum(case when {HEADER} then 1 else 0 end) over (partition by path order by i) as s from l),
s0 as (select path, name, s, min(i) as start_line, max(i) as end_line, string_agg(x, chr(10) order by i) as t, arg_min(x, i) as head from h group by all),
s1 as (select path, name, start_line, end_line, {STRIP.format('t')} as text, case when s = 0 then name else (select {TITLE} from (select head as x)) end as title from s0),
sec as (select *, row_number() over (partition by path order by start_line) as k from s1 where text <> '')
"""
_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


def windows(size: int, cap: int | None = None) -> str:
    text = STRIP.format("string_agg(x, chr(10) order by i)")
    text = f"left({text}, {cap})" if cap else text
    return f"w as (select path, name, min(i) as start_line, max(i) as end_line, {text} as text from l group by path, name, (i - 1) // {size}), win as (select * from w where text <> '')"


def merged(least: int, backward: bool) -> str:
    """Relation mrg(path, name, k, g): the group of each row of sec (numbered k by path)."""
    tail = f"""
gs as (select path, g, max(end_line) - min(start_line) + 1 as n, max(g) over (partition by path) as last from fold join sec using (path, k) group by path, g),
mrg as (select path, k, case when fold.g > 1 and fold.g = last and n < {least} then fold.g - 1 else fold.g end as g from fold join gs using (path, g))""" if backward else "mrg as (select path, k, g from fold)"
    return f"""
fold as (
  select path, k, 1 as g, start_line as lo, end_line as hi from sec where k = 1
  union all
  select s.path, s.k, case when f.hi - f.lo + 1 < {least} then f.g else f.g + 1 end, case when f.hi - f.lo + 1 < {least} then f.lo else s.start_line end, s.end_line
  from fold f join sec s on s.path = f.path and s.k = f.k + 1),
{tail},
grp as (select path, any_value(name) as name, g, min(start_line) as start_line, max(end_line) as end_line, string_agg(text, chr(10) || chr(10) order by k) as text, arg_min(title, k) as title from mrg join sec using (path, k) group by path, g)
"""


def split(source: str, most: int) -> str:
    """Relation cut(path, title, start_line, end_line, text): pieces of the rows of ``source``."""
    return rf"""
big as (select *, path || ':' || start_line as key, len(string_split(text, chr(10))) as nl from {source}),
bl as (select key, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from big where end_line - start_line + 1 > {most} and nl > {most}),
bs as (select key, i from (select *, sum(case when regexp_matches(x, '^\s*\$\$') then 1 else 0 end) over (partition by key order by i) as d from bl) where not regexp_matches(x, '\S') and d % 2 = 0),
walk as (
  select key, 0 as pos, nl, 0 as step, cast(null as bigint) as cut from big where end_line - start_line + 1 > {most} and nl > {most}
  union all
  select key, nxt + 1, nl, step + 1, nxt from (
    select w.key, w.nl, w.step, coalesce((select max(i) from bs where bs.key = w.key and i > w.pos and i <= w.pos + {most}), (select min(i) from bs where bs.key = w.key and i > w.pos)) as nxt
    from walk w where w.pos + {most} < w.nl) where nxt is not null),
pc as (select key, pos as a, coalesce(lead(cut) over (partition by key order by step), nl) as b, nl from walk),
pt as (select key, a, b, any_value(nl) as nl, coalesce({STRIP.format("string_agg(x, chr(10) order by i)")}, '') as text from pc join bl using (key) where i >= a and i < b group by key, a, b),
pn as (select *, row_number() over (partition by key order by a) as r from pt where text <> ''),
cut as (
  select big.path, big.name, title, start_line, end_line, big.text from big where key not in (select key from pn)
  union all
  select path, name, title, start_line + a, case when b < pn.nl then start_line + b - 1 else end_line end, case when r > 1 then '## ' || title || ' (continued)' || chr(10) || chr(10) || pn.text else pn.text end
  from pn join big using (key))
"""


def plaintext(most: int, least: int) -> str:
    """Relation grp of the plain-text chunks of f, by way of relations of paragraphs."""
    return rf"""
b as (select *, i - row_number() over (partition by path order by i) as g from l where regexp_matches(x, '\S')),
pa as (select path, any_value(name) as name, min(i) as start_line, max(i) as end_line, {STRIP.format('string_agg(x, chr(10) order by i)')} as text, any_value(name) as title from b group by path, g),
pk as (select *, row_number() over (partition by path order by start_line) as k from pa),
fill as (
  select path, k, 1 as g, start_line as lo from pk where k = 1
  union all
  select p.path, p.k, case when p.end_line - f.lo + 1 > {most} then f.g + 1 else f.g end, case when p.end_line - f.lo + 1 > {most} then p.start_line else f.lo end from fill f join pk p on p.path = f.path and p.k = f.k + 1),
sec as (select path, any_value(name) as name, g as k, min(start_line) as start_line, max(end_line) as end_line, string_agg(text, chr(10) || chr(10) order by k) as text, any_value(title) as title from fill join pk using (path, k) group by path, g),
{merged(least, False)}
"""


POINTS = """
p as (select vec_id, embedding, label, vec_id % 10 / 10.0 as math_density, source, n_chars from embeddings left join documents on vec_id = doc_id),
q as (select embedding::double[] as v from embeddings where vec_id = 0)
"""


def topk(where: str) -> str:
    return f"""with {POINTS},
s as (select vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score, source, n_chars from p, q where {where})
select cast(row_number() over (order by score desc, vec_id) as int) as rank, vec_id, score, source, n_chars from s order by score desc, vec_id limit 10"""


PART = """
t as (select ['definition', 'theorem', 'proposition', 'corollary', 'lemma', 'section', 'term', 'class', 'function', 'method', 'remark'] as kinds),
e as (select p_name as concept, 'd/f' || p_partkey % 7 || '.md' as file_path, cast(p_partkey as int) as start_line, kinds[p_size % 11 + 1] as entry_type, kinds from part, t),
c as (select lower(p_name) as q from part where p_partkey = 1),
hit as (
  select concept, entry_type, start_line, file_path, cast(lower(concept) = q as int) as exact,
         cast(case when entry_type = 'remark' then 99 else list_position(kinds, entry_type) - 1 end as int) as priority
  from e, c where contains(lower(concept), q) or contains(q, lower(concept)))
"""

EVAL = rf"""
f as (select source || '/' || doc_id || '.txt' as path, doc_id || '.txt' as name, doc_id, text as content from documents),
{LINES},
ids as (select path, doc_id from f),
gold as (select 'q' || doc_id % 20 as query_id, 2 as grade, doc_id as span_id, path as file, doc_id % 4 + 1 as s_lo, doc_id % 4 + 1 + doc_id % 3 as s_hi from ids),
spans as (select * from gold union all select query_id, 1, span_id, file, greatest(s_lo - 2, 1), s_hi + 2 from gold),
win as (
  select label, path, min(i) as lo, max(i) as hi from l, (values ('line-2', 2), ('line-5', 5), ('whole-file (canary)', 1000000000)) as c(label, size)
  group by label, path, (i - 1) // size having regexp_matches(string_agg(x, chr(10)), '\S')),
rk as (select label, 'q' || doc_id % 20 as query_id, path, lo, hi, row_number() over (partition by label, doc_id % 20 order by (doc_id * 7 + lo * 3) % 101, doc_id, lo) as rank from win join ids using (path)),
res as (select * from rk where rank <= 10),
wt as (select path, i, len(regexp_extract_all(x, '\S+')) as tokens from l),
ks as (select unnest([3, 5, 7, 10]) as k),
labels as (select distinct label from res),
gl as (select query_id, grade, span_id, path, i, tokens from spans join wt on path = file and i between s_lo and s_hi),
cov as (
  select label, k, grade, coalesce(sum(tokens) filter (where exists (select 1 from res r where r.label = labels.label and r.query_id = gl.query_id and r.path = gl.path and r.rank <= k and i between r.lo and r.hi)), 0) / sum(tokens) as coverage
  from gl, ks, labels group by all),
ns as (select grade, count(*) as n_spans from spans group by 1),
rl as (
  select label, query_id, rank, k, tokens, exists (select 1 from spans s where s.query_id = res.query_id and s.file = res.path and i between s_lo and s_hi) as useful
  from res, ks, wt where wt.path = res.path and i between lo and hi and rank <= k),
cq as (select label, k, query_id, coalesce(sum(tokens) filter (where useful), 0) / sum(tokens) as c from rl group by all having sum(tokens) > 0),
con as (select label, k, avg(c) as concentration from cq group by all),
tou as (select label, k, g.query_id, span_id, max(case when lo <= s_lo and s_hi <= hi then 1 else 0 end) as whole from res r, ks, gold g where r.query_id = g.query_id and path = file and rank <= k and lo <= s_hi and s_lo <= hi group by all),
who as (select label, k, count(*) as n_overlapped, sum(whole) / count(*) as wholeness from tou group by all)
"""

VERSIONS = rf"""
{FILES},
{LINES},
num as (select path, cast(substr(source, 4) as int) as m from f),
{windows(40)},
w3 as (select path, min(i) as start_line, max(i) as end_line, string_agg(x, chr(10) order by i) as text from l group by path, (i - 1) // 3),
old as (select path, md5(path || ':plaintext:' || start_line || '-' || end_line) as m5 from win join num using (path) where m < 10),
new as (select path, md5(path || ':plaintext:' || start_line || '-' || end_line) as m5 from w3 join num using (path) where m >= 5 and regexp_matches(text, '\S'))
"""

ENRICH = rf"""
{FILES},
{LINES},
{windows(4)},
gr as (select *, ('0x' || substr(md5(path), 1, 12))::ubigint % 64 as g from win where end_line - start_line + 1 >= 3),
el as (select *, row_number() over (partition by g order by path, start_line) - 1 as z from gr)
"""

ANSWERS = r"""
a0 as (select conv_id, turn, regexp_replace(text, '[^A-Za-z ]', 'x', 'g') as t, (conv_id + turn) % 7 as c from conversations where text is not null)
"""


def _sample_values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


#: Written by hand from the texts of ``samples``.
SAMPLE_CHUNKS = [
    ("notes/read.md", 1, 5, "markdown", None, None, None, False), ("notes/read.md", 6, 11, "markdown", None, None, None, False), ("notes/read.md", 13, 17, "markdown", None, None, None, False),
    ("notes/plain.txt", 1, 4, "plaintext", None, None, None, False), ("notes/plain.txt", 6, 12, "plaintext", None, None, None, False),
    ("pkg/tool.py", 1, 4, "code", "python", "module_preamble", "tool.py preamble", False), ("pkg/tool.py", 7, 9, "code", "python", "function", "small", False),
    ("pkg/tool.py", 12, 20, "code", "python", "class", "Box", False), ("pkg/tool.py", 13, 14, "code", "python", "method", "Box.get", True),
    ("pkg/tool.py", 16, 18, "code", "python", "method", "Box.size", True), ("pkg/tool.py", 23, 29, "code", "python", "function", "long", False),
    ("pkg/broken.py", 1, 2, "code", "python", "module_preamble", "broken.py preamble", False), ("pkg/broken.py", 3, 4, "code", "python", "function", "f", False),
    ("pkg/broken.py", 6, 8, "code", "python", "class", "A", False),
    ("proofs/Basic.lean", 1, 2, "code", "lean", "module_preamble", "Basic.lean preamble", False), ("proofs/Basic.lean", 3, 7, "code", "lean", "function", "one", False),
    ("proofs/Basic.lean", 8, 9, "code", "lean", "theorem", "two", False), ("proofs/Basic.lean", 10, 13, "code", "lean", "class", "P", False),
    ("proofs/Basic.lean", 14, 16, "code", "lean", "lemma", "last", False),
    ("web/app.js", 1, 2, "code", "javascript", "module_preamble", "app.js preamble", False), ("web/app.js", 4, 6, "code", "javascript", "function", "go", False),
    ("web/app.js", 8, 15, "code", "javascript", "class", "View", False), ("web/app.js", 9, 11, "code", "javascript", "method", "View.constructor", True),
    ("web/app.js", 12, 14, "code", "javascript", "method", "View.draw", True),
    ("core/lib.rs", 1, 1, "code", "rust", "module_preamble", "lib.rs preamble", False), ("core/lib.rs", 3, 5, "code", "rust", "class", "Point", False),
    ("core/lib.rs", 7, 15, "code", "rust", "class", "Point", False), ("core/lib.rs", 8, 10, "code", "rust", "method", "Point.new", True),
    ("core/lib.rs", 12, 14, "code", "rust", "method", "Point.x", True), ("core/lib.rs", 17, 19, "code", "rust", "function", "main", False),
]
SAMPLE_INDEX = [
    ("notes/read.md", "First", "section", 3, 5), ("notes/read.md", "Second", "section", 6, 17), ("notes/read.md", "gap", "term", 6, 17),
    ("pkg/tool.py", "small", "function", 8, 9), ("pkg/tool.py", "Box", "class", 12, 20), ("pkg/tool.py", "Box.get", "method", 13, 14), ("pkg/tool.py", "Box.size", "method", 17, 18),
    ("pkg/tool.py", "Box.tiny", "method", 20, 20), ("pkg/tool.py", "long", "function", 23, 29),
    ("pkg/broken.py", "f", "function", 3, 4), ("pkg/broken.py", "A", "class", 6, 8), ("pkg/broken.py", "A.m", "method", 7, 8),
    ("proofs/Basic.lean", "one", "definition", 6, 7), ("proofs/Basic.lean", "two", "theorem", 9, 9), ("proofs/Basic.lean", "P", "class", 10, 13), ("proofs/Basic.lean", "last", "lemma", 14, 16),
    ("proofs/Basic.lean", "Monad", "term", 13, 16),
    ("web/app.js", "go", "function", 4, 6), ("web/app.js", "View", "class", 8, 15), ("web/app.js", "View.constructor", "method", 9, 11), ("web/app.js", "View.draw", "method", 12, 14),
    ("core/lib.rs", "Point", "class", 3, 5), ("core/lib.rs", "Point", "class", 7, 15), ("core/lib.rs", "Point.new", "method", 8, 10), ("core/lib.rs", "Point.x", "method", 12, 14), ("core/lib.rs", "main", "function", 17, 19),
]

ORACLES = {
    "vector_topk": topk("true"),
    "vector_topk_label": topk("label = 3"),
    "vector_topk_density": topk("label = 4 and math_density >= 0.5"),
    "multi_query_topk": """
with s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "line_windows": f"with {FILES}, {LINES}, {windows(40)} select path as source_path, name || ':' || start_line as section_title, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5 from win",
    "whole_file_cap": f"with {FILES}, {LINES}, {windows(10**9, 12000)} select path as source_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, cast(length(text) as int) as n_chars, md5(text) as text_md5 from win",
    "chunk_geometry": f"""with {FILES}, {LINES}, {windows(4)}
select split_part(path, '/', 1) as label, count(*) as chunks, round(avg(end_line - start_line + 1), 6) as mean_lines, cast(median(end_line - start_line + 1) as double) as median_lines, cast(max(end_line - start_line + 1) as int) as max_lines from win group by 1""",
    "line_weights": rf"with {FILES}, {LINES} select name as basename, cast(i as int) as line_no, cast(len(regexp_extract_all(x, '\S+')) as int) as tokens from l",
    "math_density": f"with {MD}, txt as (select path as key, content as text from f), {density('txt')} select key as source_path, round(density, 6) as math_density from dens",
    "point_ids": f"with {FILES}, {LINES}, {windows(40)}, m as (select *, md5(path || ':plaintext:' || start_line || '-' || end_line) as m from win) select path as source_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, {_UUID.format('m')} as point_id from m",
    "embedding_text": """
select doc_id, md5(concat_ws(chr(10) || chr(10), text, case when doc_id % 3 = 0 then 'Summary: About ' || source end, case when doc_id % 2 = 0 then 'Questions this answers: What is ' || lang || ' | Why?' end)) as text_md5 from documents""",
    "md_sections": f"with {MD}, {LINES}, {SECTIONS} select path as source_path, title as section_title, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5 from sec",
    "md_merged": f"with recursive {MD}, {LINES}, {SECTIONS}, {merged(12, True)} select path as source_path, title as section_title, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5 from grp",
    "md_split": f"with recursive {MD}, {LINES}, {SECTIONS}, {split('sec', 6)} select path as source_path, title as section_title, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5 from cut",
    "md_chunks": f"""with recursive {MD}, {LINES}, {SECTIONS}, {merged(12, True)}, {split('grp', 16)},
dk as (select path || ':' || start_line || ':' || end_line as key, text from cut), {density('dk')}
select path as source_path, title as section_title, cast(start_line as int) as start_line, cast(end_line as int) as end_line, round(density, 6) as math_density, md5(text) as text_md5 from cut join dens on key = path || ':' || start_line || ':' || end_line""",
    "section_index": f"""with {MD}, {LINES}, hd as (select path, name, i, {TITLE} as concept, lead(i) over (partition by path order by i) - 1 as e from l where {HEADER})
select {STRIP.format('concept')} as concept, name as file_name, path as file_path, cast(i as int) as start_line, cast(coalesce(e, n.n) as int) as end_line, 'section' as entry_type from hd join n using (path, name)""",
    "formal_objects": rf"""with {MD}, {LINES},
o as (select path, name, i, regexp_extract(x, '(?i)\*\*(Definition|Theorem|Proposition|Corollary|Lemma|Remark|Example)\s+([\d.]+)(?:\*\*|\s)', ['kind', 'num']) as m from l
      where regexp_matches(x, '(?i)\*\*(Definition|Theorem|Proposition|Corollary|Lemma|Remark|Example)\s+([\d.]+)(?:\*\*|\s)') and not {HEADER}),
nx as (select *, lead(x) over (partition by path order by i) as after from l),
st as (select o.path, o.i, min(nx.i - 1) as e from o join nx on nx.path = o.path and nx.i > o.i and nx.i <= o.i + 50
       where regexp_matches(nx.x, '^\s*#{{1,6}}\s+\S') or (not regexp_matches(nx.x, '\S') and nx.i - 1 > o.i + 1 and nx.after is not null and not regexp_matches(nx.after, '^\s*\$\$')) group by all)
select m.kind || ' ' || m.num as concept, o.name as file_name, o.path as file_path, cast(o.i as int) as start_line, cast(coalesce(e, least(o.i + 50, n.n)) as int) as end_line, lower(m.kind) as entry_type
from o join n on n.path = o.path left join st on st.path = o.path and st.i = o.i""",
    "key_terms": f"""with {MD}, {LINES}, t as (select unnest(['the', 'Part 18', 'que', 'verboten', 'of']) as term),
k as (select path, name, term, min(i) as i from l, t where contains(lower(x), lower(term)) group by all)
select term as concept, k.name as file_name, k.path as file_path, cast(greatest(i - 2, 1) as int) as start_line, cast(least(i + 10, n.n) as int) as end_line, 'term' as entry_type
from k join n on n.path = k.path where not exists (select 1 from l where l.path = k.path and {HEADER} and lower({STRIP.format(TITLE)}) = lower(term))""",
    "paragraphs": rf"""with {MD}, {LINES}, b as (select *, i - row_number() over (partition by path order by i) as g from l where regexp_matches(x, '\S'))
select path as source_path, cast(min(i) as int) as start_line, cast(max(i) as int) as end_line, md5({STRIP.format('string_agg(x, chr(10) order by i)')}) as text_md5 from b group by path, g""",
    "plaintext_chunks": f"with recursive {MD}, {LINES}, {plaintext(12, 6)} select path as source_path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(text) as text_md5 from grp",
    "concept_lookup": f"with {PART} select concept, entry_type, start_line, exact, priority from hit",
    "lookup_top": f"with {PART}, r as (select *, cast(row_number() over (order by exact desc, priority, file_path, start_line, concept) as int) as rank from hit) select rank, concept, entry_type, start_line from r where rank <= 10",
    "parent_context": """
with h as (select doc_id, n_chars, doc_id - doc_id % 10 as p, doc_id % 10 <> 0 as child, row_number() over (order by n_chars desc, doc_id) as rank from documents),
r as (select *, child and row_number() over (partition by child, p order by rank) = 1 as first from h where rank <= 40)
select cast(rank as int) as rank, r.doc_id, case when child then 'c' || p end as parent_id, case when first then 's' || d.doc_id end as parent_symbol, case when first then d.lang end as parent_language,
       case when first then md5(case when length(d.text) > 3000 then left(d.text, 3000) || chr(10) || '... [truncated]' else d.text end) end as parent_md5
from r left join documents d on d.doc_id = r.p and first""",
    "result_format": """
with b as (select *, case when doc_id % 2 = 0 then lang end as l, case when length(text) > 2000 then left(text, 2000) || chr(10) || chr(10) || '... [truncated, ' || length(text) || ' chars total]' else text end as t from documents)
select doc_id, md5('### Result ' || (doc_id + 1) || ' (score: ' || printf('%.4f', 1.0 / (doc_id + 1)) || ')' || chr(10) || '**File:** `' || source || '.py` — Lines 1–' || n_chars || case when l is not null then ' (' || l || ')' else '' end
  || case when doc_id % 3 = 0 then chr(10) || '**Symbol:** `sym` (function)' else '' end || case when doc_id % 5 = 0 then chr(10) || '**Summary:** Sum.' else '' end
  || case when doc_id % 4 > 0 then chr(10) || '**Math density:** ' || printf('%.2f', doc_id % 4 / 4.0) else '' end || chr(10) || chr(10)
  || case when l is not null then '```' || l || chr(10) || t || chr(10) || '```' else t end || chr(10)) as text_md5 from b""",
    "sync_incremental": f"""with {VERSIONS}
select {_UUID.format('m5')} as point_id, coalesce(new.path, old.path) as source_path, case when new.path is null then 'deleted' when old.path is null then 'inserted' else 'kept' end as state from old full join new using (m5)""",
    "deleted_counts": f"with {VERSIONS} select path as source_path, count(*) as deleted from old where path not in (select path from new) group by 1",
    "source_paths": f"with {VERSIONS} select distinct path as source_path from new",
    "coverage": f"with {EVAL} select label, cast(k as int) as k, cast(grade as int) as grade, n_spans, round(coverage, 9) as coverage from cov join ns using (grade)",
    "coverage_by_ext": f"with {EVAL} select label, cast(k as int) as k, cast(grade as int) as grade, '.txt' as ext, n_spans, round(coverage, 9) as coverage from cov join ns using (grade)",
    "concentration": f"with {EVAL} select label, cast(k as int) as k, round(coalesce(concentration, 0), 9) as concentration from labels cross join ks left join con using (label, k)",
    "wholeness": f"with {EVAL} select label, cast(k as int) as k, coalesce(n_overlapped, 0) as n_overlapped, round(coalesce(wholeness, 0), 9) as wholeness from labels cross join ks left join who using (label, k)",
    "canary": f"""with {EVAL}, b as (select label, k, coverage, concentration from cov join con using (label, k) where grade = 2)
select cast(k as int) as k, bool_and(o.coverage < c.coverage and o.concentration < c.concentration) as canary_best from b c join b o using (k) where c.label = 'whole-file (canary)' and o.label <> c.label group by k""",
    "report_pivot": f"""with {EVAL},
m as (select label, 'coverage@' || k || case when grade = 2 then ' (decisive)' else ' (supportive)' end as metric, printf('%.3f', coverage) as value from cov
  union all select label, '.txt coverage@' || k || ' (n=' || n_spans || ')', printf('%.3f', coverage) from cov join ns using (grade) where grade = 2
  union all select label, 'concentration@' || k, printf('%.3f', concentration) from con
  union all select label, p || ' wholeness@' || k, printf('%.3f (n=%d)', coalesce(wholeness, 0), coalesce(n_overlapped, 0)) from labels cross join ks cross join (values ('overall'), ('.txt')) as x(p) left join who using (label, k))
select metric, max(value) filter (where label = 'line-2') as line_2, max(value) filter (where label = 'line-5') as line_5, max(value) filter (where label = 'whole-file (canary)') as whole_file from m group by 1""",
    "setup_counts": f"""with {MD}, {LINES}, t as (select regexp_replace(text, '\\r\\n?', chr(10), 'g') as t from documents),
c as (select '.txt' as ext, len(string_split(t, chr(10))) - case when t = '' or t like '%' || chr(10) then 1 else 0 end as n from t)
select ext, count(*) as files, cast(sum(n) as bigint) as lines from c group by 1 union all select '.md', (select count(*) from documents), (select count(*) from l)""",
    "ext_dispatch": """
with x as (select doc_id, (['.md', '.py', '.js', '.rs', '.lean', '.frag', '.txt', '.rst', '.hpp', ''])[doc_id % 10 + 1] as ext from documents),
m as (select * from (values ('.md', 'markdown', null), ('.py', 'python', 'python'), ('.js', 'code', 'javascript'), ('.rs', 'code', 'rust'), ('.lean', 'lean', 'lean'), ('.frag', 'code', 'glsl'), ('.hpp', 'code', 'cpp')) as t(ext, strategy, language))
select x.ext, coalesce(strategy, 'plaintext') as strategy, language, count(*) as files from x left join m on m.ext = x.ext group by all""",
    "enrich_batches": f"with {ENRICH} select path as source_path, cast(start_line as int) as start_line, g || '-' || z // 10 as batch, cast(z % 10 + 1 as int) as id from el",
    "enrich_prompts": f"""with {ENRICH},
p as (select g || '-' || z // 10 as b, z % 10 + 1 as id, '--- CHUNK ' || (z % 10 + 1) || ' ---' || chr(10) || 'Type: plaintext' || chr(10) || 'File: ' || name || case when start_line = 1 then ' (en)' else '' end || chr(10) || 'Lines: ' || start_line || '-' || end_line || chr(10) || chr(10) || left(text, 2000) as t from el)
select b as batch, cast(count(*) as int) as n, md5('Passages: ' || count(*) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by id)) as prompt_md5 from p group by b""",
    "enrich_parse": rf"""with {ANSWERS}
select conv_id, turn, c in (0, 1) as ok, case when c in (0, 1) then '1:' || {STRIP.format("(' ' || t || ' 1 ')")} || ';2:' || {STRIP.format("(' ' || t || ' 2 ')")} end as items,
       case when c in (0, 1) then '' when c = 2 then 'Expected 2 chunks but got' [:24] when c = 3 then 'Chunk ids did not match 1..2' [:24] else 'Could not parse JSON fro' end as error from a0""",
    "chunk_type_counts": f"""with recursive {MD}, {LINES}, {SECTIONS}, {merged(20, True)}, {split('grp', 100)},
dk as (select path || ':' || start_line || ':' || end_line as key, text from cut), {density('dk')}
select 'markdown' as chunk_type, count(*) as chunks, round(sum(density), 6) as density_sum from dens
union all select 'plaintext', (with recursive {FILES}, {LINES}, {plaintext(100, 20)} select count(*) from grp), 0e0""",
    "hash_embedding": """
with recursive s as (select item_id, 0 as pos, cast(('0x' || substr(md5(text), 25, 8))::ubigint & 2147483647 as bigint) as st, cast(null as double) as v from benchmark where text is not null
  union all select item_id, pos + 1, (st * 1103515245 + 12345) & 2147483647, ((st * 1103515245 + 12345) & 2147483647) / 2147483647.0::double - 0.5 from s where pos < 16),
n as (select item_id, sqrt(sum(v * v)) as n from s where v is not null group by 1)
select item_id, cast(pos - 1 as int) as pos, round(v / n, 9) as value from s join n using (item_id) where v is not null""",
    "sample_chunks": f"select * from (values {_sample_values(SAMPLE_CHUNKS)}) as t(source_path, start_line, end_line, chunk_type, language, symbol_type, symbol_name, has_parent)",
    "sample_index": f"select * from (values {_sample_values(SAMPLE_INDEX)}) as t(file_path, concept, entry_type, start_line, end_line)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
