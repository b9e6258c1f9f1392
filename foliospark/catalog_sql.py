"""SQL for DuckDB that gives the rows of the core's queries, written from their meaning: by line tables and windows where
the operators work on arrays."""

from __future__ import annotations

from foliospark.options import ANALYSIS_HEADINGS, EXCLUDED_SECTIONS, HINT_EXCLUDED, PROTECTED_SECTIONS, REFUSAL_PHRASES

W = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
TITLES = "['Introduction','References','Methods','Notes on contributors','Index terms']"
MD = f"""base as (select doc_id, text, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
  CASE WHEN i = 1 THEN '# ' || x
       WHEN (i-1) % 6 = 2 THEN '## ' || ({TITLES})[(doc_id+i-1) % 5 + 1]
       WHEN (i-1) % 6 = 4 THEN chr(10) || '### ' || x
       WHEN (i-1) % 6 = 5 THEN '  - ' || x
       ELSE x END), chr(10)) as md0 from documents)"""
PLAIN, SHIFT, H1 = "md0", "substr(replace(chr(10) || md0, chr(10) || '#', chr(10) || '##'), 2)", "replace(md0, chr(10) || '### ', chr(10) || '# ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def any_of(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def lines(md: str, dialect: str = "python") -> str:
    """md and its lines: (doc_id, n, line, s, level, title); n from 0, s the stripped line."""
    cut = r"string_split_regex(md, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')" if dialect == "python" else "string_split(md, chr(10))"
    drop = "where not (line = '' and n = last)" if dialect == "python" else ""
    return f"""with {MD}, md as (select doc_id, text, {md} as md from base), parts as (select doc_id, {cut} as p from md),
ln as (select doc_id, n, line, {strip("line")} as s from (select doc_id, unnest(p) as line, generate_subscripts(p, 1) - 1 as n, len(p) - 1 as last from parts) {drop}),
hd as (select *, nullif(length(regexp_extract(s, '^(#{{1,10}}){W}', 1)), 0) as level, regexp_extract(s, '^#{{1,10}}{W}+(.*)', 1, 's') as title from ln)"""


def back(column: str, name: str, ctes: str, source: str, by: str = "chr(10)", where: str = "true") -> str:
    """One row per document: the column's lines joined in order, documents without a line give empty text."""
    return f"""{ctes} select doc_id, coalesce(t, '') as {name} from md left join
  (select doc_id, string_agg({column}, {by} order by n) as t from {source} where {where} group by doc_id) using (doc_id)"""


# Sections: (g) the running number of excluded headings, the level of the last, and whether another heading ended it.
SKIP = f""", ex as (select *, level is not null and {any_of("lower(title)", EXCLUDED_SECTIONS)} and not {any_of("lower(title)", PROTECTED_SECTIONS)} as x from hd),
g as (select *, sum(x::int) over (partition by doc_id order by n) as g from ex),
l0 as (select *, first_value(level) over (partition by doc_id, g order by n) as lvl from g),
kp as (select *, g = 0 or (not x and max((not x and level is not null and level <= lvl)::int) over (partition by doc_id, g order by n) = 1) as keep from l0)"""
KEPT = SKIP + f", kept as (select doc_id, coalesce({strip('string_agg(line, chr(10) order by n) filter (keep)')}, '') as md from kp group by doc_id)"


def outlined(source: str, column: str, prefix: str = "o_") -> str:
    """CTEs: the outline (doc_id, outline) of a text column of a source with doc_id."""
    p = prefix
    cut = rf"string_split_regex({column}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f""", {p}a as (select doc_id, {cut} as p from {source}),
{p}b as (select doc_id, n, line from (select doc_id, unnest(p) as line, generate_subscripts(p, 1) - 1 as n from {p}a)),
{p}c as (select *, nullif(length(regexp_extract(line, '^(#{{1,10}}){W}', 1)), 0) as fl from {p}b),
{p}d as (select *, min(fl) over (partition by doc_id) as top from {p}c),
{p}e as (select doc_id, n, case when fl is not null and top > 1 and top < 10 then repeat('#', (fl - top + 1)::int) || ' ' || {strip("regexp_replace(line, '^#{1,10}', '')")} else line end as line from {p}d),
{p}f as (select *, {strip("line")} as s, nullif(length(regexp_extract({strip("line")}, '^(#{{1,10}}){W}', 1)), 0) as level from {p}e),
{p}g as (select *, coalesce(last_value(level ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row), 0) as cur,
  length(line) - length(regexp_replace(line, '^{W}+', '')) as lead from {p}f where s <> ''),
{p}h as (select doc_id, n, case when level is not null then repeat(' ', (2 * (level - 1))::int) || '- ' || regexp_extract(s, '^#{{1,10}}{W}+(.*)', 1, 's')
  else repeat(' ', (2 * cur + lead)::int) || '- ' || regexp_replace(s, '^(?:[-*+]|[0-9]+\\.){W}+', '') end as line from {p}g),
{p}o as (select d.doc_id, coalesce(t, '') as outline from {source} d left join (select doc_id, string_agg(line, chr(10) order by n) as t from {p}h group by doc_id) using (doc_id))"""


def grouped(md: str, starts: str) -> str:
    """CTEs: chunks (doc_id, chunk_no, chunk) that begin at lines where `starts` holds."""
    return f"""{lines(md, "web")}, gr as (select *, sum((n > 0 and ({starts}))::int) over (partition by doc_id order by n) as c from hd),
ch as (select doc_id, c::int as chunk_no, string_agg(line, chr(10) order by n) as chunk from gr group by doc_id, c)"""


def packed(source: str, by: str, width: int, limit: int) -> str:
    """Recursive packing of the parts of (id, t): (id, chunk_no, chunk)."""
    return f""", pk_p as (select id, string_split(t, {by}) as p from {source}),
pk as (select id, p, 1 as i, 0 as c, length(p[1]) + {width} as n from pk_p
  union all select id, p, i + 1, case when n + length(p[i+1]) + {width} > {limit} then c + 1 else c end,
  case when n + length(p[i+1]) + {width} > {limit} then length(p[i+1]) + {width} else n + length(p[i+1]) + {width} end from pk where i < len(p)),
pk_o as (select id, c::int as chunk_no, string_agg(p[i], {by} order by i) as chunk from pk group by id, c)"""


def hierarchy(limit: int, source: str = "base", column: str = "md0") -> str:
    """CTEs: levels two to four and paragraphs, each cutting only what is over the limit; `k` orders the chunks `t` of
    `every` (doc_id, k, t)."""
    out = f", l1 as (select doc_id, [0] as k, {column} as t from {source})"
    for number, (mark, prior) in enumerate((("##", "l1"), ("###", "l2"), ("####", "l3"))):
        name, where = f"l{number + 2}", "true" if number == 0 else f"length(t) > {limit}"
        out += f""", {name}_n as (select doc_id, k, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from {prior} where {where}),
{name}_g as (select *, sum((n > 1 and starts_with(line, '{mark} '))::int) over (partition by doc_id, k order by n) as c from {name}_n),
{name} as (select doc_id, list_append(k, c::int) as k, string_agg(line, chr(10) order by n) as t from {name}_g group by doc_id, k, c
  union all select doc_id, list_append(k, 0), t from {prior} where not ({where}))"""
    out += f", big as (select {{'d': doc_id, 'k': k}} as id, t from l4 where length(t) > {limit})" + packed("big", "chr(10) || chr(10)", 2, limit)
    return out + f""", every as (select doc_id, list_append(k, 0) as k, t from l4 where length(t) <= {limit} union all select id.d, list_append(id.k, chunk_no), chunk from pk_o)"""


FIXED = """with recursive docs as (select doc_id, coalesce(text, '') as t from documents),
cut as (select doc_id, t, 0 as s, 0 as e, -1 as k from docs
  union all select doc_id, t, e, case when e + 600 >= length(t) then length(t)
    when instr(substr(t, e + 601), chr(10)) > 0 and instr(substr(t, e + 601), chr(10)) - 1 < 200 then e + 600 + instr(substr(t, e + 601), chr(10)) else e + 600 end, k + 1
  from cut where e < length(t))
select doc_id, k::int as chunk_no, substr(t, s + 1, e - s) as chunk from cut where k >= 0"""

# Anchors: exactly, else the window at a place of the first ten letters with the least edit distance, the first of equals.
TOC = f"""with docs as (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as t from documents),
ln as (select doc_id, text, t, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from docs),
an as (select doc_id, text, t, i, 'T' || i as title, case when i % 18 = 12 then substr(x, 1, 12) || '~' || substr(x, 14, 17) else substr(x, 1, 30) end as anchor from ln where i % 6 = 0),
ab as (select *, {strip("lower(anchor)")} as b from an),
near as (select doc_id, i, min({{'d': d, 'p': p}}).p as p from (select doc_id, i, p - 1 as p, levenshtein(b, substr(t, p, length(b))) as d, floor(length(b) * 0.3) as most
  from (select *, unnest(range(1, length(t) + 1)) as p from ab where length(b) > 10 and instr(t, b) = 0 and instr(t, substr(b, 1, 10)) > 0) where substr(t, p, 10) = substr(b, 1, 10)) where d <= most group by doc_id, i),
en as (select ab.*, coalesce(case when b <> '' and instr(t, b) > 0 then instr(t, b) - 1 end, near.p, case when instr(t, lower(title)) > 0 then instr(t, lower(title)) - 1 end) as pos from ab left join near using (doc_id, i)),
ps as (select *, length(text) as n, row_number() over (partition by doc_id order by i) - 1 as k from en),
nx as (select *, coalesce(first_value(pos ignore nulls) over (partition by doc_id order by k rows between 1 following and unbounded following), n) as e from ps),
st as (select *, coalesce(pos, lag(e) over (partition by doc_id order by k), 0) as s from nx)"""

FUZZY = f"""with an as (select doc_id, lower(coalesce(text, '')) as t, case when trim(coalesce(text, ''), ' ') = '' then '' else substr(piece, 1, 12) || '~' || substr(piece, 14, 40) end as anchor
  from (select doc_id, text, trim(lower(substr(text, greatest(length(text) // 2, 1), 40)), ' ') as piece from documents)),
a as (select doc_id, t, anchor, {strip("anchor")} as b from an),
pos as (select doc_id, t, b, unnest(range(1, length(t) + 1)) as p from a where length(b) > 10 and instr(t, b) = 0),
hit as (select doc_id, b, p - 1 as p, levenshtein(b, substr(t, p, length(b))) as d from pos where substr(t, p, 10) = substr(b, 1, 10)),
best as (select doc_id, min({{'d': d, 'p': p}}) as m from hit where d <= floor(length(b) * 0.3) group by doc_id)
select a.doc_id, a.anchor, case when b = '' then null when instr(t, b) > 0 then instr(t, b) - 1 else m.p end::int as pos from a left join best using (doc_id)"""


def words(x: str, most: int) -> str:
    """The first words of a text as a pattern that takes any white space between them."""
    return f"array_to_string(list_transform(list_filter(string_split_regex({x}, '{W}+'), lambda w: w <> '')[1:{most}], lambda w: regexp_escape(w)), '\\s+')"


# A cursor that only goes forward: title and snippet, else ten words of the snippet, else the title.
WEB_ANCHORS = f"""with recursive {MD}, sp as (select doc_id, md0, string_split(md0, chr(10)) as p from base),
hl as (select doc_id, md0, unnest(p) as x, generate_subscripts(p, 1) as i, p from sp),
h0 as (select doc_id, md0, substr(x, 4) as t0, coalesce(p[i + 1], '') as y, row_number() over (partition by doc_id order by i) - 1 as k from hl where starts_with(x, '## ')),
h as (select doc_id, md0, k, case when k % 3 = 2 then 'No such ' || t0 else t0 end as title, case when k % 2 = 0 then '' else y end as snippet from h0),
w as (select *, {words("title", 1000)} as pt, {words("snippet", 5)} as p5, {words("snippet", 10)} as p10,
  len(list_filter(string_split_regex(snippet, '{W}+'), lambda x: x <> '')) as n from h),
cur as (select doc_id, -1 as k, 0 as cu, null::bigint as pos, null::varchar as title from base
  union all select doc_id, k, (case when hit > 0 then cu + hit else cu end)::int, case when hit > 0 then cu + hit - 1 end, title from (
    select doc_id, k, cu, title, case when a <> '' then instr(rest, a) when b <> '' then instr(rest, b) when c <> '' then instr(rest, c) else 0 end as hit from (
      select w.doc_id, w.k, w.title, cur.cu, substr(md0, cur.cu + 1) as rest,
        case when pt <> '' and p5 <> '' then regexp_extract(substr(md0, cur.cu + 1), '(?i)(?:' || pt || ')[\\s\\S]{{0,500}}?' || p5) else '' end as a,
        case when n >= 5 then regexp_extract(substr(md0, cur.cu + 1), '(?i)' || p10) else '' end as b,
        case when pt <> '' then regexp_extract(substr(md0, cur.cu + 1), '(?i)' || pt) else '' end as c
      from cur join w on w.doc_id = cur.doc_id and w.k = cur.k + 1))),
found as (select doc_id, pos, title, row_number() over (partition by doc_id order by pos) as id, lead(pos) over (partition by doc_id order by pos) as e from cur where pos is not null)
select f.doc_id, id::int as chapter_no, title, {strip("substr(md0, (pos + 1)::int, (coalesce(e, length(md0)) - pos)::int)")} as text from found f join base using (doc_id)
union all select doc_id, 1, 'Full Text', {strip("md0")} from base where doc_id not in (select doc_id from found)"""

# CSV without quotes, which the sample's glossaries are.
GLOSSARY = f"""with ln as (select file_name, unnest(string_split(replace(coalesce(content, ''), chr(13), ''), chr(10))) as x, generate_subscripts(string_split(replace(coalesce(content, ''), chr(13), ''), chr(10)), 1) as n from dictionary_files)
select file_name, coalesce(string_agg({strip("string_split(x, ',')[1]")} || ': ' || {strip("string_split(x, ',')[2]")}, chr(10) order by n) filter (where contains(x, ',')), '') as glossary from ln group by file_name"""


REFUSED = any_of("res_text", REFUSAL_PHRASES)
HAS_TITLE = "starts_with(s0, '# ')"
TITLED = f"""with {MD}, f as (select doc_id, text, md0, string_split(md0, chr(10))[1] as l0 from base), g as (select *, {strip("l0")} as s0 from f)"""
CHAPTERS = grouped(PLAIN, "starts_with(line, '## ')")


HEADINGS_ONLY = f"({strip('t')} = '' or list_bool_and(list_transform(string_split({strip('t')}, chr(10)), lambda x: starts_with({strip('x')}, '#'))))"
ECHOED = strip("replace({x}, 'a', 'A')")


def echoed(x: str) -> str:
    """What the echoing stub makes of a text."""
    return ECHOED.replace("{x}", x)


def indented(x: str, by: int) -> str:
    return f"'{' ' * by}' || replace({x}, chr(10), chr(10) || '{' ' * by}')"


def paper_pipeline(web: bool, archived: bool = False) -> str:
    """The whole paper pipeline with the echoing stub: python or web with sections removed, or the archived web one."""
    start = lines(echoed("md0"), "web" if web else "python").replace("with ", "with recursive ", 1)
    kept = ", kept0 as (select doc_id, md from md)" if archived else SKIP + f", kept0 as (select md.doc_id, coalesce(k.md, '') as md from md left join (select doc_id, {strip('string_agg(line, chr(10) order by n) filter (keep)')} as md from kp group by doc_id) k using (doc_id))"
    answer = f"case when t = '' then chr(10) || chr(10) || '(翻訳エラー)' else {echoed('t')} end" if web else echoed("t")
    where = "true" if web else f"not {HEADINGS_ONLY}"
    out = start + kept + hierarchy(4000, "kept0", "md")
    out += f", answers as (select doc_id, k, {answer} as t from every where {where}), tr0 as (select doc_id, string_agg(t, chr(10) || chr(10) order by k) as md from answers where {'true' if web else "t <> ''"} group by doc_id)"
    if web:  # only the first heading of level one stays, and no introduction after line 30
        out += f""", tl as (select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) - 1 as n from tr0),
th as (select *, starts_with({strip("line")}, '# ') as h1, sum(starts_with({strip("line")}, '# ')::int) over (partition by doc_id order by n) as c from tl),
tr as (select doc_id, string_agg(line, chr(10) order by n) filter (case when h1 then c = 1 else not (starts_with(lower({strip("line")}), '## introduction') and n > 30) end) as md from th group by doc_id)"""
    else:
        out += ", tr as (select * from tr0)"
    out += f""", pp as (select m.doc_id, m.md as structured, k.md as kmd, coalesce(tr.md, '') as tmd, string_split(k.md, chr(10))[1] as kl, string_split(coalesce(tr.md, ''), chr(10))[1] as tl from md m join kept0 k using (doc_id) left join tr using (doc_id)),
sm as (select doc_id, structured as md from pp), """
    title = "case when starts_with(kl, '# ') then trim(substr(kl, 3)) else 'doc ' || doc_id end" if web else f"case when starts_with({strip('kl')}, '# ') then replace({strip('kl')}, '# ', '') else 'doc ' || doc_id end"
    body = f"case when starts_with(tl, '# ') then {strip('substr(tmd, length(tl) + 2)')} else tmd end" if web else strip(f"case when starts_with({strip('tl')}, '# ') then substr(tmd, length(tl) + 2) else tmd end")
    out += f"bd as (select doc_id, structured, {title} as title, {body} as md from pp){outlined('sm', 'md', 's_')}{outlined('bd', 'md', 'b_')}"
    label = "要約 (Summary)" if archived else "レジュメ (Resume)"
    part = lambda x, by: indented(x, by) if web else f"case when {x} = '' then '' else {indented(x, by)} end"
    return out + f" select doc_id, structured, '- ' || title || chr(10) || '  - {label}' || chr(10) || {part('so.outline', 4)} || chr(10) || {part('bo.outline', 2)} as outline from bd join s_o so using (doc_id) join b_o bo using (doc_id)"


def plain_lines(x: str, by: int) -> str:
    """The lines with ink of a text behind blanks."""
    return f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} <> ''), lambda l: '{' ' * by}' || l), chr(10))"


# Chapters of the fixture through the web book: structured, the book summed up, each summed up and translated.
WEB_BOOK = f"""{CHAPTERS}, c1 as (select doc_id, chunk_no as k, case when chunk = '' then '' else {echoed("chunk")} end as st from ch),
bk as (select doc_id, case when string_agg(st, '' order by k) = '' and count(*) = 1 then chr(10) || chr(10) || '(翻訳エラー)' else {strip("string_agg(st, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by k)")} end as summary from c1 group by doc_id),
tl as (select doc_id, k, st, unnest(string_split(st, chr(10))) as line, generate_subscripts(string_split(st, chr(10)), 1) - 1 as n from c1),
th as (select *, starts_with({strip("line")}, '# ') as h1, sum(starts_with({strip("line")}, '# ')::int) over (partition by doc_id, k order by n) as c from tl),
tr as (select {{'d': doc_id, 'k': k}} as doc_id, any_value(st) as st, string_agg(line, chr(10) order by n) filter (case when h1 then c = 1 else not (starts_with(lower({strip("line")}), '## introduction') and n > 30) end) as md from th group by doc_id, k){outlined("tr", "md")},
nd as (select doc_id.d as id, doc_id.k as k, '- C' || doc_id.k || chr(10) || '  - Summary' || chr(10) || {plain_lines("st", 4)} || chr(10) || '  - Translation / Body' || chr(10) || {indented("outline", 4)} as node from tr join o_o using (doc_id))
select bk.doc_id, '- Book Summary' || chr(10) || {plain_lines("summary", 2)} || chr(10) || string_agg(node, chr(10) order by k) as outline from nd join bk on bk.doc_id = nd.id group by bk.doc_id, summary"""
SIMPLE_BOOK = f"""{CHAPTERS}, c1 as (select {{'d': doc_id, 'k': chunk_no}} as doc_id, {echoed("chunk")} as st from ch),
c2 as (select doc_id, {strip("regexp_replace(st, '(?m)^#+.*$', '', 'g')")} as md from c1){outlined("c1", "st", "s_")}{outlined("c2", "md", "b_")},
nd as (select so.doc_id.d as id, so.doc_id.k as k, '- C' || so.doc_id.k || chr(10) || '  - Summary' || chr(10) || {indented("so.outline", 4)} || chr(10) || '  - Full Text (Translation)' || chr(10) || {indented("bo.outline", 4)} as node from s_o so join b_o bo using (doc_id))
select id as doc_id, string_agg(node, chr(10) order by k) as outline from nd group by id"""

# A book by the table of contents of its level-two headings, of which equal ones are found at the first's place.
BOOK = f"""with recursive {MD}, hl as (select doc_id, md0, unnest(string_split(md0, chr(10))) as x, generate_subscripts(string_split(md0, chr(10)), 1) as n from base),
toc as (select doc_id, md0, n, {strip("substr(x, 4)")} as title, {strip("x")} as anchor from hl where starts_with(x, '## ')
  union all select doc_id, md0, 0, 'All', {strip("substr(md0, 1, 20)")} from base where doc_id not in (select doc_id from hl where starts_with(x, '## '))),
ps as (select *, nullif(instr(lower(md0), lower(anchor)), 0) - 1 as pos, length(md0) as len, row_number() over (partition by doc_id order by n) - 1 as k from toc),
nx as (select *, coalesce(first_value(pos ignore nulls) over (partition by doc_id order by k rows between 1 following and unbounded following), len) as e from ps),
cp as (select {{'d': doc_id, 'k': k}} as doc_id, title, {strip("substr(md0, (pos + 1)::int, greatest(e - pos, 0)::int)")} as chapter from nx),
cs as (select doc_id, title, case when chapter = '' then '-' else {echoed("chapter")} end as summary, case when chapter = '' then '' else {echoed("chapter")} end as md from cp){hierarchy(4000, "cs", "md")},
an0 as (select doc_id, k, {echoed("t")} as res_text from every where not {HEADINGS_ONLY}),
an as (select doc_id, k, case when length(res_text) < 500 and {REFUSED} then '' else res_text end as t from an0),
tr as (select doc_id, string_agg(t, chr(10) || chr(10) order by k) as md from an where t <> '' group by doc_id),
bd as (select doc_id, {strip(f"case when starts_with({strip('string_split(md, chr(10))[1]')}, '# ') then substr(md, length(string_split(md, chr(10))[1]) + 2) else md end")} as md from (select doc_id, coalesce(tr.md, '') as md from cs left join tr using (doc_id))),
hs as (select doc_id, {echoed("substr(md0, 1, 5000)")} as md from base){outlined("cs", "summary", "s_")}{outlined("bd", "md", "b_")}{outlined("hs", "md", "h_")},
nd as (select cs.doc_id.d as id, cs.doc_id.k as k, '  - ' || title || chr(10) || '    - 章レジュメ' || chr(10) || case when so.outline = '' then '' else {indented("so.outline", 6)} end || chr(10) || case when bo.outline = '' then '' else {indented("bo.outline", 4)} end as node
  from cs join s_o so using (doc_id) join b_o bo using (doc_id))
select id as doc_id, '- doc ' || id || chr(10) || '  - 全体レジュメ' || chr(10) || case when outline = '' then '' else {indented("outline", 4)} end || chr(10) || string_agg(node, chr(10) order by k) as outline from nd join h_o on h_o.doc_id = nd.id group by id, outline"""

SQL: dict[str, str] = {
    "pipeline_book": BOOK,
    "glossary_rows": GLOSSARY,
    "glossary_list": "select file_name, updated_at from dictionary_files where starts_with(file_name, 'h')",
    "web_anchor_split": WEB_ANCHORS,
    "pipeline_paper": paper_pipeline(False),
    "pipeline_web_paper": paper_pipeline(True),
    "pipeline_archived_web_paper": paper_pipeline(True, True),
    "pipeline_web_book": WEB_BOOK,
    "pipeline_simple_book": SIMPLE_BOOK,
    "heading_table": f"{lines(PLAIN)} select doc_id, n::int as line_no, level::int as level, {strip('title')} as title from hd where level is not null",
    "heading_histogram": f"{lines(PLAIN)} select level::int as level, lang, count(*) as n from hd join documents using (doc_id) where level is not null group by level, lang",
    "extract_outline": back("s", "hint", lines(PLAIN), "hd", where=f"starts_with(s, '#') and not {any_of('s', ANALYSIS_HEADINGS)} and not {any_of('lower(s)', [w.lower() for w in HINT_EXCLUDED])}"),
    "remove_sections": f"{lines(PLAIN)}{KEPT} select doc_id, coalesce(kept.md, '') as kept from md left join kept using (doc_id)",
    "paper_outline": f"{lines(PLAIN)}{KEPT}{outlined('kept', 'md')} select doc_id, outline from o_o",
    "normalize_headings": lines(SHIFT)
    + f""", fl as (select *, nullif(length(regexp_extract(line, '^(#{{1,10}}){W}', 1)), 0) as f from hd), tp as (select *, min(f) over (partition by doc_id) as top from fl)
select md.doc_id, case when max(top) > 1 and max(top) < 10 then string_agg(case when f is not null then repeat('#', (f - top + 1)::int) || ' ' || {strip("regexp_replace(line, '^#{1,10}', '')")} else line end, chr(10) order by n) else any_value(md.md) end as shifted
from md left join tp using (doc_id) group by md.doc_id""",
    "to_outline": f"with {MD}, src as (select doc_id, {SHIFT} as md from base){outlined('src', 'md')} select doc_id, outline from o_o",
    "dedupe_h1": lines(H1, "web")
    + """, h as (select *, starts_with(s, '# ') as h1, sum(starts_with(s, '# ')::int) over (partition by doc_id order by n) as k from hd)
select doc_id, coalesce(string_agg(line, chr(10) order by n) filter (case when h1 then k = 1 else not (starts_with(lower(s), '## introduction') and n > 30) end), '') as cleaned from h group by doc_id""",
    "strip_headings": lines(PLAIN, "web") + f" select doc_id, {strip('string_agg(case when starts_with(line, chr(35)) then substr(line, 1, 0) else line end, chr(10) order by n)')} as body from hd group by doc_id",
    "squeeze": f"select doc_id, {strip(f'''regexp_replace(coalesce(text, ''), '{W}+', ' ', 'g')''')} as line from documents",
    "title_and_body": f"""{TITLED} select doc_id, case when {HAS_TITLE} then replace(s0, '# ', '') else 'untitled' end as title,
  {strip(f"case when {HAS_TITLE} then substr(md0, length(l0) + 2) else md0 end")} as body, substr(coalesce(text, ''), 1, 5000) as opening from g""",
    "split_h2": f"{CHAPTERS} select * from ch",
    "split_h3": f"{grouped(PLAIN, '''starts_with(line, '### ')''')} select * from ch",
    "drop_heading_only": f"{CHAPTERS} select * from ch where not (trim(chunk, ' ' || chr(10) || chr(9)) = '' or list_bool_and(list_transform(string_split({strip('chunk')}, chr(10)), lambda x: starts_with({strip('x')}, '#'))))",
    "pack_paragraphs": f"with recursive {MD}, src as (select doc_id as id, md0 as t from base){packed('src', 'chr(10) || chr(10)', 2, 600)} select id as doc_id, chunk_no, chunk from pk_o",
    "pack_lines": f"""with recursive {MD}, src as (select doc_id as id, md0 as t from base where length(md0) > 600){packed('src', 'chr(10)', 1, 600)}
select id as doc_id, chunk_no, chunk from pk_o union all select doc_id, 0, md0 from base where length(md0) <= 600""",
    "hier_chunks": f"with recursive {MD}{hierarchy(150)} select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_no, t as chunk from every",
    "chunk_counts": f"with recursive {MD}, src as (select doc_id as id, md0 as t from base){packed('src', 'chr(10) || chr(10)', 2, 300)} select id as doc_id, count(*) as n_chunks, count(*) filter (where {strip('chunk')} = '') as n_blank from pk_o group by id",
    "fixed_chunks": FIXED,
    "anchor_split": f"{TOC} select doc_id, k::int as chapter_no, title, {strip('substr(text, (s + 1)::int, greatest(e - s, 0)::int)')} as text, s::int as start, e::int as \"end\" from st",
    "fuzzy_anchor": FUZZY,
    "toc_json": f"""{lines(PLAIN)}, k as (select doc_id, row_number() over (partition by doc_id order by n) - 1 as r, n, {strip("title")} as title from hd where level is not null and not {any_of("lower(title)", EXCLUDED_SECTIONS)})
select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as entry_no, title as chapter_title, 'line ' || n as anchor_text from k""",
    "web_toc_json": "select distinct chapter_id, chapter_no as chapter_number, title from chapters",
    "refusal_filter": f"select call_id, case when length(res_text) < 500 and {REFUSED} then '' else coalesce(res_text, '') end as kept from (select distinct call_id, res_text from translation_chunks)",
    "glossary_latest": "select file_name, updated_at, max(entry_id) as entry_id from glossary_sample g where updated_at = (select max(updated_at) from glossary_sample h where h.file_name = g.file_name) group by file_name, updated_at",
    "glossary_compiled": f"select string_agg({strip('content')}, chr(10) order by -coalesce(updated_at, 0), file_name) as glossary from dictionary_files where content is not null",
    "glossary_delete": "select file_name, updated_at from dictionary_files where file_name not like '%s.csv'",
    "join_context": "select call_id, chunk_no, '{ctx} ' || paper_name || chr(10) || clean_markdown || chr(10) || 'term: 訳' as prompt from (select distinct call_id, paper_id, chunk_no, clean_markdown from translation_chunks) join paper_pipeline using (paper_id)",
    "ordered_answers": """with l as (select *, row_number() over (partition by paper_id, chunk_no order by attempt desc, call_id desc) as r from translation_chunks where res_text is not null)
select paper_id, string_agg(res_text, chr(10) || chr(10) order by chunk_no) as answer from l where r = 1 group by paper_id""",
    "positional_join": f"""{CHAPTERS}, g3 as (select doc_id, sum((n > 0 and starts_with(line, '### '))::int) over (partition by doc_id order by n) as c, n, line from hd),
c3 as (select doc_id, c::int as chunk_no, string_agg(line, chr(10) order by n) as chapter from g3 group by doc_id, c)
select doc_id, chunk_no as chapter_no, 'C' || chunk_no as title, chapter from ch join c3 using (doc_id, chunk_no)""",
    "joined_markdown": f"{CHAPTERS} select doc_id, string_agg(chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chunk_no) as markdown from ch group by doc_id",
    "model_stub": f"select paper_id, {strip('''upper(replace(structured_md, chr(10) || chr(10), ' '))''')} as answer from paper_pipeline where structured_md is not null",
    "assemble_paper": f"""{TITLED}, body as (select doc_id, case when {HAS_TITLE} then replace(s0, '# ', '') else 'doc ' || doc_id end as title,
  {strip(f"case when {HAS_TITLE} then substr(replace(md0, 'a', 'A'), length(l0) + 2) else replace(md0, 'a', 'A') end")} as md from g){outlined('body', 'md')}
select doc_id, '- ' || title || chr(10) || '  - レジュメ (Resume)' || chr(10) || '    - S' || chr(10) || '      - a' || chr(10) || '      - b' || chr(10) ||
  case when outline = '' then '' else '  ' || replace(outline, chr(10), chr(10) || '  ') end as outline from body join o_o using (doc_id)""",
    "heading_chunks": f"""with recursive {MD}, nl as (select doc_id, unnest(string_split(md0, chr(10))) as line, generate_subscripts(string_split(md0, chr(10)), 1) as n from base),
gr as (select *, sum((n > 1 and starts_with(ltrim(line, ' ' || chr(9)), '#'))::int) over (partition by doc_id order by n) as c from nl),
hc as (select doc_id, c::int as c, string_agg(line, chr(10) order by n) as t from gr group by doc_id, c),
src as (select {{'d': doc_id, 'c': c}} as id, t from hc where length(t) > 60){packed('src', 'chr(10)', 1, 60)},
every as (select doc_id, c, 0 as k, t from hc where length(t) <= 60 union all select id.d, id.c, chunk_no, chunk from pk_o)
select doc_id, (row_number() over (partition by doc_id order by c, k) - 1)::int as chunk_no, t as chunk from every""",
    "chapters_h1": f"""{grouped(H1, "starts_with(line, '# ') and length(line) > 2")} select doc_id, chunk_no as c_no,
  case when starts_with(chunk, '# ') and length({strip('string_split(chunk, chr(10))[1]')}) > 1 then {strip("substr(string_split(chunk, chr(10))[1], 3)")} else 'Section ' || (chunk_no + 1) end as title, {strip("chunk")} as text from ch""",
    "assemble_book": f"""{CHAPTERS}, src as (select {{'d': doc_id, 'k': chunk_no}} as doc_id, {strip(f"case when starts_with({strip('string_split(chunk, chr(10))[1]')}, '# ') then substr(chunk, length(string_split(chunk, chr(10))[1]) + 2) else chunk end")} as md from ch){outlined('src', 'md')},
nd as (select doc_id.d as id, doc_id.k as k, '  - C' || doc_id.k || chr(10) || '    - 章レジュメ' || chr(10) || case when doc_id.k % 2 = 0 then '      - s' else '' end || chr(10) || case when outline = '' then '' else '    ' || replace(outline, chr(10), chr(10) || '    ') end as node from o_o)
select id as doc_id, '- book ' || id || chr(10) || '  - 全体レジュメ' || chr(10) || '    - all' || chr(10) || string_agg(node, chr(10) order by k) as outline from nd group by id""",
    "assemble_web_book": f"""{CHAPTERS}, src as (select {{'d': doc_id, 'k': chunk_no}} as doc_id, case when chunk = '' then '(翻訳なし)' else chunk end as md from ch){outlined('src', 'md')},
nd as (select doc_id.d as id, doc_id.k as k, '- C' || doc_id.k || chr(10) || '  - Summary' || chr(10) || case when doc_id.k % 2 = 0 then '    - s' else '    (要約なし)' end || chr(10) || '  - Translation / Body' || chr(10) || '    ' || replace(outline, chr(10), chr(10) || '    ') as node from o_o)
select id as doc_id, '- Book Summary' || chr(10) || '  - all' || chr(10) || '  - of it' || chr(10) || string_agg(node, chr(10) order by k) as outline from nd group by id""",
    "assemble_simple_book": f"""{CHAPTERS}, src as (select {{'d': doc_id, 'k': chunk_no}} as doc_id, chunk as md from ch){outlined('src', 'md')},
nd as (select doc_id.d as id, doc_id.k as k, '- C' || doc_id.k || chr(10) || '  - Summary' || chr(10) || case when doc_id.k % 2 = 0 then '    - s' else '    ' end || chr(10) || '  - Full Text (Translation)' || chr(10) || '    ' || replace(outline, chr(10), chr(10) || '    ') as node from o_o)
select id as doc_id, string_agg(node, chr(10) order by k) as outline from nd group by id""",
}
