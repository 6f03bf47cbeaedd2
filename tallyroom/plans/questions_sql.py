"""SQL twins of the questionnaire queries: the same steps with plain windows over whole keys."""

from __future__ import annotations

from tallyroom.operators import report
from tallyroom.operators.dictionary import column_rules, field_rules
from tallyroom.plans import grid


def _values(rules: list[dict], names: list[str]) -> str:
    def one(v):
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]::varchar[]"
        return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ",\n".join("(" + ", ".join(one(r[n]) for n in names) + ")" for r in rules)


def _predicate(label: str) -> str:
    return f"""case match_kind when 'pool' then list_contains(patterns, lower({label}))
      when 'contains_all' then len(list_filter(patterns, lambda p: not contains(lower({label}), p))) = 0
      when 'contains_any' then len(list_filter(patterns, lambda p: contains(lower({label}), p))) > 0
      when 'prefix' then starts_with(lower({label}), patterns[1]) and length({label}) > length(patterns[1])
      when 'exact_case' then list_contains(patterns, {label}) else match_kind = 'any' end"""


_CELLS = grid.cells_sql()

_ROWS = _CELLS + """,
 gridrows as (select workbook_id, row_idx, coalesce(max(text) filter (col_idx = 0), '') as c0,
   coalesce(max(text) filter (col_idx = 1), '') as c1, coalesce(max(text) filter (col_idx = 2), '') as c2,
   max(literal) filter (col_idx = 2) as literal2, count(*) filter (col_idx = 2) > 0 as has_c2,
   bool_and(text = '') as all_blank, arg_min(text, col_idx) filter (text <> '') as first_text,
   map(list(col_idx order by col_idx), list(text order by col_idx)) as m, max(col_idx) as last_col
   from valued group by 1, 2),
 facts as (select *, first_text is null or starts_with(first_text, '#') as skipped,
   array_to_string(list_transform(range(0, cast(last_col + 2 as bigint)), lambda i: coalesce(m[cast(i as int)], '')), ' | ') as shown from gridrows),
 kept as (select *, row_number() over (partition by workbook_id order by row_idx) as rn from (select *,
   count(*) filter (not skipped) over (partition by workbook_id order by row_idx) as seen from facts) t where seen > 0),
 qrows as (select *, cast(sum(case when rn = 1 or (c0 <> '' and not starts_with(c0, '#')) then 1 else 0 end)
   over (partition by workbook_id order by row_idx) as bigint) as q_seq from kept),
 typed as (select workbook_id, q_seq, arg_min(c0, row_idx) as qid, min(row_idx) filter (c1 <> '') as type_row,
   arg_min(c1, row_idx) filter (c1 <> '') as label, arg_min(c2, row_idx) filter (c1 <> '') as type_text,
   arg_min(has_c2, row_idx) filter (c1 <> '') as has_type from qrows group by 1, 2),
 heads as (select *, case when lower(label) = 'type' then type_text end as qtype,
   case when label is null then 'Question type not found for question ''' || qid || ''''
     when lower(label) <> 'type' then 'Question type not found for question ''' || qid || ''' at cell ' || type_row || ':1 - ''' || label || ''''
   end as fatal0 from typed)"""

_MATCHED = _ROWS + f""",
 rules(qtype, priority, field, kind, match_kind, patterns, target) as (values
   {_values(field_rules(), ["qtype", "priority", "field", "kind", "match_kind", "patterns", "target"])}),
 known as (select h.*, coalesce(fatal0, case when qtype not in (select qtype from rules) then
     'Unrecognized question type for question ''' || qid || ''' at cell '
     || case when has_type then type_row || ':2' else 'Undefined cell coords (Null cell)' end || ' - ''' || qtype || '''' end) as fatal from heads h),
 content as (select r.*, k.qid, k.qtype from qrows r join known k using (workbook_id, q_seq)
   where k.fatal is null and r.row_idx > k.type_row),
 hits as (select c.workbook_id, c.row_idx, r.field, r.kind, coalesce(r.target, case when r.field = 'js' then substr(c.c1, 4) end) as target
   from content c join rules r on r.qtype = c.qtype and {_predicate("c.c1")}
   qualify row_number() over (partition by c.workbook_id, c.row_idx order by r.priority) = 1),
 matched as (select c.*, h.field, h.kind, h.target from content c left join hits h using (workbook_id, row_idx)),
 islands as (select *, case when c1 <> '' then row_idx - row_number() over (partition by workbook_id, q_seq, c1 <> '' order by row_idx) end as isl from matched),
 titled as (select *, case when isl is not null then min(row_idx) filter (kind = 'table' and not skipped)
   over (partition by workbook_id, q_seq, isl) end as title from islands),
 placed as (select *, case when title < row_idx then 'body' when skipped then 'skipped' when field is null then 'unmatched' else 'field' end as status,
   case when title <= row_idx then title end as title_row from titled),
 extent as (select workbook_id, q_seq, title_row, max(row_idx) as last_row from placed where title_row is not null group by 1, 2, 3),
 marked as (select *, min(row_idx) over (partition by workbook_id, q_seq, field) as first_row from placed where status = 'field'),
 places as (select a.*, case when e.last_row > a.row_idx then 'rows ' || a.row_idx || '-' || e.last_row || ': ' || a.shown || ' ...'
     else 'row ' || a.row_idx || ': ' || a.shown end as place
   from marked a left join extent e on e.workbook_id = a.workbook_id and e.q_seq = a.q_seq and e.title_row = a.row_idx),
 dups as (select p.workbook_id, p.q_seq, p.row_idx, 'This field was already processed(here: ' || f.place || ') for question ''' || p.qid
     || ''' (' || p.qtype || ') at ' || p.place as error
   from places p join places f on f.workbook_id = p.workbook_id and f.row_idx = p.first_row where p.first_row < p.row_idx),
 odd as (select *, row_idx - row_number() over (partition by workbook_id, q_seq order by row_idx) as g from placed where status = 'unmatched'),
 oddruns as (select workbook_id, q_seq, min(row_idx) as row_idx, max(row_idx) as last_row, 'Unrecognized field(s) for question ''' || any_value(qid)
     || ''' (' || any_value(qtype) || ') at ' || case when min(row_idx) = max(row_idx) then 'row ' || min(row_idx) || ': ' || arg_min(shown, row_idx)
     else 'rows ' || min(row_idx) || '-' || max(row_idx) || ': ' || arg_min(shown, row_idx) || ' ...' end as error
   from odd group by workbook_id, q_seq, g),
 pairs as (select workbook_id, q_seq, row_idx as seq, target as k, case when kind = 'pair' then coalesce(literal2, 'null')
     else cast(to_json('##JS##' || case when field = 'block' then 'isBlock.bind(null, ' || c2 || ')' else c2 end || '##JS-END##') as varchar) end as v
   from marked where kind <> 'table' and first_row = row_idx)"""

_TABLES = _MATCHED + f""",
 crules(field, priority, kind, match_kind, patterns, target) as (values
   {_values(column_rules(), ["field", "priority", "kind", "match_kind", "patterns", "target"])}),
 titles as (select workbook_id, q_seq, row_idx as title_row, qid, qtype, field, target as prop from marked where kind = 'table' and first_row = row_idx),
 hcells as (select t.*, v.col_idx, v.text as header from titles t
   join valued v on v.workbook_id = t.workbook_id and v.row_idx = t.title_row + 1 and v.text <> ''
   join placed p on p.workbook_id = t.workbook_id and p.row_idx = t.title_row + 1 and p.title_row = t.title_row),
 cols as (select h.*, c.kind, case when c.kind = 'item' then coalesce(c.target, h.header) end as cprop from hcells h
   left join crules c on c.field = h.field and {_predicate("h.header")}
   qualify row_number() over (partition by h.workbook_id, h.title_row, h.col_idx order by c.priority nulls last) = 1),
 body as (select t.*, p.row_idx from titles t join placed p on p.workbook_id = t.workbook_id and p.title_row = t.title_row
   where p.row_idx > t.title_row + 1 and not p.skipped),
 bcells as (select b.*, v.col_idx, v.text, v.literal, c.header, c.kind, c.cprop from body b
   join valued v on v.workbook_id = b.workbook_id and v.row_idx = b.row_idx
   left join cols c on c.workbook_id = b.workbook_id and c.title_row = b.title_row and c.col_idx = v.col_idx),
 ifields as (select * from bcells where cprop is not null and literal is not null and not starts_with(text, '#')),
 iobj as (select b.workbook_id, b.q_seq, b.title_row, b.row_idx, b.field, b.prop,
   '{{' || coalesce(string_agg(cast(to_json(f.cprop) as varchar) || ':' || f.literal, ',' order by f.col_idx), '') || '}}' as item,
   '{{' || coalesce(string_agg(case when lower(right(f.cprop, 7)) = '(image)' then cast(to_json(trim(left(f.cprop, length(f.cprop) - 7))) as varchar)
        || ':{{"img":' || f.literal || '}}' when lower(right(f.text, 7)) = '(image)' then cast(to_json(f.cprop) as varchar) || ':{{"img":'
        || cast(to_json(trim(left(f.text, length(f.text) - 7))) as varchar) || '}}'
      else cast(to_json(f.cprop) as varchar) || ':' || f.literal end, ',' order by f.col_idx), '') || '}}' as imaged,
   max(f.literal) filter (f.cprop = 'group') as grp, max(f.literal) filter (f.cprop = 'groupId') as gid,
   max(f.literal) filter (f.cprop = 'header') as ghead, max(f.text) filter (f.cprop = 'name') as aname, max(f.text) filter (f.cprop = 'cond') as acond,
   '{{' || coalesce(string_agg(cast(to_json(f.cprop) as varchar) || ':' || f.literal, ',' order by f.col_idx) filter (f.cprop in ('id', 'text')), '') || '}}' as slim,
   '[' || coalesce(string_agg(cast(to_json(case when lower(right(f.cprop, 7)) = '(image)' then trim(left(f.cprop, length(f.cprop) - 7)) else f.cprop end) as varchar),
      ',' order by f.col_idx), '') || ']' as names
   from body b left join ifields f on f.workbook_id = b.workbook_id and f.row_idx = b.row_idx group by 1, 2, 3, 4, 5, 6),
 built as (select t.workbook_id, t.q_seq, t.title_row, t.field, t.prop, '[' || coalesce(string_agg(case when t.field = 'conjointItems' then i.imaged else i.item end,
     ',' order by i.row_idx), '') || ']' as items, arg_min(i.names, i.row_idx) as names from titles t
   left join iobj i on i.workbook_id = t.workbook_id and i.title_row = t.title_row
   where exists (select 1 from cols c where c.workbook_id = t.workbook_id and c.title_row = t.title_row and c.kind = 'item') group by 1, 2, 3, 4, 5),
 scol as (select workbook_id, q_seq, title_row, min(col_idx) as col_idx from cols where kind = 'shuffle' group by 1, 2, 3),
 flags as (select b.workbook_id, b.q_seq, b.title_row, b.row_idx, coalesce(v.literal = 'true' and not starts_with(v.text, '#'), false) as flag,
   case when v.text <> '' and not starts_with(v.text, '#') and v.literal not in ('true', 'false') then v.text end as bad,
   row_number() over (partition by b.workbook_id, b.title_row order by b.row_idx) - 1 as i, count(*) over (partition by b.workbook_id, b.title_row) as n
   from body b join scol s on s.workbook_id = b.workbook_id and s.title_row = b.title_row
   left join valued v on v.workbook_id = b.workbook_id and v.row_idx = b.row_idx and v.col_idx = s.col_idx),
 shuffles as (select workbook_id, q_seq, title_row, case when bool_and(not flag) then null when bool_and(flag) then 'true'
     when count(*) filter (not flag) = min(i) filter (flag) then '{{"exceptFirst":' || count(*) filter (not flag) || '}}'
     when count(*) filter (not flag) = max(n) - 1 - max(i) filter (flag) then '{{"exceptLast":' || count(*) filter (not flag) || '}}'
     else '{{"except":[' || string_agg(i, ',' order by i) filter (not flag) || ']}}' end as s from flags group by 1, 2, 3),
 gitems as (select workbook_id, q_seq, grp as "group", '[' || string_agg(slim, ',' order by row_idx) || ']' as items, count(*) as n
   from iobj where field = 'groupItems' and grp is not null group by 1, 2, 3),
 ngroups as (select g.workbook_id, g.q_seq, g.row_idx, g.gid as "group", coalesce(i.n, 0) as n,
   '{{"id":' || g.gid || ',"header":' || g.ghead || ',"items":' || coalesce(i.items, '[]') || '}}' as v
   from iobj g left join gitems i on i.workbook_id = g.workbook_id and i.q_seq = g.q_seq and i."group" = g.gid where g.field = 'groups'),
 acode as (select workbook_id, q_seq, title_row, string_agg('alias.defineOr(''' || aname || ''', ' || case when starts_with(ltrim(acond), 'function')
     then acond else cast(to_json(acond) as varchar) end || ')', chr(10) order by row_idx) as code from iobj where field = 'aliases' group by 1, 2, 3)"""

_DOCS = _TABLES + """,
 added as (select workbook_id, q_seq, seq, 0 as sub, k, v from pairs
   union all select workbook_id, q_seq, title_row, 0, prop, items from built where field not in ('groupItems', 'groups', 'aliases')
   union all select workbook_id, q_seq, title_row, 1, 'shuffleItems', s from shuffles where s is not null
   union all select workbook_id, q_seq, title_row, 2, 'properties', coalesce(names, '[]') from built where field = 'conjointItems'
   union all select b.workbook_id, b.q_seq, b.title_row, 3, 'items', '[' || string_agg(g.v, ',' order by g.row_idx) || ']'
     from built b join ngroups g using (workbook_id, q_seq) where b.field = 'groupItems' group by 1, 2, 3
   union all select workbook_id, q_seq, title_row, 4, 'code', cast(to_json(code) as varchar) from acode),
 once as (select workbook_id, q_seq, k, min(seq * 10 + sub) as at, arg_max(v, seq * 10 + sub) as v from added a
   where not exists (select 1 from acode c where c.workbook_id = a.workbook_id and c.q_seq = a.q_seq and a.seq < c.title_row) group by 1, 2, 3),
 bodies as (select k.workbook_id, k.q_seq, case when c.code is null then k.qid end as qid, case when c.code is null then k.qtype else 'JsCode' end as qtype,
   case when c.code is null then '{"id":' || cast(to_json(k.qid) as varchar) || ',"type":' || cast(to_json(k.qtype) as varchar) else '{"type":"JsCode"' end
     || coalesce(string_agg(',' || cast(to_json(o.k) as varchar) || ':' || o.v, '' order by o.at), '') || '}' as body
   from known k left join once o on o.workbook_id = k.workbook_id and o.q_seq = k.q_seq
   left join acode c on c.workbook_id = k.workbook_id and c.q_seq = k.q_seq where k.fatal is null group by k.workbook_id, k.q_seq, k.qid, k.qtype, c.code),
 told as (select workbook_id, q_seq, 0 as part, title_row as seq, row_idx as sub,
     'Unexpected cell value. Expected: +, -, Yes, No or empty cell; actual: ' || bad as error from flags where bad is not null
   union all select workbook_id, q_seq, 0, row_idx, row_idx, 'No items for group ' || "group" from ngroups where n = 0
   union all select workbook_id, q_seq, 1, row_idx, row_idx, error from dups
   union all select workbook_id, q_seq, 1, row_idx, row_idx, error from oddruns),
 errs as (select workbook_id, q_seq, error, row_number() over (partition by workbook_id, q_seq order by part, seq, sub, error) - 1 as pos from told),
 notes as (select workbook_id, min(q_seq) as q_seq, 'Duplicate question id ' || qid || ': repeated ' || count(*) - 1 || ' times' as note
   from bodies where qid is not null group by workbook_id, qid having count(*) > 1),
 messages as (select workbook_id, 0 as section, q_seq, cast(0 as bigint) as pos, fatal as message from known where fatal is not null
   union all select workbook_id, 1, q_seq, pos, error from errs
   union all select workbook_id, 3, q_seq, 0, note from notes),
 sections as (select workbook_id, section, ['FATAL ERRORS:', 'ERRORS:', 'WARNINGS:', 'NOTIFICATIONS:'][section + 1] || chr(10)
   || string_agg(message, chr(10) order by q_seq, pos, message) as t from messages group by 1, 2)"""


def _code_out(text: str) -> str:
    """The code of a text out of its quotes and marks."""
    lines = "chr(10) || repeat(' ', 9)"
    pieces = f"""string_split_regex({text}, '"##JS##|##JS-END##"')"""
    opened = f"""list_transform({pieces}, lambda p, i: case when i % 2 = 1 then p when p = '' then '""'
      else replace(json_extract_string('["' || p || '"]', '$[0]'), chr(10), {lines}) end)"""
    return f"replace(replace(replace(array_to_string({opened}, ''), '##JS##', ''), '##JS-END##', ''), '\\n', {lines})"


def _set_in(text: str, extra: int = 0) -> str:
    return f"replace(regexp_replace({text}, '\\n+$', ''), chr(10), chr(10) || repeat(' ', {7 + extra}))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD, _REST = report.MODULE_TEXT.split("{notes}")
_MIDDLE, _TAIL = _REST.split("{questions}")

# Documents over several lines: by tokens, each with the depth of objects and the container it stands in.
_PRETTY = _DOCS + """,
 tokens as (select workbook_id, q_seq, generate_subscripts(t, 1) as i, unnest(t) as t from (select workbook_id, q_seq,
   regexp_extract_all(body, '"(?:[^"\\\\]|\\\\.)*"|[{}\\[\\],:]|[^"{}\\[\\],:]+') as t from bodies) x),
 deep as (select *, sum(case t when '{' then 1 when '}' then -1 else 0 end) over w as d, lag(t) over w as was, lead(t) over w as next,
   sum(case when t in ('{', '[') then 1 when t in ('}', ']') then -1 else 0 end) over w as level
   from tokens window w as (partition by workbook_id, q_seq order by i)),
 held as (select *, last_value(case when t in ('{', '[') then t end ignore nulls) over (partition by workbook_id, q_seq, level order by i) as holder from deep),
 docs as (select workbook_id, q_seq, string_agg(case when t = '{' and next <> '}' then '{' || chr(10) || repeat('  ', d::int)
     when t = '}' and was <> '{' then chr(10) || repeat('  ', d::int) || '}'
     when t = ',' and holder = '{' then ',' || chr(10) || repeat('  ', d::int) else t end, '' order by i) as doc from held group by 1, 2)"""

_MODULES = _PRETTY + f""",
 codes as (select workbook_id, q_seq, case when starts_with(v, '"') then json_extract_string('[' || v || ']', '$[0]') else v end as code from once where k = 'code'),
 marks as (select workbook_id, q_seq, string_agg('/* ' || {_set_in("error", 2)} || ' */ ' || chr(10) || repeat(' ', 7), '' order by pos) as marks from errs group by 1, 2),
 texts as (select k.workbook_id, k.q_seq, case when k.fatal is not null then '/* ' || k.fatal || ' */'
     when b.qtype = 'JsCode' then {_set_in("coalesce(c.code, '')")} else coalesce(m.marks, '') || 'qs.push(' || {_set_in("d.doc")} || ')' end as text
   from known k left join bodies b on b.workbook_id = k.workbook_id and b.q_seq = k.q_seq left join docs d on d.workbook_id = k.workbook_id and d.q_seq = k.q_seq
   left join codes c on c.workbook_id = k.workbook_id and c.q_seq = k.q_seq left join marks m on m.workbook_id = k.workbook_id and m.q_seq = k.q_seq),
 whole as (select workbook_id, string_agg(text, chr(13) || chr(10) || chr(13) || chr(10) || repeat(' ', 7) order by q_seq) as body from texts group by 1),
 said as (select workbook_id, string_agg('/* ' || note || ' */', '' order by q_seq, note) as notes from notes group by 1),
 modules as (select w.workbook_id, {_code_out(f"({_quoted(_HEAD)} || coalesce(s.notes, '') || {_quoted(_MIDDLE)} || w.body || {_quoted(_TAIL)})")} as js
   from whole w left join said s on s.workbook_id = w.workbook_id),
 reports as (select w.workbook_id, coalesce(string_agg(s.t, chr(10) || chr(10) order by s.section), '') as notifications
   from (select distinct workbook_id from known) w left join sections s on s.workbook_id = w.workbook_id group by 1)"""


def _on(ctes: str, body: str) -> str:
    body = body.strip()
    return f"with {ctes}{body}" if body.startswith(",") else f"with {ctes} {body}"


_T = "workbook_id, q_seq, title_row"
_PATHS = """paths as (select '/in/' || replace(p_name, ' ', '%20') || '.' || p_partkey || '.' || ['xls', 'xlsx', 'csv', 'XLS', 'x%6Cs'][p_partkey % 5 + 1] as path,
   p_partkey % 13 <> 0 as found, p_partkey % 5 < 2 as good from part),
 routes as (select path, case when found and good then replace(path, '%20', ' ') end as read_from,
   case when not found then 'File Not Found: ' || path when not good then 'Only xls and xlsx formats are supported' end as error from paths)"""
ORACLES = {
    "sheet_rows": _on(_CELLS, """, present as (select workbook_id, row_idx, count(*) as n from valued group by 1, 2),
       every as (select workbook_id, unnest(range(min(row_idx), max(row_idx) + 1)) as row_idx from present group by 1)
       select e.workbook_id, cast(e.row_idx as int) as row_idx, p.n as n_cells from every e left join present p using (workbook_id, row_idx)"""),
    "cell_at": _on(_CELLS, "select workbook_id, row_idx, max(text) filter (col_idx = 2) as text, max(literal) filter (col_idx = 2) as literal from valued group by 1, 2"),
    "cell_slice": _on(_CELLS, """select r.workbook_id, r.row_idx, cast(c.c as int) as col_idx, v.text
       from (select distinct workbook_id, row_idx from valued) r cross join (values (1), (2), (3), (4)) c(c)
       left join valued v on v.workbook_id = r.workbook_id and v.row_idx = r.row_idx and v.col_idx = c.c"""),
    "cell_string": _on(_CELLS, "select workbook_id, row_idx, col_idx, text from valued"),
    "cell_json": _on(_CELLS, "select workbook_id, row_idx, col_idx, literal from valued"),
    "cell_bool": _on(_CELLS, """select workbook_id, row_idx, col_idx, coalesce(literal = 'true', false) as truth,
       case when literal not in ('true', 'false') then text end as error from valued"""),
    "is_blank": _on(_CELLS, "select workbook_id, row_idx, col_idx, text = '' as blank, starts_with(text, '#') as commented from valued"),
    "row_all_blank": _on(_CELLS, """, present as (select workbook_id, row_idx, bool_and(text = '') as b from valued group by 1, 2),
       every as (select workbook_id, unnest(range(min(row_idx), max(row_idx) + 1)) as row_idx from present group by 1)
       select e.workbook_id, cast(e.row_idx as int) as row_idx, coalesce(p.b, false) as all_blank from every e left join present p using (workbook_id, row_idx)"""),
    "skip_blank_comment": _on(_ROWS, "select workbook_id, row_idx, first_text from facts where not skipped"),
    "split_questions": _on(_ROWS, "select workbook_id, row_idx, q_seq from qrows"),
    "segment_rows": """
      with kept as (select *, row_number() over (partition by conv_id order by turn) as rn from (select *,
          count(*) filter (role <> 'system') over (partition by conv_id order by turn) as seen from conversations) t where seen > 0)
      select cast(conv_id as varchar) as workbook_id, turn as row_idx, cast(sum(case when rn = 1 or role = 'user' then 1 else 0 end)
        over (partition by conv_id order by turn) as bigint) as q_seq from kept""",
    "drop_leading": _on(_ROWS, "select q.workbook_id, q.q_seq, q.row_idx from qrows q join heads h using (workbook_id, q_seq) where q.row_idx >= h.type_row"),
    "question_type": _on(_ROWS, "select workbook_id, q_seq, qid, type_row, qtype, fatal0 as fatal from heads"),
    "known_type": _on(_MATCHED, "select workbook_id, q_seq, qtype, fatal from known"),
    "match_fields": _on(_MATCHED, "select workbook_id, q_seq, row_idx, field, kind, target from matched"),
    "label_predicates": _on(_CELLS, """select workbook_id, row_idx, lower(text) in ('optional', 'cond') as pool,
       contains(lower(text), 'te') or contains(lower(text), 'oc') as contains, text ilike 'js-_%' as prefix,
       case when text ilike 'js-_%' then substr(text, 4) end as rest from valued where col_idx = 1"""),
    "table_extent": _on(_MATCHED, "select workbook_id, q_seq, title_row, last_row from extent"),
    "merge_unrecognized": _on(_MATCHED, "select workbook_id, q_seq, row_idx, last_row, error from oddruns"),
    "duplicate_field": _on(_MATCHED, "select workbook_id, q_seq, row_idx, error from dups"),
    "pair_value": _on(_MATCHED, "select workbook_id, q_seq, seq, k, v from pairs"),
    "block_condition": _on(_CELLS, """select workbook_id, row_idx, 'isBlock.bind(null, ' || coalesce(max(text) filter (col_idx = 2), '') || ')' as cond
       from valued group by 1, 2"""),
    "and_conditions": _on(_ROWS, "select workbook_id, q_seq, string_agg(c1, ' && ' order by row_idx) as cond from qrows where c1 <> '' group by 1, 2"),
    "table_columns": _on(_TABLES, f"select {_T}, row_idx, col_idx, coalesce(header, '') as header, text from bcells where text <> '' and not starts_with(text, '#')"),
    "match_columns": _on(_TABLES, f"select {_T}, col_idx, header, kind, cprop as prop from cols"),
    "columns_by_kind": _on(_TABLES, f"""select {_T}, count(*) filter (kind = 'item') as n_item, count(*) filter (kind = 'shuffle') as n_shuffle,
       count(*) filter (kind is null) as n_undefined from cols group by 1, 2, 3"""),
    "drop_null_fields": _on(_TABLES, f"select {_T}, row_idx, item from iobj"),
    "project_fields": _on(_TABLES, "select workbook_id, q_seq, row_idx, slim as item from iobj where field = 'groupItems'"),
    "image_cells": _on(_TABLES, "select workbook_id, q_seq, row_idx, imaged as item from iobj where field = 'conjointItems'"),
    "shuffle_summary": _on(_TABLES, f'select {_T}, s as "shuffleItems" from shuffles'),
    "build_rows": _on(_TABLES, f"select {_T}, prop, items from built"),
    "property_list": _on(_TABLES, f"select {_T}, names as properties from built where field = 'conjointItems'"),
    "group_items": _on(_TABLES, 'select workbook_id, q_seq, "group", items, n from gitems'),
    "nest_items_in_groups": _on(_TABLES, 'select workbook_id, q_seq, row_idx, "group", n, v from ngroups'),
    "alias_code": _on(_TABLES, f"select {_T}, code from acode"),
    "row_text": _on(_ROWS, "select workbook_id, row_idx, shown from facts"),
    "cell_coords": _on(_CELLS, "select workbook_id, row_idx, col_idx, row_idx || ':' || col_idx as coords from valued"),
    "row_range": _on(_ROWS, """select workbook_id, q_seq, case when min(row_idx) = max(row_idx) then 'row ' || min(row_idx) || ': ' || arg_min(shown, row_idx)
       else 'rows ' || min(row_idx) || '-' || max(row_idx) || ': ' || arg_min(shown, row_idx) || ' ...' end as place from qrows group by 1, 2"""),
    "error_text": _on(_ROWS, """select workbook_id, q_seq, 'Odd' || case when qid <> 'Q7' then ' for question ''' || qid || '''' else '' end
       || case when qtype <> 'Info' then ' (' || qtype || ')' else '' end || coalesce(' at row ' || type_row, '') as error from heads"""),
    "fold_question": _on(_DOCS, "select workbook_id, q_seq, qid, qtype, body from bodies"),
    "question_errors": _on(_DOCS, """select k.workbook_id, k.q_seq, coalesce(string_agg(e.error, chr(10) order by e.pos), '') as errors, k.fatal
       from known k left join errs e on e.workbook_id = k.workbook_id and e.q_seq = k.q_seq group by k.workbook_id, k.q_seq, k.fatal"""),
    "duplicate_qids": _on(_DOCS, "select workbook_id, note from notes"),
    "union_notifications": _on(_DOCS, "select workbook_id, section, q_seq, cast(pos as int) as pos, message from messages"),
    "severity_report": _on(_DOCS, """select w.workbook_id, coalesce(string_agg(s.t, chr(10) || chr(10) order by s.section), '') as notifications
       from (select distinct workbook_id from known) w left join sections s on s.workbook_id = w.workbook_id group by 1"""),
    "code_unquote": _on(_PRETTY, f"select workbook_id, q_seq, {_code_out('doc')} as code from docs"),
    "render_module": _on(_MODULES, "select workbook_id, js from modules"),
    "result_json": _on(_MODULES, f""", {_PATHS}
      select m.workbook_id, '{{' || chr(10) || '  "js":' || cast(to_json(js) as varchar) || ',' || chr(10) || '  "notifications":'
        || cast(to_json(notifications) as varchar) || chr(10) || '}}' as json from modules m join reports r on r.workbook_id = m.workbook_id
      union all select path, '{{' || chr(10) || '  "error":' || cast(to_json(error) as varchar) || chr(10) || '}}' from routes where error is not null"""),
    "workbook_catalog": f"with {_PATHS} select * from routes",
}
ORACLES["is_commented"] = ORACLES["is_blank"]
