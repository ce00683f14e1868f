"""DuckDB twins of the queries that SQL can express; the others are tested against brute force."""

from paperlake.llm.licenses import TEMPLATES, THRESHOLD

URL_FILTER = r"""
with parts as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda p: p <> '' and not starts_with(p, 'utm_') and not starts_with(p, 'ref='))) as query
  from parts
), known as (
  select page_id, host, path,
         case when regexp_replace(host, '^(www|m)\.', '') <> '' then
           regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
           || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end end as canonical,
         case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
              when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
              when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from split
)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when canonical in (select canonical from known where (page_id % 10 = 0 or starts_with(host, 'spam-')) and canonical is not null) then 'block'
            else 'allow' end as verdict
from known
"""


_TEMPLATES = ", ".join(f"('{name}', {k}, '{text}')" for k, (name, text) in enumerate(TEMPLATES.items()))

LICENSES = rf"""
with templates(license, place, statement) as (values {_TEMPLATES}
), template_terms as (
  select license, place, term, count(*) as tf
  from (select license, place, unnest(regexp_split_to_array(lower(statement), '[^a-z0-9]+')) as term from templates)
  where term <> '' group by all
), line_terms as (
  select doc_id, line, term, count(*) as tf
  from (
    select doc_id, line, unnest(string_split_regex(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) as term
    from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
  ) where term <> '' group by all
), n as (select count(*) as docs from documents
), idf as (
  select t.term, ln((1 + n.docs) / (1 + count(distinct l.doc_id))) + 1 as idf
  from (select distinct term from template_terms) t left join line_terms l on l.term = t.term, n group by t.term, n.docs
), sizes as (
  select license, sqrt(sum(tf * tf * idf * idf)) as size from template_terms join idf using (term) group by license
), line_sizes as (
  select doc_id, line, sqrt(sum(power(tf * coalesce(idf, ln(1 + n.docs) + 1), 2))) as size
  from line_terms left join idf using (term), n group by all
), cosines as (
  select l.doc_id, l.line, t.license, t.place, round(sum(l.tf * t.tf * i.idf * i.idf) / any_value(s.size) / any_value(z.size), 6) as score
  from line_terms l join template_terms t on l.term = t.term join idf i on i.term = l.term
  join sizes s on s.license = t.license join line_sizes z on z.doc_id = l.doc_id and z.line = l.line
  group by l.doc_id, l.line, t.license, t.place
), best as (
  select doc_id, line, license, score from cosines where score >= {THRESHOLD}
  qualify row_number() over (partition by doc_id order by score desc, line, place) = 1
), files as (
  select d.doc_id, b.license, b.score,
         case when b.line is not null and length(d.text) < 1000 then
           case d.doc_id % 3 when 0 then d.source when 1 then d.source || '/' || d.lang else d.source || '/' || d.lang || '/d' || (d.doc_id % 64) end
         else d.source || '/' || d.lang || '/d' || (d.doc_id % 64) end as directory,
         case when b.line is not null and length(d.text) < 1000 then 'LICENSE.' || d.doc_id else d.doc_id || '.txt' end as name
  from documents d left join best b using (doc_id)
), given as (
  select directory as above, license as given from files where name like 'LICENSE.%' and license is not null
  qualify row_number() over (partition by directory order by score desc, license desc) = 1
), nearest as (
  select f.doc_id, g.above, g.given from files f join given g on f.directory = g.above or starts_with(f.directory, g.above || '/')
  qualify row_number() over (partition by f.doc_id order by length(g.above) desc) = 1
)
select f.doc_id, f.directory || '/' || f.name as path, f.license, round(f.score, 4) as score, coalesce(f.license, n.given) as licensed_as,
       case when f.license is not null then 'header' when n.doc_id is not null then 'inherited' else 'none' end as how,
       case when f.license is null then n.above end as from_directory
from files f left join nearest n using (doc_id)
"""


#: Levels that the twin reduces a tree by: 3 ** LEVELS leaves of a source.
LEVELS = 14


def _reduced(name: str, levels: int) -> str:
    """Nodes of all levels of trees ``{name}0`` (t, i, d, n), with the siblings of each before and behind it."""
    parts = []
    for k in range(levels):
        run = "over (partition by t, i // 3 order by i rows between"
        parts.append(
            f"""{name}{k}_near as (
  select *, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as before,
         coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as behind from {name}{k} where n > 1
), {name}{k + 1} as (
  select t, i // 3 as i, sha256(string_agg(d, '' order by i)) as d, any_value((n + 2) // 3) as n from {name}{k} where n > 1 group by t, i // 3
)"""
        )
    every = " union all ".join(f"select t, i, d, n from {name}{k}" for k in range(levels + 1))
    parts.append(f"{name}_root as (select t, d from ({every}) where n = 1)")
    return ", ".join(parts)


def _folded(name: str, levels: int, source: str, tree: str, rank: str) -> str:
    """Rows of ``source`` with their digest ``f`` folded up, and the siblings met (``s``)."""
    at = source
    parts = []
    for k in range(levels):
        parts.append(
            f"""{name}f{k} as (
  select o.* replace (case when x.n is null then o.f else sha256(x.before || o.f || x.behind) end as f, o.s || coalesce(x.before || x.behind, '') as s)
  from {at} o left join {name}{k}_near x on x.t = o.{tree} and x.i = o.{rank} // {3**k}
)"""
        )
        at = f"{name}f{k}"
    return ", ".join(parts)


def _leaf(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns) + ")"


def _merkle() -> str:
    """CRC32 by its table, made from the rule of its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    crc = (
        f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]), "
        f"lambda a, b: xor(a >> 8, ({table}::bigint[])[(xor(a, b) & 255) + 1])))"
    )
    found = "case when " + crc + " % 2 = 0 then replace(text, chr(10), '') else text end"
    return f"""
with named as (select source as name, row_number() over (order by source nulls first) - 1 as t from (select distinct source from documents)
), leaves as (
  select d.doc_id, n.t, {_leaf("text")} as leaf, {_leaf("(" + found + ")")} as found
  from documents d join named n on d.source is not distinct from n.name
), ranked as (
  select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by t) as n from leaves
), a0 as (select t, r as i, leaf as d, n from ranked
), {_reduced("a", LEVELS)}, b0 as (select 0 as t, t as i, d, count(*) over () as n from a_root
), {_reduced("b", LEVELS)}, start as (select doc_id, t, r, leaf, 0 as top, found as f, '' as s from ranked
), {_folded("a", LEVELS, "start", "t", "r")}, {_folded("b", LEVELS, f"af{LEVELS - 1}", "top", "t")}
select o.doc_id, o.leaf, a_root.d as subroot, b_root.d as root, sha256(o.s) as proof_sha256, o.f as folded_root, o.f = b_root.d as verified
from bf{LEVELS - 1} o join a_root using (t) cross join b_root
"""


MERKLE = _merkle()

FIM = """
with texts as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), drawn as (
  select doc_id, text, length(text) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from texts
), cut as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), said as (
  select *, substring(text, 1, low) as p, substring(text, low + 1, high - low) as m, substring(text, high + 1, n - high) as s from cut
), put as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as output from said
), found as (
  select *, instr(output, '<P>') as at_p, instr(output, '<S>') as at_s, instr(output, '<M>') as at_m from put
)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars, case when form <> 'plain' then high - low end as middle_chars,
       sha256(output) as output_sha256,
       sha256(case form when 'plain' then output
              when 'psm' then substring(output, 4, at_s - 4) || substring(output, at_m + 3) || substring(output, at_s + 3, at_m - at_s - 3)
              else substring(output, at_p + 3, at_m - at_p - 3) || substring(output, at_m + 3) || substring(output, 4, at_p - 4) end) as restored_sha256
from found
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": LICENSES, "op9_url_filter": URL_FILTER, "op11_merkle": MERKLE, "op13_fim": FIM}
