"""SQL twins of the queries, for DuckDB over the same tables.

Each twin is written from the operator's definition as plain relational SQL. The
common table expressions below mirror ``inputs``; ``_sql`` adds those a query needs.
"""

from __future__ import annotations

import re

from paperlake.constants import LINK_GAP, PAGE_LABEL, PDF_LABEL, STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TENANT = "user_id, guild_id"


def _pid(doc: str) -> str:
    """Paper id of a document number."""
    return (
        f"concat('24', lpad(cast(1 + ({doc}) % 12 as varchar), 2, '0'), '.', "
        f"lpad(cast({doc} as varchar), cast(greatest(5, length(cast({doc} as varchar))) as integer), '0'))"
    )


def _decode(raw: str) -> str:
    return (
        f"list_filter(list_transform(case when coalesce({raw}, '') like '[%' "
        f"then json_extract_string({raw}, '$[*]') else string_split(coalesce({raw}, ''), ',') end, "
        f"lambda x: trim(x)), lambda x: x <> '')"
    )


def _iso(column: str) -> str:
    return f"strftime(cast({column} as timestamp), '%Y-%m-%dT%H:%M:%S.%f')"


def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
        f"lambda t: length(t) > 1 and t not in ({_STOP}))"
    )


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def _cut(text: str, limit: int) -> str:
    return (
        f"case when length({text}) <= {limit} then {text} else "
        f"concat(regexp_replace(substr({text}, 1, {limit - 3}), '\\s+$', ''), '...') end"
    )


def _authors(items: str, limit: int) -> str:
    return (
        f"case when len({items}) = 0 then 'Unknown' else concat(array_to_string({items}[1:{limit}], ', '), "
        f"case when len({items}) > {limit} then ', et al.' else '' end) end"
    )


def _cats(items: str, limit: int) -> str:
    return f"case when len({items}) = 0 then 'N/A' else array_to_string({items}[1:{limit}], ', ') end"


def _date(text: str) -> str:
    return f"case when coalesce({text}, '') = '' then 'Unknown' else substr({text}, 1, 10) end"


def _summary(text: str) -> str:
    parts = (
        f"list_filter(list_transform(string_split(replace({text}, chr(10), ' '), '.'), "
        f"lambda s: {_strip('s')}), lambda s: s <> '')"
    )
    return (
        f"case when {text} = '' then 'No abstract available.' "
        f"when len({parts}) = 0 then substr({text}, 1, 500) "
        f"else substr(concat(array_to_string({parts}[1:2], '. '), '.'), 1, 500) end"
    )


_PAPER_TEXT = "concat_ws(' ', title, title, summary, array_to_string(categories, ' '))"
_IDF = "(ln((cast(n as double) + 1) / (cast(df as double) + 1)) + 1)"

_LAST_FIRST = r"regexp_replace({0}, '^(.*) ([^ ]*)$', '\2, \1', 's')"
_SURNAME = r"lower(regexp_replace(regexp_extract({0}, '([^ ]*)$', 1), '[^a-zA-Z0-9]', '', 'g'))"


def _key(authors: str, published: str) -> str:
    surname = _SURNAME.format(f"coalesce({authors}[1], 'unknown')")
    return (
        f"concat(case when {surname} = '' then 'unknown' else {surname} end, "
        f"case when {published} = '' then 'nd' else substr({published}, 1, 4) end)"
    )


def _escape(text: str) -> str:
    """Escape by character, one pass."""
    once = (
        "case c when '\\' then '\\textbackslash{}' when '&' then '\\&' when '%' then '\\%' "
        "when '#' then '\\#' when '_' then '\\_' when '{' then '\\{' when '}' then '\\}' else c end"
    )
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: {once}), '')"


def _bibtex() -> str:
    names = f"array_to_string(list_transform(authors, lambda a: {_LAST_FIRST.format('a')}), ' and ')"
    return (
        f"concat('@article{{', {_key('authors', 'published')}, ',', chr(10), "
        f"'  title     = {{', {_escape('title')}, '}},', chr(10), "
        f"'  author    = {{', case when len(authors) = 0 then 'Unknown' else {names} end, '}},', chr(10), "
        "'  year      = {', substr(published, 1, 4), '},', chr(10), "
        "'  eprint    = {', paper_id, '},', chr(10), "
        "'  archivePrefix = {arXiv},', chr(10), "
        "'  primaryClass  = {', coalesce(categories[1], 'N/A'), '},', chr(10), "
        "'  url       = {', arxiv_url, '},', chr(10), "
        "case when doi <> '' then concat('  doi       = {', doi, '},', chr(10)) else '' end, '}')"
    )


_WHO = (
    "case when len(authors) = 0 then 'Unknown' else array_to_string(authors, ', ') end, "
    "case when published = '' then '' else concat(' (', substr(published, 1, 4), ')') end"
)
_DOI = "case when doi = '' then '' else concat(' doi:', doi) end"
_PLAIN = f"concat({_WHO}, '. ', title, '. arXiv:', paper_id, '.', {_DOI})"
_MARKDOWN = f"concat({_WHO}, '. **', title, '**. [arXiv:', paper_id, '](', arxiv_url, ')', {_DOI})"
_CITES = {"bibtex": _bibtex(), "plain": _PLAIN, "markdown": _MARKDOWN}
_TAGS = {"bibtex": "bibtex", "plain": "", "markdown": "md"}
_EXT = {"bibtex": "bib", "plain": "txt", "markdown": "md"}

_LINKS = (
    f"concat('[{PAGE_LABEL}](', arxiv_url, ')', "
    f"case when pdf_url = '' then '' else concat('{LINK_GAP}[{PDF_LABEL}](', pdf_url, ')') end)"
)

_ROW = (
    f"{_cut('title', 200)} as title_line, {_authors('authors', 2)} as authors_line, "
    f"{_date('published')} as published_date, {_cats('categories', 2)} as categories_line"
)


_CTES: dict[str, str] = {
    "n_docs": "select count(*) as n_docs from documents",
    "n_parts": "select count(*) as n_parts from part",
    "papers_raw": f"""
        select doc_id, {_pid('doc_id')} as paper_id,
            trim(split_part(text, chr(10), 1), ' ') as title,
            case when doc_id % 2 = 0 then concat(p1.p_name, ', ', p2.p_name)
                 else concat('["', p1.p_name, ', Jr.", "', p2.p_name, '"]') end as authors,
            text as summary,
            case when doc_id % 13 <> 0 then concat(cast(2000 + doc_id % 25 as varchar), '-',
                 lpad(cast(1 + doc_id % 12 as varchar), 2, '0'), '-01T00:00:00Z') end as published,
            concat(cast(2001 + (doc_id * 3) % 25 as varchar), '-',
                 lpad(cast(1 + doc_id % 12 as varchar), 2, '0'), '-15T00:00:00Z') as updated,
            case when doc_id % 2 = 0 then concat(lang, ', ', source)
                 else concat('["', lang, '", "', source, '"]') end as categories,
            concat('https://arxiv.org/abs/', {_pid('doc_id')}) as arxiv_url,
            case when doc_id % 7 <> 0 then concat('https://arxiv.org/pdf/', {_pid('doc_id')}) end as pdf_url,
            case when doc_id % 3 = 0 then concat('10.1234/d', cast(doc_id as varchar))
                 when doc_id % 3 = 1 then '' end as doi
        from documents cross join n_parts
        join part p1 on p1.p_partkey = doc_id % n_parts
        join part p2 on p2.p_partkey = (doc_id * 7 + 3) % n_parts""",
    "papers": f"""
        select doc_id, paper_id, title, {_decode('authors')} as authors, coalesce(summary, '') as summary,
            coalesce(published, '') as published, coalesce(updated, '') as updated,
            {_decode('categories')} as categories, arxiv_url, coalesce(pdf_url, '') as pdf_url,
            coalesce(doi, '') as doi
        from papers_raw""",
    "attempts": """
        select cast(o_custkey as varchar) as user_id, concat('g', cast(o_orderkey % 2 as varchar)) as guild_id,
            (o_custkey * 13 + o_orderkey % 16) % n_docs as doc_id, o_orderdate as saved_at, o_orderkey as seq,
            case o_orderstatus when 'F' then 'done' when 'P' then 'reading' else 'to-read' end as status,
            case o_orderpriority when '1-URGENT' then 'must read' when '2-HIGH' then '' end as note,
            o_orderpriority as coll
        from orders cross join n_docs""",
    "saved": f"""
        select a.seq as id, user_id, guild_id, p.* exclude (updated), status, note, saved_at
        from (select *, row_number() over (partition by {_TENANT}, doc_id order by saved_at, seq) as rn
              from attempts) a
        join papers_raw p on p.doc_id = a.doc_id where rn = 1""",
    "listed": """
        select id, user_id, guild_id, p.* exclude (updated), status, note, saved_at
        from saved s join papers p on p.doc_id = s.doc_id""",
    "collections": f"""
        select min(seq) as id, {_TENANT}, coll as name, min(saved_at) as created_at
        from attempts where coll <> '5-LOW' group by {_TENANT}, coll""",
    "lines": f"""
        select concat_ws('-', lpad(cast(l_orderkey as varchar), 12, '0'), lpad(cast(l_linenumber as varchar), 12, '0'),
                lpad(cast(l_partkey as varchar), 12, '0'), lpad(cast(l_suppkey as varchar), 12, '0'),
                lpad(cast(cast(round(l_extendedprice * 100) as bigint) as varchar), 12, '0')) as seq,
            l_shipdate as requested_at, {_TENANT},
            case when l_linenumber % 4 = 0 then 'misc' else coll end as name,
            case when l_linenumber % 3 = 0 then l_partkey % n_docs else doc_id end as doc_id,
            l_linenumber as line, l_returnflag as flag, l_partkey as part
        from attempts cross join n_docs join lineitem on l_orderkey = seq""",
    "line_requests": f"""
        select *, cast(('0x' || substr(md5(seq), 1, 15)) as bigint) as id, {_pid('doc_id')} as paper_id from lines""",
    "adds": f"""
        select r.*, c.id as collection_id, s.id is not null as is_saved,
            row_number() over (partition by r.user_id, r.guild_id, r.name, r.paper_id
                               order by requested_at, r.seq) as rn
        from line_requests r
        left join collections c on c.user_id = r.user_id and c.guild_id = r.guild_id and c.name = r.name
        left join saved s on s.user_id = r.user_id and s.guild_id = r.guild_id and s.doc_id = r.doc_id""",
    "add_outcomes": f"""
        select seq, requested_at, {_TENANT}, name, paper_id, collection_id,
            case when collection_id is null then 'not_found' when not is_saved then 'not_saved'
                 when rn > 1 then 'duplicate' else 'added' end as outcome
        from adds""",
    "memberships": f"""
        select collection_id, {_TENANT}, paper_id, requested_at as added_at from add_outcomes where outcome = 'added'""",
    "contents": """
        select m.collection_id, m.added_at, s.* exclude (saved_at, id)
        from memberships m join listed s using (user_id, guild_id, paper_id)""",
    "order_requests": f"select *, saved_at as requested_at, {_pid('doc_id')} as paper_id from attempts",
    "paper_removals": f"""
        select seq, requested_at, {_TENANT},
            {_pid("case when status = 'done' then doc_id else (cast(user_id as bigint) * 17 + seq) % n_docs end")}
            as paper_id
        from order_requests cross join n_docs""",
    "collection_removals": f"""
        select seq, requested_at, {_TENANT},
            case when status = 'reading' then coll else concat('old ', coll) end as name
        from order_requests""",
    "removed_collections": f"""
        select seq, {_TENANT}, name, id as collection_id,
            row_number() over (partition by {_TENANT}, name order by requested_at, seq) as rn
        from collection_removals left join collections using (user_id, guild_id, name)""",
    "membership_removals": f"""
        select seq, {_TENANT}, r.name, r.paper_id, c.id as collection_id, m.paper_id is not null as held,
            row_number() over (partition by {_TENANT}, r.name, r.paper_id order by requested_at, seq) as rn
        from (select *, case when seq % 5 = 0 then 'misc' else coll end as name from order_requests) r
        left join collections c using (user_id, guild_id, name)
        left join memberships m on m.collection_id = c.id and m.paper_id = r.paper_id""",
    "landed": f"""
        select r.id, {_TENANT}, p.* exclude (updated, doc_id),
            case flag when 'A' then 'done' when 'N' then 'to-read' else 'archived' end as status,
            requested_at as saved_at
        from line_requests r left join papers_raw p on p.doc_id = r.part""",
    "terms": f"""
        select paper_id, term, count(*) as tf
        from (select paper_id, unnest({_tokens(_PAPER_TEXT)}) as term from papers) group by all""",
    "corpus_df": """
        select term, count(*) as df, (select count(*) from papers) as n from terms group by term""",
    "lib_terms": "select user_id, guild_id, paper_id, term, tf from saved join terms using (paper_id)",
    "lib_sizes": f"select {_TENANT}, count(*) as n from saved group by {_TENANT}",
    "lib_df": f"""
        select {_TENANT}, term, df, {_IDF} as idf
        from (select {_TENANT}, term, count(*) as df from lib_terms group by all) join lib_sizes using ({_TENANT})""",
    "lib_weights": f"""
        select {_TENANT}, paper_id, term, tf * idf as w from lib_terms join lib_df using ({_TENANT}, term)""",
    "lib_norms": f"select {_TENANT}, paper_id, sqrt(sum(w * w)) as norm from lib_weights group by all",
    "newest": f"select {_TENANT}, arg_max(paper_id, (saved_at, id)) as paper_id from saved group by {_TENANT}",
    "external": f"""
        select distinct {_TENANT}, {_pid('(cast(user_id as bigint) * 7 + 1) % n_docs')} as paper_id
        from attempts cross join n_docs""",
    "scores": f"""
        select t.user_id, t.guild_id, t.paper_id as target_id, b.paper_id,
            round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 4) as score
        from targets t
        join lib_weights a on a.user_id = t.user_id and a.guild_id = t.guild_id and a.paper_id = t.paper_id
        join lib_weights b on b.user_id = t.user_id and b.guild_id = t.guild_id and b.term = a.term
            and b.paper_id <> t.paper_id
        join lib_norms na on na.user_id = t.user_id and na.guild_id = t.guild_id and na.paper_id = t.paper_id
        join lib_norms nb on nb.user_id = t.user_id and nb.guild_id = t.guild_id and nb.paper_id = b.paper_id
        group by 1, 2, 3, 4""",
    "best": f"""
        select * from (select *, row_number() over (partition by {_TENANT}, target_id
                                                    order by score desc, paper_id) as rank from scores)
        where rank <= 5""",
    # outside targets: every request has its own corpus
    "ext_members": f"""
        select e.user_id, e.guild_id, e.paper_id as target_id, s.paper_id
        from external e join saved s using ({_TENANT}) where s.paper_id <> e.paper_id
        union all select {_TENANT}, paper_id, paper_id from external""",
    "ext_terms": "select user_id, guild_id, target_id, paper_id, term, tf from ext_members join terms using (paper_id)",
    "ext_df": f"""
        select {_TENANT}, target_id, term, df, {_IDF} as idf
        from (select {_TENANT}, target_id, term, count(*) as df from ext_terms group by all)
        join (select {_TENANT}, target_id, count(*) as n from ext_members group by all) using ({_TENANT}, target_id)""",
    "ext_weights": f"""
        select {_TENANT}, target_id, paper_id, term, tf * idf as w
        from ext_terms join ext_df using ({_TENANT}, target_id, term)""",
    "ext_norms": f"select {_TENANT}, target_id, paper_id, sqrt(sum(w * w)) as norm from ext_weights group by all",
    "ext_scores": f"""
        select a.user_id, a.guild_id, a.target_id, b.paper_id,
            round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 4) as score
        from ext_weights a
        join ext_weights b on a.user_id = b.user_id and a.guild_id = b.guild_id and a.target_id = b.target_id
            and a.term = b.term and b.paper_id <> b.target_id
        join ext_norms na on na.user_id = a.user_id and na.guild_id = a.guild_id and na.target_id = a.target_id
            and na.paper_id = a.target_id
        join ext_norms nb on nb.user_id = b.user_id and nb.guild_id = b.guild_id and nb.target_id = b.target_id
            and nb.paper_id = b.paper_id
        where a.paper_id = a.target_id group by 1, 2, 3, 4""",
    "search_requests": r"""
        select concat(doc_id, '-', form) as request_id,
            case form when 0 then concat(regexp_extract(text, '^\S+', 0), ' ', regexp_extract(text, '[A-Za-z]{9,}', 0))
                 when 1 then regexp_extract(text, '[A-Za-z]{9,}', 0) else '' end as query,
            case when form <> 1 and (k + form) % 2 = 1 then lang else '' end as category,
            case (k + form) % 5 when 1 then 'submittedDate' when 2 then 'lastUpdatedDate' else 'relevance' end as sort_by,
            case when (k + form) % 3 = 2 then 'ascending' else 'descending' end as sort_order,
            least(case (k + form) % 6 when 0 then 50 when 1 then 10 else 5 end, 25) as max_results
        from (select *, doc_id // 100 as k, unnest([0, 1, 2]) as form from documents where doc_id % 100 = 0)""",
    "query_terms": f"""
        select request_id, term, count(*) as query_tf
        from (select request_id, unnest({_tokens('query')}) as term from search_requests) group by all""",
    "paper_norms": f"""
        select paper_id, sqrt(sum(tf * {_IDF} * tf * {_IDF})) as norm
        from terms join corpus_df using (term) group by paper_id""",
    "query_norms": f"""
        select request_id, sqrt(sum(query_tf * {_IDF} * query_tf * {_IDF})) as query_norm
        from query_terms join corpus_df using (term) group by request_id""",
    "hits": f"""
        select request_id, paper_id, count(*) as shared, sum(tf * query_tf * {_IDF} * {_IDF}) as dot
        from query_terms join terms using (term) join corpus_df using (term) group by all""",
    "matches": """
        select r.*, p.paper_id, p.published, p.updated, round(h.dot / (n.norm * q.query_norm), 6) as relevance
        from search_requests r join hits h using (request_id) join papers p using (paper_id)
        join paper_norms n using (paper_id) join query_norms q using (request_id)
        where h.shared = (select count(*) from query_terms t where t.request_id = r.request_id)
          and (r.category = '' or list_contains(p.categories, r.category))""",
    "all_matches": """
        select * from matches
        union all by name
        select r.*, p.paper_id, p.published, p.updated, cast(0 as double) as relevance
        from search_requests r join papers p on r.category = '' or list_contains(p.categories, r.category)
        where r.request_id not in (select request_id from query_terms)""",
    "ordered": """
        select *, row_number() over (partition by request_id order by
            case when sort_by = 'relevance' then case when sort_order = 'descending' then relevance
                 else -relevance end end desc nulls last,
            case when sort_order = 'descending' then case sort_by when 'submittedDate' then published
                 when 'lastUpdatedDate' then updated end end desc nulls last,
            case when sort_order = 'ascending' then case sort_by when 'submittedDate' then published
                 when 'lastUpdatedDate' then updated end end asc nulls first,
            paper_id) as rank
        from all_matches""",
    "results": "select * from ordered where rank <= max_results",
    "commands": f"""
        select cast(user_id as varchar) as user_id, concat('g', cast(event_id % 2 as varchar)) as guild_id,
            {_pid('(event_id * 7 + user_id) % 10')} as paper_id, ts, event_id as seq,
            case event_type when 'signup' then 'save' when 'purchase' then 'save' when 'click' then 'set_status'
                 when 'view' then 'set_note' else 'remove' end as command,
            case cast(floor(value) as integer) % 4 when 0 then 'to-read' when 1 then 'reading' when 2 then 'done'
                 else 'bogus' end as status_arg,
            props as note_arg
        from events""",
    "marked": f"""
        select *, coalesce(last_value(case command when 'save' then 1 when 'remove' then 0 end ignore nulls) over (
            partition by {_TENANT}, paper_id order by ts, seq rows between unbounded preceding and 1 preceding), 0)
            as present
        from commands""",
    "outcomes": """
        select *, case when command = 'save' then case when present = 1 then 'duplicate' else 'saved' end
            when command = 'set_status' and status_arg = 'bogus' then 'invalid'
            when command = 'set_note' and (length(note_arg) < 1 or length(note_arg) > 500) then 'invalid'
            when present = 0 then 'not_found' when command = 'remove' then 'removed' else 'updated' end as outcome
        from marked""",
    "epochs": f"""
        select *, count(*) filter (outcome = 'saved') over (
            partition by {_TENANT}, paper_id order by ts, seq rows unbounded preceding) as epoch from outcomes""",
    "replayed": f"""
        select {_TENANT}, paper_id,
            coalesce(arg_max(status_arg, (ts, seq)) filter (command = 'set_status' and outcome = 'updated'), 'to-read')
                as status,
            arg_max(trim(note_arg), (ts, seq)) filter (command = 'set_note' and outcome = 'updated') as note,
            {_iso("min(ts) filter (outcome = 'saved')")} as saved_at
        from epochs e
        where epoch > 0 and epoch = (select max(epoch) from epochs x where x.user_id = e.user_id
                                     and x.guild_id = e.guild_id and x.paper_id = e.paper_id)
        group by all
        having count(*) filter (outcome = 'removed') = 0""",
}

_MATERIALIZED = {"terms", "lib_terms", "lib_weights", "ext_terms", "ext_weights", "papers", "saved", "line_requests"}




def _sql(body: str, **own: str) -> str:
    """Prefix ``body`` with the table expressions it needs, dependencies first."""
    ctes = {**_CTES, **own}
    order: list[str] = []

    def add(sql: str) -> None:
        words = set(re.findall(r"[a-z_]+", sql))
        for name in ctes:
            if name in words and name not in order and ctes[name] is not sql:
                add(ctes[name])
                if name not in order:
                    order.append(name)

    add(body)
    if not order:
        return body.strip()
    heads = [
        f"{name} as {'materialized ' if name in _MATERIALIZED else ''}({ctes[name].strip()})" for name in order
    ]
    return "with " + ",\n".join(heads) + "\n" + body.strip()


_TEXT_LISTS = "array_to_string(authors, '|') as authors"
_LISTED = (
    f"{_TENANT}, paper_id, title, {_TEXT_LISTS}, summary, published, "
    "array_to_string(categories, '|') as categories, arxiv_url, pdf_url, doi"
)


def _payloads() -> str:
    parts = []
    for fmt, cite in _CITES.items():
        heading = f"concat('**{fmt.title()} citation for** `', paper_id, '`')"
        payload = f"concat({heading}, chr(10), '```{_TAGS[fmt]}', chr(10), citation, chr(10), '```')"
        parts.append(
            f"select paper_id, '{fmt}' as format, citation, "
            f"case when length({payload}) < 2000 then 'inline' else 'file' end as delivery, "
            f"case when length({payload}) < 2000 then {payload} end as payload, "
            f"concat(paper_id, '.{_EXT[fmt]}') as file_name from (select *, {cite} as citation from papers)"
        )
    return " union all ".join(parts)


def _members_with_cites(fmt: str) -> str:
    return f"""select x.*, c.name, {_CITES[fmt]} as citation
        from contents x join collections c on c.id = x.collection_id"""


def _null_counts() -> str:
    required = {
        "saved_papers": ("landed", "id user_id guild_id paper_id title authors arxiv_url status saved_at"),
        "collections": ("collections", "id user_id guild_id name created_at"),
        "collection_papers": ("memberships", "collection_id paper_id user_id guild_id added_at"),
    }
    return " union all ".join(
        f"select '{table}' as \"table\", '{column}' as column_name, "
        f"count(*) filter ({column} is null) as violations from {source}"
        for table, (source, columns) in required.items()
        for column in columns.split()
    )


def _state_of(targets: str) -> str:
    return f"""
        select t.user_id, t.guild_id, t.paper_id,
            case when s.id is null then 'not_saved' when z.n < 2 then 'too_few'
                 when coalesce(b.found, 0) = 0 then 'none_similar' else 'ok' end as state,
            coalesce(b.found, 0) as found
        from {targets} t
        left join saved s on s.user_id = t.user_id and s.guild_id = t.guild_id and s.paper_id = t.paper_id
        left join lib_sizes z on z.user_id = t.user_id and z.guild_id = t.guild_id
        left join (select user_id, guild_id, target_id, count(*) as found from best group by all) b
            on b.user_id = t.user_id and b.guild_id = t.guild_id and b.target_id = t.paper_id"""


def _pages(source: str, per_page: int, order: str, columns: str) -> str:
    rank = f"row_number() over (partition by {_TENANT} order by {order})"
    total = f"count(*) over (partition by {_TENANT})"
    return f"""select {columns}, {rank} as idx, {total} as total,
        cast(ceil({rank} / {per_page}.0) as bigint) as page,
        cast(greatest(1, ceil({total} / {per_page}.0)) as bigint) as total_pages from {source}"""


_COUNTED = f"""select c.id, {_TENANT}, c.name, c.created_at, count(m.paper_id) as paper_count
    from collections c left join (select collection_id, paper_id from memberships) m on m.collection_id = c.id
    group by all"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources
    q["scan_saved_papers"] = _sql(
        f"select id, {_TENANT}, paper_id, title, authors, summary, published, categories, arxiv_url, pdf_url, doi, "
        f"status, note, {_iso('saved_at')} as saved_at from saved"
    )
    clean = r"trim(regexp_replace({0}, '[\s\x1c-\x1f]+', ' ', 'g'))"
    q["atom_ingest"] = _sql(
        f"select paper_id, {clean.format('title')} as title, {_TEXT_LISTS}, {clean.format('summary')} as summary, "
        "published, updated, array_to_string(categories, '|') as categories, concat(arxiv_url, 'v2') as arxiv_url, "
        "case when pdf_url = '' then 'second' else pdf_url end as pdf_url, doi from papers"
    )
    q["atom_stream"] = _sql(
        f"select paper_id, {clean.format('title')} as title, {_TEXT_LISTS}, {clean.format('summary')} as summary, "
        "published, updated, array_to_string(categories, '|') as categories, arxiv_url, pdf_url, doi from papers"
    )
    q["atom_stream_repeats"] = q["atom_stream"]
    q["lookup_by_id"] = _sql(
        f"select i.paper_id, p.paper_id is not null as found, p.title, p.doi from (select distinct "
        f"{_pid('p_partkey')} as paper_id from part where p_partkey % 10 <> 9) i "
        "left join papers p on p.paper_id = i.paper_id and p.title <> ''"
    )
    q["export_citation_payload"] = _sql(_payloads())

    # projections and look-ups
    listing = f"select {_LISTED}, status, note, {_iso('saved_at')} as saved_at from listed"
    q["library_listing"] = _sql(listing)
    q["library_corpus"] = _sql(f"select {_LISTED} from listed")
    q["library_one_tenant"] = _sql(f"{listing} where user_id = '7' and guild_id = 'g1'")
    q["library_by_status"] = _sql(f"{listing} where status = 'reading'")
    asked = f"(select distinct {_TENANT}, paper_id from line_requests) r left join saved s using ({_TENANT}, paper_id)"
    q["paper_exists"] = _sql(f"select {_TENANT}, paper_id, s.id is not null as saved from {asked}")
    q["get_note"] = _sql(
        f"select {_TENANT}, paper_id, case when s.id is not null then coalesce(note, '') end as note from {asked}"
    )
    q["note_state"] = _sql(
        f"select {_TENANT}, paper_id, case when s.id is null then 'not_saved' when coalesce(note, '') = '' "
        f"then 'no_note' else 'note' end as state from {asked}"
    )
    q["suggest_paper_ids"] = _sql(f"""
        select * from (select {_TENANT}, needle, paper_id, row_number() over (
            partition by {_TENANT}, needle order by saved_at desc, paper_id) as position
            from (select distinct {_TENANT}, unnest([right(user_id, 1), '', concat('0', right(user_id, 1)), concat('.00', right(user_id, 1)),
                  concat('240', right(user_id, 1), '.0'), '2401.X']) as needle from attempts) r
            join saved using ({_TENANT}) where contains(lower(paper_id), lower(needle)))
        where position <= 25""")
    q["suggest_collections"] = _sql(f"""
        select * from (select {_TENANT}, needle, name, row_number() over (
            partition by {_TENANT}, needle order by name) as position
            from (select distinct {_TENANT}, unnest(case guild_id when 'g0' then ['I', 'rea'] else ['', 'URGENT', 'collect'] end) as needle from attempts) r
            join collections using ({_TENANT}) where contains(lower(name), lower(needle)))
        where position <= 25""")

    # collections
    q["collection_counts"] = _sql(
        f"select id, {_TENANT}, name, {_iso('created_at')} as created_at, paper_count from ({_COUNTED})"
    )
    q["collection_papers"] = _sql(f"""
        select m.collection_id, {_TENANT}, paper_id, {_iso('m.added_at')} as added_at, r.title,
            array_to_string(l.authors, '|') as authors, r.summary, r.published,
            array_to_string(l.categories, '|') as categories, r.arxiv_url, r.pdf_url, r.doi, r.status, r.note
        from memberships m join saved r using ({_TENANT}, paper_id) join listed l using ({_TENANT}, paper_id)""")
    q["collection_state"] = _sql(f"""
        select {_TENANT}, name, case when c.id is null then 'missing' when h.papers is null then 'empty'
            else 'ok' end as state, coalesce(h.papers, 0) as papers
        from (select distinct {_TENANT}, name from line_requests) r
        left join collections c using ({_TENANT}, name)
        left join (select collection_id, count(*) as papers from contents group by all) h on h.collection_id = c.id""")
    q["collection_names"] = _sql(f"select {_TENANT}, name from collections")
    q["collection_pages"] = _sql(
        _pages(
            f"({_COUNTED})", 10, "created_at desc, id",
            f"id, {_TENANT}, name, {_iso('created_at')} as created_at, paper_count, "
            "strftime(created_at, '%Y-%m-%d') as created",
        )
    )
    q["collection_head"] = _sql(f"""
        select collection_id, {_TENANT}, paper_id, position, total, status, {_cut('title', 200)} as title_line,
            {_authors('authors', 2)} as authors_line, {_date('published')} as published_date
        from (select *, row_number() over (partition by collection_id order by added_at desc, paper_id) as position,
                  count(*) over (partition by collection_id) as total from contents) where position <= 15""")
    heading = "concat('**', cast(papers as varchar), '** citations from **', name, '**')"
    q["export_collection"] = _sql(
        f"""
        select collection_id, {_TENANT}, name, 'bibtex' as format, papers, length(joined) as text_length,
            case when length(joined) + length({heading}) + 6 + 8 < 2000 then 'inline' else 'file' end as delivery,
            concat(name, '.bib') as file_name,
            case when length(joined) + length({heading}) + 6 + 8 < 2000
                 then concat({heading}, chr(10), '```bibtex', chr(10), joined, chr(10), '```') end as payload
        from (select collection_id, {_TENANT}, name, count(*) as papers,
                  string_agg(citation, chr(10) || chr(10) order by added_at desc, paper_id) as joined
              from cited group by all)""",
        cited=_members_with_cites("bibtex"),
    )
    q["export_collection_file"] = _sql(
        f"""
        select {_TENANT}, collection_id, concat(name, '.md') as file_name, position,
            case when position = total then citation else citation || chr(10) end as text
        from (select *, row_number() over (partition by collection_id order by added_at desc, paper_id) as position,
                  count(*) over (partition by collection_id) as total from cited)""",
        cited=_members_with_cites("markdown"),
    )

    # counts, paging, order
    q["library_size"] = _sql(f"""
        select t.user_id, t.guild_id, coalesce(n, 0) as total
        from (select cast(c_custkey as varchar) as user_id, unnest(['g0', 'g1']) as guild_id from customer) t
        left join lib_sizes using ({_TENANT})""")
    q["status_counts"] = _sql(f"select {_TENANT}, status, count(*) as papers from saved group by all")
    filled = (
        "count(*) filter (status = 'to-read') as to_read, count(*) filter (status = 'reading') as reading, "
        "count(*) filter (status = 'done') as done"
    )
    q["status_counts_filled"] = _sql(f"select {_TENANT}, {filled} from saved group by {_TENANT}")
    cats = (
        f"select {_TENANT}, category, count(*) as papers "
        f"from (select {_TENANT}, unnest(categories) as category from listed) group by all"
    )
    q["category_counts"] = _sql(cats)
    top = (
        f"select * from (select *, row_number() over (partition by {_TENANT} order by papers desc, category) as rank "
        f"from ({cats})) where rank <= 5"
    )
    q["top_categories"] = _sql(top)
    q["library_stats"] = _sql(f"""
        select {_TENANT}, coalesce(total, 0) as total, coalesce(to_read, 0) as to_read,
            coalesce(reading, 0) as reading, coalesce(done, 0) as done,
            coalesce(collections_count, 0) as collections_count, coalesce(top, '') as top_categories
        from (select {_TENANT}, count(*) as total, {filled} from saved group by {_TENANT}) a
        full join (select {_TENANT}, count(*) as collections_count from collections group by all) b using ({_TENANT})
        left join (select {_TENANT}, string_agg(category || ':' || papers, ',' order by rank) as top
                   from ({top}) group by {_TENANT}) t using ({_TENANT})""")
    q["library_pages"] = _sql(
        _pages("saved", 5, "saved_at desc, paper_id", f"{_TENANT}, paper_id, {_iso('saved_at')} as saved_at")
    )
    q["page_lookup"] = f"select * from ({q['library_pages']}) where page = 2 or page = total_pages"
    q["paper_ids"] = _sql(f"select {_TENANT}, paper_id, {_iso('saved_at')} as saved_at from saved")
    q["library_cards"] = _sql(f"""
        select {_TENANT}, paper_id, status, {_ROW}, strftime(saved_at, '%Y-%m-%d') as saved_date,
            case when coalesce(note, '') <> '' then {_cut('note', 100)} end as note_line from listed""")

    # functions
    q["decode_lists"] = _sql(
        f"select paper_id, {_TEXT_LISTS}, len(authors) as n_authors, "
        "array_to_string(categories, '|') as categories from papers"
    )
    q["encode_lists"] = _sql(
        "select paper_id, concat('[\"', array_to_string(authors, '\",\"'), '\"]') as authors from papers"
    )
    q["strip_text"] = (
        f"select doc_id, {_strip('concat(chr(32), chr(9), chr(10), text, chr(32), chr(13), chr(10), chr(32))')} "
        "as stripped from documents"
    )
    q["clean_text"] = f"select doc_id, {clean.format('text')} as cleaned from documents"
    q["extract_ids"] = _sql("""
        select doc_id,
            case doc_id % 4 when 0 then concat(arxiv_url, 'v', cast(1 + doc_id % 9 as varchar))
                when 1 then concat('https://arxiv.org/abs/math.AG/', lpad(cast(doc_id as varchar), 7, '0'))
                when 2 then arxiv_url else concat('urn:none/', cast(doc_id as varchar), 'x') end as url,
            case doc_id % 4 when 1 then concat('math.AG/', lpad(cast(doc_id as varchar), 7, '0'))
                when 3 then concat('urn:none/', cast(doc_id as varchar), 'x') else paper_id end as extracted
        from papers""")
    q["quick_summary"] = f"select doc_id, {_summary('text')} as quick_summary from documents"
    q["truncate_text"] = f"select doc_id, {_cut('text', 120)} as cut from documents"
    q["format_authors"] = _sql(
        f"select paper_id, {_authors('authors', 1)} as one, {_authors('authors', 3)} as \"default\", "
        "'Unknown' as \"none\" from papers"
    )
    q["format_categories"] = _sql(
        f"select paper_id, {_cats('categories', 1)} as one, {_cats('categories', 5)} as \"default\", "
        "'N/A' as \"none\" from papers"
    )
    q["tokenize"] = (
        f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens "
        f"from (select doc_id, {_tokens('text')} as t from documents)"
    )
    q["saved_date"] = _sql("select seq, strftime(saved_at, '%Y-%m-%d') as saved_date from attempts")
    q["published_date"] = _sql(f"select paper_id, {_date('published')} as published_date from papers_raw")
    q["primary_category"] = _sql("select paper_id, coalesce(categories[1], 'N/A') as primary_category from papers")
    q["bibtex_key"] = _sql(
        f"select paper_id, {_key('authors', 'published')} as bibtex_key, "
        f"{_LAST_FIRST.format('authors[1]')} as last_first, "
        + _escape("concat(summary, ' \\ & 100% #_{x}')")
        + " as escaped from papers"
    )
    for fmt, cite in _CITES.items():
        q[f"cite_{fmt}"] = _sql(f"select paper_id, {cite} as citation from papers")
    q["paper_details"] = _sql(f"""
        select paper_id, {_cut('title', 256)} as title_line, {_authors('authors', 8)} as authors_line,
            {_date('published')} as published_date, {_cats('categories', 6)} as categories_line,
            case when doi <> '' then concat('https://doi.org/', doi) end as doi_url,
            {_summary('summary')} as quick_summary, {_cut('summary', 1024)} as abstract from papers""")

    # search
    q["corpus_search"] = _sql("select request_id, paper_id from all_matches")
    q["corpus_search_sorted"] = _sql(
        "select request_id, sort_by, sort_order, rank, paper_id, relevance from results"
    )
    q["top_hit"] = _sql("""
        select request_id, arg_min(paper_id, (-relevance, paper_id)) as paper_id from all_matches group by request_id""")
    line_value = (
        f"concat_ws(chr(10), concat({_authors('authors', 2)}, '  •  ', {_date('published')}, '  •  `', "
        f"{_cats('categories', 2)}, '`'), {_cut('summary', 120)}, {_LINKS})"
    )
    q["budgeted_results"] = _sql(
        f"""
        select request_id, rank, paper_id, line_name, line_value, cast(used as bigint) as used,
            count(*) over (partition by request_id) as shown, total
        from (select *, sum(length(line_name) + length(line_value)) over (partition by request_id order by rank)
                  + length(concat('\U0001F50D  ', {_cut('query', 240)}))
                  + length(concat('Showing **', cast(total as varchar), '** result',
                                  case when total <> 1 then 's' else '' end, ' from arXiv')) as used
              from (select *, {_cut('value', 1024)} as line_value from shown_lines))
        where used <= 5900""",
        shown_lines=f"""
        select o.request_id, o.query, o.rank, paper_id, count(*) over (partition by o.request_id) as total,
            concat('`', cast(o.rank as varchar), '` ', {_cut('title', 200)}) as line_name, {line_value} as value
        from (select request_id, query, paper_id, rank from ordered where rank <= 25) o join papers using (paper_id)""",
    )
    q["select_options"] = _sql(f"""
        select request_id, rank, paper_id, {_cut('title', 100)} as label, {_cut('about', 100)} as description
        from (select o.request_id, o.rank, paper_id, title,
                  concat({_date('p.published')}, ' • ', coalesce(authors[1], 'Unknown')) as about
              from (select request_id, rank, paper_id from results) o join papers p using (paper_id))""")

    # similarity
    q["term_frequencies"] = _sql("select paper_id, term, tf from terms")
    q["document_frequencies"] = _sql("select term, count(*) as df from terms group by term")
    q["idf"] = _sql(f"select term, df, n, round({_IDF}, 9) as idf from corpus_df")
    q["tfidf_vectors"] = _sql(f"""
        select paper_id, term, tf, round(tf / total * {_IDF}, 9) as weight
        from terms join corpus_df using (term)
        join (select paper_id, cast(sum(tf) as double) as total from terms group by paper_id) using (paper_id)""")
    q["pairwise_similarity"] = _sql(f"""
        select {_TENANT}, paper_a, paper_b, round(coalesce(any_value(d.dot) /
            (any_value(na.norm) * any_value(nb.norm)), 0), 4) as score
        from (select {_TENANT}, arg_max(paper_id, (saved_at, id)) as paper_a, arg_min(paper_id, (saved_at, id)) as paper_b
              from saved group by {_TENANT}) p
        left join (select e.user_id, e.guild_id, e.paper_a, e.paper_b, sum(a.w * b.w) as dot
            from (select {_TENANT}, arg_max(paper_id, (saved_at, id)) as paper_a,
                      arg_min(paper_id, (saved_at, id)) as paper_b from saved group by {_TENANT}) e
            join lib_weights a on a.user_id = e.user_id and a.guild_id = e.guild_id and a.paper_id = e.paper_a
            join lib_weights b on b.user_id = e.user_id and b.guild_id = e.guild_id and b.paper_id = e.paper_b
                and b.term = a.term group by all) d using ({_TENANT}, paper_a, paper_b)
        left join (select user_id, guild_id, paper_id as paper_a, norm from lib_norms) na using ({_TENANT}, paper_a)
        left join (select user_id, guild_id, paper_id as paper_b, norm from lib_norms) nb using ({_TENANT}, paper_b)
        group by {_TENANT}, paper_a, paper_b""")
    q["related_papers"] = _sql(
        f"""
        select {_TENANT}, target_id, paper_id, score, rank, cast(trunc(score * 100) as bigint) as percent, {_ROW}
        from best join papers using (paper_id)""",
        targets="select * from newest",
    )
    q["related_external"] = _sql(f"""
        select * from (select *, row_number() over (partition by {_TENANT}, target_id
                                                    order by score desc, paper_id) as rank from ext_scores)
        where rank <= 5""")
    q["related_state"] = _sql(
        _state_of("targets"),
        targets="select * from newest union select * from external",
    )

    # edits
    saves = f"""select r.seq, {_TENANT}, r.paper_id, r.doc_id, requested_at, s.id as held,
        row_number() over (partition by {_TENANT}, r.paper_id order by requested_at, r.seq) as rn
        from line_requests r left join saved s using ({_TENANT}, paper_id)"""
    q["save_papers"] = _sql(
        f"select seq, {_TENANT}, paper_id, case when held is null and rn = 1 then 'saved' else 'duplicate' end "
        "as outcome from saves",
        saves=saves,
    )
    stored = "paper_id, title, authors, summary, published, categories, arxiv_url, pdf_url, doi"
    q["save_papers_applied"] = _sql(
        f"select {_TENANT}, {stored}, status, note, {_iso('saved_at')} as saved_at from saved union all "
        f"select {_TENANT}, {stored}, 'to-read', null, {_iso('requested_at')} "
        "from saves join (select * exclude (paper_id), paper_id from papers_raw) using (doc_id, paper_id) "
        "where held is null and rn = 1",
        saves=saves,
    )
    creates = f"""select id, seq, requested_at, {_TENANT}, trim(name) as name, c.cid,
        row_number() over (partition by {_TENANT}, trim(name) order by requested_at, seq) as rn
        from (select id, seq, requested_at, {_TENANT}, case when line = 1 then '   '
                  when line % 2 = 0 then concat(' ', name, ' ')
                  else concat(name, ' ', cast(part % 3 as varchar)) end as name from line_requests) r
        left join (select id as cid, {_TENANT}, name from collections) c using ({_TENANT}, name)"""
    creates = creates.replace("using (user_id, guild_id, name)", (
        "on c.user_id = r.user_id and c.guild_id = r.guild_id and c.name = trim(r.name)"
    )).replace(f"select id, seq, requested_at, {_TENANT}, trim(name) as name, c.cid", (
        "select r.id, r.seq, r.requested_at, r.user_id, r.guild_id, trim(r.name) as name, c.cid"
    )).replace(f"(partition by {_TENANT}, trim(name)", "(partition by r.user_id, r.guild_id, trim(r.name)")
    q["create_collections"] = _sql(
        f"select seq, {_TENANT}, name, case when name = '' then 'blank' when cid is null and rn = 1 then 'created' "
        "else 'duplicate' end as outcome from creates",
        creates=creates,
    )
    q["create_collections_applied"] = _sql(
        f"select id, {_TENANT}, name, {_iso('created_at')} as created_at from collections union all "
        f"select id, {_TENANT}, name, {_iso('requested_at')} from creates where name <> '' and cid is null and rn = 1",
        creates=creates,
    )
    q["add_to_collection"] = _sql(
        f"select seq, {_TENANT}, name, paper_id, cast(collection_id as varchar) as collection_id, outcome "
        "from add_outcomes"
    )
    q["remove_from_collection"] = _sql(
        f"select seq, {_TENANT}, name, paper_id, case when collection_id is null then 'not_found' "
        "when held and rn = 1 then 'removed' else 'not_in_collection' end as outcome from membership_removals"
    )
    q["remove_from_collection_applied"] = _sql(
        f"select collection_id, {_TENANT}, paper_id, {_iso('added_at')} as added_at from memberships m "
        "where not exists (select 1 from membership_removals r where r.collection_id = m.collection_id "
        "and r.paper_id = m.paper_id)"
    )
    statuses = (
        f"select seq, requested_at, {_TENANT}, paper_id, case flag when 'A' then 'done' when 'N' then 'reading' "
        "else 'archived' end as status from line_requests"
    )
    q["set_status"] = _sql(
        f"select r.seq, {_TENANT}, paper_id, r.status, case when r.status = 'archived' then 'invalid' "
        f"when s.id is null then 'not_found' else 'updated' end as outcome "
        f"from statuses r left join saved s using ({_TENANT}, paper_id)",
        statuses=statuses,
    )
    q["set_status_applied"] = _sql(
        f"select {_TENANT}, paper_id, coalesce(l.status, s.status) as status from saved s left join "
        f"(select {_TENANT}, paper_id, arg_max(status, (requested_at, seq)) as status from statuses "
        f"where status <> 'archived' group by {_TENANT}, paper_id) l using ({_TENANT}, paper_id)",
        statuses=statuses,
    )
    note_rows = (
        f"select seq, requested_at, {_TENANT}, paper_id, case line when 1 then '   ' when 2 then '' "
        "when 3 then repeat('x', 501) else concat('  line ', cast(line as varchar), ' ') end as new_note "
        "from line_requests"
    )
    q["set_note"] = _sql(
        f"select r.seq, {_TENANT}, paper_id, case when length(new_note) not between 1 and 500 then 'invalid' "
        f"when s.id is null then 'not_found' else 'updated' end as outcome "
        f"from note_rows r left join saved s using ({_TENANT}, paper_id)",
        note_rows=note_rows,
    )
    q["set_note_applied"] = _sql(
        f"select {_TENANT}, paper_id, coalesce(l.new_note, s.note) as note from saved s left join "
        f"(select {_TENANT}, paper_id, arg_max(trim(new_note), (requested_at, seq)) as new_note from note_rows "
        f"where length(new_note) between 1 and 500 group by {_TENANT}, paper_id) l using ({_TENANT}, paper_id)",
        note_rows=note_rows,
    )
    q["remove_papers"] = _sql(
        f"select seq, {_TENANT}, paper_id, case when held and rn = 1 then 'removed' else 'not_found' end as outcome "
        f"from (select r.seq, {_TENANT}, paper_id, s.id is not null as held, row_number() over (partition by {_TENANT}, "
        f"paper_id order by requested_at, r.seq) as rn from paper_removals r left join saved s using ({_TENANT}, paper_id))"
    )
    gone = (
        "not exists (select 1 from paper_removals r where r.user_id = x.user_id and r.guild_id = x.guild_id "
        "and r.paper_id = x.paper_id)"
    )
    q["remove_papers_applied"] = _sql(
        f"select 'library' as place, {_TENANT}, paper_id from saved x where {gone} union all "
        f"select cast(collection_id as varchar), {_TENANT}, paper_id from memberships x where {gone}"
    )
    q["delete_collections"] = _sql(
        f"select seq, {_TENANT}, name, case when collection_id is not null and rn = 1 then 'deleted' "
        "else 'not_found' end as outcome from removed_collections"
    )
    dropped = "(select collection_id from removed_collections where collection_id is not null)"
    q["delete_collections_applied"] = _sql(
        f"select 'collection' as kind, id as collection_id, cast(null as varchar) as paper_id from collections "
        f"where id not in {dropped} union all select 'member', collection_id, paper_id from memberships "
        f"where collection_id not in {dropped}"
    )
    q["replay_outcomes"] = _sql(f"select {_TENANT}, paper_id, seq, command, outcome from outcomes")
    q["replay_library"] = _sql("select * from replayed")
    q["replay_stream"] = q["replay_library"]
    q["replay_stateful"] = q["replay_library"]

    # data quality and layouts
    q["dup_keys"] = _sql(
        "select 'saved_papers' as \"table\", concat(user_id, '/', guild_id, '/', paper_id) as key, count(*) as \"rows\" "
        "from landed group by user_id, guild_id, paper_id having count(*) > 1 union all "
        "select 'collections', concat(user_id, '/', guild_id, '/', name), count(*) "
        "from (select * from collections union all select * from collections where id % 2 = 0) "
        "group by user_id, guild_id, name having count(*) > 1 union all "
        "select 'collection_papers', concat(collection_id, '/', paper_id), count(*) "
        "from (select * from memberships union all select * from memberships where collection_id % 2 = 0) "
        "group by collection_id, paper_id having count(*) > 1"
    )
    q["null_violations"] = _sql(_null_counts())
    q["orphan_memberships"] = _sql(
        f"select collection_id, paper_id, {_TENANT}, 'no_collection' as reason from memberships "
        f"where collection_id in {dropped} union all "
        f"select collection_id, paper_id, {_TENANT}, 'no_paper' from memberships x "
        f"where not ({gone})"
    )
    q["bad_status"] = _sql(
        f"select id, {_TENANT}, paper_id, status from landed where status not in ('to-read', 'reading', 'done')"
    )
    q["upgrade_columns"] = _sql(
        f"select {_TENANT}, paper_id, title, 'to-read' as status, cast(null as varchar) as note, "
        "cast(null as varchar) as summary from saved"
    )
    q["upgrade_guild"] = _sql(
        "select 'saved_papers' as \"table\", user_id, '' as guild_id, paper_id as item from saved union all "
        "select 'collections', user_id, '', name from collections union all "
        "select 'collection_papers', user_id, '', paper_id from memberships"
    )
    return q
