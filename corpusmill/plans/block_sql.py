"""SQL of URLs, blocks and snapshots, put together from expressions as the plans are."""

from __future__ import annotations

from corpusmill.functions.urls import TRACKING_KEYS, UNRESERVED

FIELD, RECORD = "chr(31)", "chr(30)"
_REMOVED = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]"
_BLANK = r"[\x{09}\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def folded(text: str) -> str:
    """The character rules; joiners are only dropped, so the texts must hold none beside pictographs."""
    out = f"replace(nfc_normalize({text}), chr(8205), '')"
    out = rf"regexp_replace(regexp_replace({out}, '{_BLANK}', ' ', 'g'), '{_REMOVED}', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[‘’‚‛]', '''', 'g'), '[“”„‟]', chr(34), 'g')"
    return rf"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def hashed_text(text: str) -> str:
    return rf"regexp_replace(regexp_replace({folded(text)}, '[ \n\x{{1680}}\x{{2028}}\x{{2029}}]+', ' ', 'g'), '^ | $', '', 'g')"


def content_text(text: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace({folded(text)}, '[ \x{{1680}}]+', ' ', 'g'), "
        r"' ?[\n\x{2028}\x{2029}][ \n\x{1680}\x{2028}\x{2029}]*', chr(10), 'g'), '^[ \n\x{1680}\x{2028}\x{2029}]+|[ \n\x{1680}\x{2028}\x{2029}]+$', '', 'g')"
    )


# --- URLs --------------------------------------------------------------------------------


def respelled(text: str, name: str) -> str:
    """Escapes of unreserved characters decoded and the others in upper case; ``name`` is the lambda's variable."""
    value = f"(strpos('0123456789ABCDEF', upper({name}[1])) - 1) * 16 + strpos('0123456789ABCDEF', upper({name}[2])) - 1"
    one = f"case when regexp_matches({name}, '^[0-9A-Fa-f]{{2}}') then case when strpos('{UNRESERVED}', chr(({value})::int)) > 0 then chr(({value})::int) else '%' || upper({name}[1:2]) end || {name}[3:] else '%' || {name} end"
    return f"split_part({text}, '%', 1) || list_aggregate(list_concat([''], list_transform(string_split({text}, '%')[2:], lambda {name}: {one})), 'string_agg', '')"


_URL = "trim(canonical_uri)"
_NO_FRAGMENT = f"split_part({_URL}, '#', 1)"
_SCHEME = f"lower(regexp_extract({_NO_FRAGMENT}, '^([A-Za-z]+)://', 1))"
_AUTHORITY = f"regexp_extract({_NO_FRAGMENT}, '^[A-Za-z]+://([^/?]*)', 1)"
_PATH = f"regexp_extract({_NO_FRAGMENT}, '^[A-Za-z]+://[^/?]*([^?]*)', 1)"
_PORTLESS = f"regexp_replace(lower({_AUTHORITY}), case {_SCHEME} when 'http' then ':(80)?$' else ':(443)?$' end, '')"
_SEGMENTS = f"list_filter(string_split({respelled(_PATH, 'p')}, '/'), lambda s: s <> '' and s <> '.')"
_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
_ITEMS = f"""list_filter(list_transform(string_split(regexp_extract({_NO_FRAGMENT}, '\\?(.*)$', 1), '&'), lambda q: {respelled('q', 'e')}),
             lambda i: i <> '' and not list_contains([{_KEYS}], lower(split_part(i, '=', 1))))"""
_SORTED = f"array_to_string(list_transform(list_sort(list_transform({_ITEMS}, lambda i: split_part(i, '=', 1) || chr(1) || i)), lambda i: split_part(i, chr(1), 2)), '&')"
_FRAGMENT = f"case when strpos({_URL}, '#') > 0 then substring({_URL}, strpos({_URL}, '#') + 1) else '' end"
#: For absolute http(s) URLs without parent segments, users and addresses in brackets.
CANONICAL_URL = (
    f"""{_SCHEME} || '://' || regexp_replace({_PORTLESS}, '\\.$', '') || '/' || array_to_string({_SEGMENTS}, '/')
        || case when coalesce({_SORTED}, '') = '' then '' else '?' || {_SORTED} end
        || case when {_FRAGMENT} = '' then '' else '#' || {respelled(f'({_FRAGMENT})', 'f')} end"""
)
#: The spelling under which pages of snapshots are compared.
PAGE_KEY = f"rtrim({_SCHEME} || '://' || {_PORTLESS} || {respelled(_PATH, 'p')}, '/')"

# --- blocks ------------------------------------------------------------------------------


def _string(block: str, name: str) -> str:
    return f"coalesce(json_extract_string({block}, '$.{name}'), '')"


def _list(block: str, name: str, kind: str = "JSON") -> str:
    return f"coalesce(json_extract({block}, '$.{name}')::{kind}[], [])"


def _joined(values: str) -> str:
    """Strings of a list one behind the other."""
    return f"list_aggregate(list_concat([''], {values}), 'string_agg', '')"


def _listed(values: str, name: str) -> str:
    return _joined(f"list_transform({values}, lambda {name}: {FIELD} || {hashed_text(name)})")


def leaf_records(b: str, n: str) -> str:
    """The records of one block without pairs; ``n`` makes the names of lambda variables its own."""
    columns = f"case when len({_list(b, 'header')}) > 0 then len({_list(b, 'header')}) when len({_list(b, 'rows')}) > 0 then json_array_length({_list(b, 'rows')}[1]) else 0 end"
    link = f"'LINK' || {FIELD} || {hashed_text(_string(f'l{n}', 'text'))} || {FIELD} || {_string(f'l{n}', 'href')} || {RECORD}"
    header = f"case when len({_list(b, 'header')}) > 0 then 'TH' || {_listed(_list(b, 'header', 'varchar'), f'h{n}')} || {RECORD} else '' end"
    rows = _joined(f"list_transform({_list(b, 'rows')}, lambda r{n}: 'TR' || {_listed(f'coalesce(r{n}::varchar[], [])', f'c{n}')} || {RECORD})")
    return f"""case json_extract_string({b}, '$.type')
      when 'heading' then 'H' || {FIELD} || {_string(b, 'level')} || {FIELD} || {hashed_text(_string(b, 'text'))} || {RECORD}
      when 'paragraph' then 'P' || {FIELD} || {hashed_text(_string(b, 'text'))} || {RECORD} || {_joined(f"list_transform({_list(b, 'links')}, lambda l{n}: {link})")}
      when 'list' then 'LIST' || {FIELD} || case when json_extract_string({b}, '$.ordered') = 'true' then '1' else '0' end || {FIELD} || {_string(b, 'depth')} || {FIELD} || {_string(b, 'start')}
        || {_listed(_list(b, 'items', 'varchar'), f'i{n}')} || {RECORD}
      when 'table' then 'TABLE' || {FIELD} || {hashed_text(_string(b, 'caption'))} || {FIELD} || {columns} || {RECORD} || {header} || {rows} || 'ENDTABLE' || {RECORD}
      when 'image' then case when {_string(b, 'role')} <> 'decorative' then 'IMG' || {FIELD} || {hashed_text(_string(b, 'alt'))} || {FIELD} || {hashed_text(_string(b, 'caption'))} || {RECORD} else '' end
      else '' end"""


def records(blocks: str) -> str:
    """The records of an array of blocks; of anything else none."""
    pair = f"'FAQ' || {FIELD} || {hashed_text(_string('b', 'question'))} || {RECORD} || {_joined(f'list_transform({_list("b", "answer")}, lambda a: {leaf_records("a", "1")})')} || 'ENDFAQ' || {RECORD}"
    one = f"case when json_extract_string(b, '$.type') = 'faq_pair' then {pair} else {leaf_records('b', '0')} end"
    return f"case when json_type({blocks}) = 'ARRAY' then {_joined(f'list_transform({blocks}::JSON[], lambda b: {one})')} else '' end"


def _rendered(b: str, n: str) -> str:
    table = f"list_concat(case when len({_list(b, 'header')}) > 0 then [array_to_string({_list(b, 'header', 'varchar')}, ' | ')] else [] end, list_transform({_list(b, 'rows')}, lambda w{n}: array_to_string(w{n}::varchar[], ' | ')))"
    return f"""case when {_idle(b)} then '' else case json_extract_string({b}, '$.type') when 'heading' then {_string(b, 'text')} when 'paragraph' then {_string(b, 'text')}
      when 'list' then coalesce(array_to_string({_list(b, 'items', 'varchar')}, chr(10)), '') when 'table' then coalesce(array_to_string({table}, chr(10)), '') when 'image' then {_string(b, 'alt')} else '' end end"""


def _idle(b: str) -> str:
    return f"(json_extract_string({b}, '$.type') = 'image' and trim(regexp_replace(lower({_string(b, 'alt')}), '\\s+', ' ', 'g')) in ('test', 'contact us'))"


_SAYS = f"""case json_extract_string(b, '$.type') when 'heading' then trim({_string('b', 'text')}) <> '' when 'paragraph' then trim({_string('b', 'text')}) <> ''
  when 'list' then len(list_filter({_list('b', 'items', 'varchar')}, lambda i: trim(i) <> '')) > 0 when 'table' then len({_list('b', 'header')}) > 0 or len({_list('b', 'rows')}) > 0
  when 'image' then trim({_string('b', 'alt')}) <> '' else true end"""

CONTRACT_HASHES = f"select record_id, sha256('DOC' || {FIELD} || {hashed_text('title')} || {RECORD} || {records('blocks')}) as content_hash from contract"

CONTRACT_CHUNKS = f"""
  with e as (select record_id, unnest(range(len(blocks::JSON[]))) as ord, unnest(blocks::JSON[]) as b from contract where json_type(blocks) = 'ARRAY'),
  u as (select record_id, ord, json_extract_string(b, '$.type') = 'faq_pair' as pair,
               case when json_extract_string(b, '$.type') = 'faq_pair'
                    then array_to_string(list_concat([{_string('b', 'question')}], list_filter(list_transform({_list('b', 'answer')}, lambda a: {_rendered('a', '1')}), lambda t: t <> '')), chr(10))
                    else {_rendered('b', '0')} end as text from e),
  g as (select *, count(*) filter (where pair) over (partition by record_id order by ord rows between unbounded preceding and 1 preceding) as g from u),
  r as (select record_id, g, 0 as side, string_agg(text, chr(10) || chr(10) order by ord) as text from g where not pair and text <> '' group by 1, 2
        union all select record_id, g, 1, text from g where pair and text <> ''),
  w as (select *, unnest(range(case when side = 1 or length(text) <= 1000 then 1 else ceil((length(text) - 1000) / 850.0)::int + 1 end)) as i from r)
  select record_id, (row_number() over (partition by record_id order by g, side, i) - 1)::int as chunk_index,
         sha256(case when side = 1 then text else substring(text, (i * 850 + 1)::bigint, 1000) end) as content_hash from w"""

FAQ_PAIR_HASHES = rf"""
  with p as (select faq_id, list_filter(pairs, lambda p: coalesce(regexp_matches(p.question, '[^ \t\n\r]') and regexp_matches(p.answer, '[^ \t\n\r]'), false)) as ps from service_faq_data)
  select faq_id, sha256('DOC' || {FIELD} || 'FAQ' || {RECORD} || {_joined(f"list_transform(coalesce(ps, []), lambda x: 'FAQ' || {FIELD} || {hashed_text('x.question')} || {RECORD} || 'P' || {FIELD} || {hashed_text('x.answer')} || {RECORD} || 'ENDFAQ' || {RECORD})")}) as content_hash from p"""

URL_CANONICAL = f"select record_id, {CANONICAL_URL} as url from contract"

ACCEPTANCE_GATE = f"""
  select record_id, case when trim(canonical_uri) = '' then 'empty canonical_uri' when canonical_uri is distinct from {CANONICAL_URL} then 'canonical_uri is not normalized'
    when trim(title) = '' then 'empty title' when json_type(blocks) <> 'ARRAY' or json_array_length(blocks) = 0 then 'no content blocks'
    when not list_bool_or(list_transform(blocks::JSON[], lambda b: {_SAYS})) then 'no textual content' when extractor_version < 1 then 'invalid extractor_version' end as reason from contract"""

FAQ_RECORDS = f"""
  with b as (select dictionary_name, faq_key, parent_canonical_uri || '#faq' as canonical_uri, {content_text("(parent_title || ' — FAQ')")} as title, coalesce(pairs, []) as ps from service_faq_data),
  c as (select *, list_filter(ps, lambda p: coalesce({hashed_text('p.question')} <> '' and {hashed_text('p.answer')} <> '', false)) as kept, {CANONICAL_URL} as url from b)
  select url as canonical_uri, title,
         sha256('DOC' || {FIELD} || {hashed_text('title')} || {RECORD} || {_joined(f"list_transform(kept, lambda x: 'FAQ' || {FIELD} || {hashed_text('x.question')} || {RECORD} || 'P' || {FIELD} || {hashed_text('x.answer')} || {RECORD} || 'ENDFAQ' || {RECORD})")}) as content_hash,
         len(kept)::int as n_blocks, (len(ps) - len(kept))::int as half_pairs, dictionary_name || ':' || faq_key as source_ref,
         case when url is null then 'unusable_identity' when trim(title) = '' then 'empty title' when len(kept) = 0 then 'no content blocks' end as reason from c"""

IMAGE_RECORDS = rf"""
  with r as (select doc_id, {content_text("coalesce(content_type, '')")} as framework, {content_text("coalesce(lang, '')")} as summary, coalesce(text, '') as body from documents where source = 'image_descriptions'),
  p as (select *, list_filter(list_transform(list_transform(regexp_split_to_array(body, '\n[ \t]*\n\s*'), lambda x: trim(replace(x, chr(13), ''), ' ')), lambda x: {content_text('x')}), lambda x: x <> '') as ps from r)
  select 'https://www.certhaven.example/images/' || doc_id || '.png' as canonical_uri, framework as title,
         sha256('DOC' || {FIELD} || {hashed_text('framework')} || {RECORD} || case when framework <> '' then 'H' || {FIELD} || '2' || {FIELD} || {hashed_text('framework')} || {RECORD} else '' end
                || case when summary <> '' then 'P' || {FIELD} || {hashed_text('summary')} || {RECORD} else '' end
                || {_joined(f"list_transform(ps, lambda x: 'P' || {FIELD} || {hashed_text('x')} || {RECORD})")}) as content_hash,
         ((framework <> '')::int + (summary <> '')::int + len(ps))::int as n_blocks, 'images/' || doc_id || '.png' as source_ref,
         case when trim(framework) = '' then 'empty title' when framework = '' and summary = '' and len(ps) = 0 then 'no content blocks' end as reason from p"""

# --- snapshots ---------------------------------------------------------------------------

_FOLD = r"trim(regexp_replace(nfc_normalize({}), '[\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_CHANGES = f"""
  with good as (select run_id, lag(run_id) over o as earlier from runs where run_mode = 'sync' and run_status = 'succeeded' and inventory_complete
                window o as (partition by source_scope order by started_at, run_id)),
  latest as (select run_id, {PAGE_KEY} as page, record_id, title, lang, content_type, blocks from contract where run_id in (select run_id from good)
             qualify row_number() over (partition by run_id, page order by retrieved_at desc, record_id desc) = 1),
  nodes as (select l.record_id, t.fullkey, case when t.type in ('ARRAY', 'OBJECT') then t.type when t.type = 'VARCHAR' then 'S' || {_FOLD.format("json_extract_string(t.atom, '$')")} else t.atom::varchar end as node
            from latest l, json_tree(l.blocks) t),
  spelled as (select record_id, string_agg(fullkey || chr(31) || node, chr(30) order by fullkey) as spelling from nodes group by 1),
  pages as (select l.run_id, l.page, {_FOLD.format('l.title')} || chr(29) || coalesce({_FOLD.format('l.lang')}, chr(28)) || chr(29) || {_FOLD.format('l.content_type')} || chr(29) || s.spelling as content
            from latest l left join spelled s using (record_id)),
  pairs as (select run_id, earlier from good where earlier is not null),
  now as (select r.run_id as pair, p.page, p.content from pairs r join pages p on p.run_id = r.run_id),
  before as (select r.run_id as pair, p.page, p.content from pairs r join pages p on p.run_id = r.earlier),
  changes as (select coalesce(n.pair, b.pair) as run_id, coalesce(n.page, b.page) as canonical_uri,
                     case when b.page is null then 'added' when n.page is null then 'removed' else 'changed' end as change_type
              from now n full join before b on n.pair = b.pair and n.page = b.page where n.content is distinct from b.content)"""
P1_FOUND = _CHANGES + " select run_id, canonical_uri, change_type from changes"
P1_CHANGE_COUNTS = _CHANGES + """
  select p.run_id, any_value(r.changed) as recorded_changed, count(*) filter (where change_type = 'added') as true_added, count(*) filter (where change_type = 'removed') as true_removed,
         count(*) filter (where change_type = 'changed') as true_changed
  from pairs p join runs r using (run_id) left join changes c on c.run_id = p.run_id group by 1"""
