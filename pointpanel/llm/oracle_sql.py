"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, {WORDS} as w, string_split(text, chr(10)) as lines from d),
base as (select r, doc_id, text, w, lines,
  list_filter(lines, lambda x: length(trim(x, {TRIM})) > 0) as solid from w),
positions as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from base where len(w) > 8),
grams as (select r, i, string_agg(word, ' ') over (partition by r order by i rows between current row and 7 following) as g,
  count(*) over (partition by r order by i rows between current row and 7 following) as n from positions),
twice as (select r, i, count(*) over (partition by r, g) as c from grams where n = 8),
marked as (select p.r, p.i, max(case when t.c >= 2 then 1 else 0 end)
  over (partition by p.r order by p.i rows between 7 preceding and current row) as hit
  from positions p left join twice t on p.r = t.r and p.i = t.i),
repeats as (select r, sum(hit) as n from marked group by r),
lines as (select r, unnest(lines) as line, unnest(range(len(lines))) as k from base),
parts as (select r, k, line, trim(line, {TRIM}) as body from lines),
scored as (select r, k, line, body,
  len(regexp_split_to_array(body, '[\x20\x09-\x0D]+')) as words,
  len(regexp_split_to_array(body, '(^|[\x20\t])[|\x{{BB}}\x{{203A}}\x{{B7}}\x{{2022}}>]+([\x20\t]|$)')) - 1 as bars,
  len(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '([#*$%&]{{2,}}|!{{2,}})$'))) as decorated,
  length(regexp_replace(body, '[^A-Z]', '', 'g')) as capitals, length(regexp_replace(body, '[^a-z]', '', 'g')) as small
  from parts),
judged as (select r, k, line, body,
  body <> '' and (regexp_matches(body, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|skip to (main )?content|sign (in|up) (to|for|now)|log in to|subscribe to our|share on (facebook|twitter)|click here to|lorem ipsum|powered by )')
    or (bars * 5 >= words and bars >= 2) or decorated * 2 > words or (capitals > 4 * small and capitals >= 20)
    or (words < 3 and not regexp_matches(body, '[.!?:;,\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]["'')\]\x{{201D}}\x{{2019}}\x{{BB}}]*$'))) as fails
  from scored),
cleaned as (select r, count(*) filter (where fails) as n_failed_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) filter (where fails), 0) as lost_chars,
  coalesce(string_agg(line, chr(10) order by k) filter (where not fails), '') as cleaned from judged group by r),
counted as (select b.r, b.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(solid) - len(list_distinct(solid)))::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words,
  len(solid)::bigint as n_lines, c.n_failed_lines::bigint as n_failed_lines, c.lost_chars::bigint as lost_chars, c.cleaned
  from base b left join repeats p on b.r = p.r left join cleaned c on b.r = c.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * lost_chars <= 50 * word_chars as kept,
  n_lines, n_failed_lines, lost_chars, sha256(cleaned) as cleaned_sha256 from counted
"""

OP6 = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as k from d),
keyed as (select r, doc_id, k, line,
  translate(trim(line, {TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
frequent as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select keyed.*, coalesce(frequent.key is not null and doc_id <> keeper, false) as gone
  from keyed left join frequent on keyed.key = frequent.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id
"""

def _base32(h: str) -> str:
    digits = " || ".join(f"to_base(('0x' || substr({h}, {k}, 10))::bigint, 32, 8)" for k in range(1, 40, 10))
    return f"'sha1:' || translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


def _urn(h: str) -> str:
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


OP3 = rf"""
with p as (select row_number() over () as r, page_id, url, coalesce(html, '') as html from pages),
b as (select *, sha1(html) as ph, md5('response|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '')) as rh,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
  || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html as block from p),
t as (select *, {_base32("ph")} as pd, sha1(block) as bh, {_urn("rh")} as rid,
  regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', '', 'g'),
    '(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|article|section|nav|aside|main|header|footer|title|head|body|html|form|'
    || 'blockquote|pre|hr|option|select)\b[^>]*>', chr(10), 'g'),
    '<[^>]*>', '', 'g') as bare from b),
u as (select *, {_base32("bh")} as bd,
  replace(replace(replace(replace(replace(replace(replace(replace(replace(bare, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') as decoded from t),
v as (select *, trim(regexp_replace(regexp_replace(decoded, '[ \t\r\x0B\f\x{{A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
  ' ' || chr(10)) as txt from u),
w as (select *, sha1(txt) as th from v),
x as (select *, {_base32("th")} as td from w),
j as (select *, to_json({{
  'warc': list_sort(list_filter(['Content-Length: ' || strlen(block), 'Content-Type: application/http; msgtype=response',
    'WARC-Block-Digest: ' || bd, 'WARC-Date: 1970-01-01T00:00:00Z', 'WARC-Payload-Digest: ' || pd, 'WARC-Record-ID: ' || rid,
    'WARC-Target-URI: ' || url, 'WARC-Type: response'], lambda s: s is not null)),
  'status': 'HTTP/1.1 200 OK', 'http': ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)],
  'digests': {{'payload': pd, 'text': td}}, 'title': trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)),
  'links': regexp_extract_all(html, '(?i)href="([^"]*)"', 1)}})::varchar as meta from x),
made as (select page_id, url, rid, pd, 'metadata' as kind, 'application/json' as type, meta as block from j
  union all select page_id, url, rid, pd, 'conversion', 'text/plain; charset=utf-8', txt from j),
h as (select *, md5(kind || '|' || rid) as ih, sha1(block) as sh from made)
select page_id, kind as warc_type, {_urn("ih")} as warc_record_id, rid as warc_refers_to, url as warc_target_uri,
  '1970-01-01T00:00:00Z' as warc_date, pd as warc_payload_digest, {_base32("sh")} as warc_block_digest, type as content_type,
  strlen(block)::varchar as content_length, block from h
"""

OP12 = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
-- crc32 of the decimal digits, byte by byte and bit by bit
crc as (select conv_id, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
  lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, (v % 2) * 3988292384))) as c
  from (select distinct conv_id from t)),
h as (select conv_id, conv_id - conv_id % 5 as origin, xor(c, 4294967295) % 9 as h from crc),
held as (select conv_id, origin, h, least(h, coalesce((select count(*) from t where t.conv_id = h.origin), 0)) as k from h),
rebuilt as (select held.conv_id, k + pos - h as depth, role, text from held join t on t.conv_id = held.conv_id where pos > h
  union all select held.conv_id, pos, role, text from held join t on t.conv_id = origin where pos <= k),
marked as (select conv_id, depth, strlen(text) as size, md5(concat(length(role), ':', role, text)) as m from rebuilt),
prefixes as (select conv_id, depth, size, string_agg(m, '') over (partition by conv_id order by depth) as p from marked
  union all select conv_id, 0, 0, '' from h),
nodes as (select p, depth, min(size) as size, min(conv_id) as conv_id, count(*) as n from prefixes group by p, depth),
lengths as (select conv_id, max(depth) as len from prefixes group by conv_id),
ends as (select p, depth, string_agg(x.conv_id::varchar, ',' order by x.conv_id) as ids from prefixes x join lengths l on x.conv_id = l.conv_id and depth = len
  group by p, depth),
kids as (select left(p, length(p) - 32) as p, count(*) as c from nodes where depth > 0 group by 1),
below as (select v.p, sum((u.n - 1) * u.size) as saved, sum(case when kids.c is null then 1 else 0 end) as leaves
  from nodes v join nodes u on starts_with(u.p, v.p) left join kids on kids.p = u.p group by v.p)
select v.conv_id, v.depth::bigint as depth, up.conv_id as parent_conv_id, v.n as n_convs, coalesce(kids.c, 0) as n_children,
  below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, sha256(coalesce(ends.ids, '')) as ends_sha256
from nodes v left join nodes up on v.depth > 0 and up.p = left(v.p, length(v.p) - 32) left join kids on kids.p = v.p
join below on below.p = v.p left join ends on ends.p = v.p
"""

OP13 = """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding::double[] as v from embeddings),
p as (select id, label, list_transform(v, lambda x: floor(256 * x)) as v from e
  where id is not null and label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, a.label as own, b.id, b.label, list_dot_product(a.v, b.v)::bigint as score from p a join p b on a.id <> b.id where a.id % 100 = 0),
near as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from s where label = own) where k <= 5),
hard as (select near.anchor_id, near.id as positive_id, s.id as negative_id, near.score as positive_score, s.score as negative_score,
  row_number() over (partition by near.anchor_id, near.id order by s.score desc, s.id) as rank
  from near join s on s.anchor_id = near.anchor_id and s.label <> s.own and 80 * near.score <= 100 * s.score and s.score <= near.score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from hard where rank <= 5
"""

ORACLES = {"op3_warc_derivatives": OP3, "op4_line_first": OP4, "op6_line_dedup": OP6, "op12_prefix_trie": OP12, "op13_tree_negatives": OP13}
