"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidelog.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES, _needed, _template_words

LINE_DEDUP = """
with rows as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) lines from documents),
windows as (select doc_id, p, lines[p + 1] a, lines[p + 2] b, lines[p + 3] c
            from (select doc_id, lines, unnest(range(0, len(lines) - 2)) p from rows where doc_id is not null and len(lines) >= 3)),
kept as (select * from windows where trim(a, ' ') <> '' or trim(b, ' ') <> '' or trim(c, ' ') <> ''),
firsts as (select a, b, c, min((doc_id, p)) first from kept group by a, b, c having count(*) > 1),
covered as (select doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) gone
            from kept join firsts using (a, b, c) where (doc_id, p) > first group by doc_id)
select r.doc_id,
       case when gone is null then text
            else array_to_string([lines[i] for i in range(1, len(lines) + 1) if not list_contains(gone, i - 1)], chr(10)) end as text,
       cast(len(lines) as integer) as n_lines, cast(coalesce(len(gone), 0) as integer) as n_removed
from rows r left join covered using (doc_id)
"""

EXACT_DEDUP = r"""
with rows as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') normal from documents),
ranked as (select *, first_value(doc_id) over (partition by normal order by n desc, doc_id) keep_id, count(*) over (partition by normal) group_size from rows)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(normal) as text_sha256 from ranked
"""


def _license_scan() -> str:
    letters = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"list_filter(regexp_split_to_array(" + letters + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', {_template_words(t)}, {_needed(len(_template_words(t)), CONTAINMENT)})" for k, (t, label) in enumerate(TEMPLATES.items()))
    return f"""
with rows as (select doc_id, coalesce(text, '') text from documents),
w as (select doc_id, text, {words.format("text")} ws from rows),
phrases(phrase, label, n) as (values {phrases}),
places as (select doc_id, label, s from (select doc_id, ws, label, phrase, n, unnest(range(0, len(ws) - n + 1)) s from w, phrases
             where contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' '))
           where array_to_string(ws[s + 1 : s + n], ' ') = phrase),
base as (select doc_id, count(*) n_base, min(s) first_word, max(s) last_word, list_sort(list_distinct(list(label))) labels from places group by doc_id),
lines as (select doc_id, {words.format("line")} ls from (select doc_id, unnest(string_split(text, chr(10))) line from rows)),
templates(k, label, ts, need) as (values {templates}),
hits as (select doc_id, list_distinct(list(label)) labels, max(c) best from
         (select doc_id, label, len(list_intersect(list_distinct(ls), ts)) / len(ts) c from lines, templates where len(list_intersect(list_distinct(ls), ts)) >= need)
         group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, hits.labels))), ','), '') as labels,
       case when n_base > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from w left join base using (doc_id) left join hits using (doc_id)
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = r"""(select id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
             else [array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)] end) s
      from (select {key} id, list_filter(regexp_split_to_array({folded}, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from {table}))"""

DECONTAMINATION = f"""
with d as (select distinct id, s from {_SHINGLES.format(key="doc_id", table="documents", folded=_FOLDED)}),
b as (select distinct id, s from {_SHINGLES.format(key="item_id", table="benchmark", folded=_FOLDED)}),
n as (select id, count(*) n from b group by id)
select d.id as doc_id, b.id as item_id, any_value(n) as n_item, count(*) as n_shared, count(*) / any_value(n)::double as containment
from d join b on d.s = b.s join n on n.id = b.id group by d.id, b.id having 100 * count(*) >= 75 * any_value(n)
"""

WARC = """
with rows as (select page_id, coalesce(html, '') html from pages),
named as (select *, max(page_id) over (partition by html) last from rows)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {digest} as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from named
"""


def _base32_sha1() -> str:
    """Base32 of the SHA-1 of html: five bits at a time of its 160."""
    bits = "(select string_agg(lpad(bin(('0x' || substr(sha1(html), k, 2))::int), 8, '0'), '' order by k) from (select unnest(range(1, 41, 2)) k))"
    return f"(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(b, k, 5))::int + 1, 1), '' order by k) from (select {bits} b), (select unnest(range(1, 161, 5)) k))"


ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_license_scan": _license_scan(),
    "op9_decontamination": DECONTAMINATION,
    "op10_warc": WARC.format(digest=_base32_sha1()),
}
