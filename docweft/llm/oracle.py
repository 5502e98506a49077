"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LIVE = "live as (select doc_pk, any_value(content) as content from maintenance_docs where deleted_at is null group by doc_pk)"
_TERMS = rf"""with {_LIVE},
n as (select count(*) as n_docs from live),
hits as (select doc_pk, unnest(regexp_extract_all(lower(content), '[가-힣]{{2,}}|[a-z][a-z0-9]+(?:[._-][a-z0-9]+)*')) as term from live),
counts as (select term, count(*) as occurrences, count(distinct doc_pk) as doc_freq from hits group by term),
marked as (select term, occurrences, doc_freq, n_docs,
  case when doc_freq < 3 then 'rare' when doc_freq > 0.35 * n_docs then 'common' end as mark from counts, n)
"""

_ITEMS = """select distinct 'maintenance_docs' as tbl, source as item_id from maintenance_docs where length(content) > 1200
union all select distinct 'chunks', chunk_id from chunks where length(body) > 1200"""

# Near-duplicates by comparing the shingles of all texts.
_LINKS = """with recursive rows_ as (select distinct 'maintenance_docs' as tbl, doc_pk as id, content from maintenance_docs union all select distinct 'maintenance_requests', idx, content from maintenance_requests),
n as materialized (select tbl, id, content, regexp_replace(lower(content), '[^0-9a-z가-힣]', '', 'g') as x from rows_ where length(regexp_replace(lower(content), '[^0-9a-z가-힣]', '', 'g')) >= 60),
c as materialized (select tbl, x, min(id) as rep from n group by tbl, x),
sh as materialized (select distinct tbl, rep, unnest([substring(x, i, 5) for i in range(1, length(x) - 3)]) as g from c),
sz as (select tbl, rep, count(*) as size from sh group by tbl, rep),
both_ as (select a.tbl, a.rep as a, b.rep as b, count(*) as k from sh a join sh b on a.tbl = b.tbl and a.g = b.g and a.rep < b.rep group by a.tbl, a.rep, b.rep),
links as materialized (select tbl, a, b from both_ join sz p using (tbl) join sz q using (tbl) where p.rep = a and q.rep = b and k >= 0.6 * (p.size + q.size - k)),
members as materialized (select tbl, id, rep, min(id) over (partition by tbl, content) as first from n join c using (tbl, x))
"""
_PAIRS = _LINKS + """select distinct tbl, least(i, j) as id_a, greatest(i, j) as id_b from (
  select l.tbl, p.id as i, q.id as j from links l join members p on p.tbl = l.tbl and p.rep = l.a join members q on q.tbl = l.tbl and q.rep = l.b where p.id = p.first or q.id = q.first
  union all select p.tbl, p.id, q.id from members p join members q on p.tbl = q.tbl and p.rep = q.rep and p.id <> q.id where p.id = p.first) where i <> j"""
_GROUPS = _LINKS + """, sides as (select tbl, a, b from links union all select tbl, b, a from links),
reach as (select tbl, rep, rep as g from c union select r.tbl, s.b, r.g from reach r join sides s on s.tbl = r.tbl and s.a = r.rep)
select tbl, id, rep as class_id, g as group_id from members join (select tbl, rep, min(g) as g from reach group by tbl, rep) using (tbl, rep)"""

# The statistics of texts. W are blanks and B line breaks, as classes of the regular expressions.
_W = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STATISTICS = rf"""with t as (select row_number() over () as i, doc_id, length(coalesce(text, '')) as n_chars, nfc_normalize(coalesce(text, '')) as x from documents),
words as (select i, w from (select i, unnest(string_split_regex(x, '[{_W}]+')) as w from t) where w <> ''),
by_word as (select i, count(*) as n_words, sum(length(w)) as solid, sum(length(regexp_replace(w, '[\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}]', '', 'g'))) as symbols,
  count(*) filter (regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}]+|[^\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}]+$', '', 'g') in (select lower(word) from common_words)) as hits from words group by i),
lines as (select i, trim(regexp_replace(unnest(string_split_regex(x, '\r\n|[\n\x0b\f\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')), '[{_W}]+', ' ', 'g'), ' ') as line from t),
by_line as (select i, count(*) as n_lines, count(distinct line) as lone, count(*) filter (regexp_matches(line, '[.!?。！？…:;]["''”’)\] ]*$')) as punctuated,
  count(*) filter (regexp_matches(line, '^(?:(?:[-*+•‣▪▫◦○●■□▶➤·–—※☐☑✓✔o]|\(?(?:[0-9]{{1,4}}|[\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}])[.)\]]|\[[^ ]?|\[[^ ]\]) |[\x{{2460}}-\x{{24ff}}\x{{3260}}-\x{{327f}}])')) as bullets
  from lines where line <> '' group by i)
select doc_id, n_chars, coalesce(n_lines, 0) as n_lines, coalesce(n_words, 0) as n_words, coalesce(solid / n_words, 0) as mean_word_length, coalesce(symbols / solid, 0) as symbol_ratio, coalesce(punctuated / n_lines, 0) as punctuation_line_share,
  coalesce(bullets / n_lines, 0) as bullet_line_share, coalesce(hits / n_words, 0) as common_word_share, coalesce(1 - lone / n_lines, 0) as repeated_line_share
from t left join by_word using (i) left join by_line using (i)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _TERMS + "select term, mark from marked where mark is not null",
        "p1_counts": _TERMS + "select term, occurrences, doc_freq, n_docs, mark from marked",
        "p2_found": _PAIRS,
        "p2_groups": _GROUPS,
        "p5_found": _ITEMS,
        "p5_joined": """select 'maintenance_docs' as tbl, source as item_id, md5(content) as text_md5, 0 as faults, true as counted, length(content) > 1200 as divided from (select distinct source, content from maintenance_docs where content is not null)
union all select 'chunks', chunk_id, md5(body), 0, true, length(body) > 1200 from chunks where body is not null""",
        "p6_round_trip": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
        "p7_coverage": "select doc_id, 0 as faults from documents where text <> '' union all select null, 0",
        "p8_statistics": _STATISTICS,
    }
