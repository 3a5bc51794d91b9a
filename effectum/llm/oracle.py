"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import line_dedup, quality

_TRIM = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"


def _site_lines(pages: str, columns: str) -> str:
    """The lines of ``pages``, a query that gives ``columns``, host and text; each row is a page."""
    share = round(line_dedup.RATIO * 1_000_000)
    return f"""
with pages_ as (select row_number() over () as row, * from ({pages})),
lines as (
    select row, host, i, trim(line, {_TRIM}) as bare, line
    from (select row, host, string_split(text, chr(10)) as l from pages_ where text is not null), unnest(l) with ordinality as u(line, i)),
totals as (select host, count(*) as pages from pages_ group by host),
often as (
    select n.host, bare
    from (select host, bare, count(distinct row) as n from lines where bare <> '' group by host, bare) n join totals t on n.host is not distinct from t.host
    where n >= {line_dedup.MIN_HOLDING} and n * 1000000 > {share} * pages),
kept as (
    select l.row, string_agg(l.line, chr(10) order by l.i) filter (where o.bare is null) as text, count(*) as n_lines, count(o.bare) as n_dropped
    from lines l left join often o on l.bare = o.bare and l.host is not distinct from o.host
    group by l.row)
select {columns}, case when d.text is null then null else coalesce(k.text, '') end as text, cast(coalesce(k.n_lines, 0) as bigint) as n_lines, cast(coalesce(k.n_dropped, 0) as bigint) as n_dropped
from pages_ d left join kept k on d.row = k.row"""


def site_lines_sql() -> str:
    return _site_lines("select doc_id, source as host, text from documents", "doc_id")


def page_lines_sql() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.SCRIPTS}', '', 'g'), '{line_dedup.BLOCKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g'), '[\\n\\r]+', chr(10), 'g')"
    host = f"nullif(lower(regexp_extract(url, '{line_dedup.HOST}', 1)), '')"
    return _site_lines(f"select page_id, {host} as host, {text} as text from pages", "page_id, host")


def quality_sql() -> str:
    blank, at, p = r"[^\x20\x09-\x0D]+", quality.path(), quality.MAX_REJECTED
    cases = ["case " + " ".join(f"when 1000 * {rule} > {c} * {per} then {at[rule, i]}" for i, c in enumerate(cuts)) + f" else {quality.STEPS} end" for rule, (per, cuts) in quality.RULES.items()]
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as text from documents),
base as (
    select doc_id, lang as stratum, regexp_extract_all(text, '{blank}') as words,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, length(text) - length(replace(text, '!', '')) as n_marks,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) as lines
    from d),
win as (select doc_id, i, array_to_string(words[i : i + {quality.WINDOW - 1}], ' ') as w from (select doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) as i from base)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(0, {quality.WINDOW}) as r(k) group by doc_id),
m as (
    select b.doc_id, stratum, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars, n_symbols, n_marks,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
    from base b left join covered c on b.doc_id = c.doc_id),
mm as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, least({", ".join(cases)}) as first from m),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
once as (select doc_id, min(stratum) as stratum, min(first) as first from mm where not base_failed and doc_id in (select doc_id from good) group by doc_id),
tests as (select stratum, i, count(*) as n, count(*) filter (where first <= i) as k from once, range(0, {quality.STEPS}) as r(i) group by all),
tails as (
    select *, case when k > n * {p} then 1.0 else (
        select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}::double) + (n - j) * ln(1 - {p}::double))) from (select unnest(range(0, k + 1)) as j)) end as tail
    from tests),
cuts as (
    select stratum, coalesce(min(case when tail > {quality.ERROR!r} / (select count(distinct coalesce('x' || stratum, '')) from once) then i end), {quality.STEPS}) - 1 as step
    from tails group by stratum)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
    cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and first > coalesce(c.step, -1) as kept
from mm left join cuts c on mm.stratum is not distinct from c.stratum"""
