"""ANSI SQL for the queries of the catalogue, as DuckDB runs it on the same tables.

Written apart from the operators; what they share are patterns and fixed values.
"""

from __future__ import annotations

from paperloom.functions import lexicon as L
from paperloom.functions.text import BULLET, DIGIT, METRIC, NOT_WORD, WS, WS_IN, bounded
from paperloom.operators import entities, sections
from paperloom.sources.files import URL


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+' + chr(92) + 'z')}, '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {trim('l')}), lambda l: l <> '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def bare(x: str) -> str:
    """A line without its bullet."""
    pattern = "^[\\x{2022}\\-*" + WS_IN + "]+"
    return trim(f"regexp_replace({x}, {q(pattern)}, '')")


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


_CLEAN = f"""clean as (
    select doc_id, {trim("array_to_string(list_transform(string_split(t, chr(10)), lambda l: " + trim("l") + "), chr(10))")} as text, is_scanned from (
        select doc_id, validation_info.is_scanned as is_scanned, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(coalesce(raw_text, ''), chr(173), ''), '–', '-'), '—', '-'),
            '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\r\\n|[\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') as t
        from parsed_resumes))"""

_EXTRACTED = f"""extracted as (
    select doc_id, {trim("regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")} as text from (
        select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_text, ''), '([\\p{{L}}\\p{{N}}_]+)-{WS}*\\n{WS}*([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g'),
            '\\r\\n?', chr(10), 'g'), '[\\x{{2022}}\\x{{25aa}}\\x{{2023}}\\x{{2043}}\\x{{25cf}}\\x{{2219}}]', '-', 'g'), '[\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g') as t
        from parsed_resumes))"""


def _exploded(source: str) -> str:
    return f"select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {source}"


def _upper(x: str) -> str:
    return f"upper(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'))"


_CASE_A = "case " + " ".join(f"when {has('u', sections.heading_pattern(h))} then '{s}'" for s, h in L.SECTIONS.items()) + " end"
_APPENDED = f"""appended as (
    select doc_id, section, {trim("string_agg(line, chr(10) order by pos)")} as section_text from (
        select *, coalesce(last_value(heading ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), 'HEADER') as section
        from (select *, {_CASE_A} as heading from (select *, {_upper(trim("line"))} as u from ({_exploded("clean")}))))
    where heading is null group by doc_id, section having {trim("string_agg(line, chr(10) order by pos)")} <> '')"""

_CASE_B = "case " + " ".join(f"when {has('line', sections.secondary_pattern(s))} then '{s}'" for s in L.HEADINGS) + " end"
_OVERWRITTEN = f"""overwritten as (
    with a as (select *, {_CASE_B} as heading from ({_exploded("extracted")})),
    b as (select *, heading is null and {has("line", sections.ANY_HEADING_PATTERN)} as closes from a),
    c as (select *, sum(case when heading is not null or closes then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and current row) as run from b),
    d as (select doc_id, run, max(heading) as section, bool_or(closes) as closing, count(*) filter (heading is null and not closes) as n,
            coalesce(string_agg(line, chr(10) order by pos) filter (heading is null and not closes), '') as body from c group by doc_id, run),
    e as (select *, coalesce(lead(closing) over (partition by doc_id order by run), false) as closed from d)
    select doc_id, section, {trim("arg_max(body, run)")} as section_text from e where section is not null and (n > 0 or closed) group by doc_id, section)"""

_HEADS = sections.heading_pattern([h for hs in L.SECTIONS.values() for h in hs], ends=False)
_SUMMARY = f"""told as (
    select doc_id, nullif({trim("array_to_string(list_filter([first], lambda x: x <> '') || case when stop > 0 then rest[1:stop - 1] else rest end, ' ')")}, '') as inline_summary from (
        select *, {trim(f"regexp_replace(own[place], {q(sections.INLINE_SUMMARY_PATTERN)}, '')")} as first, coalesce(list_position(list_transform(rest, lambda x: {has(_upper("x"), _HEADS)}), true), 0) as stop from (
            select *, own[place + 1:] as rest from (
                select doc_id, own, list_position(list_transform(own, lambda x: {has("x", sections.INLINE_SUMMARY_PATTERN)}), true) as place from (select doc_id, {lines("text")} as own from clean)) where place > 0)))"""


def _terms(terms: list[str], x: str) -> str:
    """Sorted terms that stand in the lowered text, each searched by its own pattern."""
    tests = ", ".join(f"case when {has(x, bounded(t))} then {q(t)} end" for t in terms)
    return f"list_filter([{tests}], lambda k: k is not null)"


_KEYWORDS = f"(select distinct {trim('lower(keyword)')} as keyword from keywords where {trim('lower(keyword)')} <> '')"
#: Keywords of the table are searched by tokens where they are one word, by position otherwise.
_KEYWORD_HITS = f"""hits as (
    with low as (select doc_id, lower(text) as t from clean where text <> ''),
    tokens as (select distinct doc_id, unnest(regexp_split_to_array(t, {q(NOT_WORD + '+')})) as token from low),
    kw as {_KEYWORDS}
    select doc_id, keyword from tokens join kw on token = keyword where {has("keyword", "^[a-z0-9_]+$")}
    union
    select doc_id, keyword from low, kw where not {has("keyword", "^[a-z0-9_]+$")} and contains(t, keyword)
        and regexp_matches(t, (case when {has("keyword", "^[a-z0-9_]")} then {q(f"(?:^|{NOT_WORD})")} else {q(NOT_WORD.replace("^", ""))} end)
            || regexp_replace(keyword, '([^a-z0-9_ ])', '\\\\\\1', 'g') || (case when {has("keyword", "[a-z0-9_]$")} then {q(f"(?:{chr(92)}z|{NOT_WORD})")} else {q(NOT_WORD.replace("^", ""))} end)))"""

_OPENS = f"not {has('x', '^[' + chr(92) + 'x{2022}' + chr(92) + '-*]')} and (case when {has('x', entities.DATED)} then length(x) < 50 else length({bare('x')}) < 80 and {bare('x')} not like '%.' end)"
_TIDY = "regexp_replace(l, " + q(WS + "+") + ", ' ', 'g')"
_SCORED = f"""base as (
    select c.doc_id, c.text, coalesce(c.is_scanned, false) as is_scanned, {lines("c.text")} as own, nullif(regexp_extract(c.text, {q(entities.EMAIL)}), '') is not null as email_present,
        nullif(regexp_extract(c.text, {q(entities.PHONE)}), '') is not null as phone_present, {has("c.text", entities.LINKEDIN)} as linkedin_present, {has("c.text", entities.GITHUB)} as github_present,
        coalesce(len(list_filter(list_transform({lines("x.section_text")}, lambda l: {trim(_TIDY)}), lambda x: {_OPENS})) > 0, false) as work_experience_present,
        coalesce(len(list_filter({lines("e.section_text")}, lambda x: {has("x", entities.DEGREE)} and not {has("lower(x)", "|".join(entities.COURSES))})) > 0, false) as education_present,
        len({_terms(L.SKILLS, "lower(c.text)")}) > 0 as skills_present, len({words("c.text")}) as word_count, coalesce(h.n, 0) as match_count
    from clean c left join (select * from appended where section = 'experience') x using (doc_id) left join (select * from appended where section = 'education') e using (doc_id)
        left join (select doc_id, count(*) as n from hits group by doc_id) h using (doc_id)),
counted as (
    select *, len(list_filter(regexp_split_to_array(text, '\\n{WS}*\\n'), lambda b: {trim("b")} <> '')) as block_count, len(list_filter(own, lambda l: {has("l", BULLET)})) as bullet_count, len(own) as total_content_lines,
        len(list_filter(own, lambda l: length(l) > 200)) as long_line_count, case when len(own) > 0 then list_sum(list_transform(own, lambda l: length(l)))::double / len(own) else 0.0 end as avg_line_length,
        len(list_filter(own, lambda l: {has("l", METRIC)})) as metric_hits,
        len(list_filter(own, lambda l: lower(trim(regexp_split_to_array({trim(f"regexp_replace(l, {q(BULLET)}, '')")}, {q(WS + "+")})[1], '.,;:!()')) in ({", ".join(map(q, L.ACTION_VERBS))}))) as verb_hits,
        case when text = '' then 0 else (select count(*) from {_KEYWORDS}) end as total_keywords, (select count(*) from {_KEYWORDS}) as all_keywords
    from base),
ratios as (
    select *, least(1.0::double, block_count::double / 5) as block_ratio, least(1.0::double, (case when total_content_lines > 0 then bullet_count::double / total_content_lines else 0 end) / 0.30::double) as bullet_ratio,
        case when total_content_lines > 0 then long_line_count::double / total_content_lines else 0.0::double end as long_line_ratio, match_count::double / greatest(all_keywords, 1) as coverage_ratio,
        case when total_content_lines = 0 then 0.0::double when avg_line_length between 20 and 100 then 1.0::double
            else greatest(0.0::double, 1 - abs(avg_line_length - (case when avg_line_length < 20 then 20.0::double else 100.0::double end)) / (case when avg_line_length < 20 then 20.0::double else 100.0::double end)) end as length_ratio,
        least(1.0::double, (case when total_content_lines > 0 then metric_hits::double / total_content_lines else 0 end) / 0.30::double) as metric_ratio,
        least(1.0::double, (case when total_content_lines > 0 then verb_hits::double / total_content_lines else 0 end) / 0.40::double) as verb_ratio
    from counted),
ratios2 as (select *, case when total_content_lines = 0 then 0.0::double else greatest(0.0::double, 1 - long_line_ratio / 0.15::double) end as long_line_score_ratio from ratios),
parts as (
    select *, 2 * email_present::int + 2 * phone_present::int + (linkedin_present or github_present)::int as contact,
        round_even(5 * ((work_experience_present::int + education_present::int + skills_present::int) / 3.0::double), 0)::int as sections,
        2 * (not is_scanned)::int + (case when word_count >= 100 then 2 when word_count >= 30 then 1 else 0 end) + (word_count >= 50)::int as parsing,
        round_even(8.0::double * length_ratio + 7.0::double * long_line_score_ratio, 0)::int as formatting, round_even(25 * least(1.0::double, match_count::double / 15), 0)::int as keywords,
        round_even(12.0::double * block_ratio + 8.0::double * bullet_ratio, 0)::int as structure, round_even(15.0::double * metric_ratio + 10.0::double * verb_ratio, 0)::int as achievements
    from ratios2),
scored as (
    select *, least(15, contact + sections + parsing) as ats_compatibility, formatting + keywords + structure + achievements + least(15, contact + sections + parsing) as score,
        (select name from (values (0, 'formatting', formatting / 15.0::double, formatting, 15), (1, 'keywords', keywords / 25.0::double, keywords, 25), (2, 'structure', structure / 20.0::double, structure, 20),
            (3, 'achievements', achievements / 25.0::double, achievements, 25), (4, 'ats_compatibility', least(15, contact + sections + parsing) / 15.0::double, 0, 15)) v(i, name, share, got, most) order by share, i limit 1) as weakest
    from parts)"""
_SCORE_WITH = f"with {_CLEAN}, {_APPENDED}, {_KEYWORD_HITS}, {_SCORED}"

_AUDITS = "(select * from (select *, row_number() over (partition by audit_id) as rn from audits) where rn = 1)"
_JSON = f"""cleaned_json as (
    select audit_id, resume_text, {trim(f"regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(p, '(?s){chr(92)}{{.*{chr(92)}}}'), ''), p), '[{chr(92)}r{chr(92)}n{chr(92)}t]+', ' ', 'g'), ',{WS}*([{chr(92)}]}}])', '{chr(92)}1', 'g')")} as payload
    from (select audit_id, resume_text, regexp_replace(regexp_replace(payload, '(?i)```json{WS}*', '', 'g'), '```{WS}*\\z', '') as p from {_AUDITS} where payload is not null)),
objects as (
    select audit_id, resume_text, case when json_type(j, '$.analysis') = 'OBJECT' then json_extract(j, '$.analysis') else j end as v from (select *, try_cast(payload as json) as j from cleaned_json where json_valid(payload)) where json_type(j) = 'OBJECT')"""


def _get(path: str) -> str:
    return f"json_extract_string(v, '$.{path}')"


_PAGES = """pages as (
    select l_orderkey as doc_id, l_linenumber % 2 as page_no, max((l_partkey % 7) * 20) >= 120 as ruled, count(*) filter (l_linestatus = 'O') as dots,
        list_sort(list({'x0': ((l_partkey % 7) * 20)::double, 'y0': ((l_suppkey % 11) * 30)::double, 'y1': ((l_suppkey % 11) * 30 + 24)::double}) filter (l_quantity >= 4)) as blocks
    from lineitem group by 1, 2),
blocks as (select doc_id, page_no, unnest(blocks) as b, generate_subscripts(blocks, 1) as i, len(blocks) as n from pages where blocks is not null),
marks as (
    with recursive walk as (
        select doc_id, page_no, 1 as i, b.x0 as anchor, 1 as cluster, b.y0 as y0, b.y1 as y1 from blocks where i = 1
        union all
        select n.doc_id, n.page_no, n.i, case when n.b.x0 - w.anchor <= 25 then w.anchor else n.b.x0 end, case when n.b.x0 - w.anchor <= 25 then w.cluster else w.cluster + 1 end, n.b.y0, n.b.y1
        from walk w join blocks n on n.doc_id = w.doc_id and n.page_no = w.page_no and n.i = w.i + 1)
    select * from walk),
clusters as (select doc_id, page_no, cluster, count(*) as n, max(y1) - min(y0) as height from marks group by 1, 2, 3),
page_columns as (select p.doc_id, p.page_no, p.ruled, p.dots, count(c.cluster) as clusters, count(*) filter (c.n >= 3 and c.height / 400.0 >= 0.25) as tall from pages p left join clusters c using (doc_id, page_no) group by 1, 2, 3, 4)"""

_BOUNDS = " or ".join(f"not coalesce({k} between 0 and {m}, false)" for k, m in L.MAXIMA.items())
_TOTAL = " + ".join(f"coalesce({k}, 0)" for k in L.MAXIMA)
_SECONDARY = ", ".join(f"{has('text', sections.secondary_pattern(n).replace('(?i)^', '(?i)(?:' + chr(92) + 'A|' + chr(92) + 'n)', 1))} as {q(n).replace(chr(39), chr(34))}" for n in ("certifications", "languages", "awards", "publications", "interests", "references"))
_PRIMARY = ", ".join(f"{has('text', f'(?i)(?:^|{NOT_WORD})(?:' + '|'.join(t) + f')(?:{chr(92)}z|{NOT_WORD})')} as {n}" for n, t in L.PRIMARY.items())
_CONTACT = rf"[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.[\p{{L}}\p{{N}}_]+|\+?\p{{Nd}}[\p{{Nd}} \-]{{8,}}\p{{Nd}}"
_KEYWORD_KEY = trim("lower(keyword)")
_RED = "(select doc_id, count(*) filter (score is null or score < 40) as n from (select distinct * from scores) where doc_id is not null group by 1)"
_PARTS, _CATEGORIES = "$.explainable_scorecard.ats_score.breakdown", "$.explainable_scorecard.ats_score.explanation.categories"
_EDGE = r"[^\p{L}\p{N}_.+#]"
def _caps(more: str = "", joins: str = "") -> str:
    """Capped scores; ``more`` red flags come from what ``joins`` brings."""
    return f"""with {_JSON}, x as (select audit_id, coalesce(upper(trim({_get("eligibility_check.status")})) = 'FAILED', false) as failed, {" + ".join(f"coalesce(try_cast({_get(f'explainable_scorecard.ats_score.breakdown.{k}')} as int), 0)" for k in L.MAXIMA)} as total,
            try_cast({_get("explainable_scorecard.overall_hiring_score.score")} as int) as s, {_get("explainable_scorecard.overall_hiring_score.interview_probability")} as p,
            len(list_filter(coalesce(json_extract_string(v, '$.recruiter_evidence_matrix[*].status'), []), lambda t: lower(trim(t)) in ('not found', 'limited'))) {more} >= 3 as many from objects{joins}),
        y as (select *, case when failed then 30 when many then 75 end as cap, case when failed then 5 when many then 50 end as chance, list_transform(regexp_extract_all(coalesce(p, ''), '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'), lambda n: n::double) as ns from x)
        select audit_id, greatest(0, least(100, total))::bigint as ats_score, (case when cap is not null then coalesce(least(s, cap), cap) else s end)::bigint as overall_score, case when chance is not null and (len(ns) = 0 or list_max(ns) > chance) then '<= ' || chance || '%' else p end as interview_probability from y"""


_MAGIC = "'\\xD0\\xCF\\x11\\xE0\\xA1\\xB1\\x1A\\xE1'::blob"

_FILES = f"""select upload_id, ext, size_mb, n_bytes, case when ext not in ('pdf', 'docx', 'txt') then 'UNSUPPORTED_FORMAT' when size_mb > 10 then 'FILE_TOO_LARGE' when n = 0 then 'EMPTY_FILE'
            when ext = 'docx' and coalesce(h[1:8] = {_MAGIC}, false) then 'ENCRYPTED' when ext = 'docx' and not coalesce(h[1:2] = 'PK'::blob, false) then 'CORRUPTED'
            when ext = 'pdf' and not coalesce(h[1:4] = '%PDF'::blob, false) then 'CORRUPTED' when ext = 'pdf' and contains(hex(h), hex('/Encrypt'::blob)) then 'ENCRYPTED'
            when ext = 'txt' and (select contains(hx, '00') or cn::double / greatest(len(hx), 1) > 0.05 from (select list_transform(range(octet_length(h)), lambda i: substr(hex(h), 2 * i + 1, 2)) as hx) cross join lateral (select len(list_filter(hx, lambda b: b < '20' and b not in ('09', '0A', '0D') or b = '7F')) as cn)) then 'CORRUPTED'
            else 'OK' end as error_code, n::double / 1048576.0 > 10 as over_strict_limit
        from (select upload_id, lower(regexp_extract(coalesce(path, ''), '(?s)\\.([^.]*)\\z', 1)) as ext, round(coalesce(n_bytes, 0)::double / 1048576.0, 2) as size_mb, coalesce(n_bytes, 0) as n, n_bytes, head_bytes as h
            from (select *, row_number() over (partition by upload_id) as rn from uploads) where rn = 1)"""

ORACLES: dict[str, str] = {
    "content_lines": f"select doc_id, len({lines('t')}) as line_count, len({words('t')}) as word_count, len(list_filter(regexp_split_to_array(t, '\\n{WS}*\\n'), lambda b: {trim('b')} <> '')) as block_count from (select doc_id, coalesce(raw_text, '') as t from parsed_resumes)",
    "clean_text": f"with {_CLEAN} select doc_id, text from clean",
    "dehyphenate_clean": f"with {_EXTRACTED} select doc_id, text from extracted",
    "corrupted_text": "select doc_id, coalesce(length(text) > 0 and (length(text) - length(regexp_replace(text, '[\\x{1}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}]', '', 'g')))::double / length(text) > 0.05, false) as corrupted from documents",
    "strip_bullets": f"""with {_CLEAN}, x as (select doc_id, unnest({lines('text')}) as l, generate_subscripts({lines('text')}, 1) - 1 as pos from clean), y as (select doc_id, pos, {trim(f"regexp_replace(l, {q(BULLET)}, '')")} as line from x)
        select doc_id, pos, line, lower(trim(regexp_split_to_array(line, {q(WS + '+')})[1], '.,;:!()')) in ({", ".join(map(q, L.ACTION_VERBS))}) as verb from y""",
    "file_validation": f"select upload_id, ext, size_mb, error_code, over_strict_limit from ({_FILES})",
    "uploads_checked": f"select error_code, count(*) as n, sum(n_bytes)::bigint as bytes from ({_FILES}) group by 1",
    "content_validation": f"""select doc_id, case when coalesce(validation_info.is_scanned, false) then 'SCANNED_DOCUMENT_DETECTED' when {trim("coalesce(raw_text, '')")} = '' or w = 0 then 'EMPTY_DOCUMENT' when w < 15 then 'INSUFFICIENT_CONTENT' else 'OK' end as error_code,
        w as word_count, w >= 30 as audit_ready from (select *, coalesce(quality_info.word_count, len({words("coalesce(raw_text, '')")}))::bigint as w from parsed_resumes)""",
    "contacts": f"""with {_CLEAN} select doc_id, nullif(regexp_extract(text, {q(entities.EMAIL)}), '') as email, nullif({trim(f"regexp_extract(text, {q(entities.PHONE)})")}, '') as phone,
        nullif(regexp_extract(text, {q(entities.LINKEDIN)}), '') as linkedin, nullif(regexp_extract(text, {q(entities.GITHUB)}), '') as github from clean""",
    "names": f"""with {_CLEAN} select doc_id, list_filter(list_transform(list_filter({lines('text')}[1:3], lambda x: not {has('x', '@|' + DIGIT)} and len({words('x')}) <= 4), lambda x: {trim(f"regexp_replace(x, {q(f'[^a-zA-Z{WS_IN}.]')}, '', 'g')")}), lambda x: x <> '')[1] as name from clean""",
    "skills": f"with {_CLEAN} select doc_id, unnest({_terms(L.SKILLS, 'lower(text)')}) as skill from clean",
    "links": f"""with x as (select doc_id, u, min(i) as i from (select doc_id, unnest(f) as u, generate_subscripts(f, 1) as i from (select doc_id, regexp_extract_all(coalesce(raw_text, '') || ' ' || coalesce(array_to_string(list_filter(list_transform(publications, lambda p: p.url), lambda u: u is not null), ' '), ''), {q(URL)}, 1) as f from parsed_resumes)) group by doc_id, u)
        select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, u as url from x""",
    "sections_append": f"with {_CLEAN}, {_APPENDED} select doc_id, section, section_text from appended",
    "sections_overwrite": f"with {_EXTRACTED}, {_OVERWRITTEN} select doc_id, section, section_text from overwritten",
    "summary": f"with {_CLEAN}, {_APPENDED}, {_SUMMARY} select c.doc_id, coalesce(a.section_text, t.inline_summary) as summary from clean c left join (select * from appended where section = 'summary') a using (doc_id) left join told t using (doc_id)",
    "completeness_flags": f"with {_EXTRACTED} select doc_id, {has('text', _CONTACT)} as contact_info, {_PRIMARY}, {_SECONDARY} from extracted",
    "structured_items": f"""with {_EXTRACTED}, {_OVERWRITTEN}, x as (select doc_id, section as list_name, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select *, list_filter(string_split(section_text, chr(10)), lambda l: {trim("trim(l, '- ')")} <> '') as ls from overwritten where section <> 'summary'))
        select doc_id, list_name, pos, case when list_name = 'languages' then {trim("trim(string_split(line, '-')[1], '- ')")} else {trim("trim(line, '- ')")} end as item, case when list_name = 'languages' and contains(line, '-') then {trim("string_split(line, '-')[2]")} end as proficiency from x""",
    "resume_heuristic": f"""with {_EXTRACTED}, x as (select doc_id, text, {words('text')} as w from extracted), y as (select doc_id, len(w) as word_count, length(text) as char_count, len(list_filter(w, lambda k: lower(k) in ({", ".join(map(q, L.RESUME_WORDS))}))) as section_words from x),
        z as (select *, case when word_count > 30 then least(round(section_words / 4.0::double, 2), 1.0::double) else 0.1::double end as confidence_score from y)
        select *, confidence_score >= 0.4 and word_count >= 50 as is_resume, word_count >= 50 as long_enough, confidence_score >= 0.6 as dense_headings from z""",
    "projects": f"""with {_CLEAN}, {_APPENDED}, a as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, list_filter(list_transform({lines("section_text")}, lambda l: {bare("l")}), lambda l: l <> '') as ls from appended where section = 'projects')),
        b as (select *, regexp_extract(line, {q(f"(?s)^(.*?)(?:{entities.PROJECT_SPLIT})(.*)" + chr(92) + "z")}, ['head', 'tail']) as p, {has("line", entities.PROJECT_SPLIT)} as opens from a),
        c as (select *, sum(case when opens or pos = 0 then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and current row) as project_no from b)
        select doc_id, project_no::bigint as project_no, max(case when opens then {trim("p.head")} when pos = 0 then line end) as project_name, {trim("string_agg(case when opens then " + trim("p.tail") + " when pos = 0 then '' else line end, ' ' order by pos)")} as description from c group by doc_id, project_no""",
    "certification_lines": f"with {_CLEAN}, {_APPENDED} select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, list_filter(list_transform({lines('section_text')}, lambda l: {bare('l')}), lambda l: l <> '') as ls from appended where section = 'certifications')",
    "skill_matches": f"with {_CLEAN}, {_KEYWORD_HITS} select doc_id, keyword from hits",
    "ats_score": f"{_SCORE_WITH} select doc_id, score::bigint as score, formatting::bigint as formatting, keywords::bigint as keywords, structure::bigint as structure, achievements::bigint as achievements, ats_compatibility::bigint as ats_compatibility, contact::bigint as contact, sections::bigint as sections, parsing::bigint as parsing, weakest from scored",
    "ats_evidence": f"""{_SCORE_WITH} select doc_id, block_count, bullet_count, total_content_lines, long_line_count, match_count, total_keywords, metric_hits, verb_hits, word_count, avg_line_length, long_line_ratio, length_ratio, long_line_score_ratio, block_ratio, bullet_ratio, metric_ratio, verb_ratio, coverage_ratio,
        email_present, phone_present, linkedin_present, github_present, work_experience_present, education_present, skills_present from scored""",
    "ats_reason": f"{_SCORE_WITH} select doc_id, format('Weakest category: {{}}, {{}} of {{}} points.', replace(weakest, '_', ' '), case weakest when 'formatting' then formatting when 'keywords' then keywords when 'structure' then structure when 'achievements' then achievements else ats_compatibility end, case weakest when 'formatting' then 15 when 'keywords' then 25 when 'structure' then 20 when 'achievements' then 25 else 15 end) as reason from scored",
    "score_check": f"select score_id, total, out_of_bounds, differs from (select score_id, ({_TOTAL})::bigint as total, {_BOUNDS} as out_of_bounds, coalesce(score <> {_TOTAL}, true) as differs from (select distinct * from scores)) where out_of_bounds or differs",
    "layout_columns": f"with {_PAGES} select doc_id, page_no::bigint as page_no, clusters from page_columns",
    "layout_issues": f"""with {_PAGES}, i as (select doc_id, page_no, 1 as r, 'TABLE' as issue_type, 'high' as severity, 'high' as confidence from page_columns where ruled union all select doc_id, page_no, 4, 'MULTI_COLUMN', 'medium', 'medium' from page_columns where tall >= 2
            union all select doc_id, page_no, 5, 'NONSTANDARD_BULLETS', 'low', 'medium' from page_columns where dots >= 2),
        g as (select doc_id, issue_type, severity, confidence, r, min(page_no) as f, string_agg(distinct page_no::varchar, ',' order by page_no::varchar) as affected_pages from i group by 1, 2, 3, 4, 5)
        select doc_id, row_number() over (partition by doc_id order by f, r) - 1 as ordinal, issue_type, severity, confidence, affected_pages from g""",
    "red_flags": f"select doc_id, n as red_flags from {_RED}",
    "evidence_rows": f"""with e as (select doc_id, row_number() over (partition by doc_id order by score_id) - 1 as pos, coalesce(target_role, 'any') as req, coalesce(reason, '') as n, case when score is null or score < 40 then 'missing' when score < 70 then 'warn' else 'ok' end as mark from (select distinct * from scores) where doc_id is not null),
        r as (select *, {trim("n")} as t from e), d as (select *, row_number() over (partition by doc_id, t order by pos) > 1 as again from r)
        select doc_id, pos, mark, case when again then '[' || req || ' Audit]: ' || n else n end as note, case when again and t <> '' then req || ': ' || n else n end as shown_note from d""",
    "score_caps": _caps(),
    "score_caps_stored": _caps(" + coalesce(n, 0)", f" join (select audit_id, doc_id from {_AUDITS}) using (audit_id) left join {_RED} using (doc_id)"),
    "aligned_scores": f"""with {_JSON}, x as (select audit_id, json_type(v, '{_PARTS}') = 'OBJECT' as has, list_transform(json_extract_string(v, '{_PARTS}.*'), lambda p: coalesce(try_cast(p as int), 0)) as ps from objects)
        select audit_id, case when has then greatest(0, least(100, coalesce(list_sum(ps), 0)))::bigint end as score from x""",
    "score_bounds": f"""with {_JSON}, x as (select audit_id, {" and ".join(f"coalesce(try_cast({_get(f'explainable_scorecard.{k}')} as int) between 0 and {m}, false)" for k, m in [*((f"ats_score.breakdown.{k}", m) for k, m in L.MAXIMA.items()), *((f"{k}.score", 100) for k in ("ats_score", "technical_depth", "recruiter_signal", "overall_hiring_score"))])} as valid,
            case when json_type(v, '{_CATEGORIES}') = 'OBJECT' then json_keys(v, '{_CATEGORIES}') else [] end as ks from objects)
        select audit_id, valid, len(ks)::bigint as categories, len(ks) <= 7 and len(list_filter(ks, lambda k: length(k) > 60)) = 0 as explanation_within_bounds from x""",
    "merged_scores": f"""{_SCORE_WITH}, {_JSON} select audit_id, coalesce(s.score, try_cast({_get("explainable_scorecard.ats_score.score")} as int))::bigint as score, s.keywords::bigint as keywords
        from objects join (select audit_id, doc_id from {_AUDITS}) using (audit_id) left join scored s using (doc_id)""",
    "section_flags": "select doc_id, " + ", ".join(f'coalesce(map_extract_value(section_completeness, \'{k}\'), false) as "{k}"' for k in L.FLAGS) + " from parsed_resumes",
    "plan_distinct": f"""with {_JSON}, l as (select audit_id, list_concat({", ".join(f"coalesce(json_extract_string(v, '$.priority_action_plan.{k}[*]'), [])" for k in ("immediate_fixes_today", "short_term_this_week", "long_term_this_month", "immediate_fixes_today"))}) as f from objects),
        x as (select audit_id, unnest(f) as item, generate_subscripts(f, 1) as i from l), y as (select audit_id, item, min(i) as i from x group by 1, 2)
        select audit_id, row_number() over (partition by audit_id order by i) - 1 as pos, item from y""",
    "lint_keywords": f"select 1::bigint as report, {_KEYWORD_KEY} as keyword, count(distinct target_role) as classes from keywords where target_role is not null group by 2 having count(distinct target_role) > 1",
    "lint_ranks": "select doc_id, list_sort(list(score_id % 3 + 1)) = [1, 2, 3] as complete from (select distinct * from scores) where doc_id is not null group by 1",
    "lint_notes": f"select doc_id, {trim('reason')} as note, count(*) as n from (select distinct * from scores) where doc_id is not null and reason is not null group by 1, 2 having count(*) > 1",
    "lint_reviews": "select doc_id, a as reviews, c as projects from (select doc_id, coalesce(len(awards), 0)::bigint as a, coalesce(len(certifications), 0)::bigint as c from parsed_resumes) where a <> c",
    "evidence_json": f"{_SCORE_WITH} select doc_id, score::bigint as score, match_count::bigint as match_count, word_count::bigint as word_count, bullet_ratio, email_present from scored",
    "safe_defaults": f"""with {_JSON} select audit_id, coalesce(nullif({_get("eligibility_check.status")}, ''), 'PASSED') as eligibility_status, case when nullif({_get("eligibility_check.status")}, '') is null then 'Hard Eligibility Check' else {_get("eligibility_check.title")} end as eligibility_title,
        coalesce(try_cast({_get("document_validation.is_resume")} as boolean), true) as is_resume, coalesce(try_cast({_get("document_validation.confidence_score")} as double), 0.95::double) as confidence_score, coalesce(nullif({_get("document_validation.detected_doc_type")}, ''), 'Resume') as detected_doc_type,
        coalesce(json_array_length(v, '$.verified_strengths'), 0)::bigint as verified_strengths, coalesce(json_array_length(v, '$.recruiter_evidence_matrix'), 0)::bigint as recruiter_evidence_matrix from objects""",
    "plan_dedup": f"""with {_JSON}, x as (select audit_id, unnest(f) as item, generate_subscripts(f, 1) as i from (select audit_id, json_extract_string(v, '$.priority_action_plan.immediate_fixes_today[*]') as f from objects)), y as (select audit_id, item, min(i) as i from x where item <> '' group by 1, 2)
        select audit_id, row_number() over (partition by audit_id order by i) - 1 as pos, item from y""",
    "coercions": f"""with {_JSON}, x as (select audit_id, coalesce(try_cast(rtrim(trim({_get("explainable_scorecard.ats_score.score")}), '%') as double), 0.0::double) as n, {_get("explainable_scorecard.overall_hiring_score.interview_probability")} as p, lower(trim({_get("eligibility_check.status")})) as e from objects)
        select audit_id, n as number, greatest(0.0::double, least(1.0::double, n / 100.0::double)) as fraction, coalesce(p, 'N/A') as text, case when e in ('high', 'medium', 'low') then e else 'medium' end as level from x""",
    "keyword_grounding": f"""with kw as (select distinct lower({trim("target_role")}) as r, {_KEYWORD_KEY} as k from keywords where {_KEYWORD_KEY} <> ''),
        a as (select audit_id, lower({trim("target_role")}) as role, lower(resume_text) as t from {_AUDITS} where resume_text is not null),
        x as (select distinct audit_id, t, k from a join kw on a.role is null or kw.r is null or kw.r = a.role),
        y as (select audit_id, k, length(k) >= 10 as given, regexp_matches(t, {q(f"(?:^|{_EDGE})")} || regexp_replace(k, '([^a-z0-9_ ])', '\\\\\\1', 'g') || {q(f"(?:{chr(92)}z|{_EDGE})")}) as hit from x)
        select audit_id, coalesce(string_agg(k, '|' order by k) filter (not hit), '') as missing, coalesce(string_agg(k, '|' order by given desc, k) filter (given or hit), '') as strong from a left join y using (audit_id) group by audit_id""",
    "unique_notes": f"""select doc_id, score_id as pos, case when row_number() over (partition by doc_id, {trim("reason")} order by score_id) > 1 then '[' || coalesce(target_role, 'any') || ' Audit]: ' || reason else reason end as note
        from (select distinct * from scores) where reason is not null and doc_id is not null""",
    "json_clean": f"with {_JSON} select audit_id, payload from cleaned_json",
    "dedup_by_hash": "select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "cache_lookup": f"""with x as (select audit_id, payload, resume_text, lower(trim(coalesce(target_role, ''))) as r from {_AUDITS} where resume_text is not null), ok as (select distinct resume_text, r from x where json_valid(payload) and not regexp_matches(payload, ',\\s*[\\]}}]'))
        select audit_id from x anti join ok using (resume_text, r)""",
    "uploads_per_account": "select account, date_trunc('day', received_at at time zone 'UTC') at time zone 'UTC' as window_start, count(*) as deliveries, sum(n_bytes)::bigint as bytes from (select *, row_number() over (partition by upload_id) as rn from uploads) where rn = 1 and received_at is not null group by 1, 2",
    "ext_corpus_rollup": "select lower(file_type) as file_type, account, count(*) as resumes, sum(coalesce(quality_info.word_count, 0))::bigint as words, grouping(lower(file_type), account)::bigint as level from parsed_resumes group by rollup (lower(file_type), account)",
    "ext_top_k": "select target_role, place, score_id, score::bigint as score from (select *, row_number() over (partition by target_role order by score desc, score_id) - 1 as place from (select distinct * from scores) where score is not null and target_role is not null) where place < 3",
}
