"""The queries' results as DuckDB SQL over the same tables, written without Spark's plans in mind."""

from __future__ import annotations

import re

from plaudit.catalog import fixture as fx
from plaudit.config import (
    ACTIONABLE_LABELS, CATEGORY_GROUPS, DEFAULTS, LINK_BASE, NA_TOKENS, NEGATIVE_CATEGORIES, POSITIVE_CATEGORIES,
    UNLINKED_SOURCES)
from plaudit.functions.text import WHITESPACE
from plaudit.plans.prompts import BLOCK_SEPARATOR, analysis_frame, category_frame
from plaudit.plans.report import RULE

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(text(value) for value in values)


SPACES = " || ".join(f"chr({ord(sign)})" for sign in WHITESPACE)
UNLINKED = listed(UNLINKED_SOURCES)


def strip(value: str) -> str:
    return f"trim({value}, {SPACES})"


def rounded(value: str, digits: int) -> str:
    return f"cast(printf('%.{digits}f', {value}) as double)"


def fixed(value: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', {value}), 'nan')"


def pct(part: str, total: str) -> str:
    return f"case when {total} = 0 then 0 else cast(round_even({part} / {total} * 100, 0) as int) end"


def month_label(month: str) -> str:
    first = f"strptime({month} || '-01', '%Y-%m-%d')"
    return f"strftime({first}, '%B') || chr(10) || left({month}, 4)"


def month_short(month: str) -> str:
    return f"strftime(strptime({month} || '-01', '%Y-%m-%d'), '%b %Y')"


def group_case(value: dict[str, str]) -> str:
    """First group with a keyword in the category."""
    cases = [f"when {' or '.join(f'contains(lower(category), {text(word)})' for word in words)} then {value[name]}"
             for name, _, words in CATEGORY_GROUPS[:-1]]
    return f"case {' '.join(cases)} else {value[CATEGORY_GROUPS[-1][0]]} end"


GROUP_ORD = group_case({name: str(at) for at, (name, _, _) in enumerate(CATEGORY_GROUPS, 1)})
GROUP_NAME = group_case({name: text(name) for name, _, _ in CATEGORY_GROUPS})
GROUP_EMOJI = group_case({name: text(emoji) for name, emoji, _ in CATEGORY_GROUPS})


def _choices() -> str:
    entries = []
    for at, label in enumerate(ACTIONABLE_LABELS):
        terms = [term for name, term, _ in fx.ACTIONABLE_TERMS if name == label]
        if terms:
            hits = ", ".join(f"case when contains(lower(review), {text(term)}) then {text(term)} end" for term in terms)
            entries.append(f"{{'ord': {at}, 'category': {text(label)}, 'hits': list_filter([{hits}], lambda x: x is not null)}}")
    return f"[{', '.join(entries)}]"


def confidences(names, lexicon) -> str:
    """List of structs, one per category in order."""
    entries = []
    for at, name in enumerate(names):
        terms = [(term, weight) for label, term, weight in lexicon if label == name]
        hits = " + ".join(f"case when contains(lower(review), {text(term)}) then {weight} else 0 end"
                          for term, weight in terms) or "0"
        total = sum(weight for _, weight in terms) or 1
        entries.append(f"{{'ord': {at}, 'category': {text(name)}, "
                       f"'confidence': cast(trunc(({hits}) * 100.0::double / {total}) as int)}}")
    return f"[{', '.join(entries)}]"


def wrapped(label: str) -> str:
    """Greedy line wrap at 14 characters; the current line is what follows the last line break."""
    words = f"regexp_split_to_array({strip(label)}, '[' || {SPACES} || ']+')"
    return (f"case when length({label}) <= 14 then {label} else list_reduce({words}, lambda acc, word: acc || "
            "case when length(split_part(acc, chr(10), -1)) + 1 + length(word) > 14 then chr(10) else ' ' end || word)"
            " end")


def titled(value: str) -> str:
    runs = f"regexp_extract_all({value}, '\\p{{L}}+|\\P{{L}}+')"
    return (f"case when {value} is null then null else coalesce(list_aggregate(list_transform({runs}, "
            "lambda x: case when left(x, 1) = 'ß' then 'Ss' else upper(left(x, 1)) end || lower(substr(x, 2))), 'string_agg', ''), '') end")


CTES = {
    "reviews0": f"""
        select concat(case when blank then 'B' else 'R' end, lpad(cast(doc_id as varchar), 8, '0')) as review_id,
            strftime(date '2026-02-18' - cast((doc_id * 13) % 365 as int), '%Y-%m-%d') as published,
            c_name as author,
            case cast(substr(source, 4) as int) % 5 when 0 then 'Google Play' when 1 then 'iOS App Store'
                when 2 then 'BBB' when 3 then 'CreditKarma'
                else case when doc_id % 43 = 0 then null else 'Trustpilot' end end as source,
            case when doc_id % 23 = 0 then null when doc_id % 41 = 0 then 'N/A' when doc_id % 29 = 0 then '3.5'
                else concat(cast(1 + (doc_id * 7 + n_chars) % 5 as varchar), '.0') end as rating_raw,
            case when doc_id % 31 = 0 then null else split_part(text, chr(10), 1) end as title,
            case when blank then '  ' else text end as review, url, doc_id
        from (select *, unnest(case when doc_id % 37 = 0 then [false, true] else [false] end) as blank from documents)
        left join customer on c_custkey = doc_id % (select count(*) from customer)
        left join pages on page_id = doc_id % (select count(*) from pages)""",
    # The tolerant dialect.
    "reviews": f"""
        select review_id, published, case when author not in ({listed(NA_TOKENS)}) then author end as author,
            case when source not in ({listed(NA_TOKENS)}) then source end as source,
            case when rating_raw not in ({listed(NA_TOKENS)}) then rating_raw end as rating_raw,
            case when title not in ({listed(NA_TOKENS)}) then title end as title,
            case when review not in ({listed(NA_TOKENS)}) then review end as review,
            case when url not in ({listed(NA_TOKENS)}) then url end as url,
            try_cast(rating_raw as double) as rating, left(published, 7) as month, doc_id
        from reviews0""",
    "analysed": f"select * from reviews where rating <= 5 and {strip('review')} <> ''",
    # The strict dialect, on ratings it accepts.
    "rated_text": f"""
        select review_id, {strip('review')} as review, cast(rating_raw as double) as rating,
            left(published, 7) as month, case when cast(rating_raw as double) >= 4 then 'pos' else 'neg' end as sentiment
        from reviews0 where rating_raw <> 'N/A' and {strip('review')} <> ''""",
    "rated": """
        select left(published, 7) as month, cast(rating_raw as double) as rating, coalesce(source, '') as source
        from reviews0 where rating_raw <> 'N/A'""",
    "recent": "select * from rated_text where month in (select distinct month from rated_text order by 1 desc limit 2)",
    "buckets": "select sentiment, month, review_id, left(review, 500) as review from recent",
    "batches": """
        select *, (row_no - 1) // 150 + 1 as batch_no from (
            select *, row_number() over (partition by sentiment order by month, md5(concat_ws(chr(31), sentiment, month, review_id, review))) as row_no,
                (count(*) over (partition by sentiment) + 149) // 150 as total_batches
            from buckets)""",
    "actionable": f"""
        select review_id, score, category, reason from (
        select *, row_number() over (partition by review_id order by score desc, ord) as nth from (
            select review_id, ord, category, cast(least(5, len(hits) + 1) as int) as score, array_to_string(hits, ', ') as reason
            from (select review_id, unnest({_choices()}, recursive := true) from analysed) where len(hits) > 0))
        where nth = 1""",
    "items": """
        select n // 150 + 1 as batch_no, cast(n % 150 as int) as pos, case when n % 97 = 0 then concat('X', cast(n as varchar)) else review_id end as review_id,
            case when n % 5 = 0 then 1 else score end as score, category, reason
        from (select *, cast(substr(review_id, 2) as bigint) as n from actionable)""",
    "grouped": f"select *, {GROUP_ORD} as group_ord, {GROUP_NAME} as group_name, {GROUP_EMOJI} as emoji from items",
    "found": """
        select *, row_number() over (order by score desc, batch_no, pos) as item_no,
            row_number() over (partition by group_name order by score desc, batch_no, pos) as group_item_no
        from grouped where score >= 3""",
    "scored": f"""
        select review_id, sentiment, month, unnest(case when sentiment = 'pos'
            then {confidences(POSITIVE_CATEGORIES, fx.POSITIVE_TERMS)}
            else {confidences(NEGATIVE_CATEGORIES, fx.NEGATIVE_TERMS)} end, recursive := true)
        from rated_text""",
    "candidates": "select review_id, ord, category, confidence from scored",
    "categorised": """
        select sentiment, month, review_id, case when confidence > 70 then category else 'other' end as category
        from (select *, row_number() over (partition by review_id order by confidence desc, ord) as nth from scored)
        where nth = 1 and month in (select month from recent)""",
    "categorised_batches": """
        select *, (row_no - 1) // 150 + 1 as batch_no from (
            select *, row_number() over (partition by sentiment order by month, md5(concat_ws(chr(31), sentiment, month, review_id, category))) as row_no
            from categorised)""",
    "counts": "select sentiment, month, category, count(*) as n from categorised group by all",
    "pairs": """
        select sentiment, category, m.month_1, m.month_2,
            cast(coalesce(sum(n) filter (month = m.month_1), 0) as bigint) as n_1,
            cast(coalesce(sum(n) filter (month = m.month_2), 0) as bigint) as n_2
        from counts join (
            select sentiment, list_sort(list(distinct month))[1] as month_1, list_sort(list(distinct month))[2] as month_2
            from counts group by sentiment) m using (sentiment)
        group by all""",
    "platforms": f"""
        select source, count(*) as total, {rounded('avg(rating)', 1)} as avg_rating,
            count(*) filter (rating >= 4) as pos, {pct('count(*) filter (rating >= 4)', 'count(*)')} as pos_pct,
            count(*) filter (rating <= 3) as neg, {pct('count(*) filter (rating <= 3)', 'count(*)')} as neg_pct
        from reviews where source is not null group by source""",
    "platform_text": f"""
        select source, total || ' reviews  |  ★ avg ' || {fixed('avg_rating', 1)} || '  |  UP ' || pos || ' (' || pos_pct
            || '%)  DOWN ' || neg || ' (' || neg_pct || '%)' as stats
        from platforms""",
    "monthly": f"""
        select month, {rounded(f"avg(rating) filter (source not in ({UNLINKED}))", 2)} as avg_rating,
            count(*) filter (source not in ({UNLINKED}) and rating >= 4) as pos,
            count(*) filter (source not in ({UNLINKED}) and rating < 4) as neg
        from rated group by month""",
    "latest": f"""
        select count(*) as total, count(*) filter (rating >= 4) as pos, count(*) filter (rating < 4) as neg
        from rated where month = (select max(month) from rated) and source not in ({UNLINKED})""",
    "by_source": f"""
        select source, month, {rounded('avg(rating)', 2)} as avg_rating, count(*) as vol
        from rated where month in (select distinct month from rated order by 1 desc limit 2) group by source, month""",
    "totals": f"""
        select count(*) as total, avg(rating) as mean, min(published) as first_day, max(published) as last_day,
            count(*) filter (rating <= 3) as total_neg from reviews""",
    "joined": f"""
        select i.*, r.review_id is not null as matched, r.published, r.author, r.source, r.rating, r.review, r.url,
            case when length(r.review) > 200 then left(r.review, 200) || '...' else r.review end as snippet,
            case when r.review_id is null then 'N/A' else coalesce(r.author, 'nan') end as written_by,
            case when r.review_id is null then 'N/A' else coalesce(r.source, 'nan') end as posted_at,
            case when r.review_id is null then '?'
                else repeat('★', cast(trunc(rating) as int)) || repeat('☆', 5 - cast(trunc(rating) as int)) end as stars,
            repeat('█', score) || repeat('░', 5 - score) as bar,
            case when r.source in ({UNLINKED}) then '{LINK_BASE}' || r.review_id when r.url <> '' then r.url end as link
        from found i left join analysed r using (review_id)""",
    "headers": f"""
        select group_ord, group_name, count(*) as n, {pct('count(*)', 'max(total_neg)')} as pct,
            first(emoji) || ' *' || group_name || '* — ' || count(*) || ' actionable review'
            || case when count(*) <> 1 then 's' else '' end || ' (' || {pct('count(*)', 'max(total_neg)')}
            || '% of negative reviews)' || chr(10) || chr(10) || '_Example: "'
            || coalesce(first(snippet order by group_item_no), '') || '" — '
            || first(case when matched then written_by else 'Unknown' end order by group_item_no) || '_' as text
        from joined, totals group by group_ord, group_name""",
    "blocks": """
        select group_ord, group_item_no, category, '*[' || group_item_no || '] ' || category || '*  `' || score || '/5  '
            || bar || '`' || chr(10) || '*Source:* ' || posted_at || '  |  *Rating:* ' || stars || '  |  *Author:* ' || written_by
            || chr(10) || '*Why actionable:* ' || reason || chr(10) || '_' || coalesce(snippet, '') || '_'
            || case when link is not null then chr(10) || '<' || link || '|View review>' else '' end as text
        from joined""",
    "themes": "select category as theme, cast(count(*) as bigint) as n from items group by category",
}


def section_json(value: str) -> str:
    """SQL of the JSON of a text block."""
    return "'{\"type\":\"section\",\"text\":{\"type\":\"mrkdwn\",\"text\":' || cast(to_json(" + value + ") as varchar) || '}}'"


NUMBERS = f"""'*Stats*' || chr(10) || 'Total reviews in export: *' || total || '*  |  Avg rating: *★ ' || {fixed('mean', 2)}
    || '*' || chr(10) || 'Date range: *' || first_day || ' → ' || last_day || '*' || chr(10) || chr(10)
    || '*Per-platform breakdown:* see replies'"""
THEMES = """':warning: *Most Actionable Themes* (' || (select count(*) from found) || ' flagged) — see threads below'
    || chr(10) || chr(10) || (select string_agg(emoji || '  *' || group_name || '*: ' || n || ' reviews', chr(10) order by group_ord)
        from (select group_ord, group_name, emoji, count(*) as n from found group by all))"""
SUMMARY = """(select 'Most frequent themes: ' || string_agg(theme || ' (' || n || ')', ', ' order by n desc, theme) || '.'
    from (select * from themes order by n desc, theme limit 5))"""
DIVIDER = """',{"type":"divider"},'"""
CTES["main"] = f"""
    select '[{{"type":"header","text":{{"type":"plain_text","text":"{DEFAULTS.report_title}","emoji":true}}}},'
        || '{{"type":"context","elements":[{{"type":"mrkdwn","text":"Generated {fx.RUN_TIME}  |  Source: `{fx.EXPORT_NAME}`"}}]}}'
        || {DIVIDER} || {section_json(NUMBERS)} || {DIVIDER} || {section_json(THEMES)} || {DIVIDER}
        || {section_json("':bar_chart: *Sentiment Summary — Recurring Themes*'")} || ',' || {section_json(SUMMARY)} || ']' as blocks_json
    from totals"""


CTES["platform_replies"] = f"""
    select block_no, '[' || {section_json("string_agg(line, chr(10) order by source)")} || ']' as blocks_json
    from (select source, (row_number() over (order by source) - 1) // {DEFAULTS.lines_per_block} + 1 as block_no,
            '  • *' || source || '*: ' || replace(replace(stats, 'UP', ':thumbsup:'), 'DOWN', ':thumbsdown:') as line from platform_text)
    group by block_no"""


def _used(sql: str) -> set[str]:
    """Names of the common tables a statement needs, directly or through others."""
    names = {name for name in CTES if re.search(rf"\b(from|join|,) {name}\b", sql)}
    return names.union(*[_used(CTES[name]) for name in names])


def oracle(name: str, body: str) -> None:
    used = _used(body)
    tables = ",\n".join(f"{cte} as ({sql})" for cte, sql in CTES.items() if cte in used)
    ORACLES[name] = f"with {tables}\n{body}" if used else body


# Sources and sinks
oracle("scan_reviews_coerce", "select review_id, published, author, source, rating, title, review, url from reviews")
oracle("scan_reviews_strict", "select review_id, review, rating, month from rated_text")
oracle("read_categorized_json", "select sentiment, month, review_id, category from categorised")
FRAGMENT = """
    select sentiment, batch_no, '{' || string_agg('"' || month || '":[' || rows || ']', ',' order by month) || '}' as months
    from (select sentiment, batch_no, month, string_agg('{"review_id":"' || review_id || '","category":"' || category || '"}',
            ',' order by row_no) as rows
        from categorised_batches group by sentiment, batch_no, month)
    group by sentiment, batch_no"""
oracle("categorized_document", f"""select sentiment, batch_no, '{{"' || sentiment || '":' || months || '}}' as document
    from ({FRAGMENT})""")
oracle("metrics_document", f"""
    select 'months' as part, month as key, '{{"months":{{"' || month || '":{{"avg_rating":' || coalesce(avg_rating::varchar, 'null')
        || ',"pos":' || pos || ',"neg":' || neg || '}}}}}}' as document from monthly
    union all select 'sentiment_breakdown', side, '{{"sentiment_breakdown":{{"' || side || '":{{"pct":' || {rounded('vol / total', 2)}
        || ',"vol":' || vol || '}}}}}}' from (select 'positive' as side, pos as vol, total from latest union all select 'negative', neg, total from latest)
    union all select 'source_breakdown', source, '{{"source_breakdown":{{"' || source || '":['
        || string_agg('{{"month":"' || month || '","avg_rating":' || avg_rating || ',"vol":' || vol || '}}', ',' order by month) || ']}}}}'
        from by_source group by source""")
REPORT = f"""
    select cast(section_ord as int) as section_ord, sort_text, cast(line_ord as bigint) as line_ord, line from (
    select 1 as section_ord, '' as sort_text, unnest(range(0, 12)) as line_ord, unnest(['', '{RULE}',
        '  {DEFAULTS.report_title.upper()}', '  Generated: {fx.RUN_TIME}  |  Source: {fx.EXPORT_NAME}', '{RULE}', '', 'STATS',
        '  Total reviews in export:          ' || total, '  Avg star rating:                  ★ ' || {fixed('mean', 2)},
        '  Date range:                       ' || first_day || ' → ' || last_day, '', '  Per-platform breakdown:']) as line
    from totals
    union all select 2, source, 0, '    ' || source || ': ' || replace(replace(stats, 'UP', '👍'), 'DOWN', '👎') from platform_text
    union all select 3, '', unnest(range(0, 4)), unnest(['', '{RULE}',
        '  MOST ACTIONABLE THEMES  (' || (select count(*) from found) || ' flagged)', '{RULE}'])
    union all select 4, '', item_no * 10, '' from joined
    union all select 4, '', item_no * 10 + 1, '  [' || item_no || '] Actionability: ' || score || '/5  ' || bar || '  |  ' || category
        from joined
    union all select 4, '', item_no * 10 + 2, '      Source: ' || posted_at || '  |  Rating: ' || stars || '  |  Author: ' || written_by from joined
    union all select 4, '', item_no * 10 + 3, '      Date:   ' || coalesce(published, 'N/A') from joined
    union all select 4, '', item_no * 10 + 4, '      WHY:    ' || reason from joined
    union all select 4, '', item_no * 10 + 5, '      Review: "' || coalesce(snippet, '') || '"' from joined
    union all select 4, '', item_no * 10 + 6, '      URL:    ' || link from joined where link is not null
    union all select 5, '', unnest(range(0, 5)), unnest(['', '{RULE}', '  SENTIMENT SUMMARY — Recurring Themes', '{RULE}', ''])
    union all select distinct 6, '', batch_no, '  Summary of batch ' || batch_no || '.' from items
    union all select 7, '', unnest(range(0, 3)), unnest(['', '{RULE}', '']))"""
oracle("report_lines", REPORT)


def by_rules(sql: str) -> str:
    """The same over the items that the terms make of the whole export."""
    return re.sub(r"\b(from|join) (items|grouped|found|joined|themes)\b", r"\1 rule_\2", sql)


CTES["rule_items"] = """
    select (n - 1) // 150 + 1 as batch_no, cast((n - 1) % 150 as int) as pos, review_id, score, category, reason
    from (select *, row_number() over (order by md5(concat_ws(chr(31), review_id, score, category, reason))) as n from actionable)"""
for _name in ("grouped", "found", "joined", "themes"):
    CTES[f"rule_{_name}"] = by_rules(CTES[_name])
oracle("analysis_report", by_rules(REPORT.replace(
    "union all select distinct 6, '', batch_no, '  Summary of batch ' || batch_no || '.' from items", f"union all select 6, '', 1, '  ' || {SUMMARY}")))
oracle("message_stream", f"""
    select cast(group_ord as int) as group_ord, cast(item_ord as bigint) as item_ord, cast(parent_ord as int) as parent_ord,
        text, blocks_json, false as unfurl_links, false as unfurl_media from (
    select 0 as group_ord, 0 as item_ord, null as parent_ord, '{DEFAULTS.report_title}' as text, blocks_json from main
    union all select 0, block_no, 0, 'Platforms ' || block_no, blocks_json from platform_replies
    union all select distinct 0, (select count(*) from platform_replies) + batch_no, 0, 'Summary ' || batch_no,
        '[' || {section_json("'Summary of batch ' || batch_no || '.'")} || ']'
        from items
    union all select group_ord, 0, null, group_name || ' (' || n || ' reviews)', '[' || {section_json("text")} || ']' from headers
    union all select group_ord, group_item_no, group_ord, '[' || group_item_no || '] ' || category,
        '[' || {section_json("text")} || ']' from blocks)""")
oracle("run_responder", """select sentiment, month, review_id,
    case when contains(lower(review), 'the') then 'credit card' else 'other' end as category from buckets""")

# Projections and filters
oracle("rating_coerce", "select review_id, rating from reviews")
oracle("null_tokens", "select review_id, source, title, review, rating_raw from reviews")
oracle("filter_analysable", "select review_id, source, rating, review from analysed")
oracle("filter_rated_text", "select review_id, rating, month, review from rated_text")
oracle("filter_rated", "select month, rating, source from rated")
oracle("month_key", "select review_id, month from reviews")
oracle("truncate_text", "select review_id, left(review, 500) as review_cut from reviews")
oracle("snippet", """select review_id,
    case when length(review) > 200 then left(review, 200) || '...' else review end as snippet from reviews""")
oracle("sentiment_two_way", """select review_id, rating,
    case when rating >= 4 then 'pos' when rating < 4 then 'neg' end as sentiment from reviews""")
oracle("sentiment_three_way", """select review_id, rating,
    case when rating >= 4 then 'pos' when rating <= 3 then 'neg' end as sentiment from reviews""")
for key in ("exclude_sources", "exclude_sources_anti"):
    oracle(key, f"select review_id, source, rating from reviews where source is null or source not in ({UNLINKED})")
oracle("review_link", f"""select review_id,
    case when source in ({UNLINKED}) then '{LINK_BASE}' || review_id when url <> '' then url end as link from reviews""")
oracle("items_min_score", "select review_id, score, category, reason from items where score >= 3")
oracle("category_valid", f"""select *, case when sentiment = 'pos' then category in ({listed(POSITIVE_CATEGORIES)})
    else category in ({listed(NEGATIVE_CATEGORIES)}) end as valid
    from (select * from categorised union all select 'neg', '2026-02', review_id, category from items)""")

# Joins
oracle("items_with_reviews", """
    select i.*, r.review_id is not null as matched, r.published, r.author, r.source, r.rating, r.url,
        case when length(r.review) > 200 then left(r.review, 200) || '...' else r.review end as snippet
    from items i left join analysed r using (review_id)""")
oracle("last_two_months", "select review_id, month, rating from recent")
oracle("assign_group", "select review_id, category, group_ord, group_name, emoji from grouped")
oracle("category_grid", """select c.sentiment, c.category, m.month, cast(coalesce(n, 0) as bigint) as n
    from (select distinct sentiment, category from counts) c join (select distinct sentiment, month from counts) m using (sentiment)
    left join counts k on k.sentiment = c.sentiment and k.category = c.category and k.month = m.month""")

# Aggregations
oracle("export_stats", f"""select count(*) as total, (select count(*) from analysed) as analysed,
    {rounded('avg(rating)', 2)} as avg_rating, min(published) as first_day, max(published) as last_day from reviews""")
oracle("platform_stats", "select * from platforms")
oracle("latest_sentiment", f"""select 'pos' as sentiment, {rounded('pos / total', 2)} as pct, pos as vol from latest
    union all select 'neg', {rounded('neg / total', 2)}, neg from latest""")
oracle("monthly_avg_rating", "select month, avg_rating from monthly")
oracle("monthly_pos_neg", "select month, pos, neg from monthly")
oracle("source_breakdown", "select * from by_source")
oracle("category_counts", "select * from counts")
oracle("bucket_reviews", "select sentiment, month, review_id, review from buckets")
oracle("bucket_counts", "select sentiment, month, count(*) as n from buckets group by all")
oracle("group_summary", "select group_ord, group_name, emoji, count(*) as n from found group by all")
oracle("group_share", f"""select group_ord, group_name, emoji, count(*) as n, max(total_neg) as total_neg,
    {pct('count(*)', 'max(total_neg)')} as pct from found, totals group by group_ord, group_name, emoji""")
oracle("theme_counts", "select * from themes")
oracle("merge_responses", "select sentiment, month, review_id, category from categorised")
oracle("unanswered", """select sentiment, month, review_id, review from buckets
    where review_id not in (select review_id from categorised_batches where batch_no % 2 = 0)""")
oracle("distinct_months", "select distinct month from rated")

# Windows, sorts, sets
oracle("batch_assign", "select sentiment, month, review_id, row_no, batch_no, total_batches from batches")
oracle("batch_assign_in_order", """
    select *, (row_no - 1) // 150 + 1 as batch_no from (
        select sentiment, month, review_id, row_number() over (partition by sentiment order by month, review_id) as row_no,
            (count(*) over (partition by sentiment) + 149) // 150 as total_batches
        from buckets)""")
oracle("item_ordinals", """select review_id, group_name, score, row_number() over (order by score desc, batch_no, pos) as item_no,
    row_number() over (partition by group_name order by score desc, batch_no, pos) as group_item_no from grouped""")
oracle("top_item_per_group", """select group_name, review_id, score, batch_no, pos from (
    select *, row_number() over (partition by group_name order by score desc, batch_no, pos) as nth from grouped) where nth = 1""")
NTH = "row_number() over (partition by review_id order by confidence desc, ord)"
oracle("pick_category", f"""select review_id, case when confidence > 70 then category else 'other' end as category
    from (select *, {NTH} as nth from candidates) where nth = 1""")
oracle("top_candidates", f"""select review_id, ord, category, confidence, cast(nth as int) as nth
    from (select *, {NTH} as nth from candidates) where nth <= 3""")
oracle("items_ranked", "select item_no, review_id, score, category, reason from found")
oracle("category_union", "select distinct sentiment, category from categorised")

# Scalar functions
oracle("fn_strip", f"select review_id, coalesce({strip('review')}, '') as stripped from reviews")
oracle("fn_stars", """select review_id, rating,
    repeat('★', cast(trunc(rating) as int)) || repeat('☆', 5 - cast(trunc(rating) as int)) as stars from reviews""")
oracle("fn_score_bar", "select review_id, score, repeat('█', score) || repeat('░', 5 - score) as bar from items")
oracle("fn_title_case", f"select review_id, {titled('review')} as label from reviews")
oracle("fn_wrap_label", f"select review_id, {wrapped('label')} as label from (select review_id, {titled('review')} as label from reviews)")
oracle("fn_month_label", f"select review_id, {month_label('month')} as label, {month_short('month')} as short from reviews")
RATIO = "n_chars / (1 + doc_id % 97)"
oracle("fn_round2", f"""select doc_id, {rounded(RATIO, 2)} as two, {rounded(RATIO, 1)} as one,
    cast(round_even({RATIO} * 100, 0) as int) as pct from documents""")
oracle("fn_format", f"""select doc_id, printf('%.2f', {RATIO}) as two, printf('%.1f', {RATIO}) as one,
    case when 1 + doc_id % 97 <> 1 then 's' else '' end as suffix from documents""")
oracle("fn_fenced_json", f"select doc_id, case when doc_id % 5 = 4 then text else {strip('text')} end as payload from documents")
oracle("fn_review_date", "select review_id, case when doc_id % 5 = 4 then 'N/A' else published end as day from reviews")

oracle("fn_base_name", "select review_id, split_part(url, '/', -1) as name from reviews")

# Responder and rule scorers
BEFORE, BETWEEN, AFTER = analysis_frame()
oracle("analysis_prompts", f"""
    select *, sha256(prompt) as prompt_hash from (
    select batch_no, max(total_batches) as total_batches, count(*) as n_reviews,
        {text(BEFORE)} || count(*) || {text(BETWEEN)} || string_agg(block, {text(BLOCK_SEPARATOR)} order by row_no) || {text(AFTER)} as prompt
    from (select *, (row_no - 1) // 150 + 1 as batch_no from (
        select row_number() over (order by md5(concat_ws(chr(31), review_id, block))) as row_no,
            (count(*) over () + 149) // 150 as total_batches, block
        from (select review_id, '[ID: ' || review_id || ']' || chr(10) || 'Source: ' || coalesce(source, 'nan') || ' | Rating: ' || rating
            || '★ | Author: ' || coalesce(author, 'nan') || chr(10) || 'Title: ' || coalesce(title, 'nan') || chr(10)
            || 'Review: ' || left(review, 500) as block
        from analysed)))
    group by batch_no)""")


def _sided(at: int) -> str:
    return f"case when sentiment = 'pos' then {text(category_frame('pos')[at])} else {text(category_frame('neg')[at])} end"


oracle("categorize_prompts", f"""
    select *, sha256(prompt) as prompt_hash from (
    select sentiment, batch_no, max(total_batches) as total_batches, cast(sum(n) as bigint) as n_reviews,
        {_sided(0)} || '{{' || string_agg('"' || month || '":[' || rows || ']', ',' order by month) || '}}' || {_sided(1)} as prompt
    from (select sentiment, batch_no, month, max(total_batches) as total_batches, count(*) as n,
            string_agg('{{"review_id":"' || review_id || '","review":' || cast(to_json(review) as varchar) || '}}', ',' order by row_no) as rows
        from batches group by sentiment, batch_no, month)
    group by sentiment, batch_no)""")
oracle("categorize_reviews", "select sentiment, month, review_id, category from categorised")
oracle("decode_analysis", """select batch_no, cast(row_number() over (partition by batch_no order by pos) - 1 as int) as pos,
    review_id, score, category, reason from items""")
oracle("decode_categories", """select sentiment, batch_no, month, review_id, category,
    cast(row_number() over (partition by sentiment, batch_no, month order by row_no) - 1 as int) as item_no
    from categorised_batches""")


oracle("score_actionability", "select * from actionable")
oracle("score_categories", "select review_id, sentiment, ord, category, confidence from scored")

# Report, messages, charts
oracle("platform_lines", """
    select source, '    ' || source || ': ' || replace(replace(stats, 'UP', '👍'), 'DOWN', '👎') as line, 'report' as kind
    from platform_text union all
    select source, '  • *' || source || '*: ' || replace(replace(stats, 'UP', ':thumbsup:'), 'DOWN', ':thumbsdown:'), 'chat'
    from platform_text""")
oracle("main_blocks", "select 0::bigint as block_no, blocks_json from main union all select * from platform_replies")
oracle("category_headers", "select group_ord, group_name, n, pct, text from headers")
oracle("item_blocks", "select group_ord, group_item_no, category, text from blocks")
oracle("chart_monthly", f"""select month, {month_label('month')} as label, pos, neg, avg_rating,
    printf('%.2f', avg_rating) as avg_label from monthly""")
oracle("chart_two_sources", f"""
    select month, {month_label('month')} as label,
        cast(coalesce(max(vol) filter (source = 'iOS App Store'), 0) as bigint) as ios_vol,
        max(avg_rating) filter (source = 'iOS App Store') as ios_rating,
        cast(coalesce(max(vol) filter (source = 'Google Play'), 0) as bigint) as google_play_vol,
        max(avg_rating) filter (source = 'Google Play') as google_play_rating
    from by_source group by month""")
for key, side in (("chart_mom_positive", "pos"), ("chart_mom_negative", "neg")):
    label = titled("category")
    oracle(key, f"""select category, {wrapped('label')} as label, {month_short('month_1')} as month_1, n_1,
        {month_short('month_2')} as month_2, n_2
        from (select *, {label} as label from pairs) where sentiment = '{side}'""")
