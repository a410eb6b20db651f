"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from plaudit.llm.byte_bpe import op10_byte_bpe
from plaudit.llm.conversations import op11_conversation_repair
from plaudit.llm.filter_audit import op12_filter_audit
from plaudit.llm.fingerprints import op5_fingerprints
from plaudit.llm.language_id import op7_language_id
from plaudit.llm.ngram_join import op3_ngram_join
from plaudit.llm.orc_tokens import op6_orc_tokens
from plaudit.llm.packing import op8_best_fit_packing
from plaudit.llm.quality_classifier import op1_quality_classifier
from plaudit.llm.quality_rules import op4_quality_rules
from plaudit.llm.revisits import op9_warc_revisits
from plaudit.llm.secrets import op2_secret_scan
from plaudit.llm.suffix_dedup import op13_suffix_dedup

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_fingerprints": op5_fingerprints,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_suffix_dedup": op13_suffix_dedup,
}

# Words of a text are runs of other characters than the ASCII blanks; all pairs that share an n-gram are compared.
OP3_SQL = """
with recursive words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w from documents),
sets as materialized (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [hash(array_to_string(w, ' '))]
        else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))))) end as grams
    from words),
copies as materialized (
    select min(doc_id) as id, count(*) as copies, grams, len(grams) as n from sets where len(grams) > 0 group by grams),
exploded as materialized (select id, n, unnest(grams) as gram from copies),
pairs as materialized (
    select a.id as a, b.id as b from exploded a join exploded b on a.gram = b.gram and a.id <> b.id
    group by a.id, a.n, b.id, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach as (
    select id, id as seen from copies
    union
    select r.id, p.b from reach r join pairs p on p.a = r.seen),
classes as (select id, min(seen) as class_id from reach group by id),
links as (select p.a as id, sum(c.copies) as links, count(*) as texts from pairs p join copies c on c.id = p.b group by p.a)
select s.doc_id, coalesce(c.id, s.doc_id) as copy_id, coalesce(k.class_id, s.doc_id) as class_id, coalesce(c.copies, 1) as copies,
    cast(coalesce(l.links, 0) + coalesce(c.copies, 1) - 1 as bigint) as n_links, coalesce(l.texts, 0) as n_linked_texts
from sets s left join copies c on c.grams = s.grams left join classes k on k.id = c.id left join links l on l.id = c.id
"""

# The latest earlier response by a window over all captures of a URL; every URL here is a host and a language.
OP9_SQL = """
with captures as (
    select page_id * 3 + k as record_id, k, page_id, html,
        regexp_replace(lower(regexp_extract(section, '^[^/?]*')), '^www[.]', '')
            || regexp_replace(regexp_extract(section, '^[^/?]*([^?]*)', 1), '/+$', '') as canonical_url,
        case when k = 0 then page_id * 7919 % 1000003 else (page_id * 104729 * k + 17) % 1000003 end as ts,
        case when page_id % 3 = 0 then null else '"' || substr(md5(html), 1, 12) || '"' end as etag, page_id % 11 as last_modified
    from (select *, regexp_replace(regexp_replace(url, '^https?://(www[.])?', ''), '/[0-9]+.*$', '') as section from pages),
        (select unnest(range(0, 3)) as k)),
filled as (
    select *, last_value(case when k = 0 then record_id end ignore nulls) over (
        partition by canonical_url order by ts, record_id rows between unbounded preceding and 1 preceding) as response_id
    from captures),
judged as (
    select v.record_id, v.canonical_url, v.ts, v.response_id, v.k, v.page_id, r.html,
        case when r.record_id is null then 'no_response'
            when coalesce(v.etag = r.etag, v.last_modified = r.last_modified) then 'resolved' else 'mismatch' end as verdict
    from filled v left join captures r on r.record_id = v.response_id where v.k > 0)
select record_id, canonical_url, ts, response_id, verdict,
    case when verdict = 'resolved' then 'cache-control: max-age=' || (page_id % 7) || chr(10) || 'content-length: ' || strlen(html) || chr(10)
        || 'content-type: text/html' || chr(10) || 'expires: ' || k end as headers,
    case when verdict = 'resolved' then sha256(html) end as digest
from judged
"""



def _edited(state: str, cost: str, letters: str, line: str = "''") -> str:
    """A state of the repair after more edits: cost, audit, lines; null stays null."""
    return f"case when {state}.c is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 'r': {state}.r || {line}}} end"


def _row_step() -> str:
    """The four states after a row, of the four states ``c0`` to ``c3`` with insertions before it."""
    line = "chr(10) || role || ':' || t"

    def taken(state: int, name: str) -> str:
        kept = _edited(f"c{state}", "late", "K", line)
        return f"case when not gone then least(case when starts_with(role, '{name[0]}') then {kept} end, " + _edited(
            f"c{state}", "3 + late", "R", f"chr(10) || '{name}:' || t") + ") end"

    gone = [_edited(f"c{state}", "4", "D") for state in range(4)]
    system = f"case when not gone and starts_with(role, 's') then {_edited('c0', 'late', 'K', line)} end"
    return (f"{gone[0]} as s0, least({gone[1]}, {system}) as s1, "
            f"least({gone[2]}, {', '.join(taken(state, 'user') for state in (0, 1, 3))}) as s2, least({gone[3]}, {taken(2, 'assistant')}) as s3")


def _insert(state: str, name: str) -> str:
    return _edited(state, "3", "I", f"chr(10) || '{name}:'")


# The rows of a conversation one after another, the best edits to each of the four states with them. The crc is taken bit by bit.
OP11_SQL = f"""
with recursive named as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as t,
        coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
hashed as (
    select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(name) + 1), lambda i: ascii(substr(name, i, 1))::ubigint)),
        lambda crc, sign: list_reduce(list_prepend(xor(crc, sign), list_transform(range(8), lambda k: k::ubigint)),
            lambda x, k: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))), 4294967295::ubigint) % 20 as fault from named),
rows as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
        case fault when 1 then '' when 2 then translate(t, '.!?', '') else t end as t, unnest(range(case when fault = 3 then 2 else 1 end)) as copy
    from hashed where fault <> 0),
placed as (
    select *, row_number() over w as pos, lag(left(role, 1)) over w || left(role, 1) as pair, not regexp_matches(t, '[^ \\x09-\\x0D]') as blank,
        row_number() over (partition by conv_id, role, t order by turn nulls first, copy) > 1 as seen,
        not regexp_matches(t, '[.!?][ \\x09-\\x0D]*$') as open
    from rows window w as (partition by conv_id order by turn nulls first, role, md5(t), copy)),
judged as (select *, blank or seen as gone, case when open then 3 else 0 end as late from placed),
walk as (
    select distinct conv_id, 0::bigint as pos, {{'c': 0, 'a': '', 'r': ''}} as s0, null::struct(c int, a varchar, r varchar) as s1,
        null::struct(c int, a varchar, r varchar) as s2, null::struct(c int, a varchar, r varchar) as s3 from conversations
    union all
    select conv_id, pos, {_row_step()}
    from (
        select w.conv_id, j.pos, role, t, gone, late, s0 as c0, s1 as c1, u as c2, least(s3, {_insert("u", "assistant")}) as c3
        from (select *, least(s2, {_insert("s0", "user")}, {_insert("s1", "user")}, {_insert("s3", "user")}) as u from walk) w
        join judged j on j.conv_id is not distinct from w.conv_id and j.pos = w.pos + 1)),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
        count_if(seen and not blank) as duplicate, count_if(open and not gone) as truncated,
        count_if(pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(pos) as n
    from judged group by conv_id),
closed as (
    select w.conv_id, w.pos, least(s0, {_edited("s1", "6", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")},
        {_insert("s2", "assistant")}, s3) as best from walk w)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit,
    sha256(substr(best.r, 2)) as repaired_sha256
from closed k left join counts c on c.conv_id is not distinct from k.conv_id where k.pos = coalesce(n, 0)
"""

# Documents counted by the set of filters they fail; every order walks through these counts.
OP12_SQL = """
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as w
    from documents),
marks as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
judged as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        concat(case when len(w) < 200 then 'A' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' end,
            case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) then 'C' end,
            case when regexp_matches(t, '[#$%&*|]') then 'D' end,
            case when doc_id > min(doc_id) over (partition by t) then 'E' end) as fails
    from texts left join marks using (doc_id)),
counted as (select part, fails, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from judged group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps as (select filter_order, cast(unnest(range(1, 6)) as int) as step from orders),
named as (select *, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as earlier from steps),
sized as (
    select part, filter_order, step, own,
        sum(n) filter (not regexp_matches(fails, '[' || earlier || own || ']')) as kept,
        sum(n) filter (contains(fails, own) and translate(fails, earlier, '') = fails) as removed,
        sum(n) filter (contains(fails, own) and translate(fails, earlier, '') <> fails) as redundant,
        sum(n) filter (fails = own) as unique_fails,
        sum(good) filter (contains(fails, own) and translate(fails, earlier, '') = fails) as good_lost,
        sum(toxic) filter (contains(fails, own) and translate(fails, earlier, '') = fails) as toxic_lost
    from counted, named group by all)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
    cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
    cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
    cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from sized
"""

ORACLES: dict[str, str] = {
    "op11_conversation_repair": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op9_warc_revisits": OP9_SQL,
    "op3_ngram_join": OP3_SQL,
}
