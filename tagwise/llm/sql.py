"""DuckDB twins of the queries that SQL can express."""

import re

QUALITY_RULES = r"""
with tokens as (
    select doc_id, lang, source, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents
), windows as (
    select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as win
    from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from tokens where len(w) >= 8)
), twice as (
    select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1
), covered as (
    select doc_id, count(distinct i + k) as n from twice, (select unnest(generate_series(0, 7)) as k) group by doc_id
), base as (
    select t.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words
    from tokens t left join covered c using (doc_id)
), rates as (
    select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol_rate,
        1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_rate,
        1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate,
        10 * word_chars // greatest(n_words, 1) as word_length,
        n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
    from base
), long as (
    select doc_id, lang, source, base_failed, rate, v from rates
    unpivot (v for rate in (symbol_rate, dup_line_rate, repeat_rate, word_length))
), placed as (
    select *, case when v < 64 then v else ((v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6)) end as low from long
), quart as (
    select rate, lang, source, count(*) as n, count(*) filter (low > 0) as others,
        quantile_disc(low, 0.25) as q1, quantile_disc(low, 0.75) as q3,
        quantile_disc(low, 0.95) filter (low > 0) as top, grouping(lang, source) as lvl
    from placed where not base_failed group by grouping sets ((rate, lang, source), (rate, lang), (rate))
), fence as (
    select *, case when 2 * others > n then n >= 50 else others >= 40 end as enough,
        case when 2 * others > n and rate = 'word_length' then q1 - 3 * (q3 - q1) - 1 end as lo,
        case when 2 * others > n then q3 + 3 * (q3 - q1) + 1 else top end as hi
    from quart
), verdict as (
    select p.doc_id, bool_or(coalesce(p.low > case when a.enough then a.hi when b.enough then b.hi else c.hi end, false)
        or coalesce(p.low < case when a.enough then a.lo when b.enough then b.lo else c.lo end, false)) as out
    from placed p
    left join fence a on a.lvl = 0 and a.rate = p.rate
        and a.lang is not distinct from p.lang and a.source is not distinct from p.source
    left join fence b on b.lvl = 1 and b.rate = p.rate and b.lang is not distinct from p.lang
    left join fence c on c.lvl = 3 and c.rate = p.rate
    group by p.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not out as kept, symbol_rate, dup_line_rate, repeat_rate, word_length
from rates join verdict using (doc_id)
"""

# DuckDB has no CRC-32; the checksum is worked out over the bytes, eight shifts each, with the usual reflected polynomial.
SHARDING = r"""
with crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i::bigint, generate_series(1::bigint, 8)),
            lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
        from (select unnest(generate_series(0, 255)) as i)
    )
), keyed as (
    select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size, coalesce(text, '') as text,
        ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as k1,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k2
    from documents
), crcs as (
    select *, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(text)), '..')]),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
    from keyed, crc_table
), placed as (
    select *, (24 * coalesce(sum(size) over (order by k1, k2 range between unbounded preceding and current row exclude group), 0)
        // sum(size) over ())::integer as shard
    from crcs
)
select doc_id, size, text_crc32, 'bytes' as law, shard,
    row_number() over (partition by shard order by xor(k1, k2), k1, k2, doc_id) - 1 as slot, null::integer as grown_shard
from placed
"""


def secrets(rules: tuple, base: tuple[str, ...]) -> str:
    """The spans of every rule, found on all texts without an index; its matcher knows no possessive repeats."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    greedy = lambda pattern: quoted(re.sub(r"([*+?}])\+", r"\1", pattern))
    each = "\nunion all\n".join(
        f"""select doc_id, {r} as place, {quoted(rule.kind)} as kind, {rule.least} as least,
        regexp_extract_all(text, {greedy(rule.pattern)}) as m,
        regexp_extract_all(text, {greedy(rule.pattern)}, {rule.group}) as g,
        string_split_regex(text, {greedy(rule.pattern)}) as between
        from texts"""
        for r, rule in enumerate(rules)
    )
    of_base = f"kind in ({', '.join(map(quoted, base))})"
    told = "string_agg(kind || ':' || s || ':' || e, ',' order by s, place)"
    counts = ", ".join(f"count(*) filter (kind = {quoted(k)}) as n_{k}" for k in base)
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents), found as (
{each}
), numbered as (
    select *, unnest(generate_series(1, len(m))) as i from found where len(m) > 0
), spans as (
    select doc_id, place, kind, s, s + length(m[i]) as e from (
        select *, (length(array_to_string(between[1:i], '')) + length(array_to_string(m[1:i - 1], '')))::bigint as s from numbered
    ) where length(g[i]) >= least
)
select t.doc_id, {counts}, sha256(coalesce({told} filter ({of_base}), '')) as base_sha256,
    coalesce({told} filter (kind is not null), '') as spans
from texts t left join spans using (doc_id) group by t.doc_id
"""


def mixing(weights: dict, share: float, max_epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" when '{k}' then {float(v)}" for k, v in sorted(weights[level].items()))
        return f"case {level}{cases} else 1.0::double end" if cases else "1.0::double"

    def shared(name: str, source: str, path: str, parents: str, level: str) -> str:
        return f"""{name}_ranked as (
    select *, {weight(level)}::double as w, capacity / ({weight(level)})::double as ratio from ({source})
), {name}_full as (
    select *, sum(capacity) over (partition by {parents} order by ratio)
        + ratio * (sum(w) over (partition by {parents}) - sum(w) over (partition by {parents} order by ratio)) <= given as f
    from {name}_ranked
), {name} as (
    select {path}, (case when f then capacity else floor(
        (given - sum(case when f then capacity else 0 end) over (partition by {parents}))::double
        / sum(case when f then 0.0 else w end) over (partition by {parents})::double * w) end)::bigint as given
    from {name}_full
)"""

    first = f"""select *, least(sum(capacity) over (),
        floor(sum(capacity) over ()::double / {max_epochs} * {share}::double)::bigint) as given
        from (select domain, (sum(tokens) * {max_epochs})::bigint as capacity from leaves group by domain)"""
    second = f"""select l.*, given from (select domain, lang, (sum(tokens) * {max_epochs})::bigint as capacity
        from leaves group by domain, lang) l join domains using (domain)"""
    third = f"""select l.domain, l.lang, l.source, (tokens * {max_epochs})::bigint as capacity, given
        from leaves l join langs using (domain, lang)"""
    return f"""
with crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i::bigint, generate_series(1::bigint, 8)),
            lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
        from (select unnest(generate_series(0, 255)) as i)
    )
), sources as (
    select source, 'domain' || (xor(list_reduce(list_prepend(4294967295::bigint,
        [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(source)), '..')]),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4)::varchar as domain
    from (select distinct coalesce(source, '') as source from documents), crc_table
), texts as (
    select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
    from documents
), rows as (
    select * from texts join sources using (source)
), leaves as (
    select domain, lang, source, sum(n_tokens)::bigint as tokens from rows group by all
), {shared("domains", first, "domain", "1", "domain")},
{shared("langs", second, "domain, lang", "domain", "lang")},
{shared("plan", third, "domain, lang, source", "domain, lang", "source")},
keyed as (
    select r.*, (p.given // l.tokens)::integer as epochs, p.given % l.tokens as rest,
        ('0x' || substr(md5({seed} || ':' || (p.given // l.tokens) || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
    from rows r join leaves l using (domain, lang, source) join plan p using (domain, lang, source) where l.tokens > 0
), placed as (
    select *, sum(n_tokens) over (partition by domain, lang, source order by k) <= rest as more from keyed
)
select doc_id, domain, lang, source, n_tokens, unnest(generate_series(0, epochs - case when more then 0 else 1 end))::integer as epoch
from placed
"""


CHAT_FORMAT = r"""
with recursive calls as (
    select *, row_number() over (partition by conv_id, call_id order by turn) as occ,
        count(*) over (partition by conv_id, call_id) as same
    from (
        select conv_id, turn, length(coalesce(text, '')) as n, mark, to_json(coalesce(text, ''))::varchar as q,
            case when mark % 5 = 0 then 'call_' || conv_id || '_s' else 'call_' || conv_id || '_' || turn end as call_id,
            (['lookup', 'measure', 'remind', 'dance'])[length(coalesce(text, '')) % 4 + 1] as name
        from (select *, ('0x' || substr(md5(coalesce(text, '')), 1, 4))::bigint as mark from conversations where role = 'assistant')
    )
), results as (
    select *, row_number() over (partition by conv_id, call_id order by turn) as occ from (
        select r.conv_id, r.turn, coalesce(c.call_id, 'call_' || r.conv_id || '_' || (r.turn - 1)) as call_id, r.text as content
        from conversations r left join calls c on c.conv_id = r.conv_id and c.turn = r.turn - 1
        where r.role = 'user' and r.turn > 0
    )
), named as (
    select distinct conv_id, call_id, occ, before from (
        select conv_id, call_id, occ, 'call_' || conv_id || '_' || (turn // 2) as before from calls where turn // 2 <> turn
        union all select conv_id, call_id, occ, 'call_' || conv_id || '_' || (turn + 2) from calls where mark % 3 = 0
        union all select conv_id, call_id, occ, 'call_' || conv_id || '_s' from calls where mark % 4 = 1
        union all select conv_id, call_id, occ, 'call_' || conv_id || '_' || turn from calls where mark % 11 = 0
    )
), edges as (
    select x.conv_id, x.call_id, x.occ, p.call_id as p_id, p.occ as p_occ, p.turn as p_turn from named x join calls p
    on p.conv_id = x.conv_id and p.call_id = x.before
        and p.occ = case when x.before = x.call_id and x.occ > 1 then x.occ - 1 else least(x.occ, p.same) end
), walks as (
    select conv_id, call_id, occ, call_id as to_id, occ as to_occ, 0 as steps, turn as latest, [call_id || ' ' || occ] as path,
        false as again
    from calls
    union all
    select w.conv_id, w.call_id, w.occ, e.p_id, e.p_occ, steps + 1, greatest(latest, e.p_turn),
        list_append(path, e.p_id || ' ' || e.p_occ), list_contains(path, e.p_id || ' ' || e.p_occ)
    from walks w join edges e on e.conv_id = w.conv_id and e.call_id = w.to_id and e.occ = w.to_occ where not again
), depths as (
    select conv_id, call_id, occ, max(steps) as depth, max(latest) as due from walks group by all having not bool_or(again)
), tools as (
    select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as turn, coalesce(c.call_id, r.call_id) as call_id,
        coalesce(c.occ, r.occ) as occ, coalesce(d.due, c.turn, r.turn) as due, depth::integer as depth, name,
        to_json(content)::varchar as content,
        case when c.conv_id is null then 'no call' when r.conv_id is null then 'no result' else 'linked' end as status,
        case when c.conv_id is null then null when n % 7 = 0 then 'not JSON' when name = 'dance' then 'unknown tool'
            when name = 'remind' then 'unknown loud' when name = 'lookup' and n % 5 = 0 then 'limit is not integer' else '' end as errors,
        case when n % 7 = 0 then null
            when name = 'lookup' then '{"limit":' || case when n % 5 = 0 then '"all"' else n::varchar end || ',"query":' || q || '}'
            when name = 'measure' then '{"chars":' || n || ',"unit":"m"}'
            else '{"loud":true,"minutes":5,"note":' || q || '}' end as arguments
    from calls c full join results r on r.conv_id = c.conv_id and r.call_id = c.call_id and r.occ = c.occ
    left join depths d on d.conv_id = c.conv_id and d.call_id = c.call_id and d.occ = c.occ
), nodes as (
    select conv_id, turn, turn as due, 0 as place, null::varchar as call_id, null::bigint as occurrence, null::integer as depth,
        null::varchar as status, null::varchar as errors,
        '{' || concat_ws(',', '"content":' || to_json(text)::varchar, '"role":' || to_json(role)::varchar) || '}' as json
    from conversations
    union all
    select conv_id, turn, due, case when status = 'no call' then 2 else 1 end, call_id, occ, depth, status, errors,
        '{' || concat_ws(',', '"arguments":' || arguments, '"call":"' || call_id || '"', '"name":"' || name || '"',
            '"result":' || content) || '}'
    from tools
)
select conv_id, row_number() over (partition by conv_id
        order by due, place, depth nulls last, md5(json), json, turn, call_id, occurrence) - 1 as position, turn,
    (['message', 'call', 'result'])[place + 1] as kind, call_id, occurrence, depth, status, errors, json
from nodes
"""


COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), listed as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
    select lang, sum(len(w))::bigint as n from listed group by lang
), f as (
    select lang, size, phrase, count(*) as f from (
        select lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase from (
            select lang, w, size, unnest(generate_series(1, len(w) - size + 1)) as i
            from listed, (select unnest(generate_series(1, 4)) as size) where len(w) >= size
        )
    ) group by lang, size, phrase
), candidates as (
    select *, string_split(phrase, ' ') as w, f as a from f where size > 1 and f >= 30
), cuts as (
    select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
    from (select *, unnest(generate_series(1, size - 1)) as k from candidates) c
    join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
    join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
    select lang, array_to_string(w[i:i + n - 1], ' ') as phrase, max(a) as longer from (
        select lang, w, a, size, n, unnest(generate_series(1, size - n + 1)) as i
        from candidates, (select unnest(generate_series(2, 3)) as n) where n < size
    ) group by all
), ranked as (
    select x.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from lowest x left join inside i using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

SPELLING = r"""
with crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i::bigint, generate_series(1::bigint, 8)),
            lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
        from (select unnest(generate_series(0, 255)) as i)
    )
), runs as (
    select doc_id, run, count(*) as n from (
        select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
        from documents
    ) group by all
), marked as (
    select run, n, xor(list_reduce(list_prepend(4294967295::bigint,
            [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..')]),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
    from runs, crc_table
), words as (
    select word, sum(n)::bigint as n from (
        select n, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
        from marked
    ) where length(word) >= 7 group by word having sum(n) >= 2
), holes as (
    select word, i, substr(word, 1, i - 1) as before, substr(word, i + 1) as behind
    from (select word, unnest(generate_series(1, length(word))) as i from words)
), shorter as (
    select distinct h.word as long, w.word as short from holes h join words w on w.word = h.before || h.behind
), pairs as (
    select a.word, b.word as other from holes a join holes b using (i, before, behind) where a.word <> b.word
    union select long, short from shorter union select short, long from shorter
), near as (
    select p.word, count(*) as n_near, arg_min(p.other, (-o.n, p.other)) as best, max(o.n) as best_n
    from pairs p join words o on o.word = p.other group by p.word
), known as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form,
        case when best_n >= 10 * w.n then best_n end as form_n
    from words w left join near using (word)
), roots as (
    with recursive up(word, root) as (
        select word, form from known where form is not null
        union all select up.word, k.form from up join known k on k.word = up.root where k.form is not null
    )
    select word, root from up where root not in (select word from known where form is not null)
)
select word, form, coalesce(root, word) as root, n, n_near, form_n from known left join roots using (word)
"""
