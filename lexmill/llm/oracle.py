"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from .quality import GRIDS, STEPS, SYMBOLS

SPACE = "[\\x20\\x09-\\x0D]+"

_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"
_CELLS = ", ".join(f"({step}, '{rule}', {GRIDS[rule][level]})" for step, (level, left_out) in enumerate(STEPS) for i, rule in enumerate(GRIDS) if i != left_out)
_RISK, _CONFIDENCE = 0.01, 0.95

OP2 = """
with sizes as (select coalesce(source, '') as s, source is null as sn, sum(length(coalesce(text, ''))) as chars from documents group by all),
rates as (
  select s, sn, (sqrt(chars::double) / sum(sqrt(chars::double)) over ()) * sum(chars) over () / chars as rate from sizes where chars > 0),
terms as (select s, sn, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k, rate from rates),
steps as (
  select s, sn, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by s, sn order by k) as cdf from terms),
units as (
  select doc_id, source, text, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u from documents),
counted as (
  select doc_id, source, any_value(text) as text, count(*) filter (cdf <= u) as n_copies
  from units join steps on s = coalesce(source, '') and sn = (source is null) group by doc_id, source, u),
copies as (select *, unnest(range(1, n_copies + 1)) as copy_no from counted where n_copies > 0)
select doc_id, source, copy_no, n_copies, md5('mix-1:order:' || coalesce(doc_id::varchar, '') || ':' || copy_no) as mix_key, sha256(coalesce(text, '')) as text_sha256
from copies
"""

OP3 = f"""
with w as (
  select doc_id, lang, coalesce(text, '') as t, {_WORDS} as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5),
twins as (
  select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) as n from starts),
covered as (select distinct doc_id, unnest(range(i, i + 5)) as p from twins where n > 1),
repeats as (select doc_id, count(*) as n from covered group by doc_id),
base as (
  select w.doc_id, lang, len(words) as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols, len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
         len(list_filter(words, lambda x: x like '%!!')) as shouts, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) as upper,
         length(t) - length(translate(t, '0123456789', '')) as digits
  from w left join repeats r using (doc_id)),
features as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, coalesce(lang, '') as stratum,
    map {{'symbol_pct': coalesce(n_symbols * 100.0::double / nullif(word_chars, 0), 0), 'shout_pct': coalesce(shouts * 100.0::double / nullif(n_words, 0), 0),
          'upper_pct': coalesce(upper * 100.0::double / nullif(word_chars, 0), 0), 'dup_line_pct': coalesce(n_dup_lines * 100.0::double / nullif(n_lines, 0), 0),
          'repeat_pct': coalesce(n_repeat_words * 100.0::double / nullif(n_words, 0), 0), 'digit_pct': coalesce(digits * 100.0::double / nullif(word_chars, 0), 0)}} as f
  from base),
cells(step, rule, cutoff) as (values {_CELLS}),
rejected as (select distinct doc_id, step from features, cells where f[rule] > cutoff),
clean as (select doc_id, stratum from features where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
totals as (select stratum, count(*) as n from clean group by all),
wrongs as (select stratum, step, count(*) as wrong from clean join rejected using (doc_id) group by all),
counts as (
  select stratum, n, s.step, coalesce(wrong, 0) as wrong
  from totals cross join (select distinct step from cells) s left join wrongs w using (stratum, step)),
tested as (
  select *, count(*) over () as tests,
    list_sum(list_transform(range(0, wrong + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) as tail
  from counts),
chosen as (select stratum, min(step) as step from tested where wrong <= n * {_RISK} and tail <= (1 - {_CONFIDENCE}) / tests group by all),
failed as (select distinct doc_id from features join chosen using (stratum) join rejected using (doc_id, step))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from failed) as kept from features
"""

OP5 = """
with recursive messages as (select distinct conv_id, turn, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
lines as (
  select conv_id, turn, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from messages),
marked as (
  select *, regexp_extract(line, '^[ \\t]*((?:>[ \\t]?)+)', 1) as marks,
         lower(trim(regexp_replace(regexp_replace(line, '^[ \\t]*((?:>[ \\t]?)+)', ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) as content from lines),
leveled as (select *, length(marks) - length(replace(marks, '>', '')) as level from marked),
starts as (
  select *, content <> '' and (lag(content) over w is null or lag(content) over w = '' or lag(level) over w <> level) as begins
  from leveled window w as (partition by conv_id, turn, text order by pos)),
numbered as (select *, count(*) filter (begins) over (partition by conv_id, turn, text order by pos) as run from starts),
runs as (
  select conv_id, turn, text, run, level, string_agg(content, ' ' order by pos) as whole, list(content) as contents
  from numbered where content <> '' group by all),
units as (
  select conv_id, turn, text, run, level, 0 as kind, whole as unit from runs
  union all select conv_id, turn, text, run, level, 1, unnest(string_split(regexp_replace(whole, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) from runs
  union all select conv_id, turn, text, run, level, 2, unnest(contents) from runs),
origins as (select conv_id, unit, min(turn) as origin from units where level = 0 group by all),
quoted as (
  select u.conv_id, u.turn, u.text, u.run, u.level, min(case when origin < u.turn then {'k': kind, 'o': origin} end).o as origin
  from units u left join origins o on o.conv_id = u.conv_id and o.unit = u.unit where u.level > 0 group by all),
links as (
  select conv_id, turn, count(*) as n_quoted, max(level) as max_quote_level, count(origin) as n_linked,
         max(case when origin is not null then {'l': -level, 'o': origin} end).o as origin from quoted group by all),
bodies as (
  select c.conv_id, c.turn, c.role,
         trim(array_to_string(list_filter(string_split(coalesce(c.text, ''), chr(10)), lambda x: not regexp_matches(x, '^[ \\t]*((?:>[ \\t]?)+)')), chr(10))) as body from conversations c),
formatted as (
  select distinct b.conv_id, b.turn, '<|' || coalesce(b.role, '') || '|>' || chr(10) || body as formatted,
         coalesce(l.origin, p.turn) as reply_to, coalesce(n_quoted, 0) as n_quoted, coalesce(n_linked, 0) as n_linked
  from bodies b left join links l using (conv_id, turn)
  left join (select distinct conv_id, turn from messages) p on p.conv_id = b.conv_id and p.turn = b.turn - 1),
turns as (select distinct conv_id, turn, reply_to from formatted where conv_id is not null and turn is not null),
chained as (
  select *, max(case when reply_to is null or reply_to <> turn - 1 then turn end) over (partition by conv_id order by turn) as chain from turns),
paths as (
  select conv_id, turn as chain, [{'off': 0::bigint, 'turn': turn}] as path from chained where turn = chain and reply_to is null
  union all select h.conv_id, h.turn, p.path || [{'off': -h.reply_to, 'turn': h.turn}]
  from paths p join chained t on t.conv_id = p.conv_id and t.chain = p.chain
  join chained h on h.conv_id = t.conv_id and h.reply_to = t.turn and h.turn = h.chain),
placed as (
  select f.*, row_number() over (partition by f.conv_id order by p.path nulls first, f.turn nulls first, formatted, f.reply_to nulls first) - 1 as place
  from formatted f left join chained c on c.conv_id = f.conv_id and c.turn = f.turn left join paths p on p.conv_id = c.conv_id and p.chain = c.chain)
select conv_id, place // 256 as segment, count(*) as n_messages, sum(n_quoted)::bigint as n_quoted, sum(n_linked)::bigint as n_linked,
       string_agg(coalesce(turn::varchar, '-') || '>' || coalesce(reply_to::varchar, '-'), ' ' order by place) as replies,
       string_agg(formatted, chr(10) order by place) as text
from placed group by conv_id, place // 256
"""

OP6 = """
with lines as (
  select doc_id, coalesce(source, chr(0)) as site, string_split(coalesce(text, ''), chr(10)) as ls from documents),
rows as (select doc_id, site, ls, unnest(range(1, len(ls) + 1)) as pos from lines),
held as (select doc_id, site, pos, ls[pos] as line, trim(ls[pos]) as t from rows),
spread as (select t from held where t <> '' group by t having count(distinct site) >= 8),
gone as (select doc_id, pos from held where t in (select t from spread))
select h.doc_id, count(*) filter (t <> '') as n_lines, count(g.pos) as n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) order by h.pos) filter (g.pos is null), '')) as kept_sha256
from held h left join gone g on g.doc_id = h.doc_id and g.pos = h.pos group by h.doc_id
"""

OP7 = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
"""

#: crc32 of a string's bytes, a byte at a time: the polynomial is divided by in the list of 256 remainders.
_CRC = """
remainders as (
    select list(r order by b) as held from (
        select b, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, b) as r from range(0, 256) t(b)))
"""
OP12 = f"""
with recursive {_CRC},
runs as (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents),
counted as (select doc_id, run, count(*) as times from runs group by all),
coded as (
    select run, times, xor(4294967295::bigint, list_reduce(
        list_transform(range(0, octet_length(encode(doc_id || ':' || run))), lambda i: ('0x' || hex(encode(doc_id || ':' || run))[2 * i + 1 : 2 * i + 2])::bigint),
        lambda c, b: xor(c >> 8, held[xor(c & 255, b) + 1]), 4294967295::bigint)) as h
    from counted, remainders),
words as (
    select word, sum(times)::bigint as n from (
        select case when h % 97 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, times from coded)
    where length(word) >= 5 group by word having sum(times) >= 3),
cuts as (select word, n, i, word[1 : i] || word[i + 2 :] as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (
    select a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cuts a join words b on a.rest = b.word),
top as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from near group by word),
forms as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when t.form_n >= 2 * w.n then t.form end as form, case when t.form_n >= 2 * w.n then t.form_n end as form_n
    from words w left join top t using (word)),
steps as (
    select word, form as latest, 1 as step from forms where form is not null
    union all select s.word, f.form, step + 1 from steps s join forms f on f.word = s.latest where f.form is not null),
last as (select word, arg_max(latest, step) as root from steps group by word)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from forms f left join last l on l.word = f.word
"""

OP13 = """
with texts as (
    select row_number() over () as t, coalesce(lang, 'und') as lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as held
    from documents),
pieces as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as words from (select lang, unnest(held) as piece from texts)),
totals as (select lang, sum(len(words))::bigint as n from pieces group by lang),
grams as (
    select lang, size, array_to_string(words[i : i + size - 1], ' ') as phrase from (
        select lang, words, size, unnest(range(1, len(words) - size + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as size))),
frequent as (select lang, size, phrase, count(*)::bigint as a from grams group by all having count(*) >= 30),
cuts as (
    select lang, phrase, size, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as part, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as rest
    from (select *, unnest(range(1, size)) as k from frequent where size > 1)),
scored as (
    select c.lang, c.phrase, c.a, l.a as l, r.a as r, ((2000000::hugeint * c.a) // (l.a::hugeint + r.a))::bigint as score
    from cuts c join frequent l on l.lang = c.lang and l.phrase = c.part join frequent r on r.lang = c.lang and r.phrase = c.rest
    qualify row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (l.a::hugeint + r.a), c.k) = 1),
inner_phrases as (
    select lang, array_to_string(string_split(phrase, ' ')[s : s + m - 1], ' ') as phrase, max(a) as longer from (
        select *, unnest(range(1, size - m + 2)) as s from (select *, unnest(range(2, size)) as m from frequent where size > 2))
    group by all),
kept as (
    select s.* from scored s left join inner_phrases i on i.lang = s.lang and i.phrase = s.phrase
    where i.longer is null or 100::hugeint * i.longer < 80::hugeint * s.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept k join totals t on t.lang = k.lang
qualify rank <= 2000
"""

ORACLE_SQL = {"op2_mixing": OP2, "op3_quality": OP3, "op5_chat_format": OP5, "op6_line_dedup": OP6, "op7_exact_dedup": OP7, "op12_spelling": OP12, "op13_collocations": OP13}
