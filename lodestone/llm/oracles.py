"""The queries that SQL can express, as SQL for DuckDB."""

SQL = {}

SQL["op1_decontamination"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
), item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark
), s as (
  select doc_id, i - 1 as p, array_to_string(w[i : i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words)
), t as (
  select item_id, i - 1 as q, array_to_string(w[i : i + 4], ' ') as sh from (select item_id, w, unnest(range(1, len(w) - 3)) as i from item_words)
), sizes as (
  select item_id, count(*) as n from t group by 1
), lengths as (
  select doc_id, count(*) as m from s group by 1
), windows as (
  select distinct s.doc_id, t.item_id, s.p - t.q as start_word, n
  from s join t using (sh) join sizes using (item_id) join lengths using (doc_id)
  where s.p >= t.q and s.p - t.q + n <= m
), own as (
  select v.doc_id, v.item_id, v.start_word, any_value(v.n) as n, s.sh, count(*) as cw
  from windows v join s on s.doc_id = v.doc_id and s.p >= v.start_word and s.p < v.start_word + v.n
  group by 1, 2, 3, 5
), counts as (
  select item_id, sh, count(*) as ci from t group by 1, 2
), judged as (
  select doc_id, item_id, start_word, sum(least(cw, ci)) / (2 * any_value(n) - sum(least(cw, ci))) as similarity
  from own join counts using (item_id, sh) group by 1, 2, 3
)
select doc_id, item_id, round(similarity, 6) as similarity, start_word from judged where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start_word) = 1
"""

SQL["op6_line_dedup"] = r"""
with parts as (
  select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][!-/:-@\[-`{-~]*[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*)', '\1' || chr(57344), 'g'), chr(57344)) as p from documents
), worded as (
  select doc_id, p, list_transform(p, lambda x: regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+')) as w from parts
), numbered as (
  select doc_id, i, p[i] as part, len(w[i]) as n from (select doc_id, p, w, unnest(range(1, len(p) + 1)) as i from worded)
), sized as (
  select *, sum(n) over (partition by doc_id order by i) as upto, cast(sum(length(part)) over (partition by doc_id order by i) as bigint) as stop from numbered
), bounds as (
  select a.doc_id, a.i, b.i as j from (select *, upto - n + 20 as wanted from sized where n > 0) a
  asof join (select * from sized where n > 0) b on a.doc_id = b.doc_id and a.wanted <= b.upto
), units as (
  select doc_id, i, j, flatten(w[i : j]) as words from bounds join worded using (doc_id)
), ranked as (
  select doc_id, i, j, row_number() over (partition by array_to_string(words, ' ') order by doc_id, i) > 1 as again from units where len(list_distinct(words)) >= 10
), gone as (
  select distinct doc_id, i from (select doc_id, unnest(range(i, j + 1)) as i from ranked where again)
), judged as (
  select s.*, g.i is not null as gone from sized s left join gone g on s.doc_id = g.doc_id and s.i = g.i
), runs as (
  select doc_id, min(stop - length(part)) as a, max(stop) as z
  from (select *, i - row_number() over (partition by doc_id order by i) as run from judged where gone) group by doc_id, run
), spans as (
  select doc_id, string_agg(a || '-' || z, ',' order by a) as spans from runs group by doc_id
)
select doc_id,
  cast(sum(case when gone then length(part) else 0 end) as bigint) as n_removed,
  sha256(coalesce(string_agg(part, '' order by i) filter (where not gone), '')) as kept_sha256,
  coalesce(any_value(spans), '') as spans
from judged left join spans using (doc_id) group by doc_id
"""

SQL["op9_chat_template"] = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) as bigint) as formatted_chars
from turns group by conv_id
"""
