"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import lines_rules

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where embedding is not null and label is not null),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93e0),
reach as (select a as vec_id, a as root from e union select e.b, reach.root from reach join e on e.a = reach.vec_id),
least as (select vec_id, min(root) as root from reach group by 1),
n as (select a as vec_id, count(*) as n from e group by 1)
select d.vec_id, coalesce(n.n, 0) as n_links, least(d.vec_id, coalesce(l.root, d.vec_id)) as component_id, d.vec_id = least(d.vec_id, coalesce(l.root, d.vec_id)) as kept
from embeddings d left join n using (vec_id) left join least l using (vec_id)"""

OP5 = f"""with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+{lines_rules.REPEAT_WINDOW - 1}], ' ') as k from w, unnest(range(1, len(ws) - {lines_rules.REPEAT_WINDOW - 2})) t(i)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
rep as (select doc_id, count(distinct j) as n from twice, unnest(range(i, i + {lines_rules.REPEAT_WINDOW})) u(j) group by 1),
l as (select doc_id, source, text, x as line, regexp_extract_all(x, {_WORD}) as lw from w, unnest(string_split(text, chr(10))) t(x)),
full_l as (select *, {_LOW.format("array_to_string(lw, ' ')")} as normal from l where len(lw) > 0),
dup as (select doc_id, count(*) - count(distinct line) as n from full_l group by 1),
common as (select source, normal from full_l group by 1, 2 having count(distinct doc_id) > {lines_rules.MAX_DOCS_PER_HOST}),
lost as (select doc_id, sum(len(lw)) as n from full_l f where exists (select 1 from common c where c.source is not distinct from f.source and c.normal = f.normal) group by 1),
c as (select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as n_removed_words
  from w left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < {lines_rules.MIN_WORDS} or 100 * n_repeat_words > {lines_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from c)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed,
  not base_failed and 100 * (n_words - n_removed_words) >= {lines_rules.MIN_KEPT_PERCENT} * n_words as kept from f"""

OP10 = f"""with recursive w as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORD}) as ws from documents),
s as (select distinct doc_id, case when len(ws) >= 3 then array_to_string(ws[i:i+2], ' ') else array_to_string(ws, ' ') end as k from w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a as doc_id, a as root from e union select e.b, reach.root from reach join e on e.a = reach.doc_id),
r as (select doc_id, min(root) as root from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(r.root, d.doc_id)) as kept
from documents d left join n using (doc_id) left join r using (doc_id)"""

OP12 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as e
  from embeddings where embedding is not null and label is not null and len(list_filter(cast(embedding as double[]), lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
p as (select anchor_id, other as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 10"""
