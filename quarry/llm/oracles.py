"""SQL (DuckDB's) of the corpus queries that SQL can express."""

from __future__ import annotations

from .embeddings import MIN_COSINE
from .quality import CLASSES, COMMON, GUARD_WORDS, JOINT_CHARACTER_DIVERGENCE, JOINT_WORD_DIVERGENCE, MAX_CHARACTER_DIVERGENCE, MAX_REPEATED_PERCENT, MIN_WORDS
from .substrings import WINDOW

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
p as (select doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as i from w where len(ws) >= {WINDOW}),
m as (select doc_id, i, min(doc_id) over (partition by array_to_string(ws[i:i + {WINDOW - 1}], ' ')) as first from p),
c as (select distinct doc_id, i + j as at from m, (select unnest(generate_series(0, {WINDOW - 1})) as j) where first < doc_id),
e as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as at from w),
k as (select e.doc_id, string_agg(word, ' ' order by e.at) as kept, count(*) as n from e anti join c on e.doc_id = c.doc_id and e.at = c.at group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""

_LENGTHS = {k: f"length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for k, p in CLASSES.items()}
_BINS = ", ".join(f"('{lang}', {k + 1}, '{word}')" for lang, words in COMMON.items() for k, word in enumerate(words))
_PART = "case when {a} > 0 then 0.5 * {a} * log2(2 * {a} / ({a} + {b})) else 0 end"


def _divergence(p: str, q: str) -> str:
    return f"sum({_PART.format(a=p, b=q)} + {_PART.format(a=q, b=p)})"


OP7 = f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (
  select doc_id, lang, {_WORDS} as ws, length(text) as n_all, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    {", ".join(f"{v} as c_{k}" for k, v in _LENGTHS.items())}
  from d
),
t as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where len(ws) > 2)),
r as (select doc_id, count(distinct i + j) as n_repeat_words from t, (select unnest([0, 1, 2]) as j) where n > 1 group by 1),
bins(lang, k, word) as (values {_BINS}),
e as (select doc_id, lang, unnest(ws) as word from w where len(ws) >= {GUARD_WORDS}),
h as (select e.doc_id, e.lang, coalesce(k, 0) as k, count(*) as n from e left join bins on e.lang = bins.lang and e.word = bins.word group by 1, 2, 3),
wp as (select h.doc_id, h.lang, k, n / len(ws) as p from h join w on h.doc_id = w.doc_id),
full_docs as (select doc_id, lang from w where len(ws) >= {GUARD_WORDS}),
n_full as (select lang, count(*) as n from full_docs group by 1),
wq as (select wp.lang, k, sum(p) / any_value(n) as q from wp join n_full on wp.lang = n_full.lang group by 1, 2),
wd as (
  select f.doc_id, {_divergence("coalesce(p, 0.0)", "q")} as v
  from full_docs f join wq on f.lang = wq.lang left join wp on wp.doc_id = f.doc_id and wp.k = wq.k group by 1
),
cp as (
  select doc_id, lang, unnest([{", ".join(f"c_{k}" for k in CLASSES)}, n_all - {" - ".join(f"c_{k}" for k in CLASSES)}]) / n_all as p, unnest(generate_series(1, {len(CLASSES) + 1})) as k
  from w where len(ws) >= {GUARD_WORDS}
),
cq as (select lang, k, avg(p) as q from cp group by 1, 2),
cd as (select doc_id, {_divergence("p", "q")} as v from cp join cq on cp.lang = cq.lang and cp.k = cq.k group by 1),
b as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(c_symbol as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, cd.v as cv, wd.v as wv
  from w left join r on w.doc_id = r.doc_id left join cd on w.doc_id = cd.doc_id left join wd on w.doc_id = wd.doc_id
),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(cv, 0) > {MAX_CHARACTER_DIVERGENCE} or coalesce(cv, 0) > {JOINT_CHARACTER_DIVERGENCE} and coalesce(wv, 0) > {JOINT_WORD_DIVERGENCE}) as kept,
  round(cv, 6) as character_divergence, round(wv, 6) as word_divergence
from f
"""

OP8 = f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach(u, v) as (select vec_id, vec_id from embeddings union select reach.u, links.v from reach join links on reach.v = links.u),
c as (select u, min(v) as component_id from reach group by 1),
n as (select u, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join c on vec_id = c.u left join n on vec_id = n.u
"""
