"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[TEXT\]|\[/TEXT\]"

CHAT = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(regexp_replace(text, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) as body,
         length(regexp_replace(role, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) as name
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(body + case role when 'user' then 16 when 'assistant' then 10 else name + 24 end)::bigint as formatted_chars,
       count(*) filter (role = 'assistant') as n_examples
from sized group by conv_id
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""

JACCARD = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), named as (select doc_id, md5(array_to_string(list_sort(s), chr(10))) as k, s from sets where len(s) > 0),
distinct_sets as (select k, min(doc_id) as d, any_value(s) as s from named group by k),
tokens as (select d, len(s) as n, unnest(s) as t from distinct_sets),
pairs as (
  select a.d as a, b.d as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from tokens a join tokens b on a.t = b.t and a.d < b.d group by a.d, b.d
), links as (
  select a, b from pairs where 100 * c >= 80 * (na + nb - c)
  union select b, a from pairs where 100 * c >= 80 * (na + nb - c)
), reach as (
  select d as node, d as other from distinct_sets
  union select r.node, l.b from reach r join links l on l.a = r.other
), least as (select node, min(other) as component_id from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(l.component_id, s.doc_id) as component_id
from sets s left join named n using (doc_id) left join distinct_sets d on d.k = n.k left join least l on l.node = d.d
"""

_URL = r"""
parts as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?:.*?)://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?:.*?)://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
), named as (
  select *, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') as domain,
         string_split(host, '.')[-1] as suffix from parts
)"""

_FIT = """greatest(2.0, least(1000.0, case when {spread} > {chance}
  then {mean} * (1 - {mean}) / ({spread} - {chance}) - 1 else 1000.0 end))"""


def _strength() -> str:
    mean, spread = "(sum(bad) / sum(n))", "(sum((bad / n) * (bad / n)) / count(*) - (sum(bad / n) / count(*)) * (sum(bad / n) / count(*)))"
    chance = f"({mean} * (1 - {mean}) * sum(1.0 / n) / count(*))"
    return _FIT.format(mean=mean, spread=spread, chance=chance)


URL_REPUTATION = f"""
with {_URL}, marks as (
  select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels group by doc_id
), outcomes as (
  select host, domain, suffix, bad from named join marks
  on doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*$', 1), '') as bigint)
), h as (select host, domain, suffix, count(*)::double as n, sum(bad)::double as bad from outcomes group by all),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from h group by all),
g as (select (sum(bad) + 1) / (sum(n) + 2) as mean, sum(n) + 2 as weight from h having sum(n) > 0),
s1 as (select suffix, (s.bad + k * g.mean) / (s.n + k) as mean, s.n + k as weight
       from s, g, (select {_strength()} as k from s)),
d1 as (select d.domain, (d.bad + k * s1.mean) / (d.n + k) as mean, d.n + k as weight
       from d join s1 using (suffix) join (select suffix, {_strength()} as k from d group by suffix) using (suffix)),
h1 as (select h.host, (h.bad + k * d1.mean) / (h.n + k) as mean, h.n + k as weight
       from h join d1 using (domain) join (select domain, {_strength()} as k from h group by domain) using (domain)),
judged as (
  select named.*, coalesce(h1.mean, d1.mean, s1.mean, g.mean) as mean,
         coalesce(h1.weight, d1.weight, s1.weight, g.weight) as weight,
         case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
              when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from named left join h1 using (host) left join d1 using (domain) left join s1 using (suffix) left join g on true
), bounded as (
  select *, coalesce(mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)), 0.0) as low from judged
)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when low > 0.25 then 'block' else 'allow' end as verdict,
       round(low, 9) as bad_rate_low
from bounded
"""

RULES = r"""
with split as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select r, i, array_to_string(w[i:i + 4], ' ') as five from (select r, w, unnest(range(1, len(w) - 3)) as i from split)
), covered as (
  select distinct r, i + k as place from (select r, i from windows qualify count(*) over (partition by r, five) > 1), range(5) as t(k)
), repeated as (select r, count(*) as n from covered group by r),
counted as (
  select doc_id, w, lines, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n, 0) as n_repeat_words
  from split left join repeated using (r)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         word_chars < 2 * n_words or word_chars > 12 * n_words
         or 10 * n_symbols > n_words
         or 10 * n_dup_lines > 3 * len(lines)
         or 5 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 4 * n_words
         or 10 * len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))) > 3 * n_words
         or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * len(lines)
         or list_has_any(list_transform(w, lambda x: lower(regexp_replace(x, '[^\p{L}]', '', 'g'))),
                         ['idiot', 'imbecile', 'moron', 'scumbag', 'worthless', 'clown', 'loser', 'dumbass']) as rejected
  from counted
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not rejected as kept
from judged
"""

def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
             for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


# The checksum's polynomial, bit by bit; ids hold ASCII characters only.
_CRC = """xor(4294967295::bigint, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda a, b: list_reduce(range(8), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end,
                           xor(a, b)), 4294967295::bigint))"""

MERKLE = f"""
with recursive leaves as (
  select r, doc_id, lang, leaf, tampered,
         row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n
  from (select row_number() over () as r, doc_id, lang, {_leaf("n_chars")} as leaf,
               case when {_CRC} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as tampered from documents)
), langs as (
  select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) over () as n_trees
  from (select distinct lang from leaves)
), placed as (
  select leaves.*, tree from leaves join langs on leaves.lang is not distinct from langs.lang
), nodes(tree, level, idx, n, h) as (
  select tree, 0, pos, n, leaf from placed
  union all
  select tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from nodes where n > 1
  group by tree, level, idx // 2, n
), subroots as (select tree, level as height, h as subroot from nodes where n = 1),
over_langs(level, idx, n, h) as (
  select 0, tree, n_trees, subroot from subroots join langs using (tree)
  union all
  select level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx)) from over_langs where n > 1
  group by level, idx // 2, n
), steps as (
  select r, lv.level as k, (pos >> lv.level) % 2 as odd, s.h as sibling
  from placed p join (select distinct tree, level from nodes where n > 1) lv using (tree)
  left join nodes s on s.tree = p.tree and s.level = lv.level and s.idx = xor(pos >> lv.level, 1)
  union all
  select r, height + lv.level, (p.tree >> lv.level) % 2, s.h
  from placed p join subroots using (tree) join (select distinct level from over_langs where n > 1) lv on true
  left join over_langs s on s.level = lv.level and s.idx = xor(p.tree >> lv.level, 1)
), proofs as (
  select r, sha256(coalesce(string_agg(sibling, '' order by k), '')) as proof_sha256, count(k) as height
  from placed left join steps using (r) group by r
), folds(r, k, h) as (
  select r, 0, tampered from placed
  union all
  select r, k + 1, sha256(case odd when 1 then sibling else '' end || h || case odd when 0 then coalesce(sibling, '') else '' end)
  from folds join steps using (r, k)
)
select doc_id, leaf, subroot, t.h as root, proof_sha256, f.h as folded_root, f.h = t.h as verified
from placed join subroots using (tree) join (select h from over_langs where n = 1) t on true
join proofs using (r) join folds f on f.r = placed.r and f.k = proofs.height
"""

LLM_ORACLE = {
    "op2_chat": CHAT,
    "op6_topk": TOP_K,
    "op9_url_reputation": URL_REPUTATION,
    "op10_jaccard": JACCARD,
    "op11_rules": RULES,
    "op12_merkle": MERKLE,
}
