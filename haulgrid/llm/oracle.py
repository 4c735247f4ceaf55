"""DuckDB SQL of the registered operators, where SQL can express them."""

from __future__ import annotations

from haulgrid.llm.licenses import HIDES, RULES, SENTENCES

EXACT = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, first(doc_id order by length(t) desc, doc_id) as keep_id from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256 from d join g using (norm)
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULES = (("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
select doc_id, '{kind}' as kind, {order} as o, gap_end + coalesce(m_before, 0) as s, gap_end + coalesce(m_before, 0) + length(m) as e
from (select doc_id, m, v, sum(length(g)) over w as gap_end, sum(length(m)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) as m_before
      from (select doc_id, generate_subscripts(ms, 1) as k, unnest(gs[1:len(ms)]) as g, unnest(ms) as m, unnest(vs) as v
            from (select doc_id, string_split_regex(t, '{pattern}') as gs, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as vs from d))
      window w as (partition by doc_id order by k))
where length(v) >= {least}"""


SECRETS = "with d as (select doc_id, coalesce(text, '') as t from documents), f as (" + " union all ".join(_matches(k, n, p, g, m) for n, (k, p, g, m) in enumerate(_RULES)) + """),
r as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, o) as spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join r using (doc_id)
"""

NEAR = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
n as (select doc_id, cast(len(sh) as bigint) as n from s),
t as (select doc_id, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from r group by 1)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c using (doc_id)
"""

_KNOWN = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
_LICENSES = sorted({name for name, _ in RULES})


def _rule(name: str) -> str:
    found = " or ".join("regexp_matches(ids, ',%s,')" % ",(?:[^,]+,)*".join(ids) for n, ids in RULES if n == name)
    hidden = "".join(f" and not ({_rule(w)})" for w, loser in HIDES if loser == name)
    return f"({found}){hidden}"


LICENSES = rf"""
with known(sentence, id) as (values {_KNOWN}),
parts as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[\n\r]+|[.!?;]+(?:[ \t]+|$)')) as s, generate_subscripts(string_split_regex(coalesce(text, ''), '[\n\r]+|[.!?;]+(?:[ \t]+|$)'), 1) as k from documents),
clean as (select doc_id, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as c from parts),
hits as (select doc_id, string_agg(id, ',' order by k) as sentence_ids, count(*) as n from clean join known on c = sentence group by doc_id),
d as (select doc_id, coalesce(n, 0) as n_sentences, coalesce(sentence_ids, '') as sentence_ids, ',' || coalesce(sentence_ids, '') || ',' as ids from documents left join hits using (doc_id))
select doc_id, n_sentences, sentence_ids, concat_ws(',', {", ".join(f"case when {_rule(n)} then '{n}' end" for n in _LICENSES)}) as licenses from d
"""

WARC = r"""
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as top from p where payload_bytes >= 1000 group by h)
select page_id, payload_bytes, payload_digest, case when page_id <> top then 'revisit' else 'response' end as record_type, case when page_id <> top then top end as refers_to
from p left join g using (h)
"""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
DECONTAMINATION = rf"""
with i as (select item_id, {_WORDS} as ws from benchmark),
win as (select distinct item_id, n, array_to_string(ws[k : k + n - 1], ' ') as g from (select item_id, ws, least(len(ws), 10) as n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as k from i where len(ws) > 0)),
lens as (select distinct n from win),
d as (select doc_id, {_WORDS} as ws from documents),
g as (select doc_id, k, n, array_to_string(ws[k : k + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, cast(len(ws) - n + 2 as bigint))) as k from d, lens where len(ws) >= n)),
m as (select g.doc_id, g.k, g.n, win.item_id from g join win on g.g = win.g and g.n = win.n),
h as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(k, k + n)) as word from m) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""

DIVERGENCE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
c as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(ts) as term from d) group by all),
k as (select lang, term, sum(n) as n from c group by lang, term having count(*) >= 30),
l as (select lang, cast(count(*) as hugeint) as v, sum(n) as total from k group by lang),
g as (select distinct lang, source from d),
s as (select lang, source, term, sum(c.n) as n from c join k using (lang, term) group by all),
t as (select lang, source, sum(n) as total from s group by all),
x as (select g.lang, g.source, k.term, coalesce(s.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(s.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) as p,
      1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
      from g join k using (lang) join l using (lang) left join s using (lang, source, term) left join t using (lang, source)),
pr as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pr.value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source
      union all select lang, source, 'term', term, p - q from x where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o) where part = 'pair' or rank <= 50
"""

COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, m, array_to_string(ws[k : k + m - 1], ' ') as ph from (select lang, ws, m, unnest(range(1, cast(len(ws) - m + 2 as bigint))) as k from w, (values (1), (2), (3), (4)) as t(m) where len(ws) >= m)),
f as materialized (select lang, m, ph, string_split(ph, ' ') as ws, a from (select lang, m, ph, count(*) as a from g group by all having count(*) >= 30)),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
t as (select lang, m, ph, a, k, array_to_string(ws[1 : k], ' ') as head, array_to_string(ws[k + 1 : m], ' ') as tail from f join (values (1), (2), (3)) as x(k) on k < m),
c as materialized (select t.lang, t.m, t.ph, t.a, k, lf.a as l, rf.a as r, (2000000::hugeint * t.a) // (lf.a + rf.a) as score
      from t join f lf on lf.lang = t.lang and lf.ph = head join f rf on rf.lang = t.lang and rf.ph = tail),
b as (select * from c qualify row_number() over (partition by lang, ph order by score, k) = 1),
s as (select lang, array_to_string(ws[o : o + q - 1], ' ') as ph, max(a) as longer from f, (values (1), (2), (3)) as x(o), (values (2), (3)) as y(q) where q < m and o + q - 1 <= m group by all),
o as (select b.lang, b.ph as phrase, b.a, b.l, b.r, cast(b.score as bigint) as score from b left join s on s.lang = b.lang and s.ph = b.ph where coalesce(100 * s.longer < 80 * b.a, true))
select o.lang, rank, phrase, a, l, r, n.n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o) o join n using (lang) where rank <= 2000
"""

ORACLE = {
    "op1_exact_dedup": EXACT,
    "op2_secret_scan": SECRETS,
    "op5_minhash_near_dedup": NEAR,
    "op7_license_scan": LICENSES,
    "op8_warc": WARC,
    "op9_decontamination": DECONTAMINATION,
    "op11_source_divergence": DIVERGENCE,
    "op13_collocations": COLLOCATIONS,
}
