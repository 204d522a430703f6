"""DuckDB SQL for the corpus queries that SQL can express."""

from touchline.llm import pii
from touchline.llm import quality_rules as rules
from touchline.llm.common import LOWER, UPPER
from touchline.llm.secret_scan import BASE_KINDS, RULES

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOWER = "lower(line)"
_PHRASES = " or ".join(f"contains({_LOWER}, {_quoted(text)})" for text in rules.BOILERPLATE)
_ENDINGS = ", ".join(_quoted(text) for text in rules.ENDINGS)

QUALITY_RULES = f"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
words as (select doc_id, body, regexp_extract_all(body, {_WORD}) as w from docs),
counted as (
  select doc_id, body, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(body) - length(translate(body, '{rules.SYMBOLS}', '')) as n_symbols
  from words),
places as (
  select doc_id, unnest(range(1, n_words - {rules.WINDOW - 2})) as pos, w from counted where n_words >= {rules.WINDOW}),
grams as (select doc_id, pos, array_to_string(w[pos:pos + {rules.WINDOW - 1}], ' ') as gram from places),
repeated as (
  select doc_id, pos from (select *, count(*) over (partition by doc_id, gram) as n from grams) where n > 1),
covered as (
  select doc_id, count(distinct pos + step) as n_repeat_words
  from repeated, range({rules.WINDOW}) as steps(step) group by doc_id),
lines as (
  select doc_id, i, line from (
    select doc_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as i
    from docs)
  where trim(line, {_SPACE}) <> ''),
judged as (
  select *, len(regexp_extract_all(line, {_WORD})) as words, len(regexp_extract_all(line, {_quoted(rules.SEPARATOR)})) as separators,
         len(regexp_extract_all(line, {_quoted(rules.MARK)})) as marks
  from lines),
passed as (
  select doc_id, line, words,
         not coalesce(
           (({_PHRASES}) and words < 25)
           or separators >= 3 or (separators >= 1 and separators * 3 >= words)
           or (marks >= 3 and marks * 2 >= words)
           or (words >= 10 and right(trim(line, {_SPACE}), 1) not in ({_ENDINGS})
               and translate(line, '.,;:!?', '') = line), false) as ok
  from judged),
by_doc as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(words) filter (ok), 0) as kept_words
  from passed group by doc_id),
measured as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words
  from counted left join by_doc using (doc_id) left join covered using (doc_id)),
verdict as (
  select *, n_words < {rules.MIN_WORDS}
            or 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words as base_failed
  from measured)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and 100 * (n_words - kept_words) <= {rules.MAX_LOST_PERCENT} * n_words as kept,
       cast(kept_words as bigint) as kept_words
from verdict
"""

MIXING = f"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0) as size from documents),
sources as (
  select source, sum(size) as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from docs group by source),
levels as (
  select *, 3 * source_size / weight as ratio,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (
            order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 3 * source_size / weight, source nulls last
                             rows between current row and unbounded following) as level
  from sources),
targets as (
  select source, source_size,
         case when ratio <= level then cast(3 * source_size as double)
              else weight * max(level) filter (ratio > level) over () end as target
  from levels),
drawn as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target) as budget,
         coalesce(sum(d.size) over (
           partition by d.source order by md5('mix:' || coalesce(cast(d.doc_id as varchar), '-')), d.doc_id nulls last,
           d.size rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join targets t on d.source is not distinct from t.source),
cut as (
  select *, case when source_size > 0 then floor(budget / source_size) else 0 end as epochs from drawn)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(epochs * size + least(size, greatest(budget - epochs * source_size - before, 0)) as bigint) as taken
from cut
"""

_EITHER_CASE = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)


def _kind(at: int) -> str:
    rule = RULES[at]
    pattern = _quoted(
        rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{_EITHER_CASE})")
    )
    return f"""
select doc_id, '{rule.kind}' as kind, {at} as ord, {rule.least} as least, {rule.group} as grp,
       regexp_extract_all(body, {pattern}) as found,
       list_transform(regexp_extract_all(body, {pattern}, {rule.group}), lambda s: length(s)) as sizes,
       list_transform(string_split_regex(body, {pattern}), lambda s: length(s)) as gaps
from docs where regexp_matches(body, {pattern})"""


_BASE = ", ".join(_quoted(kind) for kind in BASE_KINDS)
SECRET_SCAN = f"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
kinds as ({" union all ".join(_kind(at) for at in range(len(RULES)))}),
each_one as (
  select doc_id, kind, ord, least, unnest(found) as hit, unnest(sizes) as size,
         generate_subscripts(found, 1) as i, gaps, list_transform(found, lambda s: length(s)) as lengths
  from kinds),
placed as (
  select doc_id, kind, ord,
         cast(list_sum(gaps[1:i]) + coalesce(list_sum(lengths[1:i - 1]), 0) as bigint) as start, length(hit) as span
  from each_one where size >= least),
joined as (
  select doc_id,
         count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || start || ':' || (start + span), ',' order by start, ord)
           filter (kind in ({_BASE})) as base,
         string_agg(kind || ':' || start || ':' || (start + span), ',' order by start, ord) as spans
  from placed group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (doc_id)
"""

WARC = """
with digested as (
  select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as digest from pages),
kept as (
  select digest, max(page_id) as keeper from digested where octet_length(body) >= 1000 group by digest)
select page_id, cast(octet_length(body) as bigint) as payload_bytes, digest as payload_digest,
       case when page_id < keeper then 'revisit' else 'response' end as record_type,
       case when page_id < keeper then keeper end as refers_to
from digested left join kept using (digest)
"""

EXACT_TOPK = """
with usable as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""

JACCARD_JOIN = f"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w
  from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as materialized (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)),
reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.other) as component_id
from documents d left join sizes s using (doc_id) join reach r on r.doc_id = d.doc_id
group by d.doc_id
"""


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    values = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
    return f"sha256({' || '.join(_framed(value) for value in values)})"


#: crc32 of the decimal id, bit by bit.
_ODD_CRC = """
(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, nothing: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 2)
"""


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, i, digest, n) of trees over (tree, i, digest), and the siblings of each leaf."""
    return f"""
{name} as (
  select tree, 0 as level, i, digest, count(*) over (partition by tree) as n from {leaves}
  union all
  select tree, any_value(level) + 1, i // 3, sha256(string_agg(digest, '' order by i)), (any_value(n) + 2) // 3
  from {name} where n > 1 group by tree, i // 3),
{name}_path as (
  select tree, i as leaf, i, 0 as level from {name} where level = 0
  union all
  select p.tree, p.leaf, p.i // 3, p.level + 1
  from {name}_path p join {name} x on x.tree = p.tree and x.level = p.level and x.i = p.i and x.n > 1),
{name}_steps as (
  select p.tree, p.leaf, p.level, string_agg(s.digest, '' order by s.i) filter (s.i < p.i) as l,
         string_agg(s.digest, '' order by s.i) filter (s.i > p.i) as r
  from {name}_path p join {name} s on s.tree = p.tree and s.level = p.level and s.i // 3 = p.i // 3 and s.n > 1
  group by all),
{name}_proofs as (
  select tree, leaf, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} order by level) as steps
  from {name}_steps group by all)"""


MERKLE = f"""
with recursive rows_ as materialized (
  select doc_id, coalesce('=' || source, '-') as tree, {_leaf("text")} as digest,
         {_leaf(f"case when {_ODD_CRC} = 0 then replace(text, chr(10), '') else text end")} as changed
  from documents),
ranked as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as i from rows_),
{_tree("inner_", "ranked")},
subroots as materialized (
  select tree as source_tree, digest, 'all' as tree, row_number() over (order by tree) - 1 as i from inner_ where n = 1),
{_tree("outer_", "subroots")},
whole as materialized (
  select r.doc_id, r.digest as leaf, s.digest as subroot, t.digest as root, r.changed,
         list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) as steps
  from ranked r join subroots s on s.source_tree = r.tree join outer_ t on t.n = 1
  left join inner__proofs p on p.tree = r.tree and p.leaf = r.i
  left join outer__proofs q on q.leaf = s.i),
folded as (
  select *, changed as folded_root, 1 as step from whole
  union all
  select * replace (sha256(steps[step].l || folded_root || steps[step].r) as folded_root, step + 1 as step)
  from folded where step <= len(steps))
select doc_id, leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.l || s.r), ''), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folded where step = len(steps) + 1
"""

#: The base patterns as they are defined, without the marks that only keep the search linear.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"[+][0-9][\x20().0-9-]+[0-9]",
}
_PII_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_PII_VALID = {
    "email": "true",
    "ip": f"regexp_matches(value, '{pii.IP_VALUE}')",
    "card": f"""length({_PII_DIGITS}) between 16 and 19 and list_sum(list_transform(string_split(reverse({_PII_DIGITS}), ''),
      lambda c, place: case when place % 2 = 1 then cast(c as int) when c > '4' then 2 * cast(c as int) - 9 else 2 * cast(c as int) end)) % 10 = 0""",
    "phone": f"length({_PII_DIGITS}) between 8 and 15",
}
_PII_ENTITY = {"email": f"translate(value, '{UPPER}', '{LOWER}')", "ip": "value", "card": _PII_DIGITS, "phone": _PII_DIGITS}


def _pii_kind(at: int, kind: str) -> str:
    pattern = _quoted(_PII[kind])
    return f"""
select id, {at} as ord, '{kind}' as kind, start, start + length(value) as stop, '{kind}:' || {_PII_ENTITY[kind]} as entity,
       case when length(b) > {pii.CONTEXT} then regexp_replace(right(b, {pii.CONTEXT}), '^[^\\x20\\x09-\\x0D]+', '') else b end || ' ' ||
       case when length(a) > {pii.CONTEXT} then regexp_replace(left(a, {pii.CONTEXT}), '[^\\x20\\x09-\\x0D]+$', '') else a end as context
from (
  select id, unnest(hits) as value, unnest(gaps[:len(hits)]) as b, unnest(gaps[2:]) as a,
         unnest(list_transform(range(1, len(hits) + 1), lambda i:
           cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint))) as start
  from (select id, regexp_extract_all(body, {pattern}) as hits, string_split_regex(body, {pattern}) as gaps from docs)
  where len(hits) > 0)
where {_PII_VALID[kind]}"""


def _pii_items(text: str) -> str:
    terms = f"list_distinct(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{pii.TERM}'))"
    return f"list_distinct(list_concat({terms}, list_transform({terms}, lambda w: left(w, {pii.KEPT_LETTERS}) || '*')))"


_PII_SHARE = " * ".join(["(together / held)"] * 2**pii.STRICTNESS)
PII = f"""
with docs as materialized (
  select row_number() over () as id, doc_id, coalesce(text, '') as body from documents),
base as materialized ({" union all ".join(_pii_kind(at, kind) for at, kind in enumerate(pii.BASE_KINDS))}),
near as materialized (
  select distinct id, entity, unnest({_pii_items("context")}) as item from base),
holders as (select entity, count(distinct id) as holding from base group by entity),
wanted as (
  select entity, item, count(*) as together from near join docs using (id)
  group by entity, item having count(distinct body) > 1),
held as (
  select item, count(*) as held from (select unnest({_pii_items("body")}) as item from docs) group by item),
judged as materialized (
  select entity, item from wanted join holders using (entity) join held using (item), (select count(*) as n from docs)
  where {_PII_SHARE} * n >= holding and holding < n),
flagged as (
  select entity, item, case when exists (
           select 1 from judged c where c.entity = t.entity and c.item = left(t.item, {pii.KEPT_LETTERS}) || '*')
         then 'removed' else 'generalised' end as kind
  from judged t where item not like '%*'),
by_text as (select id, item, max(kind) as kind from near join flagged using (entity, item) group by all),
words as (
  select id, unnest(hits) as word,
         unnest(list_transform(range(1, len(hits) + 1), lambda i:
           cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint))) as start
  from (select id, regexp_extract_all(body, '{pii.TERM}') as hits, string_split_regex(body, '{pii.TERM}') as gaps
        from docs where id in (select id from by_text))),
spans as (
  select id, ord, kind, start, stop from base
  union all
  select w.id, case t.kind when 'generalised' then 4 else 5 end, t.kind, w.start, w.start + length(word)
  from words w join by_text t on t.id = w.id and t.item = translate(w.word, '{UPPER}', '{LOWER}')
  where not exists (select 1 from base b where b.id = w.id and b.start < w.start + length(word) and w.start < b.stop)),
listed as (
  select id, {", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind in pii.BASE_KINDS)},
         string_agg(kind || ':' || start || ':' || stop, ',' order by ord, start) filter (ord < 4) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by ord, start) as spans
  from spans group by id)
select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in pii.BASE_KINDS)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join listed using (id)
"""
