"""DuckDB SQL of the corpus queries that SQL can express on whole tables.

Packing needs a tokenizer's ids, the classifier and the mixing rates are fitted
step by step, fingerprints and pseudonyms are byte-wise hashes: these have none
and are held against plain Python in tests/llm."""

from __future__ import annotations

from tablesmith.llm.infill import MIDDLE, PREFIX, RATE, SEED, SPM_PERCENT, SUFFIX
from tablesmith.llm.licenses import LEAST_COVER, LEAST_VOTES, PHRASES, SLACK, TEMPLATES, gram_words, template_words
from tablesmith.llm.manifest import FANOUT, FIELDS
from tablesmith.llm.quality import (
    MAX_CLASS_DISTANCE,
    MAX_REPEATED_PERCENT,
    MAX_WORD_DISTANCE,
    MIN_COMPARED_CHARS,
    MIN_COMPARED_WORDS,
    MIN_WORDS,
    WORD_BINS,
)
from tablesmith.llm.runindex import WINDOW
from tablesmith.llm.secrets import BASE, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as ws from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edge e on r.b = e.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d join comp c using (doc_id) left join n using (doc_id)
"""

OP11 = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as u, {", ".join(f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint) as h{k + 1}" for k in range(4))} from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from u),
p as (
  select doc_id, t, n, array_to_string(list_slice(u, 1, a), '') as p, array_to_string(list_slice(u, a + 1, b), '') as m, array_to_string(list_slice(u, b + 1, n), '') as s,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form
  from c
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m when 'spm' then '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m else t end) as output_sha256, sha256(t) as restored_sha256
from p
"""

OP7 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
k as (select doc_id, i, ws[i] as word, case when i + 49 <= len(ws) then array_to_string(list_slice(ws, i, i + 49), ' ') end as win from p),
f as (select win, min(doc_id) as first from k where win is not null group by win),
g as (select doc_id, i, word, max(case when f.first < doc_id then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from k left join f using (win)),
r as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from g group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join r using (doc_id)
"""


OP12 = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, unnest(range(0, length(x) // 2 - {WINDOW - 1})) as i, x from d),
k as (select doc_id, i, substr(x, 2 * i + 1, {2 * WINDOW}) as s from w),
f as (select s, min(doc_id) as first from k group by s),
g as (select doc_id, i from k join f using (s) where first < doc_id),
o as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {WINDOW} then 0 else 1 end as fresh from g),
n as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from o),
r as (select doc_id, span, min(i) as a, max(i) + {WINDOW} as b from n group by doc_id, span),
h as (select doc_id, span, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from r),
m as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as head from h join d using (doc_id) group by doc_id)
select d.doc_id, length(x) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when m.n_spans is null then x else m.head || substr(x, 2 * m.last + 1) end)) as kept_sha256
from d left join m on m.doc_id = d.doc_id
"""


def _fields(text: str) -> str:
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    return " || ".join(field(c if c != "text" else text) for c in FIELDS)


OP13 = f"""
with recursive
bits(n, k, c) as (select cast(range as bigint), 0, cast(range as bigint) from range(256) union all select n, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from bits where k < 8),
crc_of as (select n, c from bits where k = 8),
crc(doc_id, s, i, c) as (
  select doc_id, cast(doc_id as varchar), 1, 4294967295::bigint from (select distinct doc_id from documents where doc_id is not null)
  union all select r.doc_id, r.s, r.i + 1, xor(x.c, r.c >> 8) from crc r join crc_of x on x.n = xor(r.c, ascii(substr(r.s, r.i, 1))::bigint) % 256 where r.i <= length(r.s)
),
even as (select doc_id from crc where i = length(s) + 1 and xor(c, 4294967295::bigint) % 2 = 0),
f as (select *, case when doc_id in (select doc_id from even) then replace(text, chr(10), '') else text end as other from documents),
h as (
  select doc_id, coalesce('=' || source, '') as tree,
    sha256({_fields('text')}) as leaf, sha256({_fields('other')}) as claimed
  from f
),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as w from h),
n(tree, level, pos, w, h) as (
  select tree, 0, pos, w, leaf from l
  union all select tree, level + 1, pos // {FANOUT}, (w + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' order by pos)) from n where w > 1 group by tree, level, w, pos // {FANOUT}
),
s as (select tree, h, row_number() over (order by tree) - 1 as pos, count(*) over () as w from n where w = 1),
t(level, pos, w, h) as (
  select 0, pos, w, h from s
  union all select level + 1, pos // {FANOUT}, (w + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' order by pos)) from t where w > 1 group by level, w, pos // {FANOUT}
),
place as (select row_number() over () as r, l.doc_id, l.leaf, l.claimed, l.tree, l.pos, s.h as subroot, s.pos as top from l join s using (tree)),
depth as (select tree, max(level) as levels from n group by tree),
own as (select r, tree, level, pos // cast({FANOUT} ** level as bigint) as pos from place join depth using (tree), range(40) x(level) where level < levels),
high as (select r, level, top // cast({FANOUT} ** level as bigint) as pos from place, range(40) x(level) where level < (select max(level) from t)),
step as (
  select r, o.level, string_agg(n.h, '' order by n.pos) filter (where n.pos < o.pos) as a, string_agg(n.h, '' order by n.pos) filter (where n.pos > o.pos) as b from own o join n on n.tree = o.tree and n.level = o.level and n.pos // {FANOUT} = o.pos // {FANOUT} group by r, o.level
  union all
  select r, 1000 + o.level, string_agg(t.h, '' order by t.pos) filter (where t.pos < o.pos), string_agg(t.h, '' order by t.pos) filter (where t.pos > o.pos) from high o join t on t.level = o.level and t.pos // {FANOUT} = o.pos // {FANOUT} group by r, o.level
),
steps as (select r, row_number() over (partition by r order by level) as k, count(*) over (partition by r) as ks, coalesce(a, '') as a, coalesce(b, '') as b from step),
proof as (select r, sha256(string_agg(a || b, '' order by k)) as proof_sha256 from steps group by r),
fold(r, k, h) as (
  select r, 1::bigint, claimed from place
  union all select fold.r, fold.k + 1, sha256(steps.a || fold.h || steps.b) from fold join steps on steps.r = fold.r and steps.k = fold.k
),
folded as (select r, arg_max(h, k) as h from fold group by r)
select doc_id, leaf, subroot, t.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded.h as folded_root, folded.h = t.h as verified
from place join folded using (r) left join proof using (r), t where t.w = 1
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Matches and the parts between them, whose lengths give the places."""
    length = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    parts = []
    for i, r in enumerate(RULES):
        p = _quoted(r.regex)
        start = f"{length.format('b[1:i]')} + {length.format('m[1:i - 1]')}"
        parts.append(
            f"select doc_id, {i} as no, '{r.kind}' as kind, {start} as s, {start} + length(m[i]) as e from (select doc_id, b, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, string_split_regex(t, {p}) as b, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {r.group}) as g from d where regexp_matches(t, {p}))) where length(g[i]) >= {r.least}"
        )
    spans = "string_agg(kind || ':' || cast(s as varchar) || ':' || cast(e as varchar), ',' order by s, no)"
    counts = ", ".join(f"cast(count(f.no) filter (where no = {i}) as bigint) as n_{k}" for i, k in enumerate(BASE))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(parts)})
select d.doc_id, {counts}, sha256(coalesce({spans} filter (where no < {len(BASE)}), '')) as base_sha256, coalesce({spans}, '') as spans from d left join f using (doc_id) group by d.doc_id
"""


def _licenses() -> str:
    known = [(label, template_words(text), True) for text, label in PHRASES.items()] + [(label, template_words(text), False) for label, text in TEMPLATES]
    sized = [(n, label, w, phrase, gram_words(w)) for n, (label, w, phrase) in enumerate(known)]
    rows = ", ".join(f"({n}, {_quoted(label)}, {phrase}, {len(w) - k + 1}, {k}, {t}, {_quoted(' '.join(w[t : t + k]))})" for n, label, w, phrase, k in sized for t in range(len(w) - k + 1))
    met = " union all ".join(f"select doc_id, template, label, phrase, grams, t, i - 1 - t as diagonal from p join g on g.k = {k} and g.gram = array_to_string(list_slice(ws, i, i + {k - 1}), ' ') where i + {k - 1} <= len(ws)" for k in sorted({k for *_, k in sized}))
    return rf"""
with g(template, label, phrase, grams, k, t, gram) as (values {rows}),
w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
v as ({met}),
l as (select doc_id, template, label, phrase, grams, diagonal, count(distinct t) as held from v group by all),
k as (select *, case when phrase or diagonal - lag(diagonal) over o <= {SLACK} then cast(phrase as int) else 1 end as fresh from l where case when phrase then held = grams else held >= least({LEAST_VOTES}, grams) end window o as (partition by doc_id, template order by diagonal)),
n as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as island from k),
c as (select n.doc_id, n.label, n.phrase, min(v.diagonal + v.t) as place, count(distinct v.t) * 1.0 / max(n.grams) as cover from n join v using (doc_id, template, diagonal) group by n.doc_id, n.template, n.label, n.phrase, n.island),
f as (
  select doc_id, count(*) filter (where phrase) as n_base, min(place) filter (where phrase) as a, max(place) filter (where phrase) as b, coalesce(string_agg(distinct label, ',' order by label) filter (where phrase), '') as base_labels,
    coalesce(string_agg(distinct label, ',' order by label) filter (where phrase or cover >= {LEAST_COVER}), '') as labels, max(cover) filter (where not phrase) as best
  from c group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(a as bigint) as first_word, cast(b as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0::double else round(coalesce(best, 0)::double, 6) end as score
from w left join f using (doc_id)
"""


def _quality() -> str:
    signs = r"""[.,;:!?'"()-]"""
    classes = ["[a-z]", "[A-Z]", "[0-9]", r"[\x09\x0B\x0C\x20]", r"[\x0A\x0D]", signs, "[#*$%&|<>]", None, r"[^\x00-\x7F]"]
    count = lambda c: f"length(t) - length(regexp_replace(t, {_quoted(c)}, '', 'g'))"
    named = ", ".join(f"{count(c)} as c{i}" for i, c in enumerate(classes) if c)
    rest = " - ".join(["length(t)", *[f"c{i}" for i, c in enumerate(classes) if c]])
    bins = ", ".join(f"({_quoted(w)})" for w in WORD_BINS)
    shares = "sqrt(greatest(0, (sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2))"
    far = lambda table, bins: f"""
      select h.doc_id, {shares} as far from (
        select b.doc_id, b.bin, coalesce(h.n, 0) * 1.0 / greatest(b.total, 1) as p, coalesce(r.n, 0) * 1.0 / greatest(b.ref_total, 1) as q
        from (select d.doc_id, d.lang as key, x.bin, t.total, s.total as ref_total from d join (select key, sum(n) as total from {table}_ref group by key) s on s.key = d.lang cross join {bins} x left join (select doc_id, sum(n) as total from {table} group by doc_id) t using (doc_id)) b
        left join {table} h on h.doc_id = b.doc_id and h.bin = b.bin left join {table}_ref r on r.key = b.key and r.bin = b.bin
      ) h group by h.doc_id"""  # noqa: E731
    return rf"""
with d as (select doc_id, coalesce('=' || lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
c as (select *, {rest} as c7 from (select doc_id, t, {named} from d)),
ch as (select doc_id, unnest(range(0, 9)) as bin, unnest([{", ".join(f"c{i}" for i in range(9))}]) as n from c),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
w as (select doc_id, i, ws[i] as w, case when i + 2 <= len(ws) then [ws[i], ws[i + 1], ws[i + 2]] end as three from p),
b as (values {bins}),
wh as (select doc_id, coalesce(b.col0, '') as bin, count(*) as n from w left join b on b.col0 = lower(trim(w.w, '.,;:!?''"()-')) group by 1, 2),
a as (select doc_id, i, length(w) as chars, case when three is not null and count(*) over (partition by doc_id, three) > 1 then 1 else 0 end as again from w),
r as (select doc_id, chars, max(again) over (partition by doc_id order by i rows between 2 preceding and current row) as covered from a),
m as (select doc_id, sum(chars) as word_chars, sum(covered) as n_repeat_words from r group by doc_id),
good as (select doc_id, lang from d left join m using (doc_id) where len(ws) >= {MIN_WORDS} and 100 * coalesce(n_repeat_words, 0) <= {MAX_REPEATED_PERCENT} * len(ws)),
ch_ref as (select lang as key, bin, sum(n) as n from ch join good using (doc_id) group by key, bin),
wh_ref as (select lang as key, bin, sum(n) as n from wh join good using (doc_id) group by key, bin),
x as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
y as (select doc_id, count(*) - count(distinct line) as n_dup_lines from x where regexp_matches(line, '{_WORD}') group by doc_id),
class_far as ({far("ch", "(select unnest(range(0, 9)) as bin)")}),
word_far as ({far("wh", "(select col0 as bin from b union all select '')")}),
f as (
  select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(c6 as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    len(ws) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED_PERCENT} * len(ws) as base_failed,
    case when length(d.t) >= {MIN_COMPARED_CHARS} then round(cf.far, 6) end as class_distance, case when len(ws) >= {MIN_COMPARED_WORDS} then round(wf.far, 6) end as word_distance
  from d join c using (doc_id) left join m using (doc_id) left join y using (doc_id) left join class_far cf using (doc_id) left join word_far wf using (doc_id)
)
select *, not base_failed and coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} as kept from f
"""


SQL = {"op1_quality": _quality(), "op2_licenses": _licenses(), "op4_near_duplicates": OP4, "op6_secrets": _secrets(), "op7_substrings": OP7, "op11_fill_in_middle": OP11, "op12_run_index": OP12, "op13_manifest": OP13}
