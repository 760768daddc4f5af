"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import best_fit, bpe, chat_format, common, exact_dedup, hard_negatives, license_scan, merkle, packing, quality, secret_scan, simhash, token_counts, url_filter


BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_pack_documents(spark, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), with_ids=False)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(common.table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(common.table(spark, sf_dir, "documents"), license_scan.prepare(spark))
    return found.select("doc_id", "n_licenses", "licenses")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"), url_filter.train(url_filter.default_examples(spark)))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts are control strings of a well-known format."""
    text = F.lit("</s>[INST] ok [/INST]")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(tricky)))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings").withColumn("label", hard_negatives.shifted_label()))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's proof; where three divides the id's CRC-32 the text is tampered with by lower-casing A to Z."""
    docs = common.table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    manifest = merkle.build_manifest(docs, F.when(touched, F.translate("text", upper, upper.lower())).otherwise(F.col("text")))
    return merkle.prove(manifest, with_paths=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_best_fit(spark, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), with_ids=False)


_OP7 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id,
       count(*) over (partition by h) as group_size,
       row_number() over (partition by h order by n desc, doc_id) = 1 as kept,
       h as text_sha256
from d
"""


_OP10 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(replace(text, '\', '\\'), '(<\||</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '+\1', 'g') as escaped from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|turn|>' || role || chr(10) || escaped || '<|end|>'))::bigint as formatted_chars
from e group by conv_id
"""


_OP11 = r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.q, r.q)::bigint as score
  from r a join r on a.vec_id % 100 = 0 and (r.label <> a.label or r.vec_id <> a.vec_id)
), p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank,
         s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


_OP12 = r"""
with recursive d as (
  select *, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
                             lambda r, k: xor(r >> 1, case when r & 1 = 1 then 3988292384 else 0 end))) as crc
  from documents
), t as (
  select *, case when xor(crc, 4294967295) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed from d
), f as (
  select doc_id, lang, coalesce('=' || lang, '') as tree,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(changed) || ':' || changed, '-') as changed
  from t
), leaves as (
  select doc_id, tree, sha256(head || body) as leaf, sha256(head || changed) as now,
         row_number() over (partition by tree order by doc_id nulls first, sha256(head || body)) - 1 as pos, count(*) over (partition by tree) as n
  from f
), nodes as (
  select 0 as lvl, tree, pos, n, leaf as h from leaves
  union all
  select lvl + 1, tree, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by lvl, tree, pos // 8
), subroots as (
  select tree as name, h, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as lvl, '' as tree, pos, n, h from subroots
  union all
  select lvl + 1, tree, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by lvl, tree, pos // 8
), every as (
  select 1 as top, lvl, tree, pos, n, h from tops union all select 0, lvl, tree, pos, n, h from nodes
), sides as (
  select a.top, a.lvl, a.tree, a.pos,
         coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') as before,
         coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') as after
  from every a join every b on a.top = b.top and a.lvl = b.lvl and a.tree = b.tree and a.pos // 8 = b.pos // 8
  where a.n > 1 group by all
), steps as (
  select l.doc_id, l.leaf, l.pos as place, l.tree, s.before, s.after, row_number() over (partition by l.tree, l.pos order by s.top, s.lvl) as step
  from leaves l join subroots r on l.tree = r.name
  join sides s on (s.top = 0 and s.tree = l.tree and s.pos = l.pos // (8 ** s.lvl)::bigint) or (s.top = 1 and s.pos = r.pos // (8 ** s.lvl)::bigint)
), proofs as (
  select tree, place, sha256(string_agg(before || after, '' order by step)) as proof, max(step) as height from steps group by all
), folded as (
  select tree, pos, 0 as step, now as h from leaves
  union all
  select f.tree, f.pos, f.step + 1, sha256(s.before || f.h || s.after) from folded f join steps s on s.tree = f.tree and s.place = f.pos and s.step = f.step + 1
)
select l.doc_id, l.leaf, r.h as subroot, t.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
from leaves l join subroots r on l.tree = r.name join (select h from tops where n = 1) t on true
left join proofs p on p.tree = l.tree and p.place = l.pos
join folded f on f.tree = l.tree and f.pos = l.pos and f.step = coalesce(p.height, 0)
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {"op7_exact_dedup": _OP7, "op10_chat_format": _OP10, "op11_hard_negatives": _OP11, "op12_merkle_manifest": _OP12}
