"""The registered queries of this subpackage: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from courtflow.llm import (
    fim,
    kdshards,
    mixing,
    packing,
    passages,
    pivots,
    quality,
    secret_scan,
    simhash,
    styletree,
    toxicity,
    trie,
    warc,
)

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    """Words left when every 13-word passage stays in its first document only."""
    kept = passages.strip_passages(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_simhash(spark, sf_dir):
    """SimHash classes over 4-word shingles at 4 bits."""
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_quality_rules(spark, sf_dir):
    """Base counts and the verdict of the risk-controlled rules, per document."""
    judged = quality.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, "base_failed", "kept")


@query
def op10_toxicity(spark, sf_dir):
    """Score of every document, learned from the labelled ones that are not held out."""
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op2_warc(spark, sf_dir):
    """A WARC record per page, written, indexed and read back."""
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLES["op2_warc"] = """
with rows as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), firsts as (
  select hex, max(page_id) as first from rows group by hex
)
select page_id, octet_length(encode(html)) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (10 * (i // 8) + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), '')
    as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to, url
from rows join firsts using (hex)
"""


@query
def op7_html_extraction(spark, sf_dir):
    """Main text of every page, judged by its host's style tree."""
    found = styletree.main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_embedding_dedup(spark, sf_dir):
    """Links, components and representatives of all embeddings at cosine 0.9."""
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op6_source_mix(spark, sf_dir):
    """Words that the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op4_packing(spark, sf_dir):
    """Where each piece of every document lies in the packed sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.tokenize(_table(spark, sf_dir, "documents"), path)
    packed = packing.pack(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op3_secret_scan(spark, sf_dir):
    """Every candidate of every document with the forest's verdict; secrets by digest only."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret"
    )


@query
def op12_kd_shards(spark, sf_dir):
    """Shard and slot of every document, near equal in bytes."""
    placed = kdshards.shard(_table(spark, sf_dir, "documents"), shards=8)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query
def op13_fill_in_middle(spark, sf_dir):
    """Every document cut for filling in its middle, and restored."""
    made = fim.restore(fim.fill_in_middle(_table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op13_fill_in_middle"] = """
with given as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as hex from documents
), drawn as (
  select *, length(text) as n, ('0x' || substr(hex, 1, 8))::bigint as h1, ('0x' || substr(hex, 9, 8))::bigint as h2,
    ('0x' || substr(hex, 17, 8))::bigint as h3, ('0x' || substr(hex, 25, 8))::bigint as h4
  from given
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from cut
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
  case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@query
def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of the rebuilt conversations, with totals of their subtrees."""
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = """
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t
  from conversations
), whole as (
  select conv_id, list(t order by pos) as ts from turns group by conv_id
), bits as (
  select *, list_reduce(range(strlen(conv_id::varchar)), lambda c, i: list_reduce(range(8),
      lambda d, j: xor(d::bigint >> 1, case when d::bigint & 1 = 1 then 3988292384 else 0 end::bigint)::bigint,
      xor(c::bigint, ord(substr(conv_id::varchar, i::int + 1, 1))::bigint)::bigint), 4294967295::bigint) as inverted
  from whole
), drawn as (
  select conv_id, ts, (xor(inverted::bigint, 4294967295) % 9)::int as h from bits
), built as (
  select c.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, c.h), list_slice(c.ts, c.h + 1, len(c.ts))) as path
  from drawn c left join drawn b on b.conv_id = c.conv_id - c.conv_id % 5
), steps as (
  select conv_id, len(path) as n, unnest(range(len(path) + 1)) as depth, path from built
), names as (
  select conv_id, n, depth, list_slice(path, 1, depth) as node, path[depth] as last from steps
), nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(strlen(last.text)) as bytes,
    string_agg(case when n = depth then conv_id::varchar end, ',' order by conv_id) as ends
  from names group by node, depth
), family as (
  select a.node, count(*) filter (b.depth = a.depth + 1) as n_children,
    sum(case when b.depth > 0 then (b.n_convs - 1) * b.bytes else 0 end) as saved_tokens,
    count(*) filter (not exists (select 1 from nodes c where c.depth = b.depth + 1 and list_slice(c.node, 1, b.depth) = b.node))
      as n_leaves
  from nodes a join (select *, unnest(range(depth + 1)) as up from nodes) b on a.depth = b.up and a.node = list_slice(b.node, 1, b.up)
  group by a.node
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, f.n_children, f.n_leaves,
  f.saved_tokens::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join family f on f.node = n.node
left join nodes p on p.depth = n.depth - 1 and p.node = list_slice(n.node, 1, n.depth - 1)
"""
