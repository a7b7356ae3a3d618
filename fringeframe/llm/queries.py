"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.llm import bpe, embeddings, filter_audit, licenses, media, mixing, pii, prefix_trie, sharding, simhash, token_counts, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s.kind.isin(*pii.BASE))
    counts = [F.size(F.expr(f"filter(pii_spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii_spans")).alias("spans"), pii.scores(F.col("pii_spans")).alias("scores"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = token_files.encode_to_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return token_files.read_back(files).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_found", lambda d: d.fixed)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d.label))), ",")
    starts = F.transform(base, lambda d: d.first)
    score = F.coalesce(F.array_max(F.transform("license_found", lambda d: d.score)), F.lit(0.0))
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("license_found")).alias("labels"), score.alias("score")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are written as shards to the shared folder; size and checksum are of what is read back."""
    folder = sharding.write_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    mark = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return spark.read.parquet(folder).select("doc_id", size, mark, "law", F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.with_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    feature = F.concat_ws(";", F.format_string("png=%dx%dx%d", "media_width", "media_height", "media_depth"), "media_feature")
    return rows.select("doc_id", F.col("media_bytes_unpadded").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", F.col("media_length").alias("media_bytes"), "media_sha256", feature.alias("feature"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.branched(prefix_trie.ranked(said)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(filter_audit.cells(docs, _table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = """
with sized as (
  select doc_id, source, text, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
         row_number() over (partition by doc_id, coalesce(text, '')) - 1 as turn
  from documents
), sums as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), ranked as (
  select *, source_size * 3e0 as cap,
         case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight
  from sums
), leveled as (
  select *, (cast(sum(source_size) over () as double)
             - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0e0))
            / sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as level
  from ranked
), leveled2 as (
  select *, (select l.level from leveled l where l.weight * l.level <= l.cap order by l.cap / l.weight, l.source is null, l.source limit 1) as t from leveled
), targets as (
  select source, source_size, least(cap, coalesce(weight * t, cap)) as target from leveled2
), rated as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0e0 end as rate,
         cast(concat('0x', substr(md5(concat('mix:', coalesce(cast(d.doc_id as varchar), ''), ':', md5(coalesce(d.text, '')), case when turn > 0 then concat(':', turn) else '' end)), 1, 8)) as bigint) / 4294967296e0 as draw
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from rated
"""

#: Nodes are lists of turns; a node's subtree is every node whose list begins with its own.
OP12_SQL = """
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
  from own group by conv_id
), got as (
  select c.conv_id, c.h, count(o.conv_id) as got from convs c left join own o on o.conv_id = c.base and o.place <= c.h group by c.conv_id, c.h
), rebuilt as (
  select c.conv_id, o.place, o.role, o.text from convs c join own o on o.conv_id = c.base and o.place <= c.h
  union all
  select o.conv_id, o.place - g.h + g.got as place, o.role, o.text from own o join got g on o.conv_id = g.conv_id where o.place > g.h
), prefixes as (
  select conv_id, place as depth, text, list({'role': role, 'text': text}) over (partition by conv_id order by place) as path from rebuilt
  union all
  select conv_id, 0, '', [] from convs
), lasting as (
  select *, max(depth) over (partition by conv_id) as length from prefixes
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')), 0) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = length), '')) as ends_sha256
  from lasting group by path, depth
), kids as (
  select n.path, count(k.path) as n_children from nodes n left join nodes k on k.depth = n.depth + 1 and k.path[1:n.depth] = n.path group by n.path
), counted as (
  select n.*, k.n_children from nodes n join kids k on n.path = k.path
), above as (
  select distinct n.path as top, u.path as path from lasting n join lasting u on n.conv_id = u.conv_id and u.depth >= n.depth
), totals as (
  select a.top, count(*) filter (where c.n_children = 0) as n_leaves, sum((c.n_convs - 1) * c.words)::bigint as saved_tokens from above a join counted c on a.path = c.path group by a.top
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, t.n_leaves, t.saved_tokens, c.ends_sha256
from counted c join totals t on c.path = t.top left join nodes p on p.depth = c.depth - 1 and c.path[1:p.depth] = p.path
"""

#: Every order is walked: a document goes at the first filter that it fails.
OP13_SQL = """
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), said as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), flagged as (
  select d.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
         case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
         + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) then 4 else 0 end
         + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
         + case when d.doc_id > min(d.doc_id) over (partition by text) then 16 else 0 end as mask
  from docs d left join said l on d.doc_id = l.doc_id
), counted as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from flagged group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as letter
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps as (
  select filter_order, step, substr(filter_order, step, 1) as filter, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) as bit,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1))), 0)::bigint as before
  from orders, (select unnest(range(1, 6)) as step)
), walked as (
  select part, filter_order, step, filter,
         sum(case when mask & (before + bit) = 0 then n else 0 end) as kept, sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as removed,
         sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
  from counted, steps group by part, filter_order, step, filter
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley
from walked
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_mixing, op4_pii, op5_simhash, op6_token_files, op7_licenses, op8_sharding, op9_embedding_dedup, op10_media, op11_token_counts, op12_prefix_trie, op13_filter_audit, pipeline)}
SQL = {"op3_mixing": OP3_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
