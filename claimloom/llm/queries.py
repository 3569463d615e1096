"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, extract, lines, neighbours, passages, quality, shards, sketches, spelling, suffixes
from .registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CONTROL = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONTROL}'
  union all select -1, 1, 'assistant', '{CONTROL}'
), marked as (
  select *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as long_text from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(long_text + length(role) + 12 + 1 + 10 + 1) as bigint) as formatted_chars
from marked group by conv_id
"""


@query("op1_chat_formatting", CHAT_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").selectExpr("conv_id", "cast(turn as long) turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string"
    )
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(_table(spark, folder, "pages"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


DECONTAMINATION_SQL = r"""
with d as (
  select doc_id, row_number() over () as row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct size from win
), grams as (
  select row, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select row, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)
), hit as (select row, i, g.size, item_id from grams g join win using (size, phrase)
), words as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + size)) as p from hit) group by row
), items as (
  select row, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct row, cast(item_id as varchar) as item from hit where item_id is not null) group by row
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (row) left join items using (row)
"""


@query("op3_decontamination", DECONTAMINATION_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


NEAR_SQL = r"""
with recursive d as (
  select doc_id, row_number() over () as row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct row, array_to_string(w[i:i + 3], ' ') as shingle
  from (select row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)
), n as (select row, count(*) as n from s group by row
), links as (
  select a, b from (select x.row as a, y.row as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.row <> y.row group by 1, 2)
  join n na on na.row = a join n nb on nb.row = b where 100 * c >= 80 * (na.n + nb.n - c)
), reach(a, b) as (
  select row, row from d union select reach.a, links.b from reach join links on links.a = reach.b
), component as (select a as row, min(doc_id) as component_id from reach join d on d.row = reach.b group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d left join n using (row) join component using (row)
"""


@query("op9_minhash_near_dedup", NEAR_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.near_duplicates(_table(spark, folder, "documents"), size=4)


@query("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    left = lines.dedup(_table(spark, folder, "documents"))
    return left.select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.length("text").cast("long").alias("n_kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op8_suffix_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.report(_table(spark, folder, "documents")).drop("begins", "ends")


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, folder, "labels")))


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(_table(spark, folder, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    first = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return align.report(_table(spark, folder, "documents"), first, public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_sharding")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.shard(_table(spark, folder, "documents"), 8).select(
        "doc_id", (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


SPELLING_SQL = """
with recursive octets as (
  select list(c order by i) as t
  from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256)) as i))
), runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
), spelled as (
  select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as digits from runs
), hashed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(digits), 2), lambda i:
      16 * (instr('0123456789ABCDEF', digits[i + 1]) - 1) + instr('0123456789ABCDEF', digits[i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from spelled, octets
), words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
  group by word having length(word) >= 6 and sum(n) >= 5
), shorter as (
  select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)
), near as (
  select word, rest as other from shorter where rest in (select word from words)
  union select rest, word from shorter where rest in (select word from words)
  union select a.word, b.word from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
), best as (
  select word, count(*) as n_near, max(n) as best_n, first(other order by n desc, encode(other)) as best
  from (select near.word, near.other, words.n from near join words on near.other = words.word) group by word
), formed as (
  select w.word, case when best_n >= 5 * n then best end as form, n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * n then best_n end as form_n
  from words w left join best using (word)
), walk as (
  select word, word as at from formed
  union all select walk.word, formed.form from walk join formed on walk.at = formed.word where formed.form is not null
)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n
from formed f join walk on walk.word = f.word join formed e on e.word = walk.at where e.form is null
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling(_table(spark, folder, "documents"))
