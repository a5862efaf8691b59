"""Registered queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import alignment, byte_bpe, exact_dedup, html_text, lang_id, lm, mixing, near_dedup, packing, pii, quality, sharding, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_read(spark, sf_dir, "documents"), key="op1")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
with light as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sized as (
  select *, length(bin(size)) * 8 + floor(size * 8 / pow(2.0, length(bin(size)) - 1))::bigint % 8 as class,
    ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from light
), classes as (
  select source, class, ceil(count(*)::double / 1000)::bigint as salts from sized group by all
), celled as (
  select s.*, s.h % c.salts as salt from sized s join classes c on s.source is not distinct from c.source and s.class = c.class
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source
), weighed as (
  select *, [3, 1, 2][((rank - 1) % 3 + 1)::bigint]::double as weight, (source_size * 2)::double as most from ranked
), levels as (
  select *, ((sum(source_size) over ())::double * 1.5 - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by most / weight, rank rows between current row and unbounded following) as level from weighed
), level as (
  select arg_min(level, (most / weight, rank)) as level from levels where level * weight <= most
), goals as (
  select source, source_size, least(coalesce((select level from level) * weight, most), most) as target,
    ('0x' || substr(md5('7|' || coalesce(source, '')), 1, 8))::bigint / 4294967296.0::double as shift from weighed
), placed as (
  select doc_id, size, source, row_number() over (partition by source order by class, salt, size, doc_id) as place from celled
), rated as (
  select p.*, g.source_size, g.target, g.shift, case when g.source_size > 0 then g.target / g.source_size else 0.0 end as rate
  from placed p join goals g on p.source is not distinct from g.source
)
select doc_id, size, source_size, target, ((floor(shift + place * rate) - floor(shift + (place - 1) * rate)) * size)::bigint as taken from rated
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_read(spark, sf_dir, "documents"))


OP3_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_read(spark, sf_dir, "documents"))


def op5_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op7_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_read(spark, sf_dir, "documents"))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffled_shards(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_read(spark, sf_dir, "documents")).drop("clean_text")


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), stable=True)


def op11_bpe_monoid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_bpe.encode(_read(spark, sf_dir, "documents"), decoded=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_label_string_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates,
        op2_source_mixing,
        op3_exact_dedup,
        op4_minhash_near_dedup,
        op5_concat_and_cut,
        op6_line_blocks,
        op7_ppm_language_id,
        op8_external_shuffle,
        op9_line_first_quality,
        op10_elias_fano_lm,
        op11_bpe_monoid_tree,
        op12_label_string_alignment,
        op13_tiled_whitening,
    )
}
ORACLES = {"op2_source_mixing": OP2_SQL, "op3_exact_dedup": OP3_SQL}
