"""The thin queries opN_<name> over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, langid, neighbours, packing, quality, setjoin, substring, tiling, tokencount, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(column: str, by: int, rest: int):
    """Whether crc32 of an id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by == rest, F.lit(False))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"), 5, 80).select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    pages = table(spark, sf_dir, "pages")
    warc.write_warc(pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held("doc_id", 3, 1))
    return out.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~held("doc_id", 4, 2)))
    out = langid.predict_languages(docs, model)
    return out.select("doc_id", held("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_warc, op3_substring_dedup, op4_quality, op5_main_text, op6_embedding_dedup, op7_decontamination, op8_language_id, op9_packing, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i : i + 4], ' '))) else array_to_string(w, ' ') end g from w where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
links as (select a.doc_id a, b.doc_id b from s a join s b using (g) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id where a.doc_id <> b.doc_id group by 1, 2 having 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r(doc_id, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join links l on l.a = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.c) component_id from r left join n on n.doc_id = r.doc_id group by 1""",
    "op2_warc": """
select page_id, strlen(coalesce(html, '')) payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(h, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as int), 1)), '') payload_digest,
 case when first = page_id then 'response' else 'revisit' end record_type, case when first <> page_id then first end refers_to
from (select *, sha1(coalesce(html, '')) h, min(page_id) over (partition by coalesce(html, '')) first from pages)""",
    "op6_embedding_dedup": """
with recursive e as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) x from embeddings where label is not null and embedding is not null),
links as (select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join links l on l.a = r.vec_id),
k as (select vec_id, min(c) component_id from r group by 1), n as (select a, count(*) n from links group by 1)
select k.vec_id, coalesce(n.n, 0) n_links, component_id, component_id = k.vec_id kept from k left join n on n.a = k.vec_id""",
}
