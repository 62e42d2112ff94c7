"""A training-data pipeline over ``documents``: five stages, each calling one operator of mosaiq.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a frame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import langid, packing, setjoin, substring, tiling
from mosaiq.llm.common import Scratch, without_ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (their language is undetermined), and so do those whose id or text is null.

    lang becomes the predicted language. The profiles are learned from the rows of docs that have a lang.
    """
    docs = docs.where("doc_id is not null and text is not null")
    named = langid.predict_languages(docs, langid.fit_languages(docs), keep_text=True).where("lang_pred <> 'und'")
    return named.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more, the one of the smallest id stays."""
    groups = setjoin.jaccard_components(docs.select("doc_id", "text"), 5, 80)
    return without_ids(docs, Scratch(spark, "near_duplicates").save(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone"))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat one of an earlier document are cut out."""
    return substring.without_repeats(docs, substring.repeated_passages(docs.select("doc_id", "text")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in tiles, or more, go."""
    found = tiling.contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_ids(docs, Scratch(spark, "decontaminated").save(found.select("doc_id").distinct(), "gone"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token sequences of at most 4096: a row for each piece, with its place."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_substrings), ("decontamination", decontaminated), ("packing", packed)]

#: None of the models, joins and tokenizers of the stages can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
