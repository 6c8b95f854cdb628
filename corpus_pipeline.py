"""The corpus pipeline: stages that each take the documents that the one before has kept.

Quality and toxicity drop documents, near-duplicate removal keeps the smallest id of each group, repeat removal
cuts repeated passages out of texts, and packing places the tokens of what is left. Classifiers learn from labelled
rows among their stage's own input. Rows whose id is null are never grouped with others and stay. Every stage but the
last returns the columns of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm import near_dedup, packing, quality_cnn, repeats, toxicity
from scorelens.llm.common import table
from scorelens.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores 0.3 or higher."""
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_cnn.scorer(docs, model)("text") >= 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or over sentences is below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(docs, model)("text") < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near-duplicates."""
    found = near_dedup.near_duplicates(docs)
    dropped = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier text, or an earlier place, has in a string of 100."""
    cut = repeats.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeats", no_repeats),
    ("packing", packed),
]

#: SQL has neither the classifiers nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
