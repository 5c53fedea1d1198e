"""The operators as stages of the corpus pipeline: (spark, docs, sf_dir) -> docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import decontamination, jaccard, lines, packing, toxicity
from tonelake.llm.common import remainder, table, without_ids
from tonelake.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the network does not call toxic. It learns from the labelled rows of the documents
    at hand, but for the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep_text=True).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text freed from lines of recurring templates; n_chars follows it."""
    cleaned = lines.without_recurring(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group: 0.8 of five-word shingles."""
    groups = jaccard.near_duplicates(docs, percent=80, size=5)
    first = groups.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, written(found.select("doc_id").distinct(), "contaminated"), "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each with its sequence and offset."""
    pieces = packing.tokenised(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packing.pack(written(pieces, "pieces"))
