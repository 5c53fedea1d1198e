"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import (
    brown,
    collocations,
    decontamination,
    jaccard,
    langid,
    lines,
    manifest,
    packing,
    pii,
    quality,
    repeats,
    secrets,
    statements,
    toxicity,
)
from tonelake.llm.common import remainder, table
from tonelake.llm.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_spaced_seeds")
def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query("op2_toxicity_network")
def op2_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text", held_out), model)


@query("op3_line_templates")
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_merged_transforms")
def op4_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_quality_forest")
def op5_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(stats, model).select("doc_id", *base, "base_failed", "kept", "anomaly")


@query("op6_partenum_join")
def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_sum_of_squares_packing")
def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packing.pack(written(pieces, "pieces"))


@query("op8_language_centroids")
def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)


@query("op9_markov_secrets")
def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.base_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = secrets.scanned(spans, secrets.fit(spans))
    kinds = [secrets.number("base", kind).alias(f"n_{kind}") for kind, _, _ in secrets.FORMS]
    return found.select(
        "doc_id",
        *kinds,
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


@query("op10_brown_classes")
def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (remainder("doc_id", 5) == 1).alias("held_out")
    return brown.fitted_scores(table(spark, sf_dir, "documents").select("doc_id", "text", held_out), "held_out")


@query("op11_private_spans")
def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op12_merkle_windows", statements.MERKLE)
def op12_merkle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


@query("op13_prefix_free_phrases", statements.PHRASES)
def op13_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
