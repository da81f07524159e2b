"""One query for each operator of this subpackage, over whole tables; (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, kd_means, language_id, learned_partitions, packing, pii, pitman_yor, quality, secret_links, spelling, toxicity, tree_forest
from .common import fold_col

#: Largest numbers of sampled labelled rows that a classifier is fitted on.
LABELLED_ROWS = 6000
PII_ROWS = 4000
ROWS_PER_LANGUAGE = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _held_out(df: DataFrame, parts: int, rest: int) -> DataFrame:
    return df.withColumn("held_out", fold_col(F.col("doc_id"), parts) == rest)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs, PII_ROWS))


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), LABELLED_ROWS)
    out = _held_out(toxicity.tag(docs, model), 3, 1)
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))


def op4_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), LABELLED_ROWS)
    out = _held_out(quality.score(docs, model), 3, 1)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages", "focus")


def op5_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ROWS_PER_LANGUAGE)
    return _held_out(language_id.identify(docs, model), 5, 0).select("doc_id", "held_out", "lang_pred", "score")


def op6_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(pitman_yor.score(table(spark, sf_dir, "documents")), 7, 2)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.detect(table(spark, sf_dir, "documents"))


def op13_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_learned_partitions, op2_pii_skip_chain, op3_toxicity_crf, op4_quality_attention, op5_language_ftrl, op6_tree_forest, op7_jaccard_join, op8_pitman_yor, op9_bpe_transducer, op10_residual_packing, op11_anagram_variants, op12_secret_links, op13_kd_means)}
ORACLE_SQL: dict[str, str] = {"op6_tree_forest": tree_forest.ORACLE_SQL, "op7_jaccard_join": jaccard_join.ORACLE_SQL, "op11_anagram_variants": spelling.ORACLE_SQL, "op13_kd_means": kd_means.oracle_sql()}
